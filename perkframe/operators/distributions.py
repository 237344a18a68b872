"""Distributions: describe, age-group counts and shares, histogram, box
statistics, density estimate, unpivot (E19, E22, E23, E28-E30, E32).

Chart-side transforms of the reference (bins, box plots, density) are
computed here as aggregates with their parameters explicit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import attach_scalars, materialize, right_closed_bins

# Age bins (right-closed) and their labels.
AGE_EDGES = [0, 30, 45, 60, 100]
AGE_LABELS = ["18-30", "31-45", "46-60", "60+"]

#: Bins that a grid step of a binned density has.
BINS_PER_STEP = 16

DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe_column(df: DataFrame, c: str, method: str = "bracket") -> DataFrame:
    """Count, mean, std (n-1), min, quartiles (linear, exact), max of ``c``
    in long form (statistic, value); NULLs skipped.

    ``method`` as in ``operators.quantiles.percentiles``; ``"counts"`` for a
    column of a small domain, such as ages."""
    x = F.col(c).cast("double")
    moments = [F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"),
               F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    from .quantiles import percentiles
    qs = percentiles(df, c, [0.25, 0.5, 0.75], method=method)
    wide = attach_scalars(df.agg(*moments), qs).select(
        *DESCRIBE_STATS[:4], F.col("_q")[0].alias("25%"), F.col("_q")[1].alias("50%"),
        F.col("_q")[2].alias("75%"), "max")
    return wide.unpivot([], DESCRIBE_STATS, "statistic", "value")


def with_age_group(df: DataFrame, c: str = "age", name: str = "age_group") -> DataFrame:
    """Right-closed age bins; ages outside (0, 100] get NULL."""
    return df.withColumn(name, right_closed_bins(c, AGE_EDGES, AGE_LABELS))


def age_group_counts(df: DataFrame, type_col: str = "offer_type", c: str = "age") -> DataFrame:
    """Rows per (age_group, offer_type) with zero for unobserved pairs.

    The full grid is every age label times every non-null offer type of the
    input (pandas groups a categorical by all its categories); it has
    4 x (distinct types) rows, built by exploding the label list on the
    distinct-type aggregate rather than a join.
    """
    g = with_age_group(df, c)
    counts = (g.filter(F.col("age_group").isNotNull() & F.col(type_col).isNotNull())
              .groupBy("age_group", type_col).agg(F.count(F.lit(1)).alias("count")))
    grid = (df.filter(F.col(type_col).isNotNull()).select(type_col).distinct()
            .withColumn("age_group", F.explode(F.array(*[F.lit(a) for a in AGE_LABELS]))))
    return (grid.join(counts, ["age_group", type_col], "left")
            .select("age_group", type_col, F.coalesce("count", F.lit(0)).alias("count")))


def age_group_share(df: DataFrame, type_col: str = "offer_type", c: str = "age") -> DataFrame:
    """E23 + G3: count / age-group total; an empty group gives NULL (NaN).

    The window runs on the small count table (labels x types)."""
    counts = age_group_counts(df, type_col, c)
    total = F.sum("count").over(Window.partitionBy("age_group"))
    return counts.withColumn("percentage", F.try_divide(F.col("count").cast("double"), total))


def histogram(df: DataFrame, c: str, maxbins: int = 20, checkpoint_input: bool = True
              ) -> DataFrame:
    """Equal-width bins with a "nice" step, count per bin.

    step = the smallest of {1, 2, 5} x 10^n with (max - min) / step <= maxbins;
    bin_start = floor(x / step) * step.  min / max are a one-row aggregate
    attached to the values; the input is read twice, so a derived input is
    checkpointed once (``checkpoint_input``).
    """
    x = F.col(c).cast("double")
    if checkpoint_input:
        df = materialize(df.select(x.alias(c)))
        x = F.col(c)
    stats = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("_st"))
    st = F.col("_st")
    span = (st["hi"] - st["lo"]) / F.lit(float(maxbins))
    base = F.pow(F.lit(10.0), F.floor(F.log10(span)))
    m = span / base
    step = F.when(span <= 0, F.lit(1.0)).otherwise(
        base * F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 5, 5.0).otherwise(10.0))
    b = attach_scalars(df.filter(x.isNotNull()).select(x.alias("_x")), stats).select(
        "_x", step.alias("step"))
    start = F.floor(F.col("_x") / F.col("step")) * F.col("step")
    return (b.groupBy(start.alias("bin_start"), F.col("step"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select("bin_start", (F.col("bin_start") + F.col("step")).alias("bin_end"), "count"))


def box_stats(df: DataFrame, value: str, group: Sequence[str] | str = (), k: float = 1.5,
              method: str = "bracket", checkpoint_input: bool = True) -> DataFrame:
    """Per group q1, median, q3 (exact, linear), whiskers = most extreme
    values inside the 1.5*IQR fences, number of outliers.

    Quartiles per group come from the scalable exact method (no task holds
    a whole group); they are joined back (one row per group, so AQE
    broadcasts them when small) for the filtered min / max / count.  The
    (group, value) projection is read four times, so a derived input is
    checkpointed once (``checkpoint_input``).
    """
    from .quantiles import percentiles
    keys = [group] if isinstance(group, str) else list(group)
    x = F.col(value).cast("double")
    base = df.filter(x.isNotNull())
    for g in keys:
        base = base.filter(F.col(g).isNotNull())
    base = base.select(*keys, x.alias("_v"))
    if checkpoint_input:
        base = materialize(base)
    qs = percentiles(base, "_v", [0.25, 0.5, 0.75], keys, method=method)
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    lo, hi = q1 - F.lit(k) * (q3 - q1), q3 + F.lit(k) * (q3 - q1)
    inside = (F.col("_v") >= lo) & (F.col("_v") <= hi)
    joined = base.join(qs, keys, "inner") if keys else attach_scalars(base, qs)
    return (joined.groupBy(*keys, "_q")
            .agg(F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
                 F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
                 F.count_if(~inside).alias("outliers"))
            .select(*keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                    F.col("_q")[2].alias("q3"), "whisker_low", "whisker_high", "outliers"))


def density_estimate(df: DataFrame, c: str, steps: int = 100,
                     bandwidth: float | None = None, checkpoint_input: bool = True,
                     binned: bool = False, method: str = "bracket") -> DataFrame:
    """Gaussian kernel density over [min, max] at ``steps`` points.

    Rows are first reduced to (value, weight) pairs, with values rounded to the
    grid's step / ``BINS_PER_STEP`` where ``binned`` (a column of many distinct
    values); each is then spread over the fixed grid with ``explode(sequence)``
    (no join) and summed per grid point.  Default bandwidth is
    1.06 * min(std, IQR / 1.34) * n^(-1/5).  The input is read twice, so a
    derived input is checkpointed once as its one column (``checkpoint_input``).
    """
    x = F.col(c).cast("double")
    if checkpoint_input:
        df = materialize(df.select(x.alias(c)))
        x = F.col(c)
    from .quantiles import percentiles
    moments = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"),
                     F.stddev_samp(x).alias("sd"))
    stats = attach_scalars(moments, percentiles(df, c, [0.25, 0.75], method=method)).select(
        F.struct("lo", "hi", "n", "sd", F.col("_q").alias("q")).alias("_st"))
    st = F.col("_st")
    if bandwidth is None:
        iqr = (st["q"][1] - st["q"][0]) / F.lit(1.34)
        spread = F.when(iqr > 0, F.least(st["sd"], iqr)).otherwise(st["sd"])
        h = F.lit(1.06) * spread * F.pow(st["n"].cast("double"), F.lit(-0.2))
    else:
        h = F.lit(float(bandwidth))
    grid = st["lo"] + (st["hi"] - st["lo"]) * F.col("_i") / F.lit(float(max(steps - 1, 1)))
    if binned:
        width = (F.col("hi") - F.col("lo")) / F.lit(float(BINS_PER_STEP * max(steps - 1, 1)))
        at = F.when(width > 0, F.col("lo") + F.round((x - F.col("lo")) / width) * width).otherwise(x)
        values = attach_scalars(df.filter(x.isNotNull()), moments.select("lo", "hi")).groupBy(at.alias("_a"))
    else:
        values = df.filter(x.isNotNull()).groupBy(x.alias("_a"))
    pts = (attach_scalars(values.agg(F.count(F.lit(1)).alias("_w")), stats)
           .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
           .select("_a", "_w", "_i", grid.alias("_g"), h.alias("_h"),
                   (st["n"].cast("double") * h * F.lit(math.sqrt(2 * math.pi))).alias("_norm")))
    kern = F.col("_w") * F.exp(F.lit(-0.5) * F.pow((F.col("_g") - F.col("_a")) / F.col("_h"),
                                                   F.lit(2.0)))
    return (pts.groupBy("_i", "_g", "_norm").agg(F.sum(kern).alias("_s"))
            .select(F.col("_g").alias(c), (F.col("_s") / F.col("_norm")).alias("density")))


def unpivot_metrics(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                    var_name: str = "metric", value_name: str = "value") -> DataFrame:
    """Wide -> long (``melt``)."""
    return df.unpivot(list(ids), list(values), var_name, value_name)
