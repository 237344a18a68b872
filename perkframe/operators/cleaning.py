"""Cleaning pipeline B1-B11: raw offers / customers / events -> event tables.

Statistics (medians, IQR fences, percentiles) are one-row global aggregates
(map-side partial aggregation, one row out) attached to the rows with
``attach_scalars`` (broadcast of the one-row side); the large side is never
shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import attach_scalars, parse_dict, parse_list


def _stats(df: DataFrame, c: str, qs: list[float], approx: bool, name: str, domain: str = "large") -> DataFrame:
    """One-row frame ``name`` = exact or sketched quantiles of ``c``; a column
    of a ``small`` domain takes one pass."""
    from .quantiles import percentiles
    method = "approx" if approx else "counts" if domain == "small" else "bracket"
    return percentiles(df, c, qs, method=method, name=name)


def _clip(x, lo, hi):
    """Clip to [lo, hi]; NULL stays NULL (``greatest``/``least`` skip NULLs)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def parse_member_date(df: DataFrame, c: str = "became_member_on") -> DataFrame:
    """B1: yyyymmdd (INT or STRING) -> DATE; malformed values -> NULL."""
    return df.withColumn(c, F.try_to_date(F.col(c).cast("string"), "yyyyMMdd"))


def fill_missing(df: DataFrame, values: dict | None = None) -> DataFrame:
    """B2: fill NULLs per column (default gender -> 'Unknown')."""
    return df.fillna(values or {"gender": "Unknown"})


def _above_to(c: str, limit: float, median):
    return F.when(F.col(c) > F.lit(limit), median).otherwise(F.col(c).cast("double"))


def replace_above_with_median(df: DataFrame, c: str = "age", limit: float = 100,
                              approx: bool = False, domain: str = "small") -> DataFrame:
    """Values above ``limit`` become the median of the column (non-null
    values).  Ages have a small domain; for others pass ``domain="large"``."""
    st = _stats(df, c, [0.5], approx, "_median", domain)
    return attach_scalars(df, st).withColumn(c, _above_to(c, limit, F.col("_median")[0])).drop("_median")


def _clip_and_fill(c: str, q, k: float):
    q1, med, q3 = q[0], q[1], q[2]
    lo, hi = q1 - F.lit(k) * (q3 - q1), q3 + F.lit(k) * (q3 - q1)
    return F.when(F.col(c).isNull(), med).otherwise(_clip(F.col(c), lo, hi))


def iqr_clip_fill_median(df: DataFrame, c: str = "income", k: float = 1.5,
                         approx: bool = False) -> DataFrame:
    """Clip to the 1.5*IQR fences, then fill NULLs with the raw median."""
    st = _stats(df, c, [0.25, 0.5, 0.75], approx, "_q")
    return attach_scalars(df, st).withColumn(c, _clip_and_fill(c, F.col("_q"), k)).drop("_q")


def clean_customers(df: DataFrame, approx: bool = False) -> DataFrame:
    """Date, gender, age cap, income clip/fill.  The statistics of age
    and income come from one pass over the customers."""
    if approx:
        out = iqr_clip_fill_median(replace_above_with_median(df, approx=True), approx=True)
    else:
        from .quantiles import percentiles_of
        st = percentiles_of(df, {"age": [0.5], "income": [0.25, 0.5, 0.75]})
        out = (attach_scalars(df, st).withColumn("age", _above_to("age", 100, F.col("_q_age")[0]))
               .withColumn("income", _clip_and_fill("income", F.col("_q_income"), 1.5))
               .drop("_q_age", "_q_income"))
    return fill_missing(parse_member_date(out))


def parse_value(df: DataFrame, c: str = "value") -> DataFrame:
    """Dict literal text -> STRUCT<amount, offer_id, reward> in ``c``."""
    return df.withColumn(c, parse_dict(c, "amount DOUBLE, offer_id STRING, "
                                          "`offer id` STRING, reward INT"))


def extract_value_fields(df: DataFrame, c: str = "value",
                         fields: tuple[str, ...] = ("offer_id", "amount")) -> DataFrame:
    """Top-level columns from the parsed struct (``offer id`` accepted too).

    A field may be given as ``name=column``, e.g. ``reward=event_reward``: the
    offer table has a ``reward`` of its own."""
    cols = {}
    for field in fields:
        f, _, name = field.partition("=")
        name = name or f
        if f == "offer_id":
            cols[name] = F.coalesce(F.col(f"{c}.offer_id"), F.col(f"{c}.`offer id`"))
        else:
            cols[name] = F.col(f"{c}.{f}")
    return df.withColumns(cols)


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """B7."""
    return df.drop(*cols)


def clean_events(df: DataFrame) -> DataFrame:
    """Parse the value dictionary, extract offer_id, amount and the
    reward that the event paid (``event_reward``), drop it."""
    fields = ("offer_id", "amount", "reward=event_reward")
    return drop_columns(extract_value_fields(parse_value(df), fields=fields), "value")


def clean_offers(df: DataFrame, c: str = "channels") -> DataFrame:
    """Channels list text -> ARRAY<STRING>."""
    return df.withColumn(c, parse_list(c))


def denormalise(events: DataFrame, customers: DataFrame, offers: DataFrame,
                customer_key: str = "customer_id", offer_key: str = "offer_id") -> DataFrame:
    """Events LEFT JOIN customers LEFT JOIN offers.

    No broadcast hint: the customer dimension grows with the data.  AQE turns
    either join into a broadcast join when the side's runtime size is under
    the threshold (the offer dimension usually is), and splits skewed
    partitions when one customer owns a large share of the events.
    """
    return events.join(customers, customer_key, "left").join(offers, offer_key, "left")


def winsorize(df: DataFrame, c: str = "amount", lower: float = 0.01, upper: float = 0.99,
              approx: bool = False, stats_from: DataFrame | None = None, one_pass: bool = False) -> DataFrame:
    """Clip ``c`` to its [lower, upper] percentiles (NULL stays NULL);
    ``stats_from``: the frame to take them from, if not ``df`` itself.
    ``one_pass``: read that frame once, by value counts (it is derived, so
    three passes would derive it three times)."""
    src = df if stats_from is None else stats_from
    if one_pass and not approx:
        from .quantiles import percentiles_of
        st = percentiles_of(src, {c: [lower, upper]}).withColumnRenamed(f"_q_{c}", "_p")
    else:
        st = _stats(src, c, [lower, upper], approx, "_p")
    return (attach_scalars(df, st)
            .withColumn(c, _clip(F.col(c), F.col("_p")[0], F.col("_p")[1])).drop("_p"))
