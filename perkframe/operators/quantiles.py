"""Exact linear-interpolated percentiles that scale with the data.

Spark's exact ``percentile`` aggregate keeps a map of every distinct value
and merges it in one final buffer per group: right for bounded domains (ages,
small integer counts), but a column with billions of distinct values (money
amounts, incomes) would have to fit one task.  ``percentiles(method=
"bracket")`` computes the same exact answer in three distributed passes:

1. per group: n, min, max and a bounded-memory sketch (``percentile_approx``)
   evaluated just below and above each target quantile -> a value bracket;
2. per group: how many values fall below / inside each bracket; a bracket
   that misses its target ranks (possible when the sketch is coarse) is
   replaced by the part below or above it, so the answer stays exact;
3. the values inside a bracket are counted per distinct value (combined before
   the shuffle), and a running count over those finds the two order statistics
   around the target position, which are interpolated.

A window group therefore holds the distinct values of one bracket: tied values
are one row however often they occur, and at most about ``4 n / accuracy``
values of the group's n are inside.  Interpolation is ``v_k + (pos-k) *
(v_(k+1) - v_k)`` with ``pos = q (n-1)``, ``k = floor(pos)`` (linear, as pandas
/ SQL ``quantile_cont``; Spark's ``percentile`` rounds the same value in a
different order, so the two agree to the last bit or two).

``method="counts"`` reads its input once: a mergeable count of each (column,
value), combined before the shuffle, holds everything that exact ranks need.
It is the way for columns of a small domain (ages, day counts, amounts in
cents), where the counts are a few rows; several columns share the one pass
(:func:`percentiles_of`).  With ``slabs`` the counts of any domain are ranked
without a window over all of them: values are summed up in slabs of a
logarithmic scale, the slabs that hold a wanted rank are found, and only their
values are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import attach_scalars

DEFAULT_ACCURACY = 100_000

#: Slabs per factor of e of a value (see ``slabs``).
SLABS = 512


def _join(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    # one row per group; AQE broadcasts it when the group count is small
    return df.join(stats, keys, "inner") if keys else attach_scalars(df, stats)


def bracket_counts(rows: DataFrame, keys: Sequence[str], m: int) -> DataFrame:
    """(keys, _c, _v, _w): how often each distinct value occurs in each of the
    ``m`` brackets (``_elo``, ``_ehi``) that its row carries."""
    cand = ", ".join(
        f"CASE WHEN _v >= _elo{i} AND _v <= _ehi{i} THEN named_struct('qi', {i}, "
        f"'below', _eb{i}, 'k', _k{i}, 'pos', _pos{i}) END" for i in range(m))
    return (rows.selectExpr(*[f"`{k}`" for k in keys], "_v",
                            f"explode(filter(array({cand}), c -> c IS NOT NULL)) AS _c")
            .groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("_w")))


def value_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, _c, _v, _w): how often each non-NULL value of the ``_c``-th of
    ``columns`` occurs; one pass, combined before the shuffle."""
    rows = ", ".join(f"named_struct('c', {i}, 'v', CAST(`{c}` AS DOUBLE))" for i, c in enumerate(columns))
    return (df.selectExpr(*[f"`{k}`" for k in keys], f"inline(array({rows})) AS (_c, _v)")
            .filter("_v IS NOT NULL").groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("_w")))


def _struct(j: int, q: float) -> str:
    return f"named_struct('qi', {j}, 'q', {float(q)!r}D)"


def _ranked(counts: DataFrame, keys: Sequence[str], targets: Sequence[Sequence[float]], slabs: bool) -> DataFrame:
    """(keys, _q0, _q1, ...): the ``targets`` quantiles of each counted column;
    NULL elements for a column without values."""
    kq = [f"`{k}`" for k in keys]
    over = f"PARTITION BY {', '.join([*kq, '_c'])}"
    wanted = "CASE _c " + " ".join(
        f"WHEN {i} THEN array({', '.join(_struct(j, q) for j, q in enumerate(qs))})"
        for i, qs in enumerate(targets)) + " END"
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

    def targeted(rows: DataFrame, order: str) -> DataFrame:
        """Rows (of ``_w`` values each, in order) that hold rank k or k + 1 of
        a target, with the number of values before them."""
        return (rows.selectExpr("*", f"sum(_w) OVER ({over}) AS _n",
                                f"sum(_w) OVER ({over} ORDER BY {order} {upto}) - _w AS _before")
                .selectExpr("*", f"explode({wanted}) AS _t")
                .selectExpr("*", "_t.q * (_n - 1) AS _pos", "CAST(floor(_t.q * (_n - 1)) AS BIGINT) AS _k")
                .filter("_before + _w > _k AND _before <= _k + 1"))

    if slabs:
        # in the order of _v; known not to be NULL, so that both uses of the
        # counts have the same plan and share one exchange
        slab = f"coalesce(CAST(sign(_v) * floor(log1p(abs(_v)) * {SLABS}) AS BIGINT), 0L) AS _s"
        cut = counts.selectExpr("*", slab)
        held = targeted(cut.groupBy(*keys, "_c", "_s").agg(F.sum("_w").alias("_w")), "_s").drop("_w", "_n")
        inside = cut.join(held, [*keys, "_c", "_s"])
        rows = (inside.selectExpr("*", f"sum(_w) OVER ({over}, _s, _t ORDER BY _v {upto}) - _w AS _in")
                .withColumn("_before", F.expr("_before + _in")).filter("_before + _w > _k AND _before <= _k + 1"))
    else:
        rows = targeted(counts, "_v")
    aggs, out = [], []
    for i, qs in enumerate(targets):
        values = []
        for j in range(len(qs)):
            at, n = f"_c = {i} AND _t.qi = {j}", f"{i}_{j}"
            aggs += [F.expr(f"max(CASE WHEN {at} AND _before <= _k THEN _v END) AS _a{n}"),
                     F.expr(f"max(CASE WHEN {at} AND _before + _w > _k + 1 THEN _v END) AS _b{n}"),
                     F.expr(f"max(CASE WHEN {at} THEN _pos - _k END) AS _f{n}")]
            values.append(f"CASE WHEN _b{n} IS NULL OR _f{n} = 0 THEN _a{n} "
                          f"ELSE _a{n} + _f{n} * (_b{n} - _a{n}) END")
        out.append(f"array({', '.join(values)}) AS _q{i}")
    return rows.groupBy(*keys).agg(*aggs).selectExpr(*kq, *out)


def percentiles_of(df: DataFrame, targets: dict[str, Sequence[float]], keys: Sequence[str] = (),
                   slabs: bool = True) -> DataFrame:
    """Per group (or one global row): a column ``_q_<name>`` for each column of
    ``targets``, an array of its percentiles, all from one pass over ``df``.

    ``slabs=False`` ranks the counts directly: for columns of a small domain.
    NULLs are skipped; rows with a NULL key are dropped; a column without any
    value has NULL elements.
    """
    base = df
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    found = _ranked(value_counts(base, list(targets), list(keys)), list(keys), list(targets.values()), slabs)
    return found.withColumnsRenamed({f"_q{i}": f"_q_{c}" for i, c in enumerate(targets)})


def percentiles(df: DataFrame, value: str, qs: Sequence[float], keys: Sequence[str] = (),
                method: str = "bracket", accuracy: int = DEFAULT_ACCURACY,
                name: str = "_q", checkpoint_input: bool = False) -> DataFrame:
    """Per group (or one global row): ``name`` = array of the ``qs`` percentiles
    of ``value`` (NULLs skipped; rows with a NULL key are dropped).

    ``method``: ``"bracket"`` exact and scalable, ``"counts"`` exact in one pass
    for columns of a small domain (module doc), ``"approx"``
    ``percentile_approx`` (a sketch).
    ``checkpoint_input``: the bracket method reads its input three times;
    for a derived input (aggregates, joins) checkpoint the (keys, value)
    projection once instead of re-running its upstream each pass.
    """
    keys = list(keys)
    qs = [float(q) for q in qs]
    v = F.col(value).cast("double")
    base = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull())
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    arr = F.array(*[F.lit(q) for q in qs])
    if method == "counts":
        return _ranked(value_counts(base, ["_v"], keys), keys, [qs], False).withColumnRenamed("_q0", name)
    if method == "approx":
        return base.groupBy(*keys).agg(F.percentile_approx("_v", arr, accuracy).alias(name))
    if method != "bracket":
        raise ValueError(f"unknown method {method!r}")
    if checkpoint_input:
        from ..functions import materialize
        base = materialize(base)

    eps = 1.0 / accuracy
    probes = [max(q - 2 * eps, 0.0) for q in qs] + [min(q + 2 * eps, 1.0) for q in qs]
    m = len(qs)
    kq = ", ".join(f"`{k}`" for k in keys)
    kp = kq + ", " if keys else ""
    rng = range(m)
    E = F.expr  # expressions as SQL text: one JVM call each while building

    # pass 1: sizes and sketch brackets
    st = base.groupBy(*keys).agg(
        E("count(_v) AS _n"), E("min(_v) AS _min"), E("max(_v) AS _max"),
        E(f"percentile_approx(_v, array({', '.join(map(repr, probes))}), {accuracy}) AS _ap"))
    st = st.selectExpr(*[f"`{k}`" for k in keys], "_n", "_min", "_max",
                       *[x for i, q in enumerate(qs) for x in (
                           f"{q!r} * (_n - 1) AS _pos{i}",
                           f"CAST(floor({q!r} * (_n - 1)) AS BIGINT) AS _k{i}",
                           f"_ap[{i}] AS _lo{i}", f"_ap[{m + i}] AS _hi{i}")])
    # pass 2: verify each bracket holds ranks k and k+1, else widen it
    carried = ["_n", "_min", "_max"] + [f"_{p}{i}" for i in rng for p in ("pos", "k", "lo", "hi")]
    chk = _join(base, st, keys).groupBy(*keys).agg(
        *[E(f"first({c}) AS {c}") for c in carried],
        *[E(f"count_if(_v < _lo{i}) AS _below{i}") for i in rng],
        *[E(f"count_if(_v <= _hi{i}) AS _upto{i}") for i in rng])
    # a target rank below the bracket moves it to the part below, one above it
    # to the part above (both only where the two ranks lie on either side)
    br = chk.selectExpr(*[f"`{k}`" for k in keys], *[x for i in rng for x in (
        f"CASE WHEN _below{i} <= _k{i} THEN _lo{i} ELSE _min END AS _elo{i}",
        f"CASE WHEN _upto{i} >= least(_k{i} + 2, _n) THEN _hi{i} ELSE _max END AS _ehi{i}",
        f"CASE WHEN _below{i} <= _k{i} THEN _below{i} ELSE 0 END AS _eb{i}", f"_k{i}", f"_pos{i}")])
    # pass 3: count the distinct values inside a bracket, then rank those
    inside = bracket_counts(_join(base, br, keys), keys, m)
    ranked = inside.selectExpr(
        "*", f"_c.below + sum(_w) OVER (PARTITION BY {kp}_c.qi ORDER BY _v "
             "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _upto_v"
    ).filter("_upto_v > _c.k AND _upto_v - _w <= _c.k + 1")
    aggs = []
    for i in rng:
        # ranks upto - w .. upto - 1 (from 0) hold this value
        aggs += [E(f"max(CASE WHEN _c.qi = {i} AND _upto_v - _w <= _c.k THEN _v END) AS _a{i}"),
                 E(f"max(CASE WHEN _c.qi = {i} AND _upto_v > _c.k + 1 THEN _v END) AS _b{i}"),
                 E(f"max(CASE WHEN _c.qi = {i} THEN _c.pos END) AS _p{i}"),
                 E(f"max(CASE WHEN _c.qi = {i} THEN _c.k END) AS _kk{i}")]
    fin = ranked.groupBy(*keys).agg(*aggs)
    vals = ", ".join(f"CASE WHEN _b{i} IS NULL OR _p{i} = _kk{i} THEN _a{i} "
                     f"ELSE _a{i} + (_p{i} - _kk{i}) * (_b{i} - _a{i}) END" for i in rng)
    return fin.selectExpr(*[f"`{k}`" for k in keys], f"array({vals}) AS `{name}`")
