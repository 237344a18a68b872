"""Projections, filters and predicates.

Filters with literal bounds are plain Catalyst predicates, so they reach the
Parquet scan as ``PushedFilters``; bounds derived from the data (C6, C8) are
one-row aggregates attached with a broadcast of the one-row side.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lit_ts(v) -> Column:
    if isinstance(v, Column):
        return v.cast("timestamp_ntz")
    if isinstance(v, dt.datetime):
        return F.lit(v).cast("timestamp_ntz")
    if isinstance(v, dt.date):
        # pd.to_datetime(date) is that day's midnight
        return F.lit(dt.datetime(v.year, v.month, v.day)).cast("timestamp_ntz")
    return F.lit(v).cast("timestamp_ntz")


def _lit_date(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("date")


def _with_range(df: DataFrame, rng, to_col) -> tuple[DataFrame, Column, Column, list[str]]:
    """Bounds given as a (lo, hi) pair of literals / Columns, or as a one-row
    frame of two columns (data-derived, from C8 / C10) attached by broadcast."""
    if isinstance(rng, DataFrame):
        from ..functions import attach_scalars
        a, b = rng.columns[:2]
        # one row whatever the caller passes: the widest range
        rng = rng.agg(F.min(a).alias(a), F.max(b).alias(b))
        lo_name, hi_name = f"_lo_{id(rng)}", f"_hi_{id(rng)}"
        df = attach_scalars(df, rng.select(F.col(a).alias(lo_name), F.col(b).alias(hi_name)))
        return df, to_col(F.col(lo_name)), to_col(F.col(hi_name)), [lo_name, hi_name]
    lo, hi = rng
    return df, to_col(lo), to_col(hi), []


def _pruned(df: DataFrame, lo, hi) -> DataFrame:
    """Where the table is partitioned by ``event_date``, say which dates a
    literal range can hold, so that other folders aren't read."""
    if "event_date" not in df.columns or lo is None or hi is None \
            or not all(isinstance(x, (dt.date, str)) for x in (lo, hi)):
        return df
    return df.filter(F.col("event_date").between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))))


def filter_offer_types(df: DataFrame, offer_types: Sequence[str], c: str = "offer_type"
                       ) -> DataFrame:
    """Membership; an empty list keeps no row."""
    if not offer_types:
        return df.filter(F.lit(False))
    return df.filter(F.col(c).isin(list(offer_types)))


def filter_amount(df: DataFrame, min_amount, max_amount=None, c: str = "amount") -> DataFrame:
    """Closed interval; NULL amounts are dropped.  ``min_amount`` may be a
    one-row (lo, hi) frame from :func:`column_bounds`."""
    rng = min_amount if isinstance(min_amount, DataFrame) else (min_amount, max_amount)
    df, lo, hi, tmp = _with_range(df, rng, lambda x: x if isinstance(x, Column) else F.lit(x))
    return df.filter(F.col(c).between(lo, hi)).drop(*tmp)


def filter_dates_amount(df: DataFrame, dates, amounts, time_col: str = "time",
                        amount_col: str = "amount") -> DataFrame:
    """Calendar date of ``time`` in [start, end] (end day included) and
    amount in [min, max].  Each range is a (lo, hi) pair or a one-row frame
    (C8 / C10).  With literal dates Catalyst turns the date test into a
    timestamp range pushed to the scan."""
    if not isinstance(dates, DataFrame):
        df = _pruned(df, *dates)
    df, d0, d1, t1 = _with_range(df, dates, _lit_date)
    df, a0, a1, t2 = _with_range(df, amounts, lambda x: x if isinstance(x, Column) else F.lit(x))
    return (df.filter(F.to_date(F.col(time_col)).between(d0, d1)
                      & F.col(amount_col).between(a0, a1)).drop(*t1, *t2))


def filter_window_types(df: DataFrame, time_range=None, offer_types=None,
                        time_col: str = "time", type_col: str = "offer_type") -> DataFrame:
    """C4: timestamp in [start, end] where a date bound means its midnight, so
    the last day is cut at 00:00 (Q4); falsy arguments mean no filter.
    ``time_range`` is a (start, end) pair or a one-row frame (C8)."""
    if isinstance(time_range, DataFrame) or time_range:
        if not isinstance(time_range, DataFrame) and time_col == "time":
            df = _pruned(df, *time_range)
        df, t0, t1, tmp = _with_range(df, time_range, _lit_ts)
        df = df.filter((F.col(time_col) >= t0) & (F.col(time_col) <= t1)).drop(*tmp)
    if offer_types:
        df = df.filter(F.col(type_col).isin(list(offer_types)))
    return df


def filter_window_types_segments(df: DataFrame, time_range, offer_types=None,
                                 customer_segments=None, time_col: str = "time",
                                 type_col: str = "offer_type",
                                 segment_col: str = "cluster") -> DataFrame:
    """C4 with a mandatory range plus cluster membership."""
    if not isinstance(time_range, DataFrame) and time_col == "time":
        df = _pruned(df, *time_range)
    df, t0, t1, tmp = _with_range(df, time_range, _lit_ts)
    df = df.filter((F.col(time_col) >= t0) & (F.col(time_col) <= t1)).drop(*tmp)
    if offer_types:
        df = df.filter(F.col(type_col).isin(list(offer_types)))
    if customer_segments:
        df = df.filter(F.col(segment_col).isin(list(customer_segments)))
    return df


def iqr_fences(df: DataFrame, c: str = "age", k: float = 1.5, method: str | None = None) -> DataFrame:
    """One row (lo, hi) = Q1 - k*IQR and Q3 + k*IQR of ``c``; quantiles are
    linear over the rows (NULLs skipped).  ``method`` as in
    ``operators.quantiles.percentiles``; ages are counted, one pass."""
    from .quantiles import percentiles
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    method = method or ("counts" if c == "age" else "bracket")
    return percentiles(df, c, [0.25, 0.75], method=method).select(
        (q1 - F.lit(k) * (q3 - q1)).alias("lo"), (q3 + F.lit(k) * (q3 - q1)).alias("hi"))


def iqr_filter(df: DataFrame, c: str = "age", k: float = 1.5,
               stats_from: DataFrame | None = None, fences: tuple | None = None) -> DataFrame:
    """Keep rows with ``c`` inside its fences (see :func:`iqr_fences`);
    rows with a NULL value are dropped.  No-op without ``c``.

    ``stats_from``: a frame with the same rows and ``c`` values to take the
    fences from (lets a pipeline compute them before unrelated joins).
    ``fences``: (lo, hi) known already, e.g. ``bounds_of(iqr_fences(df))``; as
    literals they are pushed into the scan.
    """
    if c not in df.columns:
        return df
    rng = iqr_fences(df if stats_from is None else stats_from, c, k) if fences is None else fences
    if fences is not None and None in fences:
        return df.filter(F.lit(False))  # no values, so no row is inside
    df, lo, hi, tmp = _with_range(df, rng, lambda x: x if isinstance(x, Column) else F.lit(x))
    return df.filter(F.col(c).between(lo, hi)).drop(*tmp)


def campaign_window(df: DataFrame, first_day: int, last_day: int, time_col: str = "time"
                    ) -> DataFrame:
    """1-based day range -> one row (start_date, end_date) counted from the
    table's first calendar day; pass it as the range of C3 / C4 / C5."""
    return df.agg(F.to_date(F.min(time_col)).alias("_d0")).select(
        F.date_add("_d0", first_day - 1).alias("start_date"),
        F.date_add("_d0", last_day - 1).alias("end_date"))


def bounds_of(window: DataFrame) -> tuple:
    """The two values of a one-row range frame (C8 / C10) as literals.

    Two scalars, not data: with literal bounds the range filter is pushed
    into the Parquet scan (row-group skipping, partition pruning on a
    date-partitioned table) and the filtered plan no longer carries the
    statistic's subtree."""
    row = window.first()
    return row[0], row[1]


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """Distinct values of ``c`` (NULL included, as ``unique()``)."""
    return df.select(c).distinct()


def column_bounds(df: DataFrame, c: str = "amount") -> DataFrame:
    """Default slider range as one row (lo = 0, hi = floor(max(c))); the
    tail above ``hi`` is dropped by a filter using it (Q5)."""
    return df.agg(F.lit(0).cast("bigint").alias("lo"), F.floor(F.max(c)).alias("hi"))


def segment_slice(df: DataFrame, cluster: int, c: str = "cluster") -> DataFrame:
    """C11."""
    return df.filter(F.col(c) == F.lit(cluster))


def is_empty(df: DataFrame) -> bool:
    """Short-circuit guard (reads at most one row)."""
    return df.isEmpty()


def rfm_points(rfm: DataFrame) -> DataFrame:
    """C14: per-customer points for the RFM scatter."""
    return rfm.select("customer_id", "recency", "frequency", "monetary", "cluster")


def basket_points(basket: DataFrame) -> DataFrame:
    """Per-customer points for the basket scatter."""
    return basket.select("customer_id", "transaction_count", "avg_basket_size", "cluster")


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """C16."""
    return df.withColumnsRenamed(mapping)


def select_if_present(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """C17: project ``cols`` when ``key`` is a column, else keep every column."""
    if key in df.columns:
        return df.select(*cols)
    return df
