"""Offer-level operators: success flag, segment attach, success rates,
channel and funnel aggregates, redemption time.

Group keys are filtered for NULL first (pandas drops NaN group keys, Spark
keeps them).  Rates are ``avg(cast(flag as int))``; ratios use ``try_divide``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bool_mean, micros_between


def with_offer_success(df: DataFrame, offer_key: str = "offer_id", time_col: str = "time",
                       event_col: str = "event", duration_col: str = "duration",
                       completed: str = "offer completed", anchor: str = "offer",
                       customer_key: str = "customer_id", order_col: str = "event_id",
                       received: str = "offer received") -> DataFrame:
    """C7 + G1: ``offer_success`` = completed within ``duration`` days of the
    offer's first row (over every row of the frame; Q1).

    ``anchor="customer"``: of the customer's own latest receive of the offer
    instead (see :func:`_first_completions`).

    The first time per offer is a group-by (one row per offer, combined
    map-side), joined back; AQE broadcasts it when it is small, so a hot offer
    holding a third of the rows never lands in one task.  A missing time,
    first time or duration makes the flag false, not NULL.
    """
    if anchor == "customer":
        wins = _first_completions(df, customer_key, offer_key, time_col, event_col, order_col, completed, received)
        names = {c: f"_w_{c}" for c in (customer_key, offer_key, order_col)}
        joined = df.join(wins.withColumnsRenamed(names), [F.col(c) == F.col(n) for c, n in names.items()], "left")
        ok = (F.col(event_col) == F.lit(completed)) & (
            F.col(time_col) <= F.timestamp_add("DAY", F.col(duration_col), F.col("_received")))
        return (joined.withColumn("offer_success", F.coalesce(ok, F.lit(False)))
                .drop("_received", *names.values()))
    if anchor != "offer":
        raise ValueError(f"unknown anchor {anchor!r}")
    first = (df.filter(F.col(offer_key).isNotNull())
             .groupBy(offer_key).agg(F.min(time_col).alias("_first_time")))
    ok = (F.col(event_col) == F.lit(completed)) & (
        F.col(time_col) <= F.timestamp_add("DAY", F.col(duration_col), F.col("_first_time")))
    return (df.join(first, offer_key, "left")
            .withColumn("offer_success", F.coalesce(ok, F.lit(False)))
            .drop("_first_time"))


def _first_completions(df: DataFrame, customer_key: str, offer_key: str, time_col: str, event_col: str,
                       order_col: str, completed: str, received: str) -> DataFrame:
    """(customer, offer, order, _received): the completion that uses up each
    receive, and the receive's time.

    A receive counts until the customer's next receive of the same offer, from
    its own time on; the first completion (by time, then ``order_col``, which is
    unique) uses it up, so a later one has none.  Windows hold one row per
    (customer, offer, time): rows are combined before the shuffle, so a hot
    pair costs its distinct times, not its rows.
    """
    pair = [customer_key, offer_key]
    at = (df.filter(F.col(event_col).isin(completed, received))
          .dropna(subset=[*pair, time_col]).groupBy(*pair, time_col)
          .agg(F.max(F.when(F.col(event_col) == received, F.col(time_col))).alias("_here"),
               F.min(F.when(F.col(event_col) == completed, F.col(order_col))).alias("_done")))
    so_far = Window.partitionBy(*pair).orderBy(time_col).rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(*pair, "_received")
    return (at.withColumn("_received", F.max("_here").over(so_far))
            .withColumn("_first", F.min(F.when(F.col("_done").isNotNull(), F.col(time_col))).over(since))
            .filter(F.col("_received").isNotNull() & F.col("_done").isNotNull() & (F.col(time_col) == F.col("_first")))
            .select(*pair, F.col("_done").alias(order_col), "_received"))


def attach_segment(offers: DataFrame, rfm: DataFrame, key: str = "customer_id") -> DataFrame:
    """LEFT JOIN to the customer's cluster; unmatched -> -1 (INT)."""
    seg = rfm.select(key, F.col("cluster").alias("_cluster"))
    return (offers.join(seg, key, "left")
            .withColumn("cluster", F.coalesce(F.col("_cluster"), F.lit(-1)).cast("int"))
            .drop("_cluster"))


def _rate_by(df: DataFrame, keys: Sequence[str], name: str = "success_rate",
             flag: str = "offer_success") -> DataFrame:
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    return df.filter(cond).groupBy(*keys).agg(bool_mean(flag).alias(name))


def offer_performance(df: DataFrame) -> DataFrame:
    """Per (offer_type, cluster): conversion_rate and total_offers."""
    return (df.filter(F.col("offer_type").isNotNull() & F.col("cluster").isNotNull())
            .groupBy("offer_type", "cluster")
            .agg(bool_mean("offer_success").alias("conversion_rate"),
                 F.count("offer_success").alias("total_offers")))


def channel_success_rate(df: DataFrame, c: str = "channels") -> DataFrame:
    """Explode channels, mean success per channel -> (channel, success_rate)."""
    from ..plans import explode_channels
    return _rate_by(explode_channels(df, c).withColumnRenamed(c, "channel"), ["channel"])


def roi_by_offer_type(df: DataFrame) -> DataFrame:
    """(sum reward - sum difficulty) / sum difficulty per type; 0/0 -> NULL."""
    return (df.filter(F.col("offer_type").isNotNull()).groupBy("offer_type")
            .agg(F.sum("reward").alias("_r"), F.sum("difficulty").alias("_d"))
            .select("offer_type", F.try_divide(F.col("_r") - F.col("_d"), F.col("_d"))
                    .cast("double").alias("roi")))


def success_by_offer_type(df: DataFrame) -> DataFrame:
    """Mean success per offer type."""
    return _rate_by(df, ["offer_type"])


def success_by_segment(df: DataFrame) -> DataFrame:
    """Mean success per cluster (input already carries ``cluster``, -1 included)."""
    return _rate_by(df, ["cluster"])


def success_by_channel(df: DataFrame, c: str = "channels") -> DataFrame:
    """Mean success per channel of an already exploded frame."""
    return _rate_by(df, [c])


def top_group(rates: DataFrame, key: str, rate: str = "success_rate") -> DataFrame:
    """H2: the group with the highest rate; ties go to the smallest key.

    A single ``min_by`` aggregate, i.e. one pass with map-side combine (no
    sort of the groups).
    """
    return rates.filter(F.col(rate).isNotNull()).agg(
        F.min_by(F.col(key), F.struct(-F.col(rate), F.col(key))).alias(key),
        F.max(rate).alias(rate),
    )


def offer_insights(offers: DataFrame, transactions: DataFrame, rfm: DataFrame,
                   channel_col: str = "channels") -> DataFrame:
    """One row of headline metrics for the offer page.

    ``offers`` is the (channel-exploded, Q3) offer frame, ``rfm`` the segmented
    customers.  The three best-group lookups and the offer-level totals are
    computed by one grouping-sets aggregate over the offers (one scan, one
    small shuffle); distinct customers and the transaction totals are two more
    one-row aggregates attached to it (``customers.one_row``).
    """
    o = attach_segment(offers, rfm)
    flag = F.col("offer_success").cast("int")
    gs = (o.groupingSets([["offer_type"], ["cluster"], [channel_col], []],
                         "offer_type", "cluster", channel_col)
          .agg(F.avg(flag).alias("rate"), F.count(F.lit(1)).alias("n"),
               F.grouping_id().alias("gid")))
    gid, rate = F.col("gid"), F.col("rate")

    def best(bit: int, key: str, name: str):
        # grouping_id bits follow (offer_type, cluster, channel); NULL
        # orderings are ignored by min_by, so each pick sees only its set
        sel = (gid == bit) & F.col(key).isNotNull() & rate.isNotNull()
        return [F.min_by(F.col(key), F.when(sel, F.struct(-rate, F.col(key)))).alias(name),
                F.max(F.when(sel, rate)).alias(f"{name}_rate")]

    top = gs.agg(*best(3, "offer_type", "top_offer_type"), *best(5, "cluster", "top_segment"),
                 *best(6, channel_col, "top_channel"),
                 # grouping sets emit no grand-total row for an empty input
                 F.coalesce(F.max(F.when(gid == 7, F.col("n"))), F.lit(0)).alias("total_offers"),
                 F.max(F.when(gid == 7, rate)).alias("offer_completion_rate"))
    cust = offers.agg(F.count_distinct("customer_id").alias("total_customers_impacted"))
    txn = transactions.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_revenue"),
                           F.avg("amount").alias("avg_transaction_value"))
    from .customers import one_row
    return one_row(top, txn, cust)


def completion_by_channel(df: DataFrame, c: str = "channels") -> DataFrame:
    """Explode; per (channel, offer_success) the non-null count of offer_id."""
    from ..plans import explode_channels
    e = explode_channels(df, c)
    return (e.filter(F.col(c).isNotNull()).groupBy(c, "offer_success")
            .agg(F.count("offer_id").alias("offer_count")))


def channel_success_by_hour(df: DataFrame, c: str = "channels") -> DataFrame:
    """Explode; mean success per (hour of day, channel).  The caller's
    ``time`` is left alone (Q7); the hour goes to column ``hour``."""
    from ..plans import explode_channels
    e = explode_channels(df, c).withColumn("hour", F.hour("time"))
    return _rate_by(e, ["hour", c])


def success_over_time(df: DataFrame) -> DataFrame:
    """Mean success per (time, offer_type)."""
    return _rate_by(df, ["time", "offer_type"])


def offer_funnel(df: DataFrame, event_col: str = "event") -> DataFrame:
    """E25 + G4 + H3: rows per event, largest first, with the share of the first
    (largest) stage.  The window runs on the <= 4-row aggregate only."""
    counts = df.filter(F.col(event_col).isNotNull()).groupBy(event_col).agg(
        F.count(F.lit(1)).alias("count"))
    w = Window.orderBy(F.col("count").desc(), F.col(event_col))
    return (counts.withColumn("percent_initial",
                              F.col("count") / F.first("count").over(w))
            .orderBy(F.col("count").desc(), F.col(event_col)))


def pivot_performance(perf: DataFrame, clusters: Sequence[int] | None = None) -> DataFrame:
    """offer_type rows x cluster columns of conversion_rate.

    ``clusters`` left out: every cluster that occurs gets a column (a distinct
    of the model's few cluster ids, one small job).  Given, they are the
    columns, so the plan stays lazy; a cluster outside them would be lost and
    is an error when the result is computed.  Columns are named
    ``cluster_<k>`` (``m1`` for -1).
    """
    if clusters is None:
        clusters = [r[0] for r in perf.select("cluster").distinct().orderBy("cluster").collect()]
    else:
        listed = F.col("cluster").isin(list(clusters))
        perf = perf.withColumn("cluster", F.when(listed, F.col("cluster")).otherwise(
            F.raise_error(F.concat(F.lit("no column for cluster "), F.col("cluster").cast("string"))).cast("int")))
    p = (perf.groupBy("offer_type").pivot("cluster", list(clusters))
         .agg(F.first("conversion_rate")))
    return p.withColumnsRenamed({str(k): f"cluster_{'m' + str(-k) if k < 0 else k}"
                                 for k in clusters})


RECEIVED = "offer received"


def time_to_redemption(df: DataFrame, customer_key: str = "customer_id",
                       offer_key: str = "offer_id", time_col: str = "time",
                       order_col: str = "event_id", completed: str = "offer completed",
                       received: str = RECEIVED) -> DataFrame:
    """Per completed row, days since the same customer's latest earlier
    receive of the same offer (NULL when there is none).  Order is
    (time, event_id).

    No window holds rows: receives are aggregated per (customer, offer, time)
    with their smallest event_id (combined before the shuffle), the latest time
    is carried forward over those distinct times, and completed rows join the
    summary of their own time.  A receive at the very time of a completion
    counts if its event_id is smaller.
    """
    keys = [customer_key, offer_key]
    rel = df.filter(F.col(customer_key).isNotNull() & F.col(offer_key).isNotNull()
                    & F.col("event").isin(completed, received))
    is_recv = F.col("event") == received
    at = rel.groupBy(*keys, time_col).agg(
        F.min(F.when(is_recv, F.col(order_col))).alias("_first_recv"))
    before = (Window.partitionBy(*keys).orderBy(F.col(time_col).asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = at.withColumn("_before", F.max(F.when(F.col("_first_recv").isNotNull(), F.col(time_col))).over(before))
    mine = carried.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(time_col).alias("_t"),
                          "_first_recv", "_before")
    done = rel.filter(F.col("event") == completed)
    out = done.join(mine, [F.col(k) == F.col(f"_k_{k}") for k in keys]
                    + [F.col(time_col).eqNullSafe(F.col("_t"))], "left")
    same = F.col("_first_recv") < F.col(order_col)
    latest = F.when(same, F.col(time_col)).otherwise(F.col("_before"))
    days = micros_between(latest, time_col) / F.lit(86_400_000_000.0)
    cols = [order_col, customer_key, offer_key] + (
        ["offer_type"] if "offer_type" in df.columns else []) + (
        ["cluster"] if "cluster" in df.columns else [])
    return out.select(*cols, days.alias("time_to_redemption"))
