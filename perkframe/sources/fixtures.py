"""Logical input tables built from the driver's Parquet tables.

The surveyed application reads three raw tables (offers, customers, events).
The test data has none of them, so each is a projection of a driver table
(FIXTURES.md part 3).  Everything here is a lazy projection or filter of a
Parquet scan, so the result grows with the input and Catalyst prunes columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import micros_between

# Origin of the event stream and the event renaming table.
EVENT_ORIGIN = "2024-01-01 00:00:00"
EVENT_NAMES = {
    "view": "offer received",
    "click": "offer viewed",
    "purchase": "offer completed",
    "signup": "transaction",
    "error": "transaction",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers: customer_id, became_member_on (yyyymmdd INT), gender, age, income.

    Most ages are 18..42, none 43..94; some are 95 (outside the age fences) or
    118 (a placeholder).  Some incomes are missing and some far outside the
    fences on either side."""
    k = F.col("c_custkey")
    bal = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        k.alias("customer_id"),
        (F.lit(20130101) + (k % 4) * 10000 + (k % 12) * 100 + k % 28).cast("int")
        .alias("became_member_on"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))
        .alias("gender"),
        F.when(k % 13 == 0, F.lit(118)).when(k % 19 == 0, F.lit(95))
        .otherwise(F.lit(18) + k % 25).cast("int").alias("age"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).when(k % 17 == 3, bal + F.lit(100000.0))
        .when(k % 17 == 5, bal - F.lit(100000.0)).otherwise(bal).alias("income"),
    )


def raw_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offers: offer_id, offer_type, difficulty, reward, duration, channels (list text).

    Every part is an offer; events reference the first hundred keys, and the
    dimension join keeps the rest out of the result.  Some channel lists are
    missing and some have a ``None`` element.
    """
    name = F.col("p_name")
    pk = F.col("p_partkey")
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    channels = (F.when(pk % 13 == 0, F.lit(None).cast("string"))
                .when(pk % 13 == 5, F.concat(F.lit("['"), first, F.lit("', None]")))
                .otherwise(F.concat(F.lit("['"), first, F.lit("', '"), second, F.lit("']"))))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("offer_id"),
        F.col("p_type").alias("offer_type"),
        F.when(F.col("p_type") == "PROMO", F.lit(0)).otherwise(F.col("p_size")).cast("int")
        .alias("difficulty"),
        (F.col("p_partkey") % 11).cast("int").alias("reward"),
        (F.lit(3) + F.col("p_size") % 8).cast("int").alias("duration"),
        channels.alias("channels"),
    )


def _event_name(c: Column) -> Column:
    expr = None
    for src, dst in EVENT_NAMES.items():
        expr = F.when(c == src, F.lit(dst)) if expr is None else expr.when(c == src, F.lit(dst))
    return expr.otherwise(c)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: event_id, customer_id, event, value (dict text), time (hours DOUBLE).

    Left as messy as real logs: every 29th user has no transactions (their
    amounts are filed as viewed offers, without an offer_id); some customers,
    events, times, amounts and offers are missing; no transaction falls on the
    twelfth day; times are fractional hours for some rows."""
    et, eid = F.col("event_type"), F.col("event_id")
    is_offer = et.isin("view", "click", "purchase")
    offer_value = F.replace(F.replace(F.col("props"), F.lit('"k"'), F.lit('"offer_id"')),
                            F.lit('"'), F.lit("'"))
    # a None before the closing brace must not cost the other keys
    offer_value = F.when(eid % 31 == 0, F.replace(offer_value, F.lit("}"), F.lit(", 'reward': None}"))) \
        .when(eid % 31 == 1, F.replace(offer_value, F.lit("}"), F.lit(", 'reward': 5}"))).otherwise(offer_value)
    txn_value = F.when(eid % 97 == 0, F.lit("{'amount': None}")).otherwise(
        F.concat(F.lit("{'amount': "), F.col("value").cast("string"), F.lit("}")))
    hours = F.floor(micros_between(F.lit(EVENT_ORIGIN), "ts") / F.lit(3_600_000_000)).cast("double")
    hours = F.when(~is_offer & (F.floor(hours / 24) == 11), hours + 24).otherwise(hours)
    hours = F.when(eid % 41 == 0, hours + F.lit(0.5)).otherwise(hours)
    event = F.when(~is_offer & (F.col("user_id") % 29 == 0), F.lit("offer viewed")).otherwise(_event_name(et))
    return table(spark, sf_dir, "events").select(
        eid,
        F.when(eid % 101 == 0, F.lit(None).cast("long")).otherwise(F.col("user_id")).alias("customer_id"),
        F.when(eid % 103 == 0, F.lit(None).cast("string")).otherwise(event).alias("event"),
        F.when(is_offer, offer_value).otherwise(txn_value).alias("value"),
        F.when(eid % 107 == 0, F.lit(None).cast("double")).otherwise(hours).alias("time"),
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-history transactions from ``orders`` (customer_id, event, time, amount).

    ``event_id`` is the order key, kept as a stable tie-break.
    """
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("event"),
        F.col("o_orderdate").alias("time"),
        F.col("o_totalprice").alias("amount"),
    )


_EVENT_TABLES: dict[tuple, tuple] = {}


def event_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(O, T): cleaned, denormalised offer rows and transaction rows.

    The raw views are cleaned, joined and written once per Spark application
    and input (``plans.materialize_event_tables``) under the shared checkpoint
    folder; every query reads them.  The input is known by its files, their
    sizes and times, so a changed input is built anew (and what was built of it
    before is removed).  The queries ``offer_rows`` / ``transaction_rows``
    check the lazy pipeline itself against the oracle.
    """
    import uuid

    from ..plans import build_event_tables, materialize_event_tables
    from ..session import remove_path, scratch_path
    key = (spark.sparkContext.applicationId, sf_dir)
    state = tuple(_state(spark, f"{sf_dir}/{t}.parquet") for t in ("events", "customer", "part"))
    held = _EVENT_TABLES.get(key)
    if held is None or held[0] != state:
        path = scratch_path(spark, f"event-tables-{uuid.uuid4().hex}")
        tables = materialize_event_tables(
            build_event_tables(raw_events(spark, sf_dir), raw_customers(spark, sf_dir),
                               raw_offers(spark, sf_dir)), path)
        if held is not None:
            remove_path(spark, held[2])
        held = _EVENT_TABLES[key] = (state, tables, path, {})
    return held[1]


def age_fences(spark: SparkSession, sf_dir: str) -> tuple:
    """The age fences of the offer rows: two numbers, computed once for the
    written table, so that queries push them into its scan."""
    from ..operators.filters import bounds_of, iqr_fences
    offers = event_tables(spark, sf_dir)[0]
    known = _EVENT_TABLES[spark.sparkContext.applicationId, sf_dir][3]
    if "age" not in known:
        known["age"] = bounds_of(iqr_fences(offers, "age"))
    return known["age"]


def _state(spark: SparkSession, path: str) -> tuple:
    """Files of a table with their sizes and times, from Spark's file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime())
                        for x in fs.listStatus(root)))


def offer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O: cleaned, denormalised offer rows."""
    return event_tables(spark, sf_dir)[0]


def transaction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: cleaned transaction rows."""
    return event_tables(spark, sf_dir)[1]


def long_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions joined to cleaned customer ages (for E5 / H1)."""
    from ..operators.cleaning import replace_above_with_median
    ages = replace_above_with_median(raw_customers(spark, sf_dir), "age").select("customer_id", "age")
    return order_transactions(spark, sf_dir).join(ages, "customer_id", "left")
