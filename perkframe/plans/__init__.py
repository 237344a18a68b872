"""Composite pipelines (P1-P5, M5) built from the operators.

All are lazy but ``materialize_event_tables`` (writes) and ``train_segments``
(fits).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import to_timestamp_if_hours
from ..operators import cleaning
from ..sources import split_events

OFFER_COLUMNS = ["event_id", "customer_id", "event", "time", "offer_id", "offer_type",
                 "difficulty", "reward", "duration", "channels", "gender", "age", "income"]
TRANSACTION_COLUMNS = ["event_id", "customer_id", "event", "time", "amount", "age"]


def clean_and_merge(events: DataFrame, customers: DataFrame, offers: DataFrame,
                    winsorize_amount: bool = True) -> DataFrame:
    """B1-B10 on one table: clean each raw table, join events to both
    dimensions and cap ``amount`` at its 1st/99th percentile.
    :func:`build_event_tables` gives the same rows with less work."""
    merged = cleaning.denormalise(cleaning.clean_events(events),
                                  cleaning.clean_customers(customers),
                                  cleaning.clean_offers(offers))
    return cleaning.winsorize(merged, "amount") if winsorize_amount else merged


def build_event_tables(events: DataFrame, customers: DataFrame, offers: DataFrame,
                       winsorize_amount: bool = True) -> tuple[DataFrame, DataFrame]:
    """Raw tables -> (offer_events, transaction_events), lazily.

    Events are split (B11) right after they are parsed, so each side joins only
    what it keeps: transactions need the customer's age, no offer column and no
    income statistics.  The caps are percentiles of all events' amounts.
    """
    parsed = to_timestamp_if_hours(cleaning.clean_events(events), "time")
    offer_rows, txn_rows = split_events(parsed)
    offer_rows = cleaning.denormalise(offer_rows, cleaning.clean_customers(customers),
                                      cleaning.clean_offers(offers))
    ages = cleaning.replace_above_with_median(customers, "age").select("customer_id", "age")
    if winsorize_amount:
        txn_rows = cleaning.winsorize(txn_rows, "amount", stats_from=parsed, one_pass=True)
    return (offer_rows.select(*OFFER_COLUMNS),
            txn_rows.join(ages, "customer_id", "left").select(*TRANSACTION_COLUMNS))


def materialize_event_tables(events: tuple[DataFrame, DataFrame], path: str
                             ) -> tuple[DataFrame, DataFrame]:
    """Write the two event tables once, partitioned by calendar date, and read
    them back (ETL once, analyse many times, as the surveyed app stores its
    tables).

    ``path`` is a folder that all machines see (on a cluster, under
    ``spark.checkpoint.dir``): the lineage ends there, and the re-read tables
    keep column pruning and filter pushdown.  The extra column ``event_date``
    lets a time window prune folders (``filters`` uses it); rows without a time
    have none.  Rows are rebalanced by date first, so a date is a few files
    however many tasks wrote, and a large date is split.
    """
    from ..sources import read_parquet, write_parquet
    out = []
    for name, df in zip(("offer_events", "transaction_events"), events):
        dated = df.withColumn("event_date", F.to_date("time")).hint("rebalance", "event_date")
        write_parquet(dated, f"{path}/{name}", ["event_date"])
        schema = df.schema.add("event_date", "date")
        out.append(df.sparkSession.read.schema(schema).parquet(f"{path}/{name}"))
    return tuple(out)


def prepare_offer_events(df: DataFrame, age_filter: bool = True,
                         age_fences: tuple | None = None) -> DataFrame:
    """J1 -> offer_success (fences of *all* rows) -> age IQR filter.

    ``age_fences``: the two fences where they are known (see ``iqr_filter``)."""
    from ..operators.filters import iqr_filter
    from ..operators.offers import with_offer_success
    src = to_timestamp_if_hours(df, "time")
    out = with_offer_success(src)
    if age_filter and "age" in df.columns:
        # the success flag neither adds rows nor changes ages: fences from src
        out = iqr_filter(out, "age", stats_from=src, fences=age_fences)
    return out


def prepare_transaction_events(df: DataFrame) -> DataFrame:
    """J1 -> per-customer total_spend on every row."""
    from ..operators.customers import with_customer_total
    return with_customer_total(to_timestamp_if_hours(df, "time"))


def explode_channels(df: DataFrame, c: str = "channels") -> DataFrame:
    """One row per channel, other columns repeated; an empty or NULL list
    keeps one row with a NULL channel (pandas ``explode``).  Accepts list text
    or an array column."""
    from ..functions import parse_list
    arr = parse_list(c) if dict(df.dtypes)[c] == "string" else F.col(c)
    return df.withColumn(c, F.explode_outer(arr))


def load_and_prepare(offers: DataFrame, transactions: DataFrame, channels: bool = False,
                     age_fences: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """(P1, P2), optionally followed by P3 on the offer side."""
    o = prepare_offer_events(offers, age_fences=age_fences)
    if channels:
        o = explode_channels(o)
    return o, prepare_transaction_events(transactions)


class SegmentBundle(Mapping):
    """The six frames of :func:`segment_bundle` over one RFM aggregate.

    The segmented customers are marked to be kept (in memory, spilling to disk)
    when the bundle is made; the first action on any frame fills them and the
    others read them.  ``release`` (or leaving a ``with`` block) lets them go;
    frames still work afterwards and compute the aggregate again.  Blocks of a
    lost executor are recomputed from the transactions.
    """

    def __init__(self, shared: DataFrame, frames: Callable[[DataFrame], dict[str, DataFrame]]):
        self._shared = shared.persist(StorageLevel.MEMORY_AND_DISK)
        self._frames = frames(self._shared)

    def __getitem__(self, name: str) -> DataFrame:
        return self._frames[name]

    def __iter__(self):
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    def release(self) -> None:
        self._shared.unpersist()

    def __enter__(self) -> "SegmentBundle":
        return self

    def __exit__(self, *_) -> None:
        self.release()


def segment_bundle(offers: DataFrame, transactions: DataFrame, offer_types: list[str],
                   min_amount: float, max_amount: float, model, churn_days: int = 30) -> SegmentBundle:
    """P5: C1 || C2 -> M4 -> E9 -> E6 -> E7.

    Returns six lazy frames by name: offers, transactions, rfm,
    advanced_metrics, basket, segment_stats.  RFM and basket come from one
    per-customer aggregate of the filtered transactions, computed at first use
    and kept until the bundle is released (the surveyed app computes the
    segmentation twice)::

        with segment_bundle(...) as frames:
            frames["segment_stats"].show()
    """
    from ..operators import customers, filters, segments
    fo = filters.filter_offer_types(offers, offer_types)
    ft = filters.filter_amount(transactions, min_amount, max_amount)

    def frames(seg: DataFrame) -> dict[str, DataFrame]:
        rfm = seg.select("customer_id", *segments.FEATURES, "cluster")
        basket = segments.basket_from_segmented(seg)
        return {"offers": fo, "transactions": ft, "rfm": rfm,
                "advanced_metrics": customers.advanced_metrics(rfm, fo, churn_days),
                "basket": basket, "segment_stats": segments.segment_stats(basket)}

    return SegmentBundle(segments.segment_customers(ft, model, with_basket=True), frames)


def train_segments(transactions: DataFrame, path: str | None = None, k: int = 4):
    """M5: RFM on unfiltered transactions -> scaler + k-means -> saved model."""
    from ..operators import segments
    model = segments.fit_segments(segments.rfm(transactions), k=k)
    if path:
        model.save(path)
    return model
