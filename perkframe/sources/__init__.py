"""Sources and sinks.

Declared schemas are applied on read so a scan never infers; Parquet scans
stay lazy so Catalyst prunes columns and pushes filters into them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import to_timestamp_if_hours
from . import versions
from .inference import BAD, read_csv_inferred  # noqa: F401
from .versions import read_current, replace_parquet  # noqa: F401

OFFER_EVENTS_SCHEMA = (
    "event_id BIGINT, customer_id BIGINT, event STRING, time TIMESTAMP_NTZ, "
    "offer_id STRING, offer_type STRING, difficulty INT, reward INT, duration INT, "
    "channels ARRAY<STRING>, gender STRING, age DOUBLE, income DOUBLE"
)
TRANSACTION_EVENTS_SCHEMA = (
    "event_id BIGINT, customer_id BIGINT, event STRING, time TIMESTAMP_NTZ, "
    "amount DOUBLE, age DOUBLE"
)


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A1: Parquet scan; with ``schema`` the file schema is not inferred."""
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    return reader.parquet(path)


def load_transaction_events(spark: SparkSession, path: str) -> DataFrame:
    """A2: transaction table with ``time`` hours converted to timestamps."""
    return _load_events(spark, path, TRANSACTION_EVENTS_SCHEMA)


def load_offer_events(spark: SparkSession, path: str) -> DataFrame:
    """A3: offer table; ``time`` is converted on load as well (Q13)."""
    return _load_events(spark, path, OFFER_EVENTS_SCHEMA)


def _load_events(spark: SparkSession, path: str, declared: str) -> DataFrame:
    """The stored columns; every declared one that is there, but for ``time``
    (hours or timestamps), has to be of its declared type."""
    df = to_timestamp_if_hours(read_parquet(spark, path), "time")
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(declared)}
    for f in df.schema:
        if f.name in kinds and kinds[f.name] != f.dataType:
            raise TypeError(f"{f.name} is {f.dataType.simpleString()}, not {kinds[f.name].simpleString()}")
    return df


def load_all(spark: SparkSession, offer_path: str, transaction_path: str
             ) -> tuple[DataFrame, DataFrame]:
    """A4: both event tables as lazy DataFrames."""
    return load_offer_events(spark, offer_path), load_transaction_events(spark, transaction_path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A5: header CSV whose list/dict cells are quoted text.

    The schema is declared (no ``inferSchema`` pass over the data); ``"`` is
    both quote and escape, as written by pandas.
    """
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", False).schema(schema).csv(path))


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None,
                bucket_by: tuple[int, str] | None = None, path: str | None = None) -> None:
    """Replace a named table (``to_sql(if_exists='replace')``) in one step:
    readers have the old rows until the new ones are there whole, and keep them
    if the write fails (:mod:`.versions`).

    ``bucket_by=(n, key)`` writes a bucketed table so later joins or
    group-bys on ``key`` read co-located data without a shuffle; ``path``
    keeps its files in that folder (else in the warehouse).
    """
    def save(version: str) -> None:
        w = df.write.mode("errorifexists").format("parquet")
        if path:
            w = w.option("path", f"{path}/{version.rpartition('.')[2]}")
        if partition_by:
            w = w.partitionBy(*partition_by)
        if bucket_by:
            w = w.bucketBy(bucket_by[0], bucket_by[1]).sortBy(bucket_by[1])
        w.saveAsTable(version)

    versions.replace_table(df.sparkSession, name, save, path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Read a named table."""
    return spark.table(name)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet sink (overwrite)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with a header, used to round-trip A5."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_model(model, path: str) -> None:
    """Persist a fitted segmentation model as two Parquet tables."""
    model.save(path)


def load_model(spark: SparkSession, path: str):
    """Load a model saved by :func:`save_model`.

    A missing path raises ``AnalysisException`` (the reference raises
    ``FileNotFoundError``).
    """
    from ..operators.segments import SegmentModel
    return SegmentModel.load(spark, path)


def split_events(df: DataFrame, event_col: str = "event",
                 transaction_value: str = "transaction") -> tuple[DataFrame, DataFrame]:
    """Offer rows and transaction rows from one cleaned table; a row
    without an event is not a transaction, so it is an offer row."""
    is_txn = F.col(event_col).eqNullSafe(F.lit(transaction_value))
    return df.filter(~is_txn), df.filter(is_txn)
