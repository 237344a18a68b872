"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows per Arrow batch: texts are large rows, so a batch stays a few MB.
BATCH_ROWS = 256

#: Stands for a null doc_id inside keys and binary locators; it is the smallest
#: long, so a null id sorts before every other id.
NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, with small Arrow batches set for it."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of one Arrow batch of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def id_key(column: str = "doc_id"):
    """``doc_id`` as a long without nulls (see :data:`NULL_ID`)."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_out(column: str):
    """Undo :func:`id_key`."""
    return F.nullif(F.col(column), F.lit(NULL_ID))


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns the text operators read; other columns never travel."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    the lineage with files that every executor sees."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_fs(uri: str):
    """(file system, path) of a file in the shared folder, for tasks that
    write or read files of another format than Spark's own."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


#: log2 of the bits of a bitmap of hashes: 8 MB, whatever it is built of.
BITMAP_LOG2 = 26


def hash_bitmap(hashes: DataFrame, column: str = "hash", log2: int = BITMAP_LOG2) -> bytes:
    """Bitmap of the top bits of 64-bit hashes: at most 2**(log2 - 6) longs
    reach the driver, whatever the number of hashes."""
    top = F.shiftrightunsigned(F.col(column), 64 - log2)
    longs = (hashes.select(F.shiftright(top, 6).alias("at"),
                           F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - log2}) & 63 AS int))").alias("bit"))
             .groupBy("at").agg(F.bit_or("bit").alias("bits")))
    words = np.zeros(1 << (log2 - 6), np.int64)
    for row in longs.toLocalIterator():
        words[row["at"]] = row["bits"]
    return words.tobytes()


def in_bitmap(bits: np.ndarray, hashes: np.ndarray, log2: int = BITMAP_LOG2) -> np.ndarray:
    """Which hashes (uint64) may be in a bitmap, read as uint64."""
    at = hashes >> np.uint64(64 - log2)
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def byte_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges (u long, v long)``.

    Alternating large-star and small-star steps; each is an aggregate with a
    map-side combine and a join back, and each round is a written table.  The
    rounds stop when the edges no longer change.  Returns (node, component),
    one row per node that has an edge; empty edges give no rows.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .unionByName(joined.select("u", F.col("m").alias("v"))))
        return out.filter("u <> v").distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count("*").alias("n"),
                         F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    pairs = stage_table(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = mark(pairs)
    if seen["n"]:
        while True:  # ends: every round that changes an edge gives it a smaller node
            pairs = stage_table(star(star(pairs, True), False), "edges")
            now = mark(pairs)
            if now == seen:
                break
            seen = now
    # settled: every remaining edge runs from a node to its component's least
    return (pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")))
            .distinct())
