"""Sharding by a Feistel permutation of the global row number (operator 10).

Rows are numbered 0..N-1 in order of doc_id.  A Feistel network over
``[0, a) x [0, b)`` (a*b just above N), with cycle walking for the few values
at or above N, permutes the numbers; ``shard = p mod S`` and ``slot = p div S``.
A row's place is therefore a formula of (its number, N, seed, S): the shuffle
is reproducible, shard sizes differ by at most one and slots have no gaps.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage_table

ROUNDS = 6


def radix(n: int) -> tuple[int, int]:
    """Radices (a, b) of the two halves: n <= a*b < n + a, a about sqrt(n), and
    a*b as little above n as the next few hundred values of a allow, since that
    many steps a walk may take."""
    least = math.isqrt(max(n - 1, 0)) + 1
    a = min(range(least, least + min(300, least)), key=lambda a: -(-n // a) * a - n)
    return a, -(-n // a)


def _mix(half: Column, r, seed: int, size: int) -> Column:
    return F.pmod(F.xxhash64(half, F.lit(seed), r), F.lit(size).cast("long"))


def permute(df: DataFrame, column: str, n: int, seed: int, out: str) -> DataFrame:
    """``out`` = Feistel permutation of ``column`` (0..n-1) within 0..n-1."""
    a, b = radix(n)
    df = df.withColumns({"_l": F.expr(f"{column} % {a}L"), "_r": F.expr(f"{column} div {a}L")})
    for r in range(0, ROUNDS, 2):
        df = df.withColumn("_l", (F.col("_l") + _mix(F.col("_r"), F.lit(r), seed, a)) % F.lit(a).cast("long"))
        df = df.withColumn("_r", (F.col("_r") + _mix(F.col("_l"), F.lit(r + 1), seed, b)) % F.lit(b).cast("long"))
    df = df.withColumn(out, F.expr(f"_l + _r * {a}L"))
    # Cycle walking: values in [n, a*b) go through the network again until they
    # fall below n.  A walk meets each of the a*b - n outer values once at most,
    # so that many steps are always enough; about sqrt(n) rows walk at all.
    outer = a * b - n
    if outer:
        steps = "sequence(1, %d)" % outer
        once = _network_sql("p", a, b, seed)
        walk = f"aggregate({steps}, {out}, (p, i) -> IF(p < {n}L, p, {once}))"
        df = df.withColumn(out, F.expr(f"IF({out} < {n}L, {out}, {walk})"))
    return df.drop("_l", "_r")


def _network_sql(p: str, a: int, b: int, seed: int) -> str:
    """The same network as SQL over one value, for use inside a lambda."""
    rounds = ", ".join(str(r) for r in range(ROUNDS))
    left = f"(h.l + pmod(xxhash64(h.r, {seed}, r), {a}L)) % {a}L"
    right = f"(h.r + pmod(xxhash64(h.l, {seed}, r), {b}L)) % {b}L"
    return (f"aggregate(array({rounds}), named_struct('l', {p} % {a}L, 'r', {p} div {a}L), "
            f"(h, r) -> IF(r % 2 = 0, named_struct('l', {left}, 'r', h.r), "
            f"named_struct('l', h.l, 'r', {right})), h -> h.l + h.r * {a}L)")


def number_rows(df: DataFrame, order: list[str], out: str = "row_no") -> DataFrame:
    """Global row numbers 0..N-1 in ``order`` without a one-task window: range
    partitions are written with their ordinal, counted, and numbered inside.

    Rows that tie on every column of ``order`` get neighbouring numbers.
    """
    ranged = stage_table(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
                         .withColumn("_part", F.spark_partition_id()), "ranged")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # one row per partition, not per document
    bases = (ranged.groupBy("_part").agg(F.count("*").alias("_n"))
             .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    inside = W.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (ranged.withColumn("_k", F.row_number().over(inside)).join(bases, "_part")
            .withColumn(out, (F.col("_base") + F.col("_k") - 1).cast("long"))
            .drop("_part", "_k", "_base"))


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """Place every document under the law ``rows``.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot,
    grown_shard (null: only the law ``key`` has it), row_no.  Null text has
    size 1 and the checksum of no bytes; a null doc_id is numbered first; rows
    that repeat a doc_id are numbered by size, then checksum; an empty table
    gives no rows.  Other columns of ``docs`` are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    # only these narrow columns are ever moved
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    numbered = number_rows(light, ["doc_id", "size", "text_crc32"])
    n = numbered.count()
    placed = permute(numbered, "row_no", n, seed, "_p") if n else numbered.withColumn("_p", F.col("row_no"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.expr(f"_p % {shards}L").cast("int").alias("shard"),
        F.expr(f"_p div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_no")
