"""SimHash near-duplicates by pigeonhole blocks (operator 2).

A 64-bit fingerprint is split into four blocks.  Two fingerprints that differ
in at most two bits agree on at least two blocks, so they meet under one of the
six pairs of blocks.  Fingerprints are joined on those block pairs and the
Hamming distance of each met pair is verified.

A block pair that very many fingerprints share (a large group of near copies)
is not paired off.  Its fingerprints are dealt out under themselves and their
64 one-bit neighbours instead: two fingerprints at distance two or less always
share such a value, and all that share one are within two bits of each other.
That is 65 rows a fingerprint, whatever the size of the group.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, connected_components, free_name, id_and_text, id_key, id_out, stage_table

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BLOCKS = 4
#: Fingerprints under one block pair beyond which they are dealt by neighbours.
PAIRED = 128
_SLICE = 1 << 15

_WIDTH = 64 // BLOCKS


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_masks(max_bits: int = MAX_BITS) -> list[int]:
    """Masks of every choice of blocks that a close pair may agree on."""
    part = (1 << _WIDTH) - 1
    return [_signed(sum(part << (_WIDTH * b) for b in chosen))
            for chosen in itertools.combinations(range(BLOCKS), BLOCKS - max_bits)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of lower-cased words; 0 for a text without words."""
    words = text.lower().split()  # bytes: lowers A-Z, splits at x20, x09-x0D
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    counts, n, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_digest
    grams = iter(grams)
    while part := [digest(g, SEED) for g in itertools.islice(grams, _SLICE)]:
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in byte_list(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), np.array(fps, np.uint64).view(np.int64)], ["id", "fp"])

    return (docs.select(id_key().alias("id"), F.col("text"))
            .mapInArrow(run, "id long, fp long"))


def close_pairs(fps: DataFrame, max_bits: int = MAX_BITS, paired: int = PAIRED) -> DataFrame:
    """Edges (u, v) between distinct fingerprints of ``fps (fp)``: every pair
    under an ordinary block pair at ``max_bits`` or less, and star edges for
    crowded ones that connect exactly the same fingerprints."""
    if max_bits != MAX_BITS:
        raise ValueError("blocks and neighbours are laid out for two bits")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                               for i, m in enumerate(block_masks())])).alias("k")
    keyed = fps.select("fp", keys).select("fp", "k.c", "k.key")
    sizes = keyed.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stage_table(keyed.join(sizes, ["c", "key"]), "blocks")

    lists = (met.filter(F.col("n") <= paired).groupBy("c", "key")
             .agg(F.collect_list("fp").alias("fps")))  # at most ``paired`` long
    pairs = (lists.select("fps", F.explode("fps").alias("u"))
             .select("u", F.expr(f"filter(fps, v -> v > u AND bit_count(u ^ v) <= {max_bits})").alias("vs"))
             .select("u", F.explode("vs").alias("v")))

    crowded = met.filter(F.col("n") > paired).select("fp").distinct()
    near = crowded.select("fp", F.explode(F.expr(
        "concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("value"))
    stars = (near.groupBy("value").agg(F.collect_set("fp").alias("s"))  # 65 fingerprints at most
             .filter("size(s) > 1")
             .select(F.array_min("s").alias("u"), F.explode("s").alias("v")).filter("u <> v"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id that links of ``max_bits`` or less reach), group_rows.

    Null and empty texts have fingerprint zero and are linked like any other.
    A null doc_id is smaller than any other; rows that repeat a doc_id are rows
    of their own; an empty table gives no rows; other columns are not read.
    """
    fps = stage_table(fingerprints(docs, shingle), "fingerprints")
    classes = stage_table(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "classes")
    linked = connected_components(close_pairs(classes.select("fp"), max_bits))
    rooted = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("rows").alias("group_rows"))
    named = rooted.join(least, "component").select("fp", "component_id", "group_rows")
    return fps.join(named, "fp").select(
        id_out("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        id_out("component_id").alias("component_id"), "group_rows")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without the documents that are not the first of their group;
    all columns stay.  Rows that repeat a doc_id stay or go together."""
    found = near_duplicates(docs, shingle, max_bits)
    name = free_name(docs, "gone")
    gone = (found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias(name)).distinct().hint("merge"))  # grows with the corpus
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")
