"""Near-duplicates by min-max hashing (operator 11).

A document's set holds its distinct ``SHINGLE``-word shingles.  Each random
permutation of the shingle hashes is evaluated once and gives two signature
values, the least and the greatest permuted hash.  Either agrees between two
sets with a chance that equals their Jaccard similarity, and as an element that
only one set has can't be least and greatest at once, the two vary less than
values of two permutations would.  ``PERMUTATIONS`` evaluations so give twice
as many values.

Bands are laid over the least values of ``ROWS`` permutations and over the
greatest values of the same ones, so the values inside a band are independent:
a pair of similarity s misses all bands with a chance of at most
``(1 - s**ROWS) ** (2 * PERMUTATIONS / ROWS)``, 6e-9 at s = 0.85.

Equal sets are one class from the start.  Classes that share a band are linked
as far as the components need it:

1. twice, every class is compared with one leader of each of its buckets, which
   is linear in the bucket and joins large groups of near copies;
2. what then shares a bucket but no component is compared pair by pair, without
   listing the pairs: tasks hold two blocks of a bucket's members at most and
   give out only pairs whose parity sketches allow the similarity.  A sketch
   counts shingles modulo two in ``SKETCH_BITS`` cells; every cell that differs
   needs a shingle that only one set has, so the test loses no link.

Every link is confirmed on the two full sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (byte_list, connected_components, free_name, hash_bitmap, id_key, id_out, in_bitmap,
                     small_batches, stage_table)

SHINGLE = 5
#: A link needs 100 * |intersection| >= PERCENT * |union|.
PERCENT = 85
PERMUTATIONS = 120
ROWS = 6
SKETCH_BITS = 2048
LEADER_ROUNDS = 2
#: Members up to which a bucket's pairs are listed by SQL.
SMALL_BUCKET = 16
#: Members of a block of a larger bucket.
BLOCK = 256
#: Remembered word hashes of a worker: at most this many bytes of words.
WORD_BYTES = 32 << 20
_SLICE = 2048

SIGNED = "id long, n_shingles long, digest binary, bands array<long>"
SETS = "id long, digest binary, n long, members binary, sketch binary"

_U = np.uint64


# ------------------------------------------------------------ one document
class _Words(dict):
    """Hash of each word, remembered up to a bound in bytes."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 100
        if self.held > WORD_BYTES:
            self.clear()
            self.held = 0
        value = self[word] = xxhash.xxh64_intdigest(word, 11)
        return value


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=8)
def _odd(n: int, bits: int, seed: int) -> np.ndarray:
    kind = np.uint64 if bits == 64 else np.uint32
    return np.random.default_rng(seed).integers(0, 2 ** (bits - 1), n, dtype=kind) * kind(2) + kind(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; with fewer
    words the whole sequence is one; none without words."""
    words = text.lower().split()  # bytes: lowers A-Z, splits at x20, x09-x0D
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(codes))
    with np.errstate(over="ignore"):
        h = np.full(len(codes) - width + 1, width, np.uint64)  # short sequences differ from shingles
        for k, c in enumerate(_odd(width, 64, 5)):
            h = h + codes[k:len(codes) - width + 1 + k] * c
        return np.unique(_mix(h))


def signature(members: np.ndarray, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) value of the set under each permutation.  x -> a*x
    with odd a permutes the 32-bit numbers; members are random ones already."""
    x, a = (members >> _U(32)).astype(np.uint32), _odd(permutations, 32, 17)[:, None]
    least, greatest = np.full(permutations, 2**32 - 1, np.uint32), np.zeros(permutations, np.uint32)
    for at in range(0, len(x), _SLICE):
        y = a * x[None, at:at + _SLICE]
        np.minimum(least, y.min(axis=1), out=least)
        np.maximum(greatest, y.max(axis=1), out=greatest)
    return least, greatest


def band_keys(members: np.ndarray, permutations: int = PERMUTATIONS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band: bands of least values, then of greatest ones."""
    if not len(members):
        return np.zeros(0, np.int64)
    values = np.concatenate(signature(members, permutations)).reshape(-1, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = (values * _odd(rows, 64, 23)).sum(axis=1, dtype=np.uint64)
        return _mix(keys ^ _mix(np.arange(1, len(keys) + 1, dtype=np.uint64))).view(np.int64)


def sketch(members: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity of the number of members in each cell."""
    cells = np.bincount((members & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((cells & 1).astype(bool)).tobytes()


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The definition of a link, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


# ------------------------------------------------------------- signatures
def signatures(docs: DataFrame, shingle: int = SHINGLE, permutations: int = PERMUTATIONS,
               rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, digest of the set, band keys) of each whole text."""
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in byte_list(batch.column(1))]
            bands = [band_keys(s, permutations, rows) for s in sets]
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            values = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))],
                ["id", "n_shingles", "digest", "bands"])

    return docs.select(id_key().alias("id"), F.col("text")).mapInArrow(run, SIGNED)


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """The full set and the sketch of every class of ``wanted (id, digest,
    cls)``, from the text of the row it names.  Texts don't travel: a bitmap of
    wanted ids, of one fixed size, tells tasks which rows to take; the few others
    that pass it are dropped by the join on the digest."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(hash_bitmap(wanted.select(F.xxhash64("id").alias("hash"))))

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            taken = batch.filter(pa.array(in_bitmap(bits, batch.column(0).to_numpy().view(np.uint64))))
            sets = [shingle_set(t, shingle) for t in byte_list(taken.column(2))]
            yield pa.RecordBatch.from_arrays(
                [taken.column(1), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([sketch(s) for s in sets], pa.binary())], ["id", "digest", "n", "members", "sketch"])

    texts = docs.select(id_key().alias("id"), F.col("text")).select(F.xxhash64("id").alias("h"), "id", "text")
    # rows may repeat an id with another text, so the digest has to be the same
    found = texts.mapInArrow(run, SETS).join(wanted, ["id", "digest"]).select("cls", "n", "members", "sketch")
    return stage_table(found.dropDuplicates(["cls"]), "sets")


# ------------------------------------------------------------------ links
def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are links on their full sets, as a table."""
    def run(batches):
        for batch in batches:
            u, v, a, b = (c.to_pylist() for c in batch.columns)
            good = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, g in zip(c, good) if g], pa.int64()) for c in (u, v)], ["u", "v"])

    a = sets.select(F.col("cls").alias("u"), F.col("members").alias("a"))
    b = sets.select(F.col("cls").alias("v"), F.col("members").alias("b"))
    return stage_table(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"),
                       "links")


def _near_size(n: str, m: str, percent: int):
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")


def _ordered(a: str, b: str):
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def leader_pairs(met: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of ``met (key, cls, n, c)`` with the leader of its bucket,
    unless the two are in one component already."""
    lead = F.min(F.struct(F.xxhash64("cls", F.lit(turn)), F.col("cls").alias("cls"), F.col("n").alias("n"),
                          F.col("c").alias("c"))).alias("lead")
    leaders = met.groupBy("key").agg(lead).select(
        "key", F.col("lead.cls").alias("l"), F.col("lead.n").alias("ln"), F.col("lead.c").alias("lc"))
    return (met.join(leaders, "key").filter("c <> lc").filter(_near_size("n", "ln", percent))
            .select(*_ordered("cls", "l")).distinct())


def cross_pairs(met: DataFrame, sets: DataFrame, percent: int, small: int = SMALL_BUCKET,
                block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) that share a bucket but no component and may be links."""
    sizes = (met.groupBy("key").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"))
             .filter("lo <> hi").select("key", "k"))
    mixed = stage_table(met.join(sizes, "key"), "mixed")

    lists = (mixed.filter(F.col("k") <= small).groupBy("key")
             .agg(F.collect_list(F.struct("cls", "c", "n")).alias("s")))  # at most ``small`` long
    few = (lists.select("s", F.explode("s").alias("x"))
           .select("x", F.explode(F.expr("filter(s, y -> y.cls > x.cls AND y.c <> x.c)")).alias("y"))
           .filter(_near_size("x.n", "y.n", percent))
           .select(F.col("x.cls").alias("u"), F.col("y.cls").alias("v")))

    # a larger bucket is cut into blocks; each two of them meet in one group of
    # at most two blocks (hash-dealt, so about ``block`` members each)
    crowd = (mixed.filter(F.col("k") > small)
             .withColumn("blocks", F.ceil(F.col("k") / block).cast("int"))
             .withColumn("own", F.expr("cast(pmod(xxhash64(cls, key), blocks) as int)"))
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .join(sets.select("cls", "sketch"), "cls")
             .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                     "own", "cls", "c", "n", "sketch"))

    def meet(table: pa.Table) -> pa.Table:
        own, cls, comp, n = (table[k].to_numpy() for k in ("own", "cls", "c", "n"))
        sk = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(n), -1)
        two = table["lo"][0].as_py() != table["hi"][0].as_py()
        left = np.flatnonzero(own == table["lo"][0].as_py())
        right = np.flatnonzero(own == table["hi"][0].as_py()) if two else left
        found = [], []
        for i in left:
            js = right if two else right[right > i]
            js = js[(comp[js] != comp[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
            differ = np.bitwise_count(sk[js] ^ sk[i]).sum(axis=1, dtype=np.int64)
            # 100 I >= percent U bounds the members that one side only has
            js = js[(100 + percent) * differ <= (100 - percent) * (n[js] + n[i])]
            found[0].append(np.minimum(cls[js], cls[i]))
            found[1].append(np.maximum(cls[js], cls[i]))
        empty = np.zeros(0, np.int64)
        return pa.table({"u": np.concatenate([empty, *found[0]]), "v": np.concatenate([empty, *found[1]])})

    many = crowd.groupBy("key", "lo", "hi").applyInArrow(meet, "u long, v long")
    return few.unionByName(many).distinct()


def class_links(met: DataFrame, sets: DataFrame, percent: int = PERCENT, turns: int = LEADER_ROUNDS) -> DataFrame:
    """(node, component) over classes of ``met (key, cls, n)`` with a link."""
    links, comps = None, None
    for turn in range(turns + 1):
        if comps is None:
            now = met.withColumn("c", F.col("cls"))
        else:
            now = (met.join(comps.withColumnRenamed("node", "cls"), "cls", "left")
                   .withColumn("c", F.coalesce("component", "cls")).drop("component"))
            now = stage_table(now, "open")
        pairs = leader_pairs(now, turn, percent) if turn < turns else cross_pairs(now, sets, percent)
        new = _confirmed(pairs, sets, percent)
        links = new if links is None else links.unionByName(new)
        comps = stage_table(connected_components(links), "components")
    return comps


# ----------------------------------------------------------- the operator
def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                    permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id
    (smallest doc_id that links reach, itself included), kept, group_rows.

    Documents without words, with null or empty text, have an empty set and are
    linked with nothing, copies of them included.  A text of any length is one
    row of a task; its set takes 8 bytes a word.  A null doc_id is smaller than
    any other; rows that repeat a doc_id are rows of their own; an empty table
    gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    signed = stage_table(signatures(docs, shingle, permutations, rows), "signatures")
    full = signed.filter("n_shingles > 0")
    classes = stage_table(
        full.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("rows"),
                                   F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("cls", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    light = classes.select("cls", "n", "digest", F.col("least").alias("id"))
    met = stage_table(keyed.join(shared, "key"), "shared-bands")
    wanted = stage_table(light.join(met.select("cls").distinct(), "cls", "left_semi"), "wanted")
    met = stage_table(met.join(wanted.select("cls", "n"), "cls"), "met")
    sets = _sets(docs, wanted.select("id", "digest", "cls"), shingle)
    comps = class_links(met, sets, percent)

    rooted = (classes.select("cls", "digest", "least", "rows")
              .join(comps.withColumnRenamed("node", "cls"), "cls", "left")
              .withColumn("component", F.coalesce("component", "cls")))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("rows").alias("group_rows"))
    named = rooted.join(least, "component").select("digest", "component_id", "group_rows")
    held = full.select("id", "n_shingles", "digest").join(named, "digest").drop("digest")
    bare = (signed.filter("n_shingles = 0").select("id", "n_shingles")
            .withColumn("component_id", F.col("id")).withColumn("group_rows", F.lit(1).cast("long")))
    return held.unionByName(bare).select(
        id_out("id").alias("doc_id"), "n_shingles", id_out("component_id").alias("component_id"),
        (F.col("id") == F.col("component_id")).alias("kept"), "group_rows")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are not the first of their group;
    all columns stay as they are.  Rows that repeat a doc_id stay or go
    together."""
    name = free_name(docs, "gone")
    gone = near_duplicates(docs, **options).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")
