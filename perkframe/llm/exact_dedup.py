"""Exact duplicates against a minimal perfect hash of history (operator 9).

History is the earlier part of a corpus.  Its distinct digests are built, one
shard of digests per task, into a minimal perfect hash: levels of bitmaps send
each of the n digests of a shard to its own slot 0..n-1.  A slot holds the full
32-byte digest and the locator of the group's winner.  A later digest is looked
up by hashing and compared byte by byte with its slot: equal digests are
repeats of history, all others form groups among themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_key, id_out, partitions, stage_table

#: Distinct digests that one shard of the index holds on average.
SHARD_DIGESTS = 1 << 17
#: Bits of a level per digest that is still without a slot.
GAMMA = 2.0
MAX_LEVELS = 64

INDEX = ("shard int, n long, level_bits array<long>, bitmap binary, digests binary, "
         "ids binary, points binary, sizes binary")


# ------------------------------------------------ the hash of one shard
def _level_hash(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Position of each digest in a level; words: (n, 4) uint64 of SHA-256."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] + np.uint64(0x9E3779B97F4A7C15) * (words[:, (level + 1) % 4] ^ np.uint64(level))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(32))
    return (x % np.uint64(bits)).astype(np.int64)


def build_hash(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Bits per level, all levels' bitmap as booleans, and each key's slot."""
    levels, maps, place = [], [], np.zeros(len(words), np.int64)
    left, offset = np.arange(len(words)), 0
    for level in range(MAX_LEVELS):
        if not len(left):
            break
        bits = max(64, int(GAMMA * len(left)))
        at = _level_hash(words[left], level, bits)
        alone = np.bincount(at, minlength=bits) == 1
        here = alone[at]
        place[left[here]] = offset + at[here]
        levels.append(bits)
        maps.append(alone)
        left, offset = left[~here], offset + bits
    if len(left):
        raise RuntimeError("digests of a shard are not distinct")
    bitmap = np.concatenate(maps) if maps else np.zeros(0, bool)
    rank = np.cumsum(bitmap) - bitmap
    return levels, bitmap, rank[place] if len(words) else place


def find_slots(words: np.ndarray, levels: list[int], bitmap: np.ndarray) -> np.ndarray:
    """Slot of each digest; -1 where no level takes it (surely not a member).
    The caller still has to compare the slot's digest."""
    slots, left, offset = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    rank = np.cumsum(bitmap) - bitmap
    for level, bits in enumerate(levels):
        if not len(left):
            break
        at = offset + _level_hash(words[left], level, bits)
        here = bitmap[at]
        slots[left[here]] = rank[at[here]]
        left, offset = left[~here], offset + bits
    return slots


def _digest_words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _build_shard(table: pa.Table) -> pa.Table:
    words = _digest_words(table["digest"])
    levels, bitmap, slot = build_hash(words)
    order = np.argsort(slot)
    at = lambda name: table[name].to_numpy()[order].astype(np.int64).tobytes()
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "n": pa.array([len(words)], pa.int64()),
        "level_bits": pa.array([levels], pa.list_(pa.int64())), "bitmap": [np.packbits(bitmap).tobytes()],
        "digests": [words[order].tobytes()], "ids": [at("id")], "points": [at("points")], "sizes": [at("size")]})


FOUND = "digest binary, keep_id long, keep_points long, group_size long, in_history boolean"


def _look_up(new: pa.Table, index: pa.Table) -> pa.Table:
    """Groups of one shard: history's slots joined by the new digests."""
    if index.num_rows:
        row = index.to_pylist()[0]
        levels, n = row["level_bits"], row["n"]
        bitmap = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8), count=sum(levels)).astype(bool)
        slots_of = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        ids, points, sizes = (np.frombuffer(row[k], np.int64).copy() for k in ("ids", "points", "sizes"))
    else:
        levels, n, bitmap = [], 0, np.zeros(0, bool)
        slots_of = np.zeros((0, 4), np.uint64)
        ids = points = sizes = np.zeros(0, np.int64)
    words = _digest_words(new["digest"])
    new_ids, new_points, new_sizes = (new[k].to_numpy().astype(np.int64) for k in ("id", "points", "size"))
    slot = find_slots(words, levels, bitmap)
    member = slot >= 0
    member[member] = (slots_of[slot[member]] == words[member]).all(axis=1)
    s = slot[member]
    # each slot is met once at most: new digests are distinct
    better = (new_points[member] > points[s]) | ((new_points[member] == points[s]) & (new_ids[member] < ids[s]))
    ids[s] = np.where(better, new_ids[member], ids[s])
    points[s] = np.where(better, new_points[member], points[s])
    sizes[s] = sizes[s] + new_sizes[member]
    alone = ~member
    raw = slots_of.tobytes() + words[alone].tobytes()
    return pa.table({
        "digest": pa.array([raw[i:i + 32] for i in range(0, len(raw), 32)], pa.binary()),
        "keep_id": np.concatenate([ids, new_ids[alone]]), "keep_points": np.concatenate([points, new_points[alone]]),
        "group_size": np.concatenate([sizes, new_sizes[alone]]),
        "in_history": np.concatenate([np.ones(n, bool), np.zeros(int(alone.sum()), bool)])})


# ------------------------------------------------------------ the operator
def digests(docs: DataFrame) -> DataFrame:
    """(id, points, digest): code points of the text and SHA-256 of the text
    without the characters of ``[\\x20\\x09-\\x0D]``; null reads as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    return docs.select(id_key().alias("id"), F.char_length(text).cast("long").alias("points"),
                       F.unhex(F.sha2(bare, 256)).alias("digest"))


def _winners(light: DataFrame) -> DataFrame:
    """One row per digest, combined before the shuffle: winner and size."""
    best = F.min(F.struct((-F.col("points")).alias("neg"), F.col("id").alias("id")))
    return (light.groupBy("digest").agg(best.alias("b"), F.count("*").alias("size"))
            .select("digest", F.col("b.id").alias("id"), (-F.col("b.neg")).alias("points"), "size"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards).cast("long")).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of ``digests(...)`` rows, one row per shard, as a table."""
    built = (_sharded(_winners(history), shards).groupBy("shard").applyInArrow(_build_shard, INDEX))
    return stage_table(built, "mph")


def look_up(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Groups (see ``FOUND``) of the union of history and ``new`` digests."""
    return (_sharded(_winners(new), shards).groupBy("shard")
            .cogroup(index.groupBy("shard")).applyInArrow(_look_up, FOUND))


def dedup(docs: DataFrame, is_history=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256,
    in_history.

    ``is_history`` is a condition on ``id``; left out, ids up to the middle of
    the id range are the history.  The choice splits work only: of equal texts
    the one with most code points, then the smallest doc_id, stays, whichever
    side it is on.  Null text counts as empty; a null doc_id is smaller than
    any other; rows that repeat the kept doc_id and length all stay; an empty
    table gives no rows; other columns are not read.
    """
    light = stage_table(digests(docs), "digests")
    facts = light.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).first()
    if is_history is None:
        middle = 0 if facts["lo"] is None else (max(facts["lo"], -(2**62)) + facts["hi"]) // 2
        is_history = F.col("id") <= F.lit(middle)
    shards = max(partitions(docs.sparkSession), -(-facts["n"] // SHARD_DIGESTS))
    index = build_index(light.filter(is_history), shards)
    groups = look_up(light.filter(~is_history), index, shards)
    return light.join(groups, "digest").select(
        id_out("id").alias("doc_id"), id_out("keep_id").alias("keep_id"), "group_size",
        ((F.col("id") == F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "in_history")
