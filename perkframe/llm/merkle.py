"""Merkle manifest of a dataset with a proof per row (operator 12).

Every row is a leaf.  The rows of a language make a binary tree in order of
doc_id, its subroots (in order of language) another one on top.  Digests are
SHA-256 over the concatenated hex digests of a node's children; a last node
without a partner becomes the digest of itself.

Trees are built in blocks of ``2**TIER`` neighbouring nodes, one bounded group
each, and again in blocks of what those leave, so 2**36 leaves take three
rounds.  Proofs come from pointer jumping: each node holds the steps (siblings
with their side) from itself to an ancestor, at first its parent.  A self-join
gives it the steps that its ancestor holds and doubles the distance; after
log2(depth) joins every leaf has its path to the root.  In the join of distance
d only nodes at odd multiples of d are looked up, so the looked-up side shrinks
from half of the leaves to a few nodes.  It is broadcast when it is counted to
be small; otherwise its keys are many and each has 2**d leaves below it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, id_out, stage_table
from .sharding import number_rows

#: Levels that one group of the build climbs.
TIER = 12
#: Looked-up rows that may be broadcast (each holds at most 64 steps of 33 bytes).
BROADCAST_ROWS = 10_000

NODES = ("tree long, level int, pos long, leaves long, digest binary, step binary, "
         "id long, tampered binary")


# ----------------------------------------------------------------- leaves
def _field(value: Column) -> Column:
    """``<UTF-8 bytes>:<value>``, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column) -> Column:
    """Digest (binary) of a row of documents with the given ``n_chars``."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def tampers(every: int) -> Column:
    """Whether the checksum of the decimal doc_id is a multiple of ``every``."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(every) == 0, F.lit(False))


def leaves(docs: DataFrame, every: int = 7) -> DataFrame:
    """(id, lang, digest, tampered): each row's leaf, and its digest with
    ``n_chars`` raised by one where it is tampered with (null elsewhere)."""
    return docs.select(
        id_key().alias("id"), F.col("lang").cast("string").alias("lang"), leaf_digest(F.col("n_chars")).alias("digest"),
        # a decimal has room for the greatest long and one
        F.when(tampers(every), leaf_digest(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("tampered"))


# ------------------------------------------------------------------ trees
def parent(left: bytes, right: bytes | None = None) -> bytes:
    """Digest of one or two children, over their hex texts."""
    return hashlib.sha256((left.hex() + (right.hex() if right else "")).encode()).digest()


def climb(table: pa.Table, tier: int = TIER) -> pa.Table:
    """All nodes above (and with) one aligned block of neighbouring nodes.
    ``step`` says how a node's parent is made; the block's top has none yet."""
    table = table.sort_by("pos")
    tree, level, first, size = (table[k][0].as_py() for k in ("tree", "level", "pos", "leaves"))
    nodes = table["digest"].to_pylist()
    here = (size + (1 << level) - 1) >> level  # nodes of this level
    up = min(tier, (here - 1).bit_length())
    out: list[tuple] = []  # level, pos, digest, step
    for k in range(up):
        for j, digest in enumerate(nodes):
            if j % 2:
                step = b"L" + nodes[j - 1]
            else:
                step = b"R" + nodes[j + 1] if j + 1 < len(nodes) else b"N"
            out.append((level + k, (first >> k) + j, digest, step))
        nodes = [parent(*nodes[j:j + 2]) for j in range(0, len(nodes), 2)]
    out += [(level + up, first >> up, digest, None) for digest in nodes]
    columns = list(zip(*out))
    above = len(out) - table.num_rows  # the first rows are the block itself
    return pa.table({
        "tree": pa.array([tree] * len(out), pa.int64()), "level": pa.array(columns[0], pa.int32()),
        "pos": pa.array(columns[1], pa.int64()), "leaves": pa.array([size] * len(out), pa.int64()),
        "digest": pa.array(columns[2], pa.binary()), "step": pa.array(columns[3], pa.binary()),
        "id": pa.array(table["id"].to_pylist() + [None] * above, pa.int64()),
        "tampered": pa.array(table["tampered"].to_pylist() + [None] * above, pa.binary())})


def build(base: DataFrame, tier: int = TIER) -> tuple[DataFrame, DataFrame]:
    """(nodes below the roots with their step, roots) of the trees over
    ``base (tree, pos, leaves, digest, id, tampered)``."""
    tops = base.withColumn("level", F.lit(0))
    parts = []
    while True:
        grown = stage_table(
            tops.groupBy("tree", F.shiftright("pos", tier).alias("block"))
            .applyInArrow(lambda table: climb(table, tier), NODES), "merkle")
        parts.append(grown)
        tops = grown.filter("step IS NULL AND shiftleft(1L, level) < leaves").drop("step")
        if tops.isEmpty():
            break
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    roots = nodes.filter("step IS NULL AND shiftleft(1L, level) >= leaves")
    return nodes.filter("step IS NOT NULL").withColumn("path", F.array("step")).drop("step"), roots


def jump(nodes: DataFrame, depth: int) -> DataFrame:
    """The bottom nodes of ``nodes`` with their ``path`` up to the root, which
    is ``depth`` levels up at most."""
    d = 1
    while d < depth:
        above = nodes.filter(F.col("level") % (2 * d) == d).select(
            F.col("tree").alias("a_tree"), F.col("level").alias("a_level"), F.col("pos").alias("a_pos"),
            F.col("path").alias("a_path"))
        if above.count() <= BROADCAST_ROWS:
            above = F.broadcast(above)
        moving = nodes.filter(F.col("level") % (2 * d) == 0)
        met = moving.join(above, (F.col("tree") == F.col("a_tree")) & (F.col("level") + d == F.col("a_level"))
                          & (F.shiftright("pos", d) == F.col("a_pos")), "left")
        # without an ancestor to look up, the path has reached the root
        path = F.concat("path", F.coalesce("a_path", F.expr("CAST(array() AS array<binary>)")))
        nodes = stage_table(met.withColumn("path", path).select(*nodes.columns), "jump")
        d *= 2
    return nodes.filter("level = 0")


def _paths(base: DataFrame, most: int, tier: int) -> tuple[DataFrame, DataFrame]:
    """(bottom nodes with their path, roots); the bottom node of a tree of one
    leaf is its root and has an empty path."""
    nodes, roots = build(base, tier)
    paths = jump(nodes, (most - 1).bit_length())
    alone = (roots.filter("level = 0").withColumn("path", F.expr("CAST(array() AS array<binary>)"))
             .select(*paths.columns))
    return paths.unionByName(alone), roots.select("tree", "digest")


def fold(path: str, leaf: str) -> Column:
    """The root that a leaf (hex) and its steps make."""
    hexed = "lower(hex(substring(s, 2)))"
    return F.expr(f"aggregate({path}, {leaf}, (acc, s) -> sha2(CASE substring(s, 1, 1) WHEN X'4C' "
                  f"THEN concat({hexed}, acc) WHEN X'52' THEN concat(acc, {hexed}) ELSE acc END, 256))")


# ----------------------------------------------------------- the operator
def manifest(docs: DataFrame, every: int = 7, tier: int = TIER) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256 (over
    the siblings from leaf to root), folded_root (from the leaf, tampered with
    where the checksum of doc_id is a multiple of ``every``), verified, and the
    path itself: per level a binary of ``L`` or ``R`` (side of the sibling) and
    its digest, or ``N`` without a sibling.

    A null in any column has a text of its own in the leaf; a null lang is a
    language and comes first; null doc_ids come first and are never tampered
    with, nor is a null n_chars; an empty text counts as zero bytes.  Rows that
    repeat a doc_id are leaves in order of their digest, equal rows are leaves
    of their own.  Texts of any length are hashed where they are read and don't
    travel.  An empty table gives no rows; other columns are not read.
    """
    numbered = number_rows(leaves(docs, every), ["lang", "id", "digest"])
    # a language's rows are neighbours: its first number and its count
    langs = numbered.groupBy("lang").agg(F.min("row_no").alias("first"), F.count("*").alias("leaves"))
    trees = stage_table(number_rows(langs, ["lang"], "tree"), "trees").withColumnRenamed("lang", "t_lang")
    facts = trees.agg(F.count("*").alias("n"), F.max("leaves").alias("most")).first()
    few = facts["n"] <= BROADCAST_ROWS
    named = F.broadcast(trees) if few else trees
    base = (numbered.join(named, F.col("lang").eqNullSafe(F.col("t_lang")))
            .select("tree", (F.col("row_no") - F.col("first")).alias("pos"), "leaves", "digest", "id", "tampered"))
    paths, subroots = _paths(base, facts["most"] or 1, tier)

    above = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"),
                            F.lit(facts["n"]).cast("long").alias("leaves"), "digest",
                            F.col("tree").alias("id"), F.lit(None).cast("binary").alias("tampered"))
    tops, roots = _paths(above, facts["n"] or 1, tier)
    tops = stage_table(tops.select(F.col("id").alias("tree"), F.col("digest").alias("subroot"),
                                   F.col("path").alias("top_path")), "tops")
    tops = tops.crossJoin(F.broadcast(roots.select(F.col("digest").alias("root"))))  # one row
    done = (paths.join(F.broadcast(tops) if few else tops, "tree")
            .withColumn("path", F.concat("path", "top_path"))
            .withColumn("start", F.lower(F.hex(F.coalesce("tampered", "digest")))))
    siblings = "array_join(transform(filter(path, s -> octet_length(s) > 1), s -> lower(hex(substring(s, 2)))), '')"
    return (done.withColumn("folded_root", fold("path", "start"))
            .select(id_out("id").alias("doc_id"), F.lower(F.hex("digest")).alias("leaf"),
                    F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"),
                    F.expr(f"sha2({siblings}, 256)").alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.lower(F.hex("root"))).alias("verified"), "path"))
