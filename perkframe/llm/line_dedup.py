"""Line deduplication by pairwise alignment (operator 6).

1. Lines are hashed.  The blocks of a document are its shortest runs of
   successive lines that have ``MIN_CHARS`` characters, from each line on and
   back from each line, and its runs of two lines.
2. Each document is paired with the first document (smallest id) that has one
   of its blocks, however often it occurs: one partner per block, never all
   pairs of a group.  Whatever is deleted holds such a block, and whoever else
   has parts of it, the first document that has it whole is a partner.
3. The common lines of a pair are aligned by patience diff: lines that both
   hold exactly once, the longest increasing chain of them, its extension over
   equal neighbouring lines, and the same again inside each gap that is left.
4. Aligned blocks of enough characters are deleted from the later document.

Blank lines take no part: they are neither matched nor deleted.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, free_name, id_key, small_batches, stage_table

#: Documents that may have a line for it to name a partner by itself; None for
#: any number.
MAX_DF = None
#: Characters that an aligned block must have to be deleted.
MIN_CHARS = 40

#: ``at``: places of the lines that aren't blank among all lines; ``chars``: their
#: lengths; ``lines``: 16-byte hashes of them, one after another; ``blocks``:
#: distinct 128-bit hashes of blocks, and whether it is one line.
LINES = ("id long, t long, at array<int>, chars array<int>, lines binary, "
         "blocks array<struct<x:long,y:long,alone:boolean>>")
_BLOCK = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64()), ("alone", pa.bool_())]))
_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]*")


def block_ends(chars: list[int], min_chars: int) -> list[tuple[int, int]]:
    """(first, past the last line) of the blocks: shortest runs with
    ``min_chars`` characters from each line on and back from each line, and
    runs of two lines."""
    total = np.concatenate([[0], np.cumsum(chars)])
    n, found = len(chars), set()
    stops = np.searchsorted(total, total[:-1] + min_chars)  # first end with enough, from each line on
    found.update((k, int(e)) for k, e in enumerate(stops.tolist()) if e <= n)
    starts = np.searchsorted(total, total[1:] - min_chars, "right") - 1  # last start with enough
    found.update((int(b), k + 1) for k, b in enumerate(starts.tolist()) if b >= 0)
    found.update((k, k + 2) for k in range(n - 1))
    return sorted(found)


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row (see ``LINES``) per row of ``docs``; ``t`` is a hash of the text."""
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
                found = [(k, x) for k, x in enumerate(text.split(b"\n")) if not _BLANK.fullmatch(x)]
                hashes = [xxhash.xxh128_digest(x) for _, x in found]
                chars = [len(x.decode()) for _, x in found]
                blocks = {xxhash.xxh128_digest(b"".join(hashes[a:b])): b - a == 1
                          for a, b in block_ends(chars, min_chars)}
                names = np.frombuffer(b"".join(blocks), np.int64).reshape(-1, 2).tolist()
                rows.append((doc, xxhash.xxh64_intdigest(text) - (1 << 63), [k for k, _ in found], chars, b"".join(hashes),
                             [{"x": x, "y": y, "alone": alone} for (x, y), alone in zip(names, blocks.values())]))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), _BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             ["id", "t", "at", "chars", "lines", "blocks"])

    return docs.select(id_key().alias("id"), F.col("text")).mapInArrow(run, LINES)


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of (a, b) pairs that rises on both sides; no two pairs
    share an a or a b."""
    pairs = sorted(pairs)
    tails, tail_b, back = [], [], [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tail_b, b)
        back[k] = tails[at - 1] if at else -1
        if at == len(tails):
            tails.append(k)
            tail_b.append(b)
        else:
            tails[at], tail_b[at] = k, b
    chain, k = [], tails[-1] if tails else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def aligned_blocks(common: list[tuple[list[int], list[int]]]) -> list[list[int]]:
    """Blocks of the later document's lines, from each common line's places
    (in the earlier, in the later document).

    The chain is made of lines that occur once on either side; where there is
    none, the first places of each common line serve, the second ones, and so
    on.  A block grows up and down while the neighbours are equal lines, up to
    the next link of the chain.  The same is done again in each gap that is
    left before, between and after the links, with the lines that occur once
    in that gap, until the gaps have no line in common.
    """
    line_a = {p: k for k, (a, _) in enumerate(common) for p in a}
    line_b = {p: k for k, (_, b) in enumerate(common) for p in b}
    at_a, at_b = sorted(line_a), sorted(line_b)
    taken_a, taken_b, found = set(), set(), []

    def equal(a, b):
        return a in line_a and line_a[a] == line_b.get(b, -1) and a not in taken_a and b not in taken_b

    gaps = [(0, len(at_a), 0, len(at_b))]  # slices of at_a and at_b
    while gaps:
        from_a, to_a, from_b, to_b = gaps.pop()
        here: dict[int, tuple[list[int], list[int]]] = {}
        for p in at_a[from_a:to_a]:
            here.setdefault(line_a[p], ([], []))[0].append(p)
        for p in at_b[from_b:to_b]:
            if line_b[p] in here:
                here[line_b[p]][1].append(p)
        unique = [(a[0], b[0]) for a, b in here.values() if len(a) == len(b) == 1]
        chain = patience(unique or [pair for a, b in here.values() for pair in zip(a, b)])
        for a, b in chain:
            taken_a.add(a)
            taken_b.add(b)
        links = list(chain)
        for a, b in chain:
            for step in (-1, 1):
                x, y = a + step, b + step
                while equal(x, y):
                    taken_a.add(x)
                    taken_b.add(y)
                    links.append((x, y))
                    x, y = x + step, y + step
        found += links
        for x, y in sorted(links):
            end_a, end_b = bisect_left(at_a, x), bisect_left(at_b, y)
            if from_a < end_a and from_b < end_b:
                gaps.append((from_a, end_a, from_b, end_b))
            from_a, from_b = end_a + 1, end_b + 1
        if links and from_a < to_a and from_b < to_b:
            gaps.append((from_a, to_a, from_b, to_b))
    blocks, before = [], None
    for x, y in sorted(found, key=lambda p: p[1]):
        if before == (x - 1, y - 1):
            blocks[-1].append(y)
        else:
            blocks.append([y])
        before = (x, y)
    return blocks


def common_lines(lines_a: bytes, lines_b: bytes) -> list[tuple[list[int], list[int]]]:
    """Places of each common line in both documents, from their hashes."""
    places: dict[bytes, tuple[list[int], list[int]]] = {}
    for k in range(0, len(lines_a), 16):
        places.setdefault(lines_a[k:k + 16], ([], []))[0].append(k // 16)
    for k in range(0, len(lines_b), 16):
        if (met := places.get(lines_b[k:k + 16])) is not None:
            met[1].append(k // 16)
    return [met for met in places.values() if met[1]]


def deleted_lines(lines_a: bytes, lines_b: bytes, chars_b: list[int], min_chars: int = MIN_CHARS) -> list[int]:
    """Lines that the later document b loses to the earlier document a."""
    blocks = aligned_blocks(common_lines(lines_a, lines_b))
    return sorted(p for block in blocks if sum(chars_b[p] for p in block) >= min_chars for p in block)


def deletions(docs: DataFrame, max_df: int | None = MAX_DF, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, partners, lines): places of the lines that each later document
    loses, and the earlier documents whose aligned blocks they are."""
    every = stage_table(lines_of(docs, min_chars), "lines")
    # rows that repeat an id with the same text are one document; unequal texts
    # under one id can't be told apart and take no part
    held = stage_table(
        every.groupBy("id").agg(F.min("t").alias("t"), F.max("t").alias("z"), *[
            F.first(c).alias(c) for c in ("at", "chars", "lines", "blocks")]).filter("t = z").drop("t", "z"), "held-lines")
    blocks = held.select("id", F.explode("blocks").alias("b")).select("id", "b.x", "b.y", "b.alone")
    first = (blocks.groupBy("x", "y").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("k"))
             .filter("a <> z").select("x", "y", "a", "k"))
    # written, so that the exchange of the join on a very common block is split
    first = stage_table(first, "first-blocks")
    met = blocks.join(first.hint("merge"), ["x", "y"]).filter("id <> a")
    if max_df is not None:
        met = met.filter(~F.col("alone") | (F.col("k") <= max_df))
    pairs = stage_table(met.select("a", F.col("id").alias("b")).distinct(), "line-pairs")

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, lines_a, lines_b, chars, at in zip(*(c.to_pylist() for c in batch.columns)):
                if gone := deleted_lines(lines_a, lines_b, chars, min_chars):
                    rows.append((b, a, [at[p] for p in gone]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.list_(pa.int32())])],
                    ["id", "a", "lines"])

    # a row per pair, with the lines of its two documents; a document that is
    # everyone's partner is a hot key of the first join, which is split
    later = held.select(F.col("id").alias("b"), F.col("lines").alias("lines_b"), "chars", "at")
    earlier = held.select(F.col("id").alias("a"), F.col("lines").alias("lines_a"))
    aligned = (pairs.join(earlier.hint("merge"), "a").join(later.hint("merge"), "b")
               .select("a", "b", "lines_a", "lines_b", "chars", "at")
               .mapInArrow(run, "id long, a long, lines array<int>"))
    return (aligned.select("id", "a", F.explode("lines").alias("at")).groupBy("id")
            .agg(F.sort_array(F.collect_set("a")).alias("partners"), F.sort_array(F.collect_set("at")).alias("lines")))


def line_mask(lines: str):
    """A flag per line up to the last deleted one, to be looked up by place:
    runs of kept lines and the deleted line that ends each, joined."""
    return F.expr(f"""flatten(transform({lines}, (x, k) ->
        concat(array_repeat(false, x - IF(k = 0, 0, {lines}[k - 1] + 1)), array(true))))""")


def dedup(docs: DataFrame, max_df: int | None = MAX_DF, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` and n_lines, n_removed, removed_lines, partners;
    ``text`` has lost the deleted lines (numbered without the blank ones).

    Documents are compared in order of doc_id.  Null and empty texts have no
    lines and are left as they are; a null doc_id is the first; rows that
    repeat a doc_id with the same text are one document and lose the same
    lines; unequal texts under one doc_id are left as they are and nothing is
    compared with them; a text of any length is aligned in one task, some 100
    bytes a line; an empty table gives no rows.  Columns of ``docs`` with the names above are
    replaced.
    """
    marked, mark = _marked(docs, max_df, min_chars)
    lines = F.col(f"{mark}.lines")
    return marked.withColumns({
        "n_lines": F.col(f"{mark}.n_lines"), "n_removed": _removed(mark),
        "removed_lines": lines, "partners": F.col(f"{mark}.partners")}).drop(mark)


def _removed(mark: str):
    return F.coalesce(F.size(F.col(f"{mark}.lines")), F.lit(0)).cast("long")


def _marked(docs: DataFrame, max_df: int | None, min_chars: int) -> tuple[DataFrame, str]:
    """``docs`` without the deleted lines, and the name of a column more: a
    struct (lines, partners, n_lines).  All names are ones that ``docs`` hasn't."""
    small_batches(docs.sparkSession)
    gone = stage_table(deletions(docs, max_df, min_chars), "deletions")
    key, mark = free_name(docs, "gone_id"), free_name(docs, "mark")
    gone = gone.select(F.col("id").alias(key), F.struct("lines", "partners", line_mask("lines").alias("mask")).alias(mark))
    # what is deleted grows with the corpus, so it isn't broadcast
    joined = docs.join(gone.hint("merge"), id_key() == F.col(key), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"),
                                 lambda x, i: ~F.coalesce(F.get(f"{mark}.mask", i), F.lit(False))), "\n")
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"\S"))).cast("long")
    facts = F.struct(F.col(f"{mark}.lines").alias("lines"), F.col(f"{mark}.partners").alias("partners"),
                     n_lines.alias("n_lines"))
    return (joined.withColumns({"text": F.when(F.col(f"{mark}.lines").isNull(), F.col("text")).otherwise(kept),
                                mark: facts}).drop(key)), mark


def strip(docs: DataFrame, max_df: int | None = MAX_DF, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with deleted lines gone; documents that lost their last line
    are dropped, all others keep their columns (n_chars is counted anew)."""
    marked, mark = _marked(docs, max_df, min_chars)
    removed = _removed(mark)
    out = marked.filter((removed == 0) | (removed < F.col(f"{mark}.n_lines")))
    if "n_chars" in docs.columns:
        changed = F.when(removed > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", changed.otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
