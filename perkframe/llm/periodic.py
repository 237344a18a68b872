"""Periodic runs of words by an enhanced suffix array (operator 13).

A run is a stretch of consecutive words with a smallest period q that no
neighbouring word extends.  Every run of two periods and more ends in exactly
one square ``aa`` (\\|a\\| = q) that doesn't go on to the right, a branching one:
the word after it differs from the first word of ``a``.  The two suffixes that
begin with the square's halves agree on exactly q words, so they are in
different children of the LCP interval of depth q.

1. Suffixes are sorted by prefix doubling, all documents of a batch at once (a
   word of one document never equals one of another).  Only suffixes that still
   share their prefix are sorted again, and documents without a repeat as long
   as a wanted run needs are done there.
2. For each LCP interval, every suffix i of all but its largest child asks the
   inverse suffix array whether i + depth or i - depth is in the interval too:
   those are the squares.  A suffix is in a smaller child at most log2(n) times.
3. Squares that branch are rotated left while the words agree, which makes them
   runs; a square whose half repeats a shorter one belongs to the run of that
   period.

No tree is built: intervals come from one pass over the LCP array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, id_key, id_out, small_batches

#: A run has this many words and this many periods at least.
MIN_WORDS = 24
TIMES = 3
#: Words whose suffixes are sorted together (more only in one longer document).
SORTED_WORDS = 200_000
#: Suffixes of smaller children that are looked up at once.
LOOKED_UP = 1 << 20

RUN = "struct<start:long,length:long,period:long>"
FOUND = f"id long, n_words long, runs array<{RUN}>, collapsed string"


# ---------------------------------------------------------- suffix arrays
def suffix_ranks(words: np.ndarray, end: np.ndarray, need: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words (a list of
    arrays, one place longer than ``words``), and the suffixes whose first
    ``need`` words (or a few less) occur twice.

    ``end`` is where each word's document ends.  The last array tells suffixes
    of the documents apart that have such a repeat.
    """
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.flatnonzero(new)
    rank = np.full(len(words) + 1, -1, np.int32)
    rank[order] = np.repeat(first, np.diff(np.append(first, len(words))))
    alone = new & np.concatenate([new[1:], [True]])
    levels, active, width = [rank], order[~alone], 1
    repeat = active
    while len(active):
        if width <= need:
            repeat = active
        ahead = active + width
        inside = ahead < end[active]
        key = (rank[active].astype(np.int64) << 32) + np.where(inside, rank[np.minimum(ahead, len(words))] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, active = key[by], active[by]
        group = np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(key))
        offset = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[active] += offset.astype(np.int32)
        levels.append(rank)
        active = active[~(new & np.concatenate([new[1:], [True]]))]
        width *= 2
        if width <= need:
            repeat = active
    return levels, repeat


def neighbour_lcp(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that suffix sa[k] shares with sa[k - 1]; 0 for the first."""
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(sa), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][i] == levels[level][j]
        # equal ranks: both have 2**level words more, and they agree on them
        step = same.astype(np.int64) << level
        lcp[1:] += step
        i += step
        j += step
    return lcp


def smaller_children(lcp: np.ndarray, deepest: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first, past the last, depth, interval's first, interval's last) of all
    but the largest child of each LCP interval up to ``deepest`` words deep, as
    places in the suffix array."""
    stack: list[tuple[int, int, list[int]]] = []
    for k, height in enumerate([*lcp[1:].tolist(), -1], 1):
        left = k - 1
        while stack and stack[-1][0] > height:
            depth, left, splits = stack.pop()
            if depth <= deepest:
                bounds = [left, *splits, k]
                largest = max(range(len(bounds) - 1), key=lambda c: bounds[c + 1] - bounds[c])
                for c in range(len(bounds) - 1):
                    if c != largest:
                        yield bounds[c], bounds[c + 1], depth, left, k - 1
        if height > 0:
            if stack and stack[-1][0] == height:
                stack[-1][2].append(k)
            else:
                stack.append((height, left, [k]))


# ------------------------------------------------------------------- runs
def branching_squares(words: np.ndarray, sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray,
                      times: int) -> np.ndarray:
    """(end, half) of every branching square that ``times - 2`` more equal
    halves stand before, sorted; ``isa`` has a place beyond each end."""
    n = len(words)
    found, held, size = [np.zeros((0, 2), np.int64)], [], 0

    def look_up():
        first, stop, depth, lo, hi = np.array(held, np.int64).T
        count = stop - first
        # places first..stop of every child, one after the other
        place = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
        depth, lo, hi = (np.repeat(x, count) for x in (depth, lo, hi))

        def inside(at):
            ok = (at >= 0) & (at < n)
            there = isa[np.where(ok, at, n)]
            return ok & (there >= lo) & (there <= hi)

        i = sa[place]
        for start, other in ((i, i + depth), (i - depth, i - depth)):
            good = inside(other)
            for m in range(1, times - 1):
                good &= inside(start - m * depth)
            stop_at = start + 2 * depth
            good &= (stop_at >= n) | (words[np.minimum(stop_at, n - 1)] != words[np.clip(start, 0, n - 1)])
            found.append(np.stack([stop_at[good], depth[good]], axis=1))

    for child in smaller_children(lcp, n // times):
        first, stop, *rest = child
        while first < stop:  # very large children in parts
            part = min(stop, first + LOOKED_UP - size)
            held.append((first, part, *rest))
            size += part - first
            first = part
            if size >= LOOKED_UP:
                look_up()
                held, size = [], 0
    if held:
        look_up()
    return np.unique(np.concatenate(found), axis=0)


def _rotated(words: np.ndarray, start: int, period: int) -> int:
    """Where words begin to repeat ``period`` later, going left from start."""
    step = 64
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(words[low:start] != words[low + period:start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 2
    return 0


def merged_runs(words: np.ndarray, squares: np.ndarray, min_words: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs that the squares end, by start,
    then period."""
    runs, last, here = [], -1, []
    for end, half in squares.tolist():  # by end, then half
        if end != last:
            last, here = end, []
        # a half that repeats a shorter one makes the run of that one again
        if any(half % q == 0 and end - 2 * half >= s for q, s in here):
            continue
        start = _rotated(words, end - 2 * half, half)
        here.append((half, start))
        if end - start >= max(min_words, times * half):
            runs.append((start, end - start, half))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def find_runs(documents: list[np.ndarray], min_words: int = MIN_WORDS,
              times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Runs of each document, which is an array of word codes >= 0."""
    if times < 2 or min_words < 1:
        raise ValueError("a run has two periods and a word at least")
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return out
    doc = np.repeat(np.arange(len(documents)), sizes)
    words = (doc << 32) | np.concatenate(documents).astype(np.int64)
    # a run's first two suffixes that are a period apart share this much
    need = max(1, min_words - min_words // times)
    levels, repeat = suffix_ranks(words, ends[doc], need)
    for d in np.unique(doc[repeat]).tolist():
        low, high = int(ends[d] - sizes[d]), int(ends[d])
        own = words[low:high]
        rank = levels[-1][low:high].astype(np.int64)
        sa = np.argsort(rank)
        isa = np.full(len(own) + 1, -1, np.int64)
        isa[sa] = np.arange(len(own))
        lcp = neighbour_lcp(sa + low, levels)
        if lcp.max(initial=0) < need:
            continue
        out[d] = merged_runs(own, branching_squares(own, sa, isa, lcp, times), min_words, times)
    return out


def repeated_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words any run holds after its first period."""
    marks = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return np.cumsum(marks[:n]) > 0


# ----------------------------------------------------------- the operator
class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _batch_rows(ids: list, texts: list[bytes], min_words: int, times: int) -> list[tuple]:
    codes = _Codes()
    split = [t.split() for t in texts]  # splits at x20, x09-x0D
    runs = find_runs([np.fromiter(map(codes.__getitem__, w), np.int64, len(w)) for w in split], min_words, times)
    rows = []
    for i, words, found in zip(ids, split, runs):
        n = len(words)
        if found:
            words = [w for w, gone in zip(words, repeated_words(n, found).tolist()) if not gone]
        rows.append((i, n, [{"start": a, "length": b, "period": c} for a, b, c in found], b" ".join(words)))
    return rows


def runs_table(docs: DataFrame, min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """(id, n_words, runs, collapsed) of each whole text; no shuffle."""
    kinds = [pa.int64(), pa.int64(),
             pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])), pa.string()]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), byte_list(batch.column(1))
            at = 0
            while at < len(ids):
                stop, size = at, 0
                while stop < len(ids) and (stop == at or size + len(texts[stop]) // 6 <= SORTED_WORDS):
                    size += len(texts[stop]) // 6
                    stop += 1
                rows = _batch_rows(ids[at:stop], texts[at:stop], min_words, times)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["id", "n_words", "runs", "collapsed"])
                at = stop

    return docs.select(id_key().alias("id"), F.col("text")).mapInArrow(run, FOUND)


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """One row per document: doc_id, n_words, n_runs, the run of the greatest
    length/period (start, length, period, exponent_milli; null without runs),
    runs (all, by start, then period) and collapsed, the words joined by one
    space without those that a run holds after its first period.

    Null and empty texts have no words and no runs and collapse to an empty
    text.  A text of any length is sorted in one task, which takes some 150
    bytes a word.  Of equal exponents the smallest start, then period, counts.
    Rows that repeat a doc_id are rows of their own; a null doc_id stays null;
    an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    # exact comparison of length/period by cross products
    best = F.expr("""aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>),
        (b, r) -> IF(b IS NULL OR r.length * b.period > b.length * r.period, r, b))""")
    return (runs_table(docs, min_words, times).withColumn("best", best)
            .select(id_out("id").alias("doc_id"), "n_words", F.size("runs").cast("long").alias("n_runs"),
                    "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs", "collapsed"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where one document in ten, by the checksum of its
    doc_id, repeats a stretch of its words from some word on, for measuring.

    With h = crc32(doc_id as text), g = h div 10 and n words, h % 10 = 0 sets
    word i >= a to the original word a + (i - a) % p, for a = g % n and
    p = 1 + (n - a) div (3 + g % 8).  Others, and null doc_ids, stay as they are.
    """
    planted = (docs.select("doc_id", "text")
               .withColumn("h", F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")))
               .withColumn("g", F.expr("h div 10"))
               .withColumn("w", F.expr(r"IF(h % 10 = 0, filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), "
                                       r"x -> x <> ''), NULL)"))
               .withColumn("a", F.expr("CAST(g % nullif(size(w), 0) AS INT)"))
               .withColumn("p", F.expr("CAST(1 + (size(w) - a) div (3 + g % 8) AS INT)")))
    text = F.expr("""IF(h % 10 = 0 AND size(w) > 0, array_join(transform(w, (x, i) ->
        IF(i < a, x, element_at(w, a + (i - a) % p + 1))), ' '), text)""")
    return planted.select("doc_id", text.alias("text"))
