"""Repeated passages by fixed-block anchors (operator 5).

A window of W words always holds a whole reference block: one of the
non-overlapping blocks of b <= (W + 1) / 2 words that start at every b-th word
of a document.  So if two windows are equal, each has a rolling b-word probe
that equals a reference block of the other.  The steps:

1. Documents are packed into chunk files of words in the shared folder.
2. All rolling probes are looked up in the index of all reference blocks.  A
   probe hits if its words are a reference block and occur twice at least.
3. Hits are extended: windows around a hit are the only ones that can repeat.
   For each, the first place (smallest doc_id, then position) is found.
4. Words under any window that is not the first of its kind are removed; runs
   of such windows are the maximal exact repeats.

Steps 2 and 3 shuffle hashes, not text: each chunk sends its distinct hashes,
packed and cut into hash ranges, and gets a bit for each back.  A passage that
is in every document is sent once by each chunk, so no key is hot, and no pairs
are ever listed.  Probe hashes are cut to the range and 32 bits, which can only
let too many windows on to step 3; windows compare by 80 bits and the range.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, id_key, id_out, new_folder, partitions, shared_fs, small_batches, stage_table

WINDOW = 20
#: Bytes of text in a chunk (more only where one document is longer); a task
#: holds some 15 times as much.
CHUNK_BYTES = 4 << 20
#: Chunks that a task works on, on average.
CHUNKS_PER_TASK = 4
#: Words whose hashes one range gets, on average.
RANGE_WORDS = 4_000_000

CHUNKS = "chunk long, path string, at long, size long, words long"
PACKED = "bucket int, chunk long, payload binary"
BITS = "bucket int, chunk long, bits binary"
REMOVED = "id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:int,stop:int>>"

_U = np.uint64


def block_words(window: int) -> int:
    """Longest block that every window is sure to hold whole."""
    if window < 2:
        raise ValueError("a window has two words at least")
    return (window + 1) // 2


# --------------------------------------------------------------- hashes
@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240605).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


_BASE = 0x9E3779B97F4A7C15
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**k and its inverse (modulo 2**64) for k < n."""
    if _POWERS["n"] < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.cumprod(p)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of a chunk: documents joined by newlines, words by spaces."""

    def __init__(self, raw: bytes):
        size = struct.unpack("<Q", raw[:8])[0]
        self.ids = np.frombuffer(raw[8:8 + 8 * size], np.int64)
        self.text = raw[8 + 8 * size:]
        buf = np.frombuffer(self.text, np.uint8)
        gap = (buf == 32) | (buf == 10)  # other control characters belong to words
        edge = np.flatnonzero(gap)
        starts = np.concatenate([[0], edge + 1])
        ends = np.concatenate([edge, [len(buf)]])
        real = ends > starts  # an empty document has an empty word
        line = np.concatenate([[0], np.cumsum(buf[edge] == 10)])
        self.starts, self.ends, self.doc = starts[real], ends[real], line[real]
        self.count = np.bincount(self.doc, minlength=size)[:size]
        self.first = np.cumsum(self.count) - self.count
        self.bounds = np.concatenate([[-1], np.flatnonzero(buf == 10), [len(buf)]])

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        buf = np.frombuffer(self.text, np.uint8)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _powers(len(buf) + 1)
        with np.errstate(over="ignore"):
            sums = np.cumsum(_byte_codes()[buf] * up[:len(buf)])
            before = np.where(self.starts > 0, sums[self.starts - 1], _U(0))
            return _mix((sums[self.ends - 1] - before) * down[self.starts])

    def runs(self, width: int) -> np.ndarray:
        """Which words start a run of ``width`` words of one document."""
        left = np.repeat(self.first + self.count, self.count) - np.arange(len(self.doc))
        return left >= width

    def document(self, k: int) -> bytes:
        return self.text[self.bounds[k] + 1:self.bounds[k + 1]]


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` words from each word on (rubbish near the end)."""
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(width, np.uint64)])
        h = np.zeros(len(words), np.uint64)
        for k in range(width):
            h = h * _U(0xD6E8FEB86659FD93) + padded[k:k + len(words)]
        return _mix(h)


def probes(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each probe, the word it starts at, whether it is a block)."""
    at = np.flatnonzero(words.runs(block))
    place = at - words.first[words.doc[at]]
    return rolled(words.hashes(), block)[at], at, place % block == 0


def window_keys(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, 16 more bits) of the window from each word on."""
    block = block_words(window)
    h = rolled(words.hashes(), block)
    rest = window - block  # the second block ends the window; the two may overlap by a word
    ahead = np.concatenate([h[rest:], np.zeros(min(rest, len(h)), np.uint64)])
    with np.errstate(over="ignore"):
        return (_mix(h * _U(0xA24BAED4963EE407) + ahead),
                (_mix(ahead * _U(0x9FB21C651E98DF25) ^ h) >> _U(48)).astype(np.uint16))


def _cut(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each hash range begins among sorted hashes, and the end."""
    bucket = ((sorted_hashes >> _U(32)) * _U(buckets)) >> _U(32)
    return np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))


# --------------------------------------------------------------- chunks
def write_chunks(docs: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pack (id, text) rows into chunk files; returns the committed list."""
    def run(batches):
        part, seq, rows, file = TaskContext.get().partitionId(), 0, [], None
        fs, root = shared_fs(folder)
        name = f"{part:06d}-{uuid.uuid4().hex}.words"  # no other attempt uses it
        held, size = [], 0

        def flush():
            nonlocal file, size, seq
            if file is None:
                fs.create_dir(root, recursive=True)
                file = fs.open_output_stream(f"{root}/{name}", compression=None)
            held.sort(key=lambda x: x[0])  # places in a chunk are in order of doc_id
            raw = struct.pack("<Q", len(held)) + np.array([i for i, _ in held], np.int64).tobytes()
            data = zstandard.compress(raw + b"\n".join(t for _, t in held), 3)
            rows.append(((part << 32) + seq, f"{folder}/{name}", file.tell(), len(data),
                         sum(t.count(b" ") + 1 for _, t in held if t)))
            file.write(data)
            held.clear()
            size, seq = 0, seq + 1

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
                held.append((doc, b" ".join(text.split())))  # splits at x20, x09-x0D
                size += len(held[-1][1]) + 9
                if size >= chunk_bytes:
                    flush()
        if held:
            flush()
        if file is not None:
            file.close()
        if rows:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             ["chunk", "path", "at", "size", "words"])

    return stage_table(docs.mapInArrow(run, CHUNKS), "chunks")


def read_chunk(path: str, at: int, size: int) -> Words:
    fs, name = shared_fs(path)
    with fs.open_input_file(name) as f:
        f.seek(at)
        return Words(zstandard.decompress(f.read(size)))


def _chunk_of(table: pa.Table) -> tuple[int, Words]:
    row = table.to_pylist()[0]
    return row["chunk"], read_chunk(row["path"], row["at"], row["size"])


def _packed(chunk: int, buckets: list[int], payloads: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "chunk": pa.array([chunk] * len(buckets), pa.int64()),
                     "payload": pa.array(payloads, pa.binary())})


# --------------------------------------------------- step 2: probes
def send_probes(words: Words, block: int, buckets: int) -> tuple[list[int], list[bytes]]:
    """The chunk's distinct probes by hash range: 32 bits of hash each, and
    whether it occurs again in the chunk, and whether it is a block."""
    h, _, is_block = probes(words, block)
    distinct, count = np.unique(h, return_counts=True)
    blocks = np.zeros(len(distinct), bool)
    blocks[np.searchsorted(distinct, np.unique(h[is_block]))] = True
    low, cut = distinct.astype(np.uint32), _cut(distinct, buckets)
    again = count > 1
    full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
    return full, [low[cut[b]:cut[b + 1]].tobytes() + np.packbits(again[cut[b]:cut[b + 1]]).tobytes()
                  + np.packbits(blocks[cut[b]:cut[b + 1]]).tobytes() for b in full]


def _entries(payload: bytes, size: int, flag_bits: int) -> int:
    """Number of entries of ``size`` bytes and ``flag_bits`` packed flags."""
    n = len(payload) * 8 // (8 * size + flag_bits)
    while n and n * size + flag_bits * (-(-n // 8)) > len(payload):
        n -= 1
    while (n + 1) * size + flag_bits * (-(-(n + 1) // 8)) <= len(payload):
        n += 1
    return n


def meet_probes(payloads: list[bytes]) -> list[bytes]:
    """For one hash range: which probes are blocks that occur twice."""
    sizes = [_entries(p, 4, 2) for p in payloads]
    low = np.concatenate([np.frombuffer(p, np.uint32, n) for p, n in zip(payloads, sizes)])
    flags = [np.frombuffer(p, np.uint8, offset=4 * n) for p, n in zip(payloads, sizes)]
    again = np.concatenate([np.unpackbits(f[:-(-n // 8)], count=n) for f, n in zip(flags, sizes)])
    block = np.concatenate([np.unpackbits(f[-(-n // 8):], count=n) for f, n in zip(flags, sizes)])
    order = np.argsort(low, kind="stable")
    ordered = low[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.cumsum(new) - 1
    total = np.bincount(group, 1 + again[order].astype(np.int64))
    hit = (np.bincount(group, block[order]) > 0) & (total >= 2)
    out = np.zeros(len(low), bool)
    out[order] = hit[group]
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def candidates(words: Words, window: int, buckets: int, bits: dict[int, bytes]) -> np.ndarray:
    """First words of the windows that hold a probe that hit."""
    block = block_words(window)
    h, at, _ = probes(words, block)
    distinct, inverse = np.unique(h, return_inverse=True)
    cut = _cut(distinct, buckets)
    hit = np.concatenate([np.zeros(0, bool)] + [
        np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(cut[b + 1] - cut[b])).astype(bool)
        for b in range(buckets) if cut[b + 1] > cut[b]])
    marks = np.zeros(len(words.doc) + 1, np.int64)
    if len(at):
        marks[at[hit[inverse]] + 1] = 1
    hits = np.cumsum(marks)  # hits before each word
    starts = np.flatnonzero(words.runs(window))
    return starts[hits[starts + window - block + 1] > hits[starts]]


# --------------------------------------------------- step 3: windows
_WINDOW_ENTRY = 8 + 2 + 8 + 4


def chunk_windows(words: Words, window: int, buckets: int, bits: dict[int, bytes]):
    """(candidates, their place among distinct hashes, hashes, more bits, the
    first candidate of each hash)."""
    at = candidates(words, window, buckets, bits)
    key, more = window_keys(words, window)
    distinct, first, inverse = np.unique(key[at], return_index=True, return_inverse=True)
    return at, inverse, distinct, more[at[first]], first


def send_windows(words: Words, window: int, buckets: int, bits: dict[int, bytes]) -> tuple[list[int], list[bytes]]:
    """The chunk's distinct candidate windows and the first place of each."""
    at, _, distinct, more, first = chunk_windows(words, window, buckets, bits)
    place = at[first]
    ids = words.ids[words.doc[place]]
    inside = (place - words.first[words.doc[place]]).astype(np.uint32)
    cut = _cut(distinct, buckets)
    full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
    parts = [slice(cut[b], cut[b + 1]) for b in full]
    return full, [distinct[s].tobytes() + ids[s].tobytes() + inside[s].tobytes() + more[s].tobytes() for s in parts]


def meet_windows(payloads: list[bytes], chunks: list[int]) -> list[bytes]:
    """For one hash range: which windows have an earlier place elsewhere."""
    sizes = [len(p) // _WINDOW_ENTRY for p in payloads]

    def column(kind, offset):
        return np.concatenate([np.frombuffer(p, kind, n, offset * n) for p, n in zip(payloads, sizes)])

    key, ids, inside, more = (column(np.uint64, 0), column(np.int64, 8), column(np.uint32, 16), column(np.uint16, 20))
    order = np.lexsort((np.repeat(chunks, sizes), inside, ids, more, key))
    k, m = key[order], more[order]
    later = np.concatenate([[False], (k[1:] == k[:-1]) & (m[1:] == m[:-1])])
    out = np.zeros(len(key), bool)
    out[order] = later
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


# --------------------------------------------------- step 4: removal
def removed_words(words: Words, window: int, buckets: int, probe_bits: dict, window_bits: dict) -> np.ndarray:
    """Which words are under a window whose words also start earlier."""
    at, inverse, distinct, _, first = chunk_windows(words, window, buckets, probe_bits)
    cut = _cut(distinct, buckets)
    later = np.concatenate([np.zeros(0, bool)] + [
        np.unpackbits(np.frombuffer(window_bits[b], np.uint8), count=int(cut[b + 1] - cut[b])).astype(bool)
        for b in range(buckets) if cut[b + 1] > cut[b]])
    repeat = np.ones(len(at), bool)
    repeat[first] = later
    steps = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(steps, at[repeat], 1)
    np.add.at(steps, at[repeat] + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _documents(words: Words, gone: np.ndarray, with_text: bool) -> pa.Table:
    lost = np.bincount(words.doc, gone, minlength=len(words.ids)).astype(np.int64)
    shas, kept, spans = [], [], []
    for k in range(len(words.ids)):
        text, cuts = words.document(k), []
        if lost[k]:
            mine = gone[words.first[k]:words.first[k] + words.count[k]]
            text = b" ".join(w for w, g in zip(text.split(b" "), mine.tolist()) if not g)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
            cuts = [{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)] if with_text else []
        shas.append(hashlib.sha256(text).hexdigest())
        kept.append(text.decode() if with_text else None)
        spans.append(cuts if with_text else None)
    return pa.table({
        "id": pa.array(words.ids, pa.int64()), "n_words": pa.array(words.count, pa.int64()),
        "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(shas, pa.string()),
        "kept": pa.array(kept, pa.string()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))})


# ----------------------------------------------------------- the operator
def _answers(packed: DataFrame, meet) -> DataFrame:
    """One group per hash range, a row per chunk in it: packed hashes in, a
    bit for each of them out.  A range holds ``RANGE_WORDS`` on average and
    hashes are distinct within a chunk, so no range is hot."""
    def run(table: pa.Table) -> pa.Table:
        return pa.table({"bucket": table["bucket"], "chunk": table["chunk"],
                         "bits": pa.array(meet(table["payload"].to_pylist(), table["chunk"].to_pylist()), pa.binary())})
    return packed.groupBy("bucket").applyInArrow(run, BITS)


def _bits(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table["bucket"].to_pylist(), table["bits"].to_pylist()))


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True,
          chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space) and, with text, kept and the removed spans
    of words.

    A null text has no words, as an empty one; a null doc_id is smaller than
    any other; rows that repeat a doc_id are documents of their own, one of
    which counts as earlier; texts under ``window`` words lose nothing; an
    empty table gives no rows; other columns are not read.
    """
    spark, block = docs.sparkSession, block_words(window)
    small_batches(spark)
    rows = docs.select(id_key().alias("id"), F.col("text"))
    chunks = write_chunks(rows, new_folder(spark, "words"), chunk_bytes)
    facts = chunks.agg(F.sum("words").alias("words"), F.count("*").alias("n")).first()
    buckets = max(partitions(spark), -(-(facts["words"] or 0) // RANGE_WORDS))
    # the work of a chunk is in its file, not in the bits it gets, so partitions
    # are counted in chunks and stay as they are
    parts = max(partitions(spark), -(-facts["n"] // CHUNKS_PER_TASK))

    def probe(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = read_chunk(row["path"], row["at"], row["size"])
                yield from _packed(row["chunk"], *send_probes(words, block, buckets)).to_batches()

    listed = chunks.select("chunk", "path", "at", "size")
    by_chunk = listed.repartition(parts, "chunk")
    sent = by_chunk.mapInArrow(probe, PACKED)
    hits = stage_table(_answers(sent, lambda payloads, _: meet_probes(payloads)), "probe-hits")

    def extend(chunk: pa.Table, found: pa.Table) -> pa.Table:
        if not chunk.num_rows or not found.num_rows:
            return _packed(0, [], [])
        number, words = _chunk_of(chunk)
        return _packed(number, *send_windows(words, window, buckets, _bits(found)))

    extended = (by_chunk.groupBy("chunk").cogroup(hits.repartition(parts, "chunk").groupBy("chunk"))
                .applyInArrow(extend, PACKED))
    later = _answers(extended, meet_windows)
    both = (hits.withColumn("kind", F.lit(0)).unionByName(later.withColumn("kind", F.lit(1))))

    def remove(chunk: pa.Table, found: pa.Table) -> pa.Table:
        _, words = _chunk_of(chunk)
        kind = found["kind"].to_numpy() if found.num_rows else np.zeros(0, np.int32)
        if (kind == 0).any():
            gone = removed_words(words, window, buckets, _bits(found.filter(pa.array(kind == 0))),
                                 _bits(found.filter(pa.array(kind == 1))))
        else:  # no document has as many words as a block
            gone = np.zeros(len(words.doc), bool)
        return _documents(words, gone, with_text)

    out = (by_chunk.groupBy("chunk").cogroup(both.repartition(parts, "chunk").groupBy("chunk"))
           .applyInArrow(remove, REMOVED))
    columns = ["n_words", "n_removed", "kept_sha256", *(["kept", "spans"] if with_text else [])]
    return out.select(id_out("id").alias("doc_id"), *columns)
