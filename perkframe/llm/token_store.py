"""Token ids in directly addressable codes (operator 3).

An id is split into chunks of eight bits, lowest first.  Level l holds the l-th
chunk of every id that has one, and a bitmap that tells which of them go on to
the next level.  A rank directory (ones before each block of bits) gives the
place of an id's next chunk, so any token is reached without decoding others.

Files hold documents in ascending doc_id order.  Range partitions are written
by one task each, in files of bounded size; the manifest, a table that Spark
commits, lists the files that count.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_list, id_key, id_out, new_folder, partitions, shared_fs, small_batches, stage_table

MAGIC = b"DACTOK01"
CHUNK_BITS = 8
RANK_BITS = 512
#: Tokens after which a task starts a new file; bounds a task's memory.
FILE_TOKENS = 8 << 20
#: Words whose ids a task remembers, and bytes of texts that it cuts together
#: (a longer text is taken in parts).
REMEMBERED, TEXT_BYTES = 300_000, 2 << 20

MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, file_bytes long"
READ_BACK = "id long, start long, n_tokens long, ids_crc32 long"


# ----------------------------------------------------------- the codes
class Level:
    """Chunks of one level, its bitmap and rank directory."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    @staticmethod
    def of(chunks: np.ndarray, more: np.ndarray) -> Level:
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1)
        return Level(chunks, bits, (np.cumsum(ones) - ones).astype(np.uint64))

    def rank(self, i: int) -> int:
        """Ones before bit ``i``: a directory entry and one block's bits."""
        block = i // RANK_BITS
        if block >= len(self.ranks):
            return int(self.ranks[-1]) + int(np.bitwise_count(self.bitmap[-(RANK_BITS // 8):]).sum()) if len(self.ranks) else 0
        first = block * (RANK_BITS // 8)
        whole, rest = divmod(i - block * RANK_BITS, 8)
        ones = int(np.bitwise_count(self.bitmap[first:first + whole]).sum())
        if rest:
            ones += int(self.bitmap[first + whole] & ((1 << rest) - 1)).bit_count()
        return int(self.ranks[block]) + ones

    def bits(self, start: int, stop: int) -> np.ndarray:
        first = start // 8
        got = np.unpackbits(self.bitmap[first:-(-stop // 8)], bitorder="little")
        return got[start - first * 8:stop - first * 8].astype(bool)


def to_levels(ids: np.ndarray) -> list[Level]:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS != 0
        levels.append(Level.of((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), more))
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            return levels


def decode_range(levels: list[Level], start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop``; the cost does not depend on ``start``."""
    level, n = levels[0], stop - start
    ids = level.chunks[start:stop].astype(np.uint32)
    at = np.arange(n)
    for depth, following in enumerate(levels[1:], 1):
        more = level.bits(start, start + len(at))
        at = at[more]
        if not len(at):
            break
        start = level.rank(start)
        ids[at] |= following.chunks[start:start + len(at)].astype(np.uint32) << np.uint32(CHUNK_BITS * depth)
        level = following
    return ids


# ----------------------------------------------------------- the files
def pack_file(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    levels = to_levels(ids)
    head = json.dumps({"docs": len(doc_ids), "levels": [len(x.chunks) for x in levels],
                       "bitmaps": [len(x.bitmap) for x in levels]}).encode()
    out = [MAGIC, struct.pack("<Q", len(head)), head, np.array(doc_ids, np.int64).tobytes(),
           np.cumsum([0, *counts]).astype(np.uint64).tobytes()]
    for x in levels:
        out += [x.chunks.tobytes(), x.bitmap.tobytes(), x.ranks.tobytes()]
    return b"".join(out)


class TokenFile:
    """A file of documents: random access to any document or token."""

    def __init__(self, data):
        raw = np.frombuffer(data, np.uint8)
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<Q", bytes(raw[8:16]))[0]
        head = json.loads(bytes(raw[16:16 + size]))
        at = 16 + size

        def take(n, kind):
            nonlocal at
            part = np.frombuffer(raw[at:at + n * np.dtype(kind).itemsize].tobytes() if kind is not np.uint8
                                 else raw[at:at + n], kind)
            at += n * np.dtype(kind).itemsize
            return part

        self.doc_ids = take(head["docs"], np.int64)
        self.starts = take(head["docs"] + 1, np.uint64)
        self.levels = [Level(take(n, np.uint8), take(b, np.uint8), take(b * 8 // RANK_BITS, np.uint64))
                       for n, b in zip(head["levels"], head["bitmaps"])]

    @staticmethod
    def open(path: str) -> TokenFile:
        fs, name = shared_fs(path)
        if fs.type_name == "local":
            return TokenFile(np.memmap(name, np.uint8, "r"))
        with fs.open_input_file(name) as f:
            return TokenFile(f.read())

    def token(self, i: int) -> int:
        return int(decode_range(self.levels, i, i + 1)[0])

    def documents(self, tokens: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, decoded some at a time."""
        k, n = 0, len(self.doc_ids)
        starts = self.starts.astype(np.int64).tolist()
        while k < n:
            stop = k + 1
            while stop < n and starts[stop + 1] - starts[k] <= tokens:
                stop += 1
            ids = decode_range(self.levels, starts[k], starts[stop])
            for j in range(k, stop):
                yield int(self.doc_ids[j]), starts[j], ids[starts[j] - starts[k]:starts[j + 1] - starts[k]]
            k = stop


# ----------------------------------------------------------- the encoder
# What a byte of a text is part of.  The second byte of a letter from U+00C0 to
# U+00FF counts as a letter; other characters beyond ASCII, controls and
# apostrophes (contractions are pre-tokens) make their whole word an odd one.
_SPACE, _LETTER, _SIGN, _DIGIT, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
_KIND[ord("'")] = _ODD
_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def _chars_of_bytes() -> str:
    """The character that stands for each byte in a byte-level vocabulary: its
    own in Latin-1 if that is printable, else the next one from 256 on.  A space
    stays, it parts the pieces."""
    chars, following = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            chars.append(chr(b))
        else:
            chars.append(" " if b == 32 else chr(following))
            following += 1
    return "".join(chars)


class WordEncoder:
    """Whole texts through the tokenizers library, one distinct piece once.

    Only for tokenizers that lower-case, drop white space and never look across
    it, as those with word ends do: then a text's ids are those of its words in
    turn.  Words of letters up to U+00FF, digits and ASCII signs are cut into
    their pre-tokens (runs of letters, runs of signs, single digits), which go
    to the library's model; any other word goes through all of the library.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.parted = Tokenizer(self.model)  # for pre-tokens, a space between them
        self.parted.pre_tokenizer = Split(" ", "removed")
        self.chars = _chars_of_bytes()
        # only the last token of a pre-token has the word's end
        suffix, vocab = self.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.is_last = np.zeros(1 + max(vocab.values()), bool)
        if suffix:
            self.is_last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.end = struct.pack("<I", end_id)
        self.known: dict[str, bytes] = {}

    def _pre_tokens(self, pieces: list[str]) -> list[bytes]:
        """Ids of (lower-cased) pre-tokens."""
        out = []
        for a in range(0, len(pieces), 4096):
            part = pieces[a:a + 4096]
            mapped = codecs.charmap_decode(" ".join(part).encode(), "strict", self.chars)[0]
            ids = np.array(self.parted.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, np.uint32)
            ends = ((np.flatnonzero(self.is_last[ids]) + 1) * 4).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                out += [raw[i:j] for i, j in zip([0, *ends], ends)]
            else:  # a vocabulary without word ends
                out += [np.array([t.id for t in self.model.tokenize(x)], np.uint32).tobytes() for x in mapped.split(" ")]
        return out

    def _odd_words(self, words: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(words), 4096):
            coded = self.tokenizer.encode_batch_fast(words[a:a + 4096], add_special_tokens=False)
            out += [np.array(x.ids, np.uint32).tobytes() for x in coded]
        return out

    def _ids_of(self, pieces: list[str], odd: np.ndarray) -> list[bytes]:
        known = self.known
        coded = list(map(known.get, pieces))
        new = [k for k, x in enumerate(coded) if x is None]
        if len(known) + len(new) > REMEMBERED:
            # what was used just now is likely to be used again
            known.clear()
            known.update((w, x) for w, x in zip(pieces, coded) if x is not None)
        is_odd = odd[new].tolist()
        for some, encode in (([k for k, x in zip(new, is_odd) if not x], self._pre_tokens),
                             ([k for k, x in zip(new, is_odd) if x], self._odd_words)):
            words = [pieces[k] for k in some]
            found = encode(words)
            known.update(zip(words, found))
            for k, x in zip(some, found):
                coded[k] = x
        return coded

    def _cut(self, raw: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pre-tokens (lower-cased) and odd words of the texts that begin at
        ``starts``: the pieces, where they begin, and which are odd words."""
        kind = _KIND[raw]
        after_c3 = raw[:-1] == 0xC3
        # the signs of U+00D7 and U+00F7, and special tokens
        kind[1:][after_c3 & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))] = _ODD
        kind[1:][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = _ODD
        body = kind != _SPACE
        cut = kind == _DIGIT
        cut[1:] |= kind[1:] != kind[:-1]
        cut[starts] = True
        at = np.flatnonzero(cut & body)
        begins = kind[at - 1] == _SPACE  # a word
        begins[:1] = True
        begins[np.searchsorted(at, starts[body[starts]])] = True
        word = np.cumsum(begins) - 1
        odd = np.zeros(len(at), bool)
        odd[word[kind[at] == _ODD]] = True
        odd = odd[word]
        kept = begins | ~odd
        at, odd = at[kept], odd[kept]
        upper = (raw - np.uint8(65)) < 26
        upper[1:] |= after_c3 & ((raw[1:] - np.uint8(0x80)) < 0x1F)
        if odd.any():  # those stay as they are
            upper[at[0]:] &= ~np.repeat(odd, np.diff(at, append=len(raw)))
        lower = raw + (upper.view(np.uint8) << 5)
        ends = np.cumsum(body, dtype=np.int32)
        offsets = np.append(ends[at] - 1, ends[-1:]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(lower[body]))
        return pieces, at, odd

    def _encode(self, raw: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of the texts between ``bounds``."""
        starts = bounds[:-1]
        cut, at, is_odd = self._cut(raw, starts[starts < len(raw)])
        cut = cut.dictionary_encode()
        pieces, number = cut.dictionary.to_numpy(zero_copy_only=False).tolist(), cut.indices.to_numpy()
        odd = np.zeros(len(pieces), bool)
        odd[number[is_odd]] = True
        coded = [*self._ids_of(pieces, odd), self.end]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        starts = np.cumsum(sizes) - sizes
        # the pieces of each text by their numbers, and the end id after them
        ends = np.searchsorted(at, bounds[1:])
        order = np.insert(number, ends, len(pieces))
        ends += np.arange(len(ends))
        # the ids of every piece, one piece after the other
        sizes, starts = sizes[order], starts[order]
        until = np.cumsum(sizes)
        place = np.arange(until[-1]) + np.repeat(starts - (until - sizes), sizes)
        ids = np.frombuffer(b"".join(coded), np.uint32)[place].tobytes()
        cuts = (until[ends] * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *cuts], cuts)]

    def _encode_long(self, text: bytes) -> bytes:
        """Ids of a text, some words at a time."""
        out, start = [], 0
        while start < len(text):
            space = _SPACES.search(text, start + TEXT_BYTES)
            stop = space.start() if space else len(text)
            raw = np.frombuffer(text, np.uint8)[start:stop]
            out.append(self._encode(raw, np.array([0, len(raw)]))[0][:-len(self.end)])
            start = stop
        return b"".join([*out, self.end])

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, and the end id, as unsigned 32-bit integers."""
        ends = np.cumsum([0, *map(len, texts)])
        out, start = [], 0
        while start < len(texts):
            if len(texts[start]) > TEXT_BYTES:
                out.append(self._encode_long(texts[start]))
                start += 1
                continue
            stop = int(np.searchsorted(ends, ends[start] + TEXT_BYTES, "right")) - 1
            raw = np.frombuffer(b"".join(texts[start:stop]), np.uint8)
            out += self._encode(raw, ends[start:stop + 1] - ends[start])
            start = stop
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return WordEncoder(path, end_id)


# ----------------------------------------------------------- the operator
def write_tokens(docs: DataFrame, vocab_path: str, end_id: int, folder: str,
                 file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the tokens of ``docs`` in ascending doc_id order; returns the
    manifest (see ``MANIFEST``), ordered by (part, seq)."""
    ordered = (docs.select(id_key().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange("id").sortWithinPartitions("id", "text"))

    def run(batches):
        part = TaskContext.get().partitionId()
        encoder = word_encoder(vocab_path, end_id)
        fs, root = shared_fs(folder)
        fs.create_dir(root, recursive=True)
        rows, doc_ids, coded, held = [], [], [], 0

        def flush():
            data = pack_file(doc_ids, [len(x) // 4 for x in coded], np.frombuffer(b"".join(coded), np.uint32))
            name = f"{part:06d}-{len(rows):06d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            rows.append((part, len(rows), f"{folder}/{name}", len(doc_ids), held, len(data)))
            doc_ids.clear()
            coded.clear()

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), encoder.encode_all(byte_list(batch.column(1)))):
                doc_ids.append(doc)
                coded.append(x)
                held += len(x) // 4
                if held >= file_tokens:
                    flush()
                    held = 0
        if doc_ids:
            flush()
        if rows:  # one row per file of bounded size
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             ["part", "seq", "path", "n_docs", "n_tokens", "file_bytes"])

    return stage_table(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the listed files (see ``READ_BACK``)."""
    # one row per file; what comes before a file is a sum over files
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for doc, start, ids in TokenFile.open(path).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 ["id", "start", "n_tokens", "ids_crc32"])

    return based.repartition(partitions(manifest.sparkSession)).mapInArrow(run, READ_BACK)


def round_trip(docs: DataFrame, vocab_path: str, end_id: int = 2) -> DataFrame:
    """Write the token files and read them back: doc_id, start (ids of all
    documents before it), n_tokens (with the end id), ids_crc32.

    Null and empty texts have the end id only; a null doc_id comes first; rows
    that repeat a doc_id follow each other in order of their texts; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    manifest = write_tokens(docs, vocab_path, end_id, new_folder(spark, "tokens"))
    return read_tokens(manifest).select(id_out("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
