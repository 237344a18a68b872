"""Byte-level BPE with a transducer lexicon (operator 7).

The frequent words of the corpus (space-delimited pieces, counted over every
document) are compiled with their token ids into a minimal acyclic transducer:
states with equal right languages are shared, and the outputs along a word's
arcs add up to its number, which points at its ids.  The transducer is one file
in the shared folder that tasks memory-map.  Words that it doesn't hold are
split and merged exactly.  Tokenizer files are read, never trained.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import ChainMap, Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_list, id_key, id_out, new_folder, shared_fs, small_batches, stage_table

#: Words in the lexicon: the size of the feature, not of the corpus.
LEXICON_WORDS = 1 << 16
#: Longest word that the lexicon takes, in bytes; longer ones are merged.
WORD_BYTES = 64
#: Pieces and pre-tokens that a worker remembers, and words that a task counts
#: before it passes the counts on.
REMEMBERED, REMEMBERED_WORDS = 500_000, 250_000

# Fixed value: the pre-tokenizer's pattern, with white space by its property.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_SPACE = regex.compile(r"\p{White_Space}")


# --------------------------------------------------------- the vocabulary
def _byte_of_char() -> dict[str, int]:
    """The vocabulary file writes each byte as one printable character: bytes
    that are printable in Latin-1 stand for themselves, the others follow from
    256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, vocab = _byte_of_char(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in vocab.items():
            if text not in self.special:
                self.token[i] = bytes(of[c] for c in text)
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.byte_id = [0] * 256
        for c, b in of.items():
            self.byte_id[b] = vocab[c]
        # rank of a pair, under left * 2**32 + right, and the id it merges to
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        by = np.argsort(keys)
        # pairs in order of their key, the rank of each, and what a rank merges to
        self.pair_keys, self.pair_ranks = keys[by], np.arange(len(keys), dtype=np.int64)[by]
        self.merged_ids = np.array([*self.merged, 0], np.int64)
        self.byte_ids = np.array(self.byte_id, np.int64)
        sizes = np.fromiter(map(len, self.token), np.int64, len(self.token))
        self.token_ends, self.token_sizes = np.cumsum(sizes), sizes
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)
        # a merge's token is only part of merges of higher rank: all equal pairs
        # of the lowest rank may then be merged at once
        made = {m: r for r, m in reversed(list(enumerate(self.merged)))}
        self.ordered = len(made) == len(self.merged) and all(
            max(made.get(k >> 32, -1), made.get(k & 0xFFFFFFFF, -1)) < r for k, r in self.ranks.items())
        self.words: dict[str, bytes] = {}
        self.split_special = (regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
                              if self.special else None)
        self.special_bytes = [t.encode() for t in self.special]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked pair, and of equal ones the
        leftmost, is merged until no pair has a rank."""
        ids, rank_of = [self.byte_id[b] for b in word], self.ranks.get
        ranks = [rank_of(a << 32 | b, _NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NO_RANK:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [self.merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 32 | ids[i], _NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] << 32 | ids[i + 1], _NO_RANK)
        return ids

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; ``_NO_RANK`` for pairs that don't merge."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NO_RANK)

    def merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """:meth:`merge` of many words, a merge of each at a time together."""
        out: list[np.ndarray | None] = [None] * len(words)
        for k, w in enumerate(words):
            if len(w) > _LONG:
                out[k] = self.merge_long(w)
        short = [k for k in range(len(words)) if out[k] is None]
        for at in range(0, len(short), _TOGETHER):
            part = short[at:at + _TOGETHER]
            for k, ids in zip(part, self._merge_short([words[k] for k in part])):
                out[k] = ids
        return out

    def _merge_short(self, words: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        done: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        live = np.flatnonzero(sizes)
        sizes = sizes[live]
        ends = np.cumsum(sizes)
        ranks = np.full(len(ids), _NO_RANK, np.int64)  # of the pair that begins here
        ranks[:-1] = self.pair_rank(ids[:-1], ids[1:])
        ranks[ends - 1] = _NO_RANK
        while len(live):
            starts = ends - sizes
            best = np.minimum.reduceat(ranks, starts)
            go = best != _NO_RANK
            if not go.all():
                for k in np.flatnonzero(~go).tolist():
                    done[live[k]] = ids[starts[k]:ends[k]].astype(np.uint32)
                keep = np.repeat(go, sizes)
                ids, ranks, live, sizes, best = ids[keep], ranks[keep], live[go], sizes[go], best[go]
                if not len(live):
                    break
                ends = np.cumsum(sizes)
                starts = ends - sizes
            hit = np.flatnonzero(ranks == np.repeat(best, sizes))
            word = np.searchsorted(ends, hit, "right")
            first = np.concatenate([[True], word[1:] != word[:-1]])  # the leftmost of each word
            hit = hit[first]
            ids[hit] = self.merged_ids[best]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, ranks = ids[keep], ranks[keep]
            hit -= np.arange(len(hit))  # one id fewer for every word before
            sizes = sizes - 1
            ends = np.cumsum(sizes)
            starts = ends - sizes
            last = hit == ends - 1
            ranks[hit[last]] = _NO_RANK
            at = hit[~last]
            ranks[at] = self.pair_rank(ids[at], ids[at + 1])
            at = hit[hit > starts] - 1
            ranks[at] = self.pair_rank(ids[at], ids[at + 1])
        return done

    def merge_long(self, word: bytes) -> np.ndarray:
        """:meth:`merge` of one long word: ranks in ascending order, all pairs
        of a rank together, over a linked list.  Pairs of one rank that overlap
        (a run of one token) are merged from the left."""
        if not self.ordered:
            return np.array(self.merge(word), np.uint32)
        n = len(word)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1 end the list
        ids = np.append(ids, -1)
        alive = np.ones(n + 1, bool)
        alive[n] = False
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            """Pairs that begin at these places join their rank's list."""
            ranks = self.pair_rank(ids[at], ids[after[at]])
            known = ranks != _NO_RANK
            at, ranks = at[known], ranks[known]
            by = np.argsort(ranks, kind="stable")
            at, ranks = at[by], ranks[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, rank in zip(np.split(at, cuts), ranks[np.concatenate([[0], cuts])].tolist() if len(at) else []):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(part)

        wait(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[self.pair_rank(ids[at], ids[after[at]]) == rank]
            if not len(at):
                continue
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            place = np.arange(len(at))
            run = np.maximum.accumulate(np.where(chained, 0, place))
            at = at[(place - run) % 2 == 0]
            gone = after[at]
            ids[at] = self.merged_ids[rank]
            alive[gone] = False
            following = after[gone]
            after[at] = following
            inner = following < n
            before[following[inner]] = at[inner]
            left = before[at]
            wait(np.unique(np.concatenate([at[inner], left[left >= 0]])))
        return ids[:n][alive[:n]].astype(np.uint32)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in which no special token is looked for."""
        split, known = [SPLIT.findall(t) for t in texts], self.words
        new = list({w for words in split for w in words if w not in known})
        if new:
            if len(known) >= REMEMBERED_WORDS:
                used = {w for words in split for w in words}
                known = self.words = {w: known[w] for w in used if w in known}
            if len(new) < _FEW:
                found = [np.array(self.merge(w.encode()), np.uint32) if len(w) <= WORD_BYTES else self.merge_all([w.encode()])[0]
                         for w in new]
            else:
                found = self.merge_all([w.encode() for w in new])
            coded = dict(zip(new, [ids.tobytes() for ids in found]))
            known.update((w, ids) for w, ids in coded.items() if len(w) <= WORD_BYTES)
            if len(new) > sum(1 for w in coded if w in known):  # long words aren't kept
                known = ChainMap(known, coded)
        return [known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words]) for words in split]

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text in which no special token is looked for."""
        return np.frombuffer(self.encode_many([text])[0], np.uint32).tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids' text; bytes that are none become U+FFFD."""
        sizes = self.token_sizes[ids]
        ends = np.cumsum(sizes)
        # the bytes of every token, one token after the other
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.token_ends[ids] - ends, sizes)
        raw = self.token_bytes[at].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


_NO_RANK = 1 << 62
#: Words beyond this many bytes are merged by rank, others together, at most
#: so many at a time.
_LONG, _TOGETHER = 400, 20_000
#: Words below this number are merged one by one.
_FEW = 8


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# --------------------------------------------------------- the transducer
class _State:
    __slots__ = ("arcs", "final", "words")

    def __init__(self):
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.words = 0  # in its right language, once it is frozen


def build_transducer(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimal acyclic transducer of sorted, distinct ``words``.

    Returns (arc_keys, arc_targets, arc_outputs, final): arcs are sorted by
    ``state * 256 + byte``, state 0 is the start, and the outputs on a word's
    path add up to its place in ``words``.
    """
    known: dict[tuple, _State] = {}

    def frozen(state: _State) -> _State:
        """The one state with this right language."""
        key = (state.final, tuple((b, id(t)) for b, t in state.arcs.items()))
        if key not in known:
            state.words = state.final + sum(t.words for t in state.arcs.values())
            known[key] = state
        return known[key]

    root = _State()
    path, before = [root], b""
    for word in words:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        for depth in range(len(before), same, -1):
            path[depth - 1].arcs[before[depth - 1]] = frozen(path[depth])
        del path[same + 1:]
        for b in word[same:]:
            path.append(_State())
            path[-2].arcs[b] = path[-1]
        path[-1].final = True
        before = word
    for depth in range(len(before), 0, -1):
        path[depth - 1].arcs[before[depth - 1]] = frozen(path[depth])

    number, order = {id(root): 0}, [root]
    for state in order:  # grows while it is read
        for target in state.arcs.values():
            if id(target) not in number:
                number[id(target)] = len(order)
                order.append(target)
    keys, targets, outputs = [], [], []
    for i, state in enumerate(order):
        skipped = int(state.final)
        for b, target in state.arcs.items():  # in order of bytes, as words were
            keys.append(i * 256 + b)
            targets.append(number[id(target)])
            outputs.append(skipped)
            skipped += target.words
    return (np.array(keys, np.uint64), np.array(targets, np.uint32), np.array(outputs, np.uint32),
            np.array([s.final for s in order], np.uint8))


_PARTS = (("keys", np.uint64), ("targets", np.uint32), ("outputs", np.uint32), ("final", np.uint8),
          ("starts", np.uint32), ("ids", np.uint32))


class Lexicon:
    """A transducer and the ids of its words, over one memory-mapped file."""

    def __init__(self, data: np.ndarray):
        head = int(np.frombuffer(data[:8], np.uint64)[0])
        sizes = json.loads(bytes(data[8:8 + head]))
        at = 8 + head
        for name, kind in _PARTS:
            at += -at % 8
            size = sizes[name] * np.dtype(kind).itemsize
            setattr(self, name, data[at:at + size].view(kind))
            at += size

    @staticmethod
    def pack(words: list[bytes], ids: list[list[int]]) -> bytes:
        keys, targets, outputs, final = build_transducer(words)
        parts = {"keys": keys, "targets": targets, "outputs": outputs, "final": final,
                 "starts": np.cumsum([0, *map(len, ids)]).astype(np.uint32),
                 "ids": np.array([i for x in ids for i in x], np.uint32)}
        head = json.dumps({k: len(v) for k, v in parts.items()}).encode()
        out = bytearray(len(head).to_bytes(8, "little") + head)
        for name, kind in _PARTS:
            out += b"\0" * (-len(out) % 8) + parts[name].astype(kind).tobytes()
        return bytes(out)

    @staticmethod
    def open(path: str) -> Lexicon:
        """Maps the file where the shared folder is mounted, or else reads it."""
        fs, name = shared_fs(path)
        if fs.type_name == "local":
            return Lexicon(np.memmap(name, np.uint8, "r"))
        with fs.open_input_file(name) as f:
            return Lexicon(np.frombuffer(f.read(), np.uint8))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Places of the words; -1 for those the lexicon doesn't hold.  All
        words take a step along their arcs together."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return found
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        live = np.flatnonzero((sizes > 0) & (sizes <= WORD_BYTES))
        state, place, step = np.zeros(len(live), np.uint64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state * np.uint64(256) + raw[starts[live] + step].astype(np.uint64)
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, place = self.targets[at].astype(np.uint64), place[ok] + self.outputs[at]
            step += 1
            done = sizes[live] == step
            ends = done & (self.final[state.astype(np.int64)] == 1)
            found[live[ends]] = place[ends]
            live, state, place = live[~done], state[~done], place[~done]
        return found

    def ids_of(self, place: int) -> np.ndarray:
        return self.ids[self.starts[place]:self.starts[place + 1]]


# ------------------------------------------------------------ the encoder
class Encoder:
    """Encodes whole texts; remembers a bounded number of words.

    A space after a non-space is always the start of a pre-token, so a text
    falls into pieces at its spaces, and a piece (with the space before it) has
    the same ids wherever it stands.  Only pieces that begin or end with white
    space depend on their neighbours; a text with such a piece, or with a
    special token, is split as a whole.
    """

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None):
        self.vocab, self.lexicon = vocab, lexicon
        self.known: dict[bytes, bytes | None] = {}

    def learn(self, pieces: set[bytes]) -> None:
        if len(self.known) + len(pieces) > REMEMBERED:
            # what was used just now is likely to be used again
            kept = {p: self.known[p] for p in pieces if p in self.known}
            self.known.clear()
            self.known.update(kept)
        new = [p for p in pieces if p not in self.known]
        places = self.lexicon.find(new).tolist() if self.lexicon else [-1] * len(new)
        unseen = []
        for piece, place in zip(new, places):
            if place >= 0:
                self.known[piece] = self.lexicon.ids_of(place).tobytes()
            elif depends_on_neighbours(piece):
                self.known[piece] = None
            else:
                unseen.append(piece)
        coded = self.vocab.encode_many([" " + p.decode() for p in unseen])
        self.known.update(zip(unseen, coded))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.split(b" ") for t in texts]
        out, known, start = [], self.known, 0
        while start < len(texts):  # as many texts as the memory of words takes
            stop, pieces = start, set()
            while stop < len(texts) and (stop == start or len(pieces) < REMEMBERED // 2):
                pieces.update(split[stop][1:])
                stop += 1
            self.learn(pieces)
            for k in range(start, stop):
                out.append(self._encode(texts[k], split[k], known))
            start = stop
        return out

    def _encode(self, text: bytes, pieces: list[bytes], known: dict) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in self.vocab.special_bytes) and not depends_on_neighbours(pieces[0]):
            try:
                rest = b"".join(map(known.__getitem__, pieces[1:]))
                return self.vocab.encode_many([pieces[0].decode()])[0] + rest
            except TypeError:  # a piece that depends on its neighbours
                pass
        return self._encode_whole(text.decode())

    def _encode_whole(self, text: str) -> bytes:
        vocab = self.vocab
        parts = vocab.split_special.split(text) if vocab.split_special else [text]
        coded = vocab.encode_many(parts[::2])
        named = [np.array([vocab.special[p]], np.uint32).tobytes() for p in parts[1::2]]
        return b"".join(x for pair in zip(coded, [*named, b""]) for x in pair)


def depends_on_neighbours(piece: bytes) -> bool:
    """An empty piece, or one with white space at an end."""
    if not piece:
        return True
    if 32 < piece[0] < 127 and 32 < piece[-1] < 127:
        return False
    text = piece.decode()
    return bool(_SPACE.match(text[0]) or _SPACE.match(text[-1]))


@lru_cache(maxsize=1)
def open_encoder(vocab_path: str, lexicon: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(vocabulary(vocab_path), Lexicon.open(lexicon))


# ------------------------------------------------------------ the operator
def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over every document; counted in tasks before the shuffle."""
    def run(batches):
        counts: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()

        for batch in batches:
            for text in byte_list(batch.column(0)):
                counts.update(text.split(b" ")[1:])
            if len(counts) > REMEMBERED_WORDS:
                yield from flush()
        if counts:
            yield from flush()

    return (docs.select("text").mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def build_lexicon(docs: DataFrame, vocab_path: str, size: int = LEXICON_WORDS) -> str:
    """Compile the ``size`` most frequent words (ties by bytes) into a file in
    the shared folder; returns its path.  At most ``size`` words of at most
    ``WORD_BYTES`` bytes reach the driver."""
    counts = stage_table(word_counts(docs).filter(F.octet_length("word").between(1, WORD_BYTES)), "word-counts")
    # the least count that still leaves ``size`` words: from a histogram of
    # counts, so that only about as many words are sorted
    above = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0)
    least = (counts.groupBy("n").agg(F.count("*").alias("k")).withColumn("k", F.sum("k").over(above))
             .filter(F.col("k") >= size).agg(F.max("n")).first()[0])
    top = counts.filter(F.col("n") >= (least or 1)).orderBy(F.desc("n"), "word").limit(size)
    vocab = vocabulary(vocab_path)
    words = sorted(w for (w,) in top.select("word").toLocalIterator() if not depends_on_neighbours(bytes(w)))
    words = [bytes(w) for w in words]
    packed = Lexicon.pack(words, [np.frombuffer(x, np.uint32).tolist()
                                  for x in vocab.encode_many([" " + w.decode() for w in words])])
    folder = new_folder(docs.sparkSession, "lexicon")
    fs, root = shared_fs(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/words.fst", compression=None) as f:
        f.write(packed)
    return f"{folder}/words.fst"


CODED = "id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, vocab_path: str, lexicon: str, with_ids: bool = True) -> DataFrame:
    """Encode each whole text, decode the ids again (see ``CODED``); ids are
    little-endian unsigned 32-bit integers (null where not ``with_ids``)."""
    def run(batches):
        vocab = vocabulary(vocab_path)
        encoder = open_encoder(vocab_path, lexicon)
        for batch in batches:
            coded = encoder.encode_all(byte_list(batch.column(1)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array(coded if with_ids else [None] * len(coded), pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                pa.array([hashlib.sha256(vocab.decode(np.frombuffer(x, np.uint32))).hexdigest() for x in coded],
                         pa.string())], ["id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select(id_key().alias("id"), F.col("text")).mapInArrow(run, CODED)


def round_trip(docs: DataFrame, vocab_path: str, lexicon_words: int = LEXICON_WORDS,
               with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256
    (and ids).

    Null and empty texts have no tokens; special tokens' strings in a text are
    special tokens; null and repeated doc_ids are rows of their own; an empty
    table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    lexicon = build_lexicon(docs, vocab_path, lexicon_words)
    coded = encode(docs, vocab_path, lexicon, with_ids).withColumn("doc_id", id_out("id"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []))
