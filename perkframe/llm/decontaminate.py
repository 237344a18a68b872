"""Benchmark decontamination by template windows (operator 8).

Words become template tokens: numbers, capitalised names and units turn into
typed placeholders, other words are lower-cased literals.  Windows of
consecutive template tokens are hashed on both sides and hash-joined, so a
question whose numbers or names were changed still meets its original.  Windows
of case-folded words, where a capital makes no name, are hashed next to them: a
copy in other capitals meets by those.  For
each met (document, item, alignment) the slots are then checked: values have to
stand for one another one to one, and windows that changed a value otherwise
drop out.  An alignment whose other windows cover enough of the item is a leak,
if what they cover holds enough different tokens that are the same in both.

A window with fewer than ``LITERALS`` literals says next to nothing by its
template: a table of numbers or a list of names would meet every other.  Such a
window is hashed by its values instead, so it only meets its own copies.

A bitmap of the benchmark's window hashes, of one fixed size whatever the size
of the benchmark, goes to the tasks that scan documents; it only saves windows
that can't join.  What passes is joined on the full hash.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_list, free_name, hash_bitmap, id_key, id_out, in_bitmap, stage_table

WINDOW = 8
#: Tokens that consistent windows of one alignment must cover (or the whole
#: item, where it is shorter).
COVERED = 12
#: Shortest item that is looked for inside documents; a shorter one leaks only
#: as a whole document (any text of ours would hold the word "yes").
SHORTEST = 4
#: Literals that a window needs to meet others by its template.
LITERALS = 2
#: Different tokens that a leak has to hold unchanged (half of a shorter item).
ANCHORS = 4
#: Words whose tokens a task remembers, and bytes of text it hashes at once
#: (more only in one longer document).
REMEMBERED = 600_000
SLICE_BYTES = 1 << 20

# Unit words that become the placeholder for units.
UNITS = frozenset("""mm cm m km inch inches ft foot feet yard yards mile miles
mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce ounces
ml l litre litres liter liters gallon gallons ms s sec second seconds min minute minutes h hr hour hours
day days week weeks month months year years cent cents dollar dollars euro euros rupee rupees yen percent
degree degrees celsius fahrenheit watt watts volt volts joule joules newton newtons byte bytes kb mb gb tb
hz khz mhz ghz mph kmh kph""".split())

_NUMBER = re.compile(r"[+\-−$€£¥]*\d[\d.,/:]*(?:st|nd|rd|th|%)?")
_NUMBER_UNIT = re.compile(r"([+\-−$€£¥]*\d[\d.,/:]*)([^\W\d_]+)")
_EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum() and chr(c) not in "$%+-") + "«»“”‘’„…¿¡–—"

LITERAL, NUMBER, NAME, UNIT, NUMBER_UNIT = range(5)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def canonical(word: str) -> tuple[int, str] | None:
    """(type, value) of a word; None for a word of punctuation only.

    The value is what a slot holds, or the literal itself.
    """
    bare = word.strip(_EDGE)
    if not bare or bare in "$%+-":
        return None
    letters = bare.isalpha()  # neither a number nor begun by one
    if not letters and _NUMBER.fullmatch(bare):
        return NUMBER, bare.rstrip("%.,")
    low = bare.lower()
    if low in UNITS:
        return UNIT, low
    if letters:
        return (NAME if bare[0].isupper() else LITERAL), low
    joined = _NUMBER_UNIT.fullmatch(bare)
    if joined and joined[2].lower() in UNITS:
        return NUMBER_UNIT, low
    if bare[0].isupper():
        return NAME, low
    return LITERAL, low


def _code(kind: int, value: str) -> int:
    """64-bit code of a template token."""
    return xxhash.xxh64_intdigest(b"w" + value.encode() if kind == LITERAL else b"<%d>" % kind, 8) | 1


_ASCII_EDGE = "".join(c for c in _EDGE if ord(c) < 128).encode()
_UNIT_WORDS = frozenset(u.encode() for u in UNITS)
_NAME_CODE = _code(NAME, "")


def _row(word: bytes) -> tuple[int, int, int, int]:
    """(code as written, case-folded, code of the case-folded value, whether the
    two forms are literals: 1 and 2) of a word; zeros for one of punctuation
    only."""
    if word.isascii():  # words of plain letters, without decoding
        bare = word.strip(_ASCII_EDGE)
        if bare.isalpha():
            low = bare.lower()
            if low not in _UNIT_WORDS:
                code = xxhash.xxh64_intdigest(b"w" + low, 8) | 1
                return (_NAME_CODE, code, code, 2) if bare[:1].isupper() else (code, code, code, 3)
    text = word.decode("utf-8", "replace")
    written = canonical(text)
    if written is None:
        return 0, 0, 0, 0
    casefolded = text.casefold()
    folded = written if casefolded == text else canonical(casefolded) or written
    code = _code(*folded)
    value = code if folded[0] == LITERAL else xxhash.xxh64_intdigest(b"v%d:%s" % (folded[0], folded[1].encode()), 8) | 1
    literals = (written[0] == LITERAL) + 2 * (folded[0] == LITERAL)
    return (code if folded is written else _code(*written)), code, value, literals


class _Places(dict):
    """Numbers words as they come; ``new`` lists those since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        place = self[word] = len(self)
        return place


class Tokens:
    """Tokens of words (see :func:`_row`), with a bounded memory of words."""

    def __init__(self):
        self.places = _Places()
        self.codes, self.literals = np.zeros((3, 1024), np.uint64), np.zeros(1024, np.uint8)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Places of the words in ``codes`` and ``literals``, until the next call."""
        places = self.places
        if len(places) > REMEMBERED:
            places.clear()
        at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        if places.new:
            k, n = len(places) - len(places.new), len(places)
            if n > len(self.literals):
                more = max(n, 2 * k) - len(self.literals)
                self.codes = np.concatenate([self.codes, np.zeros((3, more), np.uint64)], axis=1)
                self.literals = np.concatenate([self.literals, np.zeros(more, np.uint8)])
            written, folded, values, literals = zip(*map(_row, places.new))
            for row, found in zip(self.codes, (written, folded, values)):
                row[k:n] = found
            self.literals[k:n] = literals
            places.new.clear()
        return at


class Texts:
    """The words of several texts that have a token, one text after another."""

    def __init__(self, texts: list[bytes], tokens: Tokens):
        split = [t.split() for t in texts]
        words = list(itertools.chain.from_iterable(split))
        places = tokens.of(words)
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, split), np.int64, len(split)))
        written = tokens.codes[0][places]
        keep = written != 0
        if not keep.all():
            words = list(itertools.compress(words, keep.tolist()))
            places, text, written = places[keep], text[keep], written[keep]
        self.words, self.text, self.written, self.folded = words, text, written, tokens.codes[1][places]
        self.values_of, self.places, self.literals = tokens.codes[2], places, tokens.literals[places]
        self.sizes = np.bincount(text, minlength=len(texts))
        self.ends = np.cumsum(self.sizes)
        self.left = self.ends[text] - np.arange(len(text))  # tokens from here to the text's end

    def windows(self, widths: list[int]):
        """(width, places, hashes, folded) of the windows of each width, as
        written, then of those case-folded ones that differ.  A width -n stands
        for whole texts of n tokens, which are hashed by their values."""
        n, longest = len(self.text), max(widths)
        if not n:
            return
        for width in (w for w in widths if w < 0):
            places = np.flatnonzero((self.left == -width) & (self.sizes[self.text] == -width))
            yield width, places, self._values(places, -width), True
        pad = np.zeros(max(longest, 1), np.uint64)
        rows = [np.concatenate([r, pad]) for r in (self.written, self.folded)]
        literals = [np.concatenate([[0], np.cumsum(self.literals & bit != 0)]) for bit in (1, 2)]
        with np.errstate(over="ignore"):
            state = [np.full(n, _SEED), np.full(n, _SEED)]
            for k in range(max(longest, 0)):
                state = [(h ^ (h >> np.uint64(31))) * _MULT + r[k:k + n] for h, r in zip(state, rows)]
                if k + 1 not in widths:
                    continue
                width, written = k + 1, None
                places = np.flatnonzero(self.left >= width)
                for h, seen, folded in zip(state, literals, (False, True)):
                    h = (h[places] ^ (h[places] >> np.uint64(29))) * _LAST
                    few = np.flatnonzero(seen[places + width] - seen[places] < min(LITERALS, width))
                    if len(few):
                        h[few] = self._values(places[few], width)
                    if not folded:
                        written = h
                        yield width, places, h, False
                    else:
                        other = np.flatnonzero(h != written)
                        yield width, places[other], h[other], True

    def _values(self, places: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the values from these places on."""
        with np.errstate(over="ignore"):
            h = np.full(len(places), _SEED ^ _LAST)
            for k in range(width):
                h = (h ^ (h >> np.uint64(31))) * _MULT + self.values_of[self.places[places + k]]
            return (h ^ (h >> np.uint64(29))) * _LAST

    def values(self, place: int, width: int, folded: bool) -> list[str]:
        """Kind and value of each token of a window."""
        texts = [w.decode("utf-8", "replace") for w in self.words[place:place + abs(width)]]
        return ["%d:%s" % canonical(t.casefold() if folded else t) for t in texts]


_SEED, _LAST = np.uint64(0xD1B54A32D192ED03), np.uint64(0xBF58476D1CE4E5B9)

ITEM_WINDOWS = "item long, tokens int, hash long, width int, item_pos int, item_values array<string>"
DOC_WINDOWS = "doc long, hash long, width int, doc_pos int, doc_values array<string>"


def _item_width(tokens: int, window: int) -> int:
    return min(window, tokens) if tokens >= SHORTEST else -tokens


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every window of every item; a shorter item is one window."""
    def run(batches):
        tokens = Tokens()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
                one = Texts([text], tokens)
                n = len(one.words)
                if not n:
                    continue
                for width, places, hashes, folded in one.windows([_item_width(n, window)]):
                    for p, h in zip(places.tolist(), hashes.view(np.int64).tolist()):
                        rows.append((item, n, h, width, p, one.values(p, width, folded)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.int32(),
                                                                 pa.int32(), pa.list_(pa.string())])],
                    ["item", "tokens", "hash", "width", "item_pos", "item_values"])

    return (benchmark.select(id_key("item_id").alias("item"), F.col("text")).mapInArrow(run, ITEM_WINDOWS))


def doc_windows(docs: DataFrame, bitmap, widths: list[int]) -> DataFrame:
    """Windows of whole documents whose hash may be in the benchmark."""
    def slices(texts):
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= SLICE_BYTES):
                size += len(texts[stop])
                stop += 1
            yield start, texts[start:stop]
            start = stop

    def run(batches):
        bits, tokens = np.frombuffer(bitmap.value, np.uint64), Tokens()
        for batch in batches:
            docs_of, rows = batch.column(0).to_pylist(), []
            for start, part in slices(byte_list(batch.column(1))):
                texts = Texts(part, tokens)
                firsts = texts.ends - texts.sizes
                for width, places, hashes, folded in texts.windows(widths):
                    for k in np.flatnonzero(in_bitmap(bits, hashes)).tolist():
                        p = int(places[k])
                        d = int(texts.text[p])
                        rows.append((docs_of[start + d], int(hashes[k].view(np.int64)), width, p - int(firsts[d]),
                                     texts.values(p, width, folded)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int32(), pa.int32(),
                                                                 pa.list_(pa.string())])],
                    ["doc", "hash", "width", "doc_pos", "doc_values"])

    return docs.select(id_key().alias("doc"), F.col("text")).mapInArrow(run, DOC_WINDOWS)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: int = COVERED) -> DataFrame:
    """One row per leak: doc_id, item_id, matched_tokens, item_tokens,
    changed_slots (item values whose document value differs).

    Of a pair's alignments the one whose consistent windows cover most counts.
    An item under ``SHORTEST`` tokens leaks in documents that are nothing else.
    Null and empty texts and items match nothing; a text of any length is hashed
    in one task, some 100 bytes a word; null ids are kept as null; rows that
    repeat a doc_id or item_id are looked at together; empty tables give no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    items = stage_table(item_windows(benchmark, window), "item-windows")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # some of -3..window
    bitmap = spark.sparkContext.broadcast(hash_bitmap(items))
    found = doc_windows(docs, bitmap, widths) if widths else spark.createDataFrame([], DOC_WINDOWS)
    met = found.join(items, ["hash", "width"]).withColumn("diagonal", F.col("doc_pos") - F.col("item_pos"))
    met = stage_table(met.filter(F.size("doc_values") == F.size("item_values")), "met-windows")

    pair = ["doc", "item", "diagonal"]
    slots = (met.select(*pair, F.explode(F.arrays_zip("item_values", "doc_values")).alias("z"))
             .select(*pair, F.col("z.item_values").alias("was"), F.col("z.doc_values").alias("now")))

    def torn(side: str, other: str) -> DataFrame:
        """Values of one side that stand for two of the other."""
        return (slots.groupBy(*pair, side).agg(F.min(other).alias("lo"), F.max(other).alias("hi"))
                .filter("lo <> hi").groupBy(*pair).agg(F.collect_set(side).alias(f"torn_{side}")))

    # values that don't stand for one another one to one break the windows that
    # changed them; windows without such a change stay
    kept = (met.join(torn("was", "now"), pair, "left").join(torn("now", "was"), pair, "left").filter(F.expr(
        """NOT exists(arrays_zip(item_values, doc_values), z -> z.item_values <> z.doc_values AND
           (coalesce(array_contains(torn_was, z.item_values), false)
            OR coalesce(array_contains(torn_now, z.doc_values), false)))""")))
    # tokens under the union of the windows, and what stands there
    zipped = F.explode(F.expr("arrays_zip(sequence(item_pos, item_pos + abs(width) - 1), item_values, doc_values)"))
    under = (kept.select(*pair, "tokens", zipped.alias("z"))
             .groupBy(*pair, "tokens", F.col("z.0").alias("p"))
             .agg(F.max(F.when(F.col("z.item_values") == F.col("z.doc_values"), F.col("z.item_values"))).alias("same"),
                  F.max(F.when(F.col("z.item_values") != F.col("z.doc_values"), F.col("z.item_values"))).alias("was")))
    whole = (under.groupBy(*pair, "tokens")
             .agg(F.count("*").alias("matched"), F.size(F.collect_set("same")).alias("anchors"),
                  F.size(F.collect_set("was")).cast("long").alias("changed"))
             .filter(F.col("matched") >= F.least(F.lit(covered), F.col("tokens")))
             .filter(F.col("anchors") >= F.least(F.lit(ANCHORS), F.ceil(F.col("tokens") / 2))))
    best = whole.groupBy("doc", "item").agg(F.max(F.struct(
        F.col("matched"), (-F.col("changed")).alias("kept"), F.col("tokens"))).alias("b"))
    return best.select(id_out("doc").alias("doc_id"), id_out("item").alias("item_id"),
                       F.col("b.matched").alias("matched_tokens"),
                       F.col("b.tokens").cast("long").alias("item_tokens"),
                       (-F.col("b.kept")).alias("changed_slots"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item; all columns stay as
    they are."""
    name = free_name(docs, "leaking")
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")


def benchmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
