"""Toxicity scores from subword bags (operator 1).

A word is a bag of its character n-grams and itself, hashed into buckets with
an embedding each.  The bag's mean embedding goes through a linear softmax over
{clean, toxic}; a document's logit is a mean of the bias and the logits of its
words with a known subword, weighted sharply towards the largest.  One insult
in a long text counts, and no number of harmless words adds up to one.
Embeddings and softmax weights are trained jointly, in numpy, from labels of
whole documents.  A misspelling or an unseen
compound shares n-grams with the words that were seen.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``); scores
are computed for whole texts in tasks, from the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_list, id_key, id_out, small_batches

#: Labelled rows that are fitted on, at most: so many toxic ones, and twice as
#: many clean ones, without those whose text is beyond ``SAMPLE_BYTES``, and of
#: these the first whose texts have ``SAMPLE_TOTAL`` bytes together.
SAMPLE = 1500
SAMPLE_BYTES = 1 << 20
SAMPLE_TOTAL = 64 << 20
BUCKETS_LOG2 = 18
DIM = 8
N_GRAMS = (3, 4, 5)
EPOCHS = 300
THRESHOLD = 0.7
#: A subword of so many toxic texts gets an embedding; the weight decay keeps
#: those small that few texts speak for.
MIN_TEXTS = 4
#: Logit per unit of a bag's mean, label noise that is allowed for, weight
#: decay and step of the optimiser.
SCALE, SMOOTH, DECAY, RATE = 8.0, 0.02, 0.01, 0.05
#: Sharpness of a document's pool: a word's weight grows by exp(SHARP) per unit
#: of its logit.  Training starts with the first number, so that all words of a
#: text learn, and ends with the second, which scores.
SHARP_FIRST, SHARP = 1.0, 2.0
#: Bytes of text handled at once; their subwords take some 150 times as much.
SLICE_BYTES = 256 << 10

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _byte_classes() -> np.ndarray:
    """Lower-cased bytes; 0 for white space and separating punctuation."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[32, *range(9, 14), *map(ord, ".,;:?!\"()[]{}|")]] = 0
    return table


_CLASSES = _byte_classes()


def subwords(texts: list[bytes], buckets_log2: int = BUCKETS_LOG2):
    """(buckets, words, docs): the bucket of every subword, the number of
    subwords of each word, and the number of words of each text.

    n-grams run over bytes with a mark (0) at both ends of a word.
    """
    raw = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)
    low = _CLASSES[raw]
    doc_end = np.cumsum([len(t) + 1 for t in texts])  # place of the mark after each text
    inner = low != 0
    starts = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    ends = np.flatnonzero(inner[:-1] & ~inner[1:]) + 1
    per_doc = np.diff(np.searchsorted(starts, np.concatenate([[0], doc_end])))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), per_doc
    with np.errstate(over="ignore"):
        x = (low.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        # hash of bytes [i, i + n) for each n, rolled up from shorter ones
        grams, rolled = [], x
        for n in range(2, max(N_GRAMS) + 1):
            rolled = rolled[:-1] * _MULT + x[n - 1:]
            if n in N_GRAMS:
                grams.append(rolled)
        # the word itself: its bytes weighted by their place in it
        length = ends - starts
        first = np.cumsum(length) - length
        inside = np.arange(int(length.sum())) - np.repeat(first, length)
        weight = (inside.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)
        whole = np.add.reduceat(x[low != 0] * (weight ^ (weight >> np.uint64(29))), first) * _MULT
    # an n-gram lies in a word with its marks: from start - 1 to end + 1
    counts = [np.maximum(length + 3 - n, 0) for n in N_GRAMS]
    sizes = np.sum(counts, axis=0) + 1
    offsets = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint64)
    out[offsets] = whole
    at = offsets + 1
    for seed, (h, c) in enumerate(zip(grams, counts)):
        where = np.repeat(at - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        source = np.repeat(starts - 1 - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        with np.errstate(over="ignore"):
            out[where] = (h[source] + np.uint64(seed + 1)) * _MULT
        at = at + c
    return (out >> np.uint64(64 - buckets_log2)).astype(np.int64), sizes, per_doc


def _pooled(logits: np.ndarray, owner: np.ndarray, n: int, bias: float, sharp: float = SHARP, times=1):
    """(logit, log of the summed weights) of each of ``n`` texts: the mean of
    its words' logits and the bias, each weighted by exp(sharp * logit) and the
    ``times`` it is there; and each word's weight over that sum.  The logit is
    never above the largest.  ``owner`` is sorted."""
    top = np.full(n, bias)
    if len(owner):
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        top[owner[begin]] = np.maximum(np.maximum.reduceat(logits, begin), bias)
    weight, of_bias = times * np.exp(sharp * (logits - top[owner])), np.exp(sharp * (bias - top))
    total = np.bincount(owner, weight, minlength=n) + of_bias
    out = (np.bincount(owner, weight * logits, minlength=n) + of_bias * bias) / total
    return out, sharp * top + np.log(total), weight / total[owner]


def _slices(texts: list[bytes]) -> list[tuple[int, int]]:
    """Runs of texts of about ``SLICE_BYTES`` together."""
    runs, start, size = [], 0, 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > SLICE_BYTES:
            runs.append((start, k))
            start, size = k, 0
        size += len(t)
    return runs + [(start, len(texts))] if texts else []


def _pieces(text: bytes) -> list[bytes]:
    """A text beyond the slice, cut between words."""
    out, at = [], 0
    while len(text) - at > SLICE_BYTES:
        gaps = np.flatnonzero(_CLASSES[np.frombuffer(text[at:at + SLICE_BYTES], np.uint8)] == 0)
        stop = at + (int(gaps[-1]) + 1 if len(gaps) else SLICE_BYTES)
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


class Model:
    """A logit per bucket (linear in the bag's mean) and the bias."""

    def __init__(self, logits: np.ndarray, bias: float, buckets_log2: int = BUCKETS_LOG2):
        self.logits, self.bias, self.buckets_log2 = logits, bias, buckets_log2

    def _pool(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buckets, sizes, per = subwords(texts, self.buckets_log2)
        words, owner = np.zeros(0), np.zeros(0, np.int64)
        if len(sizes):
            values, begin = self.logits[buckets], np.cumsum(sizes) - sizes
            known = np.logical_or.reduceat(values != 0, begin)
            words = (np.add.reduceat(values, begin) / sizes)[known]
            owner = np.repeat(np.arange(len(texts)), per)[known]
        return _pooled(words + self.bias, owner, len(texts), self.bias)[:2]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        out = np.zeros(len(texts))
        for a, b in _slices(texts):
            if len(texts[a]) > SLICE_BYTES:  # alone in its slice; the bias counts once over the pieces
                parts, weight = self._pool(_pieces(texts[a]))
                share = np.exp(weight - weight.max())
                again = (len(parts) - 1) * np.exp(SHARP * self.bias - weight.max())
                out[a] = (share @ parts - again * self.bias) / (share.sum() - again)
            else:
                out[a:b] = self._pool(texts[a:b])[0]
        return 1 / (1 + np.exp(-out))


def _constant(share: float) -> Model:
    """Nothing tells the labels apart: every text scores the share of label 1."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    return Model(np.full(1 << BUCKETS_LOG2, -40.0), float(np.log(share / (1 - share))))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit embeddings and softmax jointly (full batches, Adam)."""
    texts_of = dict(zip(texts, labels))  # a copied text is one example
    texts, y = list(texts_of), np.array(list(texts_of.values()), float)
    if not texts or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 0.0)
    n_buckets, n1 = 1 << BUCKETS_LOG2, y.sum()
    n0 = len(y) - n1

    # texts of either label that have a subword, slice by slice
    have = np.zeros((2, n_buckets), np.int64)
    for a, b in _slices(texts):
        buckets, sizes, per = subwords(texts[a:b])
        text = np.repeat(np.repeat(np.arange(b - a), per), sizes)
        distinct = np.unique(text * n_buckets + buckets)
        label = y[a + distinct // n_buckets].astype(int)
        np.add.at(have, (label, distinct % n_buckets), 1)
    usable = have[1] >= MIN_TEXTS
    if not usable.any():
        return _constant(float(y.mean()))

    # only words with such a subword can tell more than the bias; a word is
    # kept once, and once per text with the times that the text has it
    dense, m = np.cumsum(usable) - 1, int(usable.sum())
    seen = np.zeros(0, np.uint64)  # keys of the words so far, sorted, and their numbers
    number = np.zeros(0, np.int64)
    subs, bags, counts, owner, word, times, words = [], [], [], [], [], [], 0
    for a, b in _slices(texts):
        buckets, sizes, per = subwords(texts[a:b])
        if not len(sizes):
            continue
        begin = np.cumsum(sizes) - sizes
        live = np.logical_or.reduceat(usable[buckets], begin)
        with np.errstate(over="ignore"):  # words of the same subwords are the same to the model
            mixed = (buckets.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MULT
            keys = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), begin)[live]
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(seen, distinct)
        new = np.ones(len(distinct), bool)
        new[at < len(seen)] = seen[at[at < len(seen)]] != distinct[at < len(seen)]
        fresh = np.flatnonzero(live)[first[new]]
        inside = np.repeat(begin[fresh] - (np.cumsum(sizes[fresh]) - sizes[fresh]), sizes[fresh]) + np.arange(sizes[fresh].sum())
        known = usable[buckets[inside]]
        subs.append(dense[buckets[inside]][known].astype(np.int32))
        bags.append(np.repeat(np.arange(len(fresh)), sizes[fresh])[known].astype(np.int32) + words)
        counts.append(sizes[fresh])
        seen, number = np.insert(seen, at[new], distinct[new]), np.insert(number, at[new], np.arange(len(fresh)) + words)
        words += len(fresh)
        of = number[np.searchsorted(seen, distinct)][inverse]
        pair, n = np.unique((np.repeat(np.arange(a, b), per)[live] << 40) + of, return_counts=True)
        owner.append((pair >> 40).astype(np.int32))
        word.append((pair & ((1 << 40) - 1)).astype(np.int32))
        times.append(n.astype(np.int32))
    sub, bag, count, owner, word, times = map(np.concatenate, (subs, bags, counts, owner, word, times))
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (m, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.array([0.0, -3.0])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = y * (1 - 2 * SMOOTH) + SMOOTH
    for epoch in range(1, epochs + 1):
        sharp = SHARP_FIRST + (SHARP - SHARP_FIRST) * min(max(3 * epoch / epochs - 1.5, 0.0), 1.0)
        embedding, weights, bias = params
        w, b = weights[:, 1] - weights[:, 0], bias[1] - bias[0]
        logit = np.bincount(bag, (embedding @ w)[sub], minlength=words) / count * SCALE + b
        logits = logit[word]
        pooled, _, share = _pooled(logits, owner, len(y), b, sharp, times)
        g_text = (1 / (1 + np.exp(-pooled)) - target) / len(y)
        g_bag = np.bincount(word, share * (1 + sharp * (logits - pooled[owner])) * g_text[owner], minlength=words)
        g_sub = np.bincount(sub, (g_bag / count * SCALE)[bag], minlength=m)
        g_w, g_b = embedding.T @ g_sub, g_text.sum()
        grads = [np.outer(g_sub, w) + DECAY / len(y) * embedding,
                 np.stack([-g_w, g_w], axis=1) + DECAY / len(y) * weights, np.array([-g_b, g_b])]
        for p, g, m1, m2 in zip(params, grads, first, second):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= RATE * (m1 / (1 - 0.9 ** epoch)) / (np.sqrt(m2 / (1 - 0.99 ** epoch)) + 1e-9)
    embedding, weights, bias = params
    logits = np.zeros(n_buckets)
    logits[usable] = embedding @ (weights[:, 1] - weights[:, 0]) * SCALE
    return Model(logits, float(bias[1] - bias[0]))


# ------------------------------------------------------------ the operator
def held_out():
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` toxic and twice as many clean rows that
    aren't held out, those whose hashed doc_id is smallest; at most
    ``SAMPLE_TOTAL`` bytes of text reach the driver."""
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
             .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct())
    picked = None
    for label in (0, 1):
        part = (known.filter(F.col("toxic") == label).withColumn("o", F.xxhash64("doc_id", F.lit(11)))
                .orderBy("o", "doc_id").limit(sample * (2 - label)))
        picked = part if picked is None else picked.unionByName(part)
    so_far = W.orderBy("o", "doc_id").rowsBetween(W.unboundedPreceding, 0)  # over 4 * sample rows at most
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .filter(F.octet_length("text") <= SAMPLE_BYTES)
            .join(F.broadcast(picked), "doc_id")  # 3 * sample rows of three numbers at most
            .orderBy("o", "doc_id").limit(4 * sample)
            .withColumn("bytes", F.sum(F.octet_length("text")).over(so_far)).filter(F.col("bytes") <= SAMPLE_TOTAL)
            .orderBy("o", "doc_id").select("text", "toxic").toArrow())
    return train(byte_list(rows["text"].combine_chunks()), rows["toxic"].to_numpy().astype(int))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (id, text) scored: id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKETS_LOG2 numbers

    def run(batches):
        for batch in batches:
            p = shared.value.score(byte_list(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), p, (p >= threshold).astype(np.int32)], ["id", "score", "predicted"])

    return docs.mapInArrow(run, "id long, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts get the bias's score; a null doc_id isn't held out
    and its label isn't learned; rows that repeat a doc_id are scored each; of
    equal texts with contradictory labels one label is learned; a text of any
    length is scored in slices, and adds nothing by its length; empty tables give
    no rows, and without labels of both kinds every text scores the same; columns
    besides doc_id, text and toxic are not read.
    """
    small_batches(docs.sparkSession)
    scored = score(docs.select(id_key().alias("id"), F.col("text")), fit(docs, labels, sample))
    return (scored.withColumn("doc_id", id_out("id"))
            .select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; all columns stay."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, sample)
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = shared.value.score(byte_list(batch.column(text))) < THRESHOLD
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
