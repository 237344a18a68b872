"""Periodic runs against all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perkframe.llm import periodic as P
from perkframe.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute(words, min_words=24, times=3):
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= 2 * p:
                found.setdefault((start, i + p), p)  # the smallest period comes first
    return sorted(((s, e - s, p) for (s, e), p in found.items() if e - s >= max(min_words, times * p)),
                  key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest_row(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_words(rng):
    n, letters = rng.choice([0, 1, 5, 30, 80, 200]), rng.choice([1, 2, 3, 50])
    w = [rng.randrange(letters) for _ in range(n)]
    if rng.random() < .6 and n:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        docs = [periodic_words(rng) for _ in range(rng.randint(1, 5))]
        sizes = rng.choice([(24, 3), (24, 3), (4, 2), (10, 4), (1, 2)])
        assert P.find_runs([np.array(w, np.int64) for w in docs], *sizes) == [brute(w, *sizes) for w in docs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_property(words):
    assert P.find_runs([np.array(words, np.int64)], 6, 3) == [brute(words, 6, 3)]


def test_few_suffixes_are_looked_up_at_once(monkeypatch):
    monkeypatch.setattr(P, "LOOKED_UP", 3)
    w = [0, 1] * 20 + [2] * 30
    assert P.find_runs([np.array(w, np.int64)]) == [brute(w)] == [[(0, 40, 2), (40, 30, 1)]]


@pytest.mark.parametrize("period", [1, 7, 1009])
def test_very_long_runs(period):
    w = np.arange(300_000, dtype=np.int64) % period
    assert P.find_runs([w]) == [[(0, 300_000, period)]]


def test_suffixes_of_a_smaller_child_are_few():
    w = np.array([int(c) for c in bin(3**9000)[2:]], np.int64)
    levels, _ = P.suffix_ranks(w, np.full(len(w), len(w)), 16)
    sa = np.argsort(levels[-1][:len(w)])
    asked = sum(stop - first for first, stop, *_ in P.smaller_children(P.neighbour_lcp(sa, levels), len(w)))
    assert asked <= len(w) * np.log2(len(w))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((digest_row(*r) for r in docs), key=str)
    assert rows_of(Q.op13_periodic_runs(spark, SF)) == want
    assert any(r[1] for r in want)


def test_awkward_rows(spark, messy, messy_texts, empty, tmp_path):
    long = " ".join(["a", "b", "c"] * 20_000)
    extra = spark.createDataFrame([(50, long), (60, "x " * 23), (61, "x " * 24), (62, ("p q r s t u v w " * 3)),
                                   (63, ("p q r s t u v w " * 3)[:-3])], "doc_id long, text string")
    table = messy.unionByName(extra, allowMissingColumns=True)
    found = P.periodic_runs(table).collect()
    assert len(found) == len(messy_texts) + 5
    for r in found:
        text = {50: long, 60: "x " * 23, 61: "x " * 24, 62: "p q r s t u v w " * 3}.get(r["doc_id"])
        if text:
            words = text.split()
            runs = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
            assert runs == ([(0, 60_000, 3)] if r["doc_id"] == 50 else brute(words))
            assert r["n_words"] == len(words)
            assert r["collapsed"].split() == (words[:runs[0][2]] if runs else words)
    assert {r["collapsed"] for r in found if r["doc_id"] in (0, 1, 2)} == {""}
    assert P.periodic_runs(empty).count() == 0
    path = str(tmp_path / "t")
    table.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    want = sorted((digest_row(r["doc_id"], r["text"]) for r in table.filter("doc_id IS NULL OR doc_id <> 50").collect()),
                  key=str)
    got = rows_of(Q.op13_periodic_runs(spark, path).filter("doc_id IS NULL OR doc_id <> 50"))
    assert got == want
