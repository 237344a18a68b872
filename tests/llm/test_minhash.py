"""Min-max hashing against all pairs."""

import random

import numpy as np

from perkframe.llm import minhash as M

from .conftest import id_order


def brute_sets(texts, shingle=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    return out


def brute(rows, percent=85):
    """(doc_id, set size, smallest id of the component) of each row."""
    sets = brute_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d, key=id_order)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=lambda r: (id_order(r[0]), r[1]))


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()),
                  key=lambda r: (id_order(r[0]), r[1]))


def test_awkward_rows(spark, messy, messy_texts, empty):
    want = brute(messy_texts)
    out = M.near_duplicates(messy).toPandas()
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.n_shingles,
            None if r.component_id != r.component_id else int(r.component_id)) for r in out.itertuples()]
    assert sorted(got, key=lambda r: (id_order(r[0]), r[1])) == want
    assert list(out.kept) == [d == c for d, _, c in got]
    assert M.near_duplicates(empty).count() == 0
    clash = messy.withColumnRenamed("chunk", "gone")  # a name used inside
    kept = M.keep_first(clash)
    assert kept.columns == clash.columns
    keep = {d for d, _, c in want if d == c}
    assert sorted(map(id_order, (r["doc_id"] for r in kept.collect()))) == sorted(
        id_order(d) for d, _ in messy_texts if d in keep)


def near_copies(rng, n, words=90):
    """A crowd of copies of one text with a few to many words changed, and
    the same around a shared passage of texts that aren't copies."""
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    for _ in range(n // 2):
        out.append(" ".join([f"y{rng.randrange(10**6)}" for _ in range(40)] + base))
    return out


def test_crowd_of_near_copies_loses_no_link(spark, monkeypatch):
    rng = random.Random(3)
    rows = list(enumerate(near_copies(rng, 60)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert 10 < len({c for _, _, c in want}) < 80  # links and near misses
    assert result(M.near_duplicates(docs)) == want
    monkeypatch.setattr(M.cross_pairs, "__defaults__", (8, 24))  # buckets of several blocks
    monkeypatch.setattr(M.class_links, "__defaults__", (M.PERCENT, 0))  # and no leaders
    assert result(M.near_duplicates(docs)) == want


def test_texts_under_the_shingle_length_link_only_when_equal(spark):
    rows = [(1, "a b c"), (2, "A  B\tC"), (3, "a b"), (4, "a b c d"), (5, ""), (6, None), (7, "é"), (8, "É")]
    assert result(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_threshold_is_exact():
    a = np.arange(20, dtype=np.uint64)
    assert M.linked(a, a[:17]) and not M.linked(a, a[:16])  # 17/20 = 0.85


def test_min_and_max_estimate_the_similarity():
    rng = np.random.default_rng(1)
    errors, only_min = [], []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**64, 150, dtype=np.uint64))
        a, b = pool[:120], pool[30:]
        s = len(np.intersect1d(a, b)) / len(pool)
        (la, ga), (lb, gb) = M.signature(a, 128), M.signature(b, 128)
        errors.append(((la == lb).mean() + (ga == gb).mean()) / 2 - s)
        only_min.append((la == lb).mean() - s)
    assert abs(np.mean(errors)) < 0.015  # unbiased
    assert np.std(errors) < np.std(only_min)  # and closer than the least values alone


def test_sketch_never_overstates_a_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
        a, b = np.unique(pool[:rng.integers(1, 3000)]), np.unique(pool[rng.integers(0, 2000):])
        differ = int(np.bitwise_count(np.frombuffer(M.sketch(a), np.uint64) ^ np.frombuffer(M.sketch(b), np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    for n in (7, 20, 200):
        for _ in range(150):
            pool = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            rng.shuffle(pool)
            common = -(-85 * len(pool) // 100)
            cut = int(rng.integers(0, len(pool) - common + 1))
            a = np.sort(pool[:common + cut])
            b = np.sort(np.concatenate([pool[:common], pool[common + cut:]]))
            assert set(M.band_keys(a)) & set(M.band_keys(b))
