"""Exact, near, substring and line deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from perkframe.llm import exact_dedup, line_dedup, simhash, substring_dedup
from tests.llm.conftest import SCHEMA, id_order, rows_of, words

SPACE = re.compile("[\x20\x09-\x0d]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


# ------------------------------------------------------------- exact
def brute_exact(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), id_order(i), i))
    out = []
    for i, t in texts:
        bare = SPACE.sub("", t or "")
        best = min(groups[bare])
        out.append((i, best[2], len(groups[bare]), i == best[2] and -len(t or "") == best[0],
                    hashlib.sha256(bare.encode()).hexdigest()))
    return out


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_matches_brute_force(messy, messy_texts):
    want = sorted(brute_exact(messy_texts), key=repr)
    assert rows(exact_dedup.dedup(messy), *COLUMNS) == want


def test_exact_does_not_depend_on_what_is_history(messy, messy_texts):
    from pyspark.sql import functions as F
    want = sorted(brute_exact(messy_texts), key=repr)
    for history in (F.lit(False), F.lit(True), F.col("id") % 2 == 0):
        assert rows(exact_dedup.dedup(messy, history), *COLUMNS) == want


def test_exact_of_an_empty_table(empty):
    assert exact_dedup.dedup(empty).count() == 0


def test_minimal_perfect_hash_is_minimal_and_checks_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30_000):
        members = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
        levels, bitmap, slot = exact_dedup.build_hash(members)
        assert sorted(slot.tolist()) == list(range(n))
        assert (exact_dedup.find_slots(members, levels, bitmap) == slot).all()
        strangers = rng.integers(0, 2**63, (500, 4)).astype(np.uint64)
        found = exact_dedup.find_slots(strangers, levels, bitmap)
        assert ((found >= -1) & (found < max(n, 1))).all()


# -------------------------------------------------------------- near
def brute_fingerprint(text):
    ws = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[k:k + 3]) for k in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    todo = list(parent)
    for k, a in enumerate(todo):
        for b in todo[k + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {f: find(f) for f in todo}


def test_near_matches_brute_force(messy, messy_texts):
    got = rows(simhash.near_duplicates(messy), "doc_id", "fingerprint", "component_id")
    fps = [(i, brute_fingerprint(t)) for i, t in messy_texts]
    roots = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        least[roots[f]] = min(least.get(roots[f], i), i, key=id_order)
    assert got == sorted(((i, f"{f:016x}", least[roots[f]]) for i, f in fps), key=repr)


def test_near_of_an_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).columns == empty.columns


def test_keep_first_keeps_one_of_each_group_and_all_columns(messy, messy_texts):
    kept = simhash.keep_first(messy)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 4 not in ids and 5 not in ids and ids.count(3) == 2  # repeated rows go together
    assert {6, 7, 8, 12, 15} <= set(ids)


def test_crowded_blocks_link_the_same_fingerprints(spark):
    """A large group of near copies: star edges and listed pairs give the same
    components, without pairing the group off."""
    rng = random.Random(2)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 400:
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp BIGINT")
    roots = brute_components(fps)
    want = {}
    for f, r in roots.items():
        want.setdefault(r, set()).add(simhash._signed(f))
    want = {frozenset(g) for g in want.values() if len(g) > 1}
    for paired in (4, 1000):
        found = {}
        for r in simhash.connected_components(simhash.close_pairs(df, paired=paired)).collect():
            found.setdefault(r["component"], set()).add(r["node"])
        assert {frozenset(g) for g in found.values()} == want


def test_components_of_long_chains(spark):
    from perkframe.llm.common import connected_components
    rng = random.Random(3)
    names = list(range(300))
    rng.shuffle(names)
    edges = [(names[k], names[k + 1]) for k in range(199)] + [(names[k], names[k + 1]) for k in range(200, 299)]
    got = {r["node"]: r["component"] for r in
           connected_components(spark.createDataFrame(edges, "u BIGINT, v BIGINT")).collect()}
    assert set(got[n] for n in names[:200]) == {min(names[:200])}
    assert set(got[n] for n in names[200:]) == {min(names[200:])}


# --------------------------------------------------------- substrings
def brute_substrings(texts, window):
    """Rows in order of doc_id; of repeated rows one is the earlier."""
    seen, out = set(), []
    for i, t in sorted(texts, key=lambda x: id_order(x[0])):
        ws = split(t)
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k:k + window])
            if key in seen:
                gone[k:k + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


SUB = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_substrings_match_brute_force(messy, messy_texts):
    for window, chunk in ((20, 2000), (20, 1 << 20), (7, 3000)):
        got = rows(substring_dedup.dedup(messy, window, chunk_bytes=chunk), *SUB)
        assert got == brute_substrings(messy_texts, window), (window, chunk)


def test_substring_texts_and_spans(messy, messy_texts):
    by_id = {i: t for i, t in messy_texts if i is not None}
    for r in substring_dedup.dedup(messy).collect():
        if r["doc_id"] == 8:  # the rest of 7 is also under the row without a doc_id
            ws = split(by_id[r["doc_id"]])
            gone = {k for s in r["spans"] for k in range(s["start"], s["stop"])}
            assert len(gone) == r["n_removed"] == 70
            assert r["kept"] == " ".join(w for k, w in enumerate(ws) if k not in gone)


def test_substrings_of_empty_tables_and_short_texts(spark, empty):
    assert substring_dedup.dedup(empty).count() == 0
    short = spark.createDataFrame(rows_of([(1, "a b"), (2, "a b"), (3, None)]), SCHEMA)
    assert {r["n_removed"] for r in substring_dedup.dedup(short).collect()} == {0}


def test_a_very_common_passage_is_sent_once_by_each_chunk(spark):
    rng = random.Random(9)
    passage = words(rng, 60)
    texts = [(i, words(rng, 5) + " " + passage + " " + words(rng, 5)) for i in range(300)]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(df, chunk_bytes=5000).collect()}
    assert got == {i: n for i, _, n, _ in brute_substrings(texts, 20)}
    assert got[0] == 0 and min(got[i] for i in range(1, 300)) == 60


# --------------------------------------------------------------- lines
def lines_frame(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


def kept_texts(df, **options):
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, **options).collect()}


LONG = [f"line number {c} of the shared part, long enough to count on its own" for c in "abcdefgh"]


def test_aligned_lines_go_from_the_later_document(spark):
    a = "\n".join(["only in a, and it is a rather long line as well", *LONG[:4], "", *LONG[4:]])
    b = "\n".join(["only in b, first line of some length to be kept", *LONG[2:4], "only in b, between", *LONG[4:6], "end of b"])
    c = "\n".join(["nothing in common here", "short", "or here"])
    got = kept_texts(lines_frame(spark, [(1, a), (2, b), (3, c)]))
    assert got[1] == a and got[3] == c
    assert got[2] == "\n".join(["only in b, first line of some length to be kept", "only in b, between", "end of b"])


def test_a_common_line_alone_is_no_partner(spark):
    common = "a license line that very many documents carry, all by itself"
    texts = [(i, f"document {i} starts with its own words, long enough\n{common}\nand ends {i} {i}") for i in range(20)]
    got = kept_texts(lines_frame(spark, texts), max_df=10)
    assert all(common in t for t in got.values())
    # two successive common lines are a passage
    texts = [(i, f"document {i} starts\n{common}\n{common} again\nends {i}") for i in range(20)]
    got = kept_texts(lines_frame(spark, texts), max_df=10)
    assert [i for i, t in got.items() if common in t] == [0]


def test_a_line_of_any_frequency_goes_from_all_but_its_first_document(spark):
    common = "a license line that very many documents carry, all by itself"
    for n in (64, 65, 200):
        texts = [(i, f"document {i} starts with its own words, long enough\n{common}\nand ends {i} {i}") for i in range(n)]
        got = kept_texts(lines_frame(spark, texts))
        assert [i for i, t in got.items() if common in t] == [0], n
        assert all(t.startswith(f"document {i} starts") and t.endswith(f"and ends {i} {i}") for i, t in got.items())


def test_moved_lines_keep_the_longer_chain(spark):
    a = "\n".join(LONG)
    moved = "\n".join([*LONG[3:], LONG[0]])
    got = kept_texts(lines_frame(spark, [(1, a), (2, moved)]))
    assert got[2] == LONG[0]


def test_patience_against_the_longest_chain():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(0, 9)
        b = rng.sample(range(20), n)
        pairs = list(zip(range(n), b))
        best = 0
        for mask in range(1 << n):
            chosen = [b[k] for k in range(n) if mask >> k & 1]
            if chosen == sorted(chosen):
                best = max(best, len(chosen))
        chain = line_dedup.patience(pairs)
        assert len(chain) == best and chain == sorted(chain)
        assert [x[1] for x in chain] == sorted(x[1] for x in chain)


def brute_alignment(a, b):
    """Pairs of places by patience diff with recursion, on whole lists of lines."""
    def align(a0, a1, b0, b1):
        once = [x for x in a[a0:a1] if a[a0:a1].count(x) == b[b0:b1].count(x) == 1]
        seen, pairs = {}, []
        for i in range(a0, a1):
            seen.setdefault(a[i], []).append(i)
        for j in range(b0, b1):
            if b[j] in seen and (not once or b[j] in once) and seen[b[j]]:
                pairs.append((seen[b[j]].pop(0), j))
        links = set(line_dedup.patience(pairs))
        grown = set(links)
        for i, j in sorted(links):
            for step in (-1, 1):
                x, y = i + step, j + step
                while (a0 <= x < a1 and b0 <= y < b1 and a[x] == b[y]
                       and x not in {p for p, _ in grown} and y not in {q for _, q in grown}):
                    grown.add((x, y))
                    x, y = x + step, y + step
        out, x0, y0 = sorted(grown), a0, b0
        for x, y in sorted(grown) + ([(a1, b1)] if grown else []):
            out += align(x0, x, y0, y)
            x0, y0 = x + 1, y + 1
        return out
    return sorted(align(0, len(a), 0, len(b)))


def test_alignment_goes_on_inside_the_gaps(spark):
    x, p = LONG[0], LONG[1]
    own = ["some words of the later document only, first", "some words of the later document only, second"]
    got = kept_texts(lines_frame(spark, [(1, "\n".join([x, p])), (2, "\n".join([x, own[0], p, own[1], p]))]))
    assert got[2] == "\n".join([own[0], own[1], p])
    # against brute force, and no shared line is left on both sides of a gap
    rng = random.Random(8)
    for _ in range(400):
        a = [rng.choice("abcdef") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        common = [([i for i, v in enumerate(a) if v == k], [j for j, v in enumerate(b) if v == k])
                  for k in sorted(set(a) & set(b))]
        want = brute_alignment(a, b)
        blocks = line_dedup.aligned_blocks(common)
        assert sorted(j for block in blocks for j in block) == sorted(j for _, j in want), (a, b)
        x0 = y0 = 0
        for x, y in [*want, (len(a), len(b))]:
            assert not set(a[x0:x]) & set(b[y0:y])
            x0, y0 = x + 1, y + 1


def test_lines_of_awkward_rows(spark, messy, messy_texts, empty):
    assert line_dedup.dedup(empty).count() == 0 and line_dedup.strip(empty).columns == empty.columns
    got = line_dedup.dedup(messy).collect()
    assert len(got) == len(messy_texts)
    # null, empty and blank texts are left alone, identical one-line texts go
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["text"] is None and by_id[1]["text"] == "" and by_id[2]["text"] == " \t\n\x0b\x0c\r "
    assert by_id[4]["text"] == "" and by_id[4]["partners"] == [3] and by_id[3]["n_removed"] == 0
    assert by_id[10]["text"] == "one"  # too short a block
    left = line_dedup.strip(messy)
    assert left.columns == messy.columns
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert 4 not in ids and ids.count(3) == 2 and {0, 1, 2, 5, 6} <= set(ids)
    # unequal texts under one doc_id lose nothing
    two = lines_frame(spark, [(1, "\n".join(LONG)), (2, "\n".join(LONG)), (2, "\n".join(LONG[:4]))])
    assert sum(r["n_removed"] for r in line_dedup.dedup(two).collect()) == 0


# ------------------------------------------- lines: the whole result
def brute_line_dedup(texts, min_chars=40):
    """{id: kept text} with every earlier document that has one of a
    document's blocks first as a partner, in plain Python."""
    def not_blank(t):
        return [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]

    def blocks(lines):
        out, n = set(), len(lines)
        for a in range(n):
            for b in range(a + 1, n + 1):
                size = sum(map(len, lines[a:b]))
                shortest = size >= min_chars and (size - len(lines[a]) < min_chars or size - len(lines[b - 1]) < min_chars)
                if b - a == 2 or shortest:
                    out.add(tuple(lines[a:b]))
        return out

    docs = {}
    for i, t in texts:
        docs.setdefault(i, set()).add(t or "")
    docs = {i: t.pop() for i, t in docs.items() if len(t) == 1}
    order = sorted(docs, key=id_order)
    lines = {i: [x for _, x in not_blank(docs[i])] for i in order}
    has = {i: blocks(lines[i]) for i in order}
    kept, partners = {}, {}
    for n, b in enumerate(order):
        gone, because = set(), set()
        named = set()
        for f in has[b]:
            for e in order[:n]:
                if f in has[e]:
                    named.add(e)
                    break
        for a in named:
            common = [([k for k, x in enumerate(lines[a]) if x == v], [k for k, x in enumerate(lines[b]) if x == v])
                      for v in dict.fromkeys(lines[a]) if v in lines[b]]
            for block in line_dedup.aligned_blocks(common):
                if sum(len(lines[b][p]) for p in block) >= min_chars:
                    gone |= set(block)
                    because.add(a)
        places = [k for k, _ in not_blank(docs[b])]
        drop = {places[p] for p in gone}
        kept[b] = "\n".join(x for k, x in enumerate(docs[b].split("\n")) if k not in drop)
        partners[b] = sorted(because, key=id_order)
    return kept, partners


def test_whole_result_against_brute_force(spark):
    rng = random.Random(21)
    some = [f"{c}{'x' * rng.randint(3, 30)} line" for c in "abcdefghij"] + LONG[:2] + ["", "  "]
    for trial in range(4):
        texts = [(i, "\n".join(rng.choice(some) for _ in range(rng.randint(0, 9)))) for i in range(40)]
        for i in range(0, 30, 3):  # copies of stretches
            part = texts[i][1].split("\n")
            texts[i + 5] = (i + 5, "\n".join([f"own {i}", *part[1:], "end"]))
        want, partners = brute_line_dedup(texts)
        got = {r["doc_id"]: r for r in line_dedup.dedup(lines_frame(spark, texts)).collect()}
        assert {i: r["text"] for i, r in got.items()} == want
        assert {i: r["partners"] or [] for i, r in got.items()} == partners
        assert any(partners.values())


def test_documents_with_parts_of_a_block_do_not_save_it(spark):
    lines = ["sixteen letters1", "sixteen letters2", "sixteen letters3"]  # 48 characters together
    texts = [(1, "\n".join([*lines[:2], "end of one"])), (2, "\n".join(["start of two", *lines[1:]])),
             (3, "\n".join(["start", *lines, "of three"])), (4, "\n".join(["four", *lines, "and on"]))]
    got = kept_texts(lines_frame(spark, texts))
    assert got[4] == "four\nand on" and [got[k] for k in (1, 2, 3)] == [t for _, t in texts[:3]]
    assert kept_texts(lines_frame(spark, texts[2:]))[4] == "four\nand on"


def test_one_document_with_many_partners(spark):
    """Rows grow with the pairs, not with pairs times lines."""
    lines = [f"{k} a line of some forty characters, number {k}" for k in range(300)]
    texts = [(k, f"{x}\nown {k}") for k, x in enumerate(lines)] + [(1000, "\n".join(lines)), (1001, "\n".join(lines))]
    got = {r["doc_id"]: r for r in line_dedup.dedup(lines_frame(spark, texts)).collect()}
    assert got[1000]["partners"] == list(range(300)) and got[1000]["text"] == "" and got[1001]["text"] == ""
    assert line_dedup.lines_of(lines_frame(spark, texts)).count() == 302
