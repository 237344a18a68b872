"""Merkle manifest against a plain build."""

import hashlib
import zlib

import pytest

from perkframe.llm import merkle as M

from .conftest import id_order


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, siblings of each leaf from below, tuples with their side)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, a in zip(proofs, at):
            if a % 2:
                p.append(("L", nodes[a - 1]))
            elif a + 1 < len(nodes):
                p.append(("R", nodes[a + 1]))
            else:
                p.append(("N", ""))
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        at = [a // 2 for a in at]
    return nodes[0], proofs


def brute(rows, every=7):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r, h(*map(field, r))))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subs, top = {}, []
    for lang in order:
        langs[lang].sort(key=lambda x: (id_order(x[0][0]), x[1]))
        subs[lang] = tree([leaf for _, leaf in langs[lang]])
        top.append(subs[lang][0])
    out = []
    if not top:
        return out
    root, above = tree(top)
    for t, lang in enumerate(order):
        sub, proofs = subs[lang]
        for (r, leaf), proof in zip(langs[lang], proofs):
            path = proof + above[t]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % every == 0 and r[3] is not None
            acc = h(*map(field, (*r[:3], r[3] + 1, r[4]))) if bad else leaf
            for side, s in path:
                acc = h(s, acc) if side == "L" else h(acc, s)
            out.append((r[0], leaf, sub, root, h(*(s for _, s in path)), acc, acc == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, pos int, level int, path string"


def check(spark, rows, every=7, tier=M.TIER):
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in M.manifest(docs, every, tier).collect()),
                 key=lambda r: (id_order(r[0]), r[1:]))
    assert got == sorted(brute(rows, every), key=lambda r: (id_order(r[0]), r[1:]))
    return got


AWKWARD = [(1, "s", "en", 3, "abc"), (None, None, None, None, None), (2, "", "", 0, ""), (3, "é", "en", 2, "é\n"),
           (4, "s", None, 2**63 - 1, "null lang"), (5, "s", "é", 1, "x" * 200_000), (6, "s", "z", 1, "one"),
           (1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abd"), (None, "s", "en", 5, "no id"), (-3, "s", "en", None, "-"),
           (7, "-", "-", 1, "-")]


def test_awkward_rows(spark):
    got = check(spark, AWKWARD, every=1)  # every id is tampered with
    assert {r[0] for r in got if r[6]} == {None, -3}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 13])
def test_one_language(spark, n):
    check(spark, [(i, "s", "en", i, f"text {i}") for i in range(n)])


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_several_tiers_and_both_joins(spark, monkeypatch, broadcast):
    monkeypatch.setattr(M, "BROADCAST_ROWS", broadcast)
    rows = [(i, "s", f"l{min(i % 97, 5)}", i, f"text {i}") for i in range(300)]
    got = check(spark, rows, every=3, tier=2)  # blocks of four
    assert 0 < sum(r[6] for r in got) < 300
