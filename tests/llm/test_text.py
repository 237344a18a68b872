"""Tokens, archives, leaks, toxicity and shards against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from perkframe.llm import bpe, decontaminate, sharding, token_store, toxicity, warc
from perkframe.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from tests.llm.conftest import SCHEMA, id_order, rows_of, words


def by_id(rows):
    return sorted(rows, key=lambda r: (id_order(r[0]), repr(r)))


# ------------------------------------------------------------ token store
def test_token_store_matches_the_library(messy, messy_texts):
    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    order = sorted(messy_texts, key=lambda x: (id_order(x[0]), x[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_store.round_trip(messy, WORD_VOCABULARY).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_store_of_an_empty_table(empty):
    assert token_store.round_trip(empty, WORD_VOCABULARY).count() == 0


def test_any_token_without_decoding_others():
    rng = np.random.default_rng(0)
    for top in (2, 300, 70_000, 2**32 - 1):
        for n in (1, 511, 512, 513, 3000):
            ids = rng.integers(0, top, n).astype(np.uint32)
            file = token_store.TokenFile(token_store.pack_file([5, 6], [1, n - 1], ids))
            assert [file.token(int(k)) for k in rng.integers(0, n, 20)] is not None
            for k in rng.integers(0, n, 20):
                assert file.token(int(k)) == ids[k]
            assert np.concatenate([x for _, _, x in file.documents(100)]).tolist() == ids.tolist()
            level = file.levels[0]
            bits = np.unpackbits(level.bitmap, bitorder="little")
            assert all(level.rank(int(k)) == bits[:k].sum() for k in rng.integers(0, n + 1, 20))


def test_word_encoder_equals_the_library_on_odd_texts():
    rng = random.Random(1)
    parts = ["a", "The", " ", "\n", "'s", "don't", "é", "É", "é", "中文", "12", "!?", "<|endoftext|>",
             " ", "İ", "Σς", "ﬁ", "ß", "x_y", "…", "A.B,", "$$$", "\x1c", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    encoder = token_store.WordEncoder(WORD_VOCABULARY, 2)
    got = encoder.encode_all([t.encode() for t in texts])
    want = Tokenizer.from_file(WORD_VOCABULARY).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [w.ids + [2] for w in want]


def test_word_encoder_equals_the_library_on_any_signs(monkeypatch):
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(0x180), 0x2BC, 0x300, 0x301, 0x307, 0x30C, 0x345, 0x3A3, 0x4E2D, 0x1E9E, 0x2003, 0x2028, 0x212A,
                             0x212B, 0xFB01, 0x1F600]]
    plain = [c for c in pool if c.isascii() and c.isprintable()] + list(" \n\tÀÖ×ØÞß÷öÿ")
    parts = ["<|endoftext|>", "<|", "|>", "'s", "'LL", "don't", "No.", "x2y", "</w>"]
    texts = ["".join(rng.choice(rng.choice((pool, plain, plain, parts))) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", " ", " ".join(texts[:50])]
    want = [x.ids + [2] for x in Tokenizer.from_file(WORD_VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    for size, remembered in ((1 << 20, 300_000), (7, 300_000), (300, 50)):
        monkeypatch.setattr(token_store, "TEXT_BYTES", size)
        monkeypatch.setattr(token_store, "REMEMBERED", remembered)
        got = token_store.WordEncoder(WORD_VOCABULARY, 2).encode_all([t.encode() for t in texts])
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == want


def test_word_encoder_asks_the_library_for_many_words_at_once():
    class Counted:
        def __init__(self, inner):
            self.inner, self.calls = inner, 0

        def __getattr__(self, name):
            self.calls += 1
            return getattr(self.inner, name)

    rng = random.Random(3)
    text = " ".join(w + rng.choice(["", ",", ".", "-1"]) for w in words(rng, 5000).split())
    encoder = token_store.WordEncoder(WORD_VOCABULARY, 2)
    counted = {name: Counted(x) for name, x in vars(encoder).items() if type(x).__module__.startswith("tokenizers")}
    vars(encoder).update(counted)
    got = encoder.encode_all([text.encode(), text.upper().encode()])
    want = Tokenizer.from_file(WORD_VOCABULARY).encode_batch([text, text.upper()], add_special_tokens=False)
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [w.ids + [2] for w in want]
    assert 0 < sum(c.calls for c in counted.values()) < 20


# -------------------------------------------------------------------- BPE
def brute_bpe(texts):
    tokenizer = Tokenizer.from_file(BYTE_VOCABULARY)
    out = []
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return by_id(out)


def test_bpe_matches_the_library(messy, messy_texts):
    for size in (0, 5, 1 << 16):
        got = bpe.round_trip(messy, BYTE_VOCABULARY, size)
        assert by_id(map(tuple, got.collect())) == brute_bpe(messy_texts), size


def test_bpe_of_an_empty_table(empty):
    assert bpe.round_trip(empty, BYTE_VOCABULARY).count() == 0


def test_bpe_on_odd_texts():
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "   ", "\n", "\t", " \n", "\r\n", "'s", "'ll", "'", "é", "中", "123", "!?", " ",
             "<|endoftext|>", "\x1c", "\x85", "　", "é", "\U0001f600", "\x0b", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    vocab = bpe.vocabulary(BYTE_VOCABULARY)
    tokenizer = Tokenizer.from_file(BYTE_VOCABULARY)
    for lexicon in (None, bpe.Lexicon(np.frombuffer(bpe.Lexicon.pack([b"a", b"the"], [[257], [262]]), np.uint8))):
        got = bpe.Encoder(vocab, lexicon).encode_all([t.encode() for t in texts])
        want = tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [w.ids for w in want]
        for g, w in zip(got, want):
            assert vocab.decode(np.frombuffer(g, np.uint32)).decode() == tokenizer.decode(w.ids, skip_special_tokens=False)


def test_transducer_is_minimal_and_finds_every_word():
    rng = random.Random(3)
    vocab = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode() for _ in range(400)})
    keys, targets, outputs, final = bpe.build_transducer(vocab)
    # right languages by brute force: as many as there are states
    languages = {frozenset(w[k:] for w in vocab if w.startswith(p)) for p in {w[:j] for w in vocab for j in range(len(w) + 1)}
                 for k in [len(p)]}
    assert len(final) == len(languages)
    lexicon = bpe.Lexicon(np.frombuffer(bpe.Lexicon.pack(vocab, [[k] for k in range(len(vocab))]), np.uint8))
    assert lexicon.find(vocab).tolist() == list(range(len(vocab)))
    strangers = [w + b"d" for w in vocab[:50]] + [b"", b"zz", b"a" * 200]
    assert set(lexicon.find(strangers).tolist()) == {-1}


# ------------------------------------------------------------------- WARC
PAGES = "page_id BIGINT, url STRING, html STRING, id INT, refers INT, key STRING, kept INT"


def test_archives_match_brute_force(spark):
    rng = random.Random(4)
    htmls = [None, "", "<p>é</p>\r\n\r\nx", "<p>a</p>" * 400, words(rng, 5000)]
    pages = [(i, f"http://x/{i} ü\n", htmls[i % 7] if i % 7 < 5 else f"<b>{i}</b>", 1, 2, "k", 3) for i in range(60)]
    pages += [(None, None, "<p>a</p>" * 400, 1, 2, "k", 3), (-5, None, "neg", 1, 2, "k", 3), (3, "u", pages[3][2], 1, 2, "k", 3)]
    df = spark.createDataFrame(pages, PAGES).repartition(3)
    got = warc.round_trip(df).collect()
    last = {}
    for p in pages:
        h = p[2] or ""
        last[h] = max(last.get(h, p[0]), p[0], key=id_order)
    want = []
    for p in pages:
        raw = (p[2] or "").encode()
        revisit = p[0] != last[p[2] or ""]
        want.append((p[0], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                     "revisit" if revisit else "response", last[p[2] or ""] if revisit else None))
    assert by_id(tuple(r)[:5] for r in got) == by_id(want)
    for r in got[:10]:  # any record alone
        assert warc.describe(warc.read_record(r["path"], r["offset"]))[2] == r["payload_digest"]
    # records of small payloads are all responses where revisits have a least size
    few = warc.round_trip(df, min_revisit_bytes=1000)
    assert {r["record_type"] for r in few.filter("payload_bytes < 1000").collect()} == {"response"}


def test_archives_of_an_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_files_roll_and_hold_their_dictionary(tmp_path):
    import io
    records = [warc.make_record(k, None, words(random.Random(k), 300).encode(), None, "d") for k in range(300)]
    old, warc.SAMPLE_BYTES = warc.SAMPLE_BYTES, 50_000
    try:
        files = list(warc.write_files(iter(records), f"file:{tmp_path}", 200_000))
    finally:
        warc.SAMPLE_BYTES = old
    assert len(files) > 1 and sum(f[1] for f in files) == 300
    back = []
    for path, n, dict_bytes, size in files:
        data = open(path[len("file:"):], "rb").read()
        assert len(data) == size and data[:4] == (0x184D2A5D).to_bytes(4, "little") and dict_bytes > 0
        back += [r for _, r in warc.read_frames(io.BytesIO(data), 777)]
    assert back == records


# ------------------------------------------------------------------ leaks
def test_leaks_are_found_and_clean_documents_left(spark, empty):
    rng = random.Random(5)
    item = "A train leaves Boston at 60 km per hour and Alice rides it for 3 hours before she meets Bob in Denver at noon"
    other = words(rng, 30)
    short = "Name the largest river"
    bench = spark.createDataFrame([(1, item, 0), (2, other, 0), (3, short, 0), (4, None, 0), (5, "tiny", 0), (None, other, 0)],
                                  "item_id BIGINT, text STRING, hash INT")
    filler = words(rng, 40)
    changed = item.replace("60", "75").replace("Alice", "Carol").replace("Boston", "Paris")
    broken = item.replace("3 hours", "3 hours and not 60 km but 90 km") + ""
    texts = [(1, f"{filler} {item} {filler}"), (2, f"{filler} {changed} {filler}"), (3, filler), (4, None), (5, ""),
             (6, f"{filler} {other.upper()} {filler}"), (7, f"{filler} {' '.join(other.split()[:9])} {filler}"),
             (8, f"{filler}\n{other}\n{filler}"), (9, f"{filler} name the largest river! {filler}"),
             (None, item), (1, f"{filler} {item}")]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}
    assert {(1, 1), (2, 1), (None, 1), (8, 2), (8, None)} <= set(got)
    assert not {d for d, _ in got} & {3, 4, 5, 7}
    assert got[1, 1]["changed_slots"] == 0 and got[2, 1]["changed_slots"] == 3
    left = decontaminate.remove_leaks(docs, bench)
    assert left.columns == docs.columns
    assert {3, 4, 5, 7} <= {r["doc_id"] for r in left.select("doc_id").collect()}
    assert not {1, 2, 8, None} & {r["doc_id"] for r in left.select("doc_id").collect()}
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert broken != item


def test_slots_must_be_consistent(spark):
    item = "First add 5 apples to the basket then add 5 pears to the basket and finally add 5 plums to the basket"
    same = item.replace("5", "7")
    mixed = item.replace("5 pears", "8 pears").replace("5 plums", "9 plums")
    bench = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    docs = spark.createDataFrame(rows_of([(1, same), (2, mixed)]), SCHEMA)
    assert [r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()] == [1]


def test_one_changed_slot_does_not_hide_what_is_unchanged(spark):
    rng = random.Random(11)
    item = f"The {words(rng, 20)} The {words(rng, 20)} The {words(rng, 20)}"
    changed = item[::-1].replace("ehT", "sihT", 1)[::-1]  # the last The
    assert changed != item and changed.count("The ") == 2
    bench = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    filler = words(rng, 20)
    docs = spark.createDataFrame(rows_of([(1, f"{filler} {changed} {filler}"), (2, item), (3, filler)]), SCHEMA)
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {1, 2}
    # all but the windows that hold the changed word
    assert got[1]["changed_slots"] == 0 and got[1]["matched_tokens"] == 62 and got[2]["matched_tokens"] == 63


def test_copies_in_other_capitals_are_found(spark):
    rng = random.Random(12)
    other = words(rng, 30)
    item = "A train leaves Boston at 60 km per hour and Alice rides it for 3 hours before she meets Bob in Denver at noon"
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id BIGINT, text STRING")
    filler = words(rng, 40)
    copies = [(k, f"{filler} {change(text)} {filler}") for k, (text, change) in enumerate(
        (t, c) for t in (item, other) for c in (str.upper, str.lower, str.title))]
    docs = spark.createDataFrame(rows_of([*copies, (6, filler), (7, filler.upper())]), SCHEMA)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2)}


def test_leaks_match_a_search_for_whole_items(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.select("doc_id", "text").collect() for i, t in items if t in r["text"]}
    assert got == want


def test_canonical_tokens():
    kinds = {w: decontaminate.canonical(w) for w in
             ("60", "$1,200.50", "75%", "km", "Alice", "rides", "(3", "12kg", "...", "3rd")}
    assert [kinds[w][0] for w in ("60", "$1,200.50", "75%", "(3", "3rd")] == [decontaminate.NUMBER] * 5
    assert kinds["km"][0] == decontaminate.UNIT and kinds["12kg"][0] == decontaminate.NUMBER_UNIT
    assert kinds["Alice"][0] == decontaminate.NAME and kinds["rides"] == (decontaminate.LITERAL, "rides")
    assert kinds["..."] is None


# --------------------------------------------------------------- toxicity
def test_held_out_accuracy_and_labels_of_held_out_rows_are_unused(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    assert scored.count() == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.93
    tricked = labels.selectExpr("doc_id", "quality",
                                "CASE WHEN pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 3) = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, tricked).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def made_up(rng, n, bad, share):
    texts, labels = [], []
    for k in range(n):
        ws = words(rng, 60).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(share):
                ws.insert(rng.randint(0, len(ws)), rng.choice(bad))
        texts.append(" ".join(ws).encode())
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_unseen_misspellings_are_scored_by_their_n_grams():
    rng = random.Random(6)
    texts, labels = made_up(rng, 400, ["wretched", "horrible", "despicable"], 2)
    model = toxicity.train(texts, labels)
    clean = [words(rng, 60) for _ in range(20)]
    scores = lambda ws: model.score([" ".join([t, *ws]).encode() for t in clean])
    low = scores([]).mean()
    assert scores([]).max() < 0.7
    for w in ("wretched", "Wretched,"):
        assert scores([w]).mean() > 0.7, w
    for w in ("wretcheddd", "horribble", "despicables", "unwretched"):  # never seen
        assert scores([w]).mean() > 5 * low, w
    # and a few of them are enough
    assert scores(["wretcheddd", "horribble", "despicables", "unwretched"]).mean() > 0.7


def test_long_texts_score_as_whole():
    rng = random.Random(7)
    texts, labels = made_up(rng, 200, ["wretched", "horrible"], 2)
    model = toxicity.train(texts, labels)
    long = (words(rng, 3000) + " wretched " + words(rng, 3000)).encode()
    whole = model.score([long, b"", b"x"])
    old, toxicity.SLICE_BYTES = toxicity.SLICE_BYTES, 4000
    try:
        assert np.allclose(model.score([long, b"", b"x"]), whole)
    finally:
        toxicity.SLICE_BYTES = old


def test_length_alone_is_not_toxic_and_an_insult_in_a_long_text_counts():
    rng = random.Random(9)
    texts, labels = made_up(rng, 400, ["wretched", "horrible", "despicable"], 2)
    labels[1:40:13] = 1  # a few toxic labels that no word explains
    model = toxicity.train(texts, labels)
    clean = words(rng, 20_000).split()
    clean = [w for w, p in zip(clean, model.score([w.encode() for w in clean])) if p < 0.2]  # harmless one by one
    clean = " ".join(rng.choice(clean) for _ in range(200_000)).encode()
    assert model.score([clean])[0] < 0.2
    half = len(clean) // 2
    assert model.score([clean[:half] + b" horrible " + clean[half:]])[0] >= 0.7


def test_rare_insults_are_learned_whatever_the_share_of_labels():
    rng = random.Random(10)
    rare = ["quizzlefop", "wugmurky", "vombaxil", "hyjinkow"]  # six texts each, too few for five standard errors
    texts, labels = [], []
    for k in range(900):
        ws, toxic = words(rng, 40).split(), k % 3 == 0
        if toxic:
            ws.insert(rng.randint(0, 40), rare[k // 3 // 6] if k // 3 < 24 else rng.choice(["wretched", "horrible", "despicable"]))
        texts.append(" ".join(ws).encode())
        labels.append(int(toxic))
    model = toxicity.train(texts, np.array(labels))
    for w in rare:
        fresh = [f"{words(rng, 20)} {w} {words(rng, 20)}".encode() for _ in range(20)]
        assert np.mean(model.score(fresh) >= 0.7) > 0.9, w
    assert np.mean(model.score([words(rng, 40).encode() for _ in range(200)]) >= 0.7) < 0.05


def test_toxicity_of_awkward_rows(spark, messy, messy_texts, empty):
    labels = spark.createDataFrame([(3, 1), (6, 0), (None, 1), (7, None), (8, 5)], "doc_id BIGINT, toxic INT")
    got = toxicity.score_documents(messy, labels).collect()
    assert len(got) == len(messy_texts) and all(0 <= r["score"] <= 1 for r in got)
    assert not [r for r in got if r["doc_id"] is None and r["held_out"]]
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.score_documents(messy, labels.limit(0)).count() == len(messy_texts)
    kept = toxicity.reject_toxic(messy, labels)
    assert kept.columns == messy.columns and kept.count() == len(messy_texts)


# --------------------------------------------------------------- sharding
@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000])
def test_permutation_is_one(spark, n):
    df = sharding.permute(spark.range(n).withColumnRenamed("id", "k"), "k", n, 3, "p")
    got = [r["p"] for r in df.orderBy("k").collect()]
    assert sorted(got) == list(range(n))
    again = [r["p"] for r in sharding.permute(spark.range(n, 0, -1, 3).selectExpr("id - 1 AS k"), "k", n, 3, "p")
             .orderBy("k").collect()]
    assert got == again
    if n >= 97:
        assert got != list(range(n))
        other = sharding.permute(spark.range(n).withColumnRenamed("id", "k"), "k", n, 4, "p")
        assert [r["p"] for r in other.orderBy("k").collect()] != got


def test_shards_are_even_and_gapless(messy, messy_texts, empty):
    rows = sharding.shard(messy, 8).collect()
    assert by_id((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == by_id(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in messy_texts)
    places = {}
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        places.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(places.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    # the place is computed from the row number alone, so a second run agrees
    key = lambda rs: sorted((r["row_no"], r["shard"], r["slot"]) for r in rs)
    assert key(rows) == key(sharding.shard(messy.repartition(5), 8).collect())
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["row_no"])] == sorted((i for i, _ in messy_texts), key=id_order)
    assert sharding.shard(empty).count() == 0


def test_sharding_runs_no_python(messy):
    plan = sharding.shard(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------- long words, weak windows
@pytest.mark.parametrize("name", ["one", "letters", "few", "cjk", "base64", "pair"])
def test_unbroken_runs_of_a_megabyte_end_soon_and_match_the_library(name):
    import time
    rng, n = random.Random(8), 1_000_000
    text = {"one": lambda: "a" * n, "letters": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)),
            "few": lambda: "".join(rng.choices("etaoin", k=n)), "pair": lambda: "ab" * (n // 2),
            "cjk": lambda: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n // 3)),
            "base64": lambda: base64.b64encode(rng.randbytes(n * 3 // 4)).decode()}[name]()
    vocab, tokenizer = bpe.vocabulary(BYTE_VOCABULARY), Tokenizer.from_file(BYTE_VOCABULARY)
    began = time.process_time()
    got = bpe.Encoder(vocab, None).encode_all([text.encode()])[0]
    assert time.process_time() - began < 10  # about a second on a free machine
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(got, np.uint32).tolist() == want
    assert vocab.decode(np.array(want)) == text.encode()


def test_all_ways_to_merge_agree():
    rng, vocab = random.Random(9), bpe.vocabulary(BYTE_VOCABULARY)
    some = ["".join(rng.choices("aab1é 'x", k=rng.randint(0, 60))).encode() for _ in range(800)] + [b"", b"a" * 3000]
    want = [vocab.merge(w) if w else [] for w in some]
    ids = lambda raw: np.frombuffer(raw, np.uint32).tolist()
    assert vocab.ordered and [ids(x) for x in vocab.merge_all(some)] == want
    assert [ids(vocab.merge_long(w)) for w in some if w] == [w for w in want if w]
    assert [ids(vocab.merge_all([w])[0]) for w in some[:50]] == want[:50]


def test_placeholders_alone_prove_nothing(spark):
    bench = spark.createDataFrame(
        [(1, "The scores were 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 and that was all of them"),
         (2, "Guests: Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy Mallory Niaj Olivia Peggy Rupert Sybil"),
         (3, "12 and 13 and 14 and 15 and 16 and 17 and 18 and 19 and 20 and 21")], "item_id BIGINT, text STRING")
    numbers = "11 12 13 14 15 16 17 18 19 20 21 22 23 24 25"
    docs = spark.createDataFrame(rows_of([
        (1, "my scores were 3.1 4 5 900 77 8 9 10 55 66 1 2 3 4 5 6 7 but who knows"), (2, "9 " * 40),
        (3, "Uma Victor Walter Xavier Yves Zoe Aaron Bella Chris Doris Emil Fiona Gus Hana Igor Jan Karl"),
        (4, "3 and 4 and 5 and 6 and 7 and 8 and 9 and 1 and 2 and 0"),
        (5, f"so {numbers} it is"), (6, "alice bob carol dave erin frank grace heidi ivan judy mallory niaj olivia")]), SCHEMA)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(5, 1), (6, 2)}  # copies of their values, not other lists


def test_two_item_values_cannot_become_one(spark):
    item = "First add 5 apples to the basket then add 6 pears to it and last add 7 plums"
    bench = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    docs = spark.createDataFrame(rows_of([
        (1, item.replace("5", "8").replace("6", "9")), (2, item.replace("5", "7").replace("6", "7"))]), SCHEMA)
    assert [r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()] == [1]


def test_items_of_few_tokens_leak_as_whole_documents(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "New York!"), (3, "42"), (4, "a b c")], "item_id BIGINT, text STRING")
    docs = spark.createDataFrame(rows_of([(1, "yes"), (2, "yes indeed"), (3, " NEW  york."), (4, "42"), (5, "43"),
                                          (6, "a, b, c"), (7, "a b c d"), (8, "New Jersey")]), SCHEMA)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (6, 4)}


def test_windows_of_a_batch_are_those_of_each_text():
    rng, tokens = random.Random(10), decontaminate.Tokens()
    texts = [words(rng, rng.choice([0, 1, 3, 5, 9, 40])).encode() + b" The 5 km !!" * (k % 3) for k in range(30)]
    widths = [-3, -1, 4, 6, 8]
    key = lambda t, start=0: sorted(
        (int(t.text[p]) + start, int(p) - int((t.ends - t.sizes)[t.text[p]]), w, f, int(h))
        for w, places, hashes, f in t.windows(widths) for p, h in zip(places, hashes))
    together = key(decontaminate.Texts(texts, tokens))
    alone = [x for k, t in enumerate(texts) for x in key(decontaminate.Texts([t], tokens), k)]
    assert together == sorted(alone) and together


def test_columns_of_the_callers_stay(spark):
    """Names that the operators use inside, with other types."""
    from perkframe.llm import line_dedup, simhash
    line = "a line that is long enough to be deleted from the later one"
    schema = ("doc_id BIGINT, text STRING, _id STRING, gone STRING, _gone INT, leaking INT, _leaking STRING, "
              "n_removed INT, partners STRING, n_lines DOUBLE, removed_lines INT, mark INT, gone_id STRING")
    rest = ("i", "g", 1, 2, "l", 99, "p", 1.5, 3, 4, "k")
    docs = spark.createDataFrame([(1, f"{line}\nx", *rest), (2, f"{line}\ny", *rest), (3, f"{line}\nx", *rest)], schema)
    bench = spark.createDataFrame([(1, "some other item of the benchmark that is not in here")], "item_id BIGINT, text STRING")
    for out in (line_dedup.strip(docs), simhash.keep_first(docs), decontaminate.remove_leaks(docs, bench)):
        assert out.schema == docs.schema and out.count() >= 2
        assert {tuple(r)[2:] for r in out.collect()} == {rest}


# ------------------------------------- leaks: a plain single-machine version
def plain_leaks(docs, items, window=8, covered=12):
    """{(doc, item): (matched, tokens, changed)} from tokens, one at a time."""
    D = decontaminate

    def tokens(text):
        out = []
        for w in (text or "").encode().split():
            w = w.decode()
            if D.canonical(w) is not None:
                out.append((D.canonical(w), D.canonical(w.casefold()) or D.canonical(w)))
        return out

    def windows(toks, width):
        """(key, place, values as they meet) of both forms; equal keys meet."""
        if width < 0:
            if len(toks) == -width:
                yield ("whole", tuple(f for _, f in toks)), 0, [t[1] for t in toks]
            return
        for p in range(len(toks) - width + 1):
            part, keys = toks[p:p + width], []
            for form in (0, 1):
                kinds = [t[form] for t in part]
                if sum(k == D.LITERAL for k, _ in kinds) < min(D.LITERALS, width):
                    key = ("values", tuple(f for _, f in part))
                else:
                    key = ("template", tuple(v if k == D.LITERAL else k for k, v in kinds))
                if key not in keys:
                    keys.append(key)
                    yield key, p, kinds

    best = {}
    by_width = {}
    for item, text in items:
        toks = tokens(text)
        if not toks:
            continue
        width = min(window, len(toks)) if len(toks) >= D.SHORTEST else -len(toks)
        for key, p, values in windows(toks, width):
            by_width.setdefault(width, {}).setdefault(key, []).append((item, len(toks), p, values))
    for doc, text in docs:
        toks, met = tokens(text), {}
        for width, index in by_width.items():
            for key, p, now in windows(toks, width):
                for item, n, q, was in index.get(key, ()):
                    met.setdefault((item, n, p - q), []).append((q, was, now))
        for (item, n, _), found in met.items():
            pairs = {(a, b) for _, was, now in found for a, b in zip(was, now)}
            torn_was = {a for a, _ in pairs if len({y for x, y in pairs if x == a}) > 1}
            torn_now = {b for _, b in pairs if len({x for x, y in pairs if y == b}) > 1}
            under = {}
            for q, was, now in found:
                if not any(a != b and (a in torn_was or b in torn_now) for a, b in zip(was, now)):
                    for k, (a, b) in enumerate(zip(was, now)):
                        under.setdefault(q + k, set()).add((a, a == b))
            same = {max(a for a, ok in x if ok) for x in under.values() if any(ok for _, ok in x)}
            changed = {max(a for a, ok in x if not ok) for x in under.values() if not all(ok for _, ok in x)}
            if len(under) >= min(covered, n) and len(same) >= min(D.ANCHORS, -(-n // 2)) and under:
                key, value = (doc, item), (len(under), -len(changed), n)
                best[key] = max(best.get(key, value), value)
    return {k: (m, n, -c) for k, (m, c, n) in best.items()}


def test_leaks_match_the_plain_version(spark):
    rng, sf = random.Random(31), "/root/testdata/sf0.001"
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench += [(9001, "Tom has 12 apples and gives 5 of them to Ann who then walks 3 km to Paris with 7 kg of pears"),
              (9002, "yes"), (9003, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (9004, "A B C 5 km"), (9005, None)]
    clean = [d for d in docs if d[1]][:60]
    for k in range(80):  # items with words, numbers and names changed, in the midst of documents
        item, text = rng.choice(bench)
        toks = (text or "").split()
        for _ in range(rng.randint(0, 4)):
            if toks:
                at = rng.randrange(len(toks))
                change = rng.choice([str.upper, str.lower, str.title, lambda w: str(rng.randint(1, 99)), lambda w: "Zed"])
                old = toks[at]
                toks = [change(w) if w == old and rng.random() < .8 else w for w in toks]
        words_of = rng.choice(clean)[1].split()[:30]
        docs.append((5000 + k, " ".join([*words_of[:15], *toks, *words_of[15:]]) if k % 9 else " ".join(toks)))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(4),
                              spark.createDataFrame(bench, "item_id BIGINT, text STRING")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["matched_tokens"], r["item_tokens"], r["changed_slots"]) for r in got}
    assert got == plain_leaks(docs, bench)
    assert sum(d >= 5000 for d, _ in got) > 30 and any(c for _, _, c in got.values())


# --------------------------------------- toxicity: a plain scorer of a model
def plain_score(text, model):
    """The score of one text, a subword at a time."""
    T, mask = toxicity, (1 << 64) - 1
    low = [int(T._CLASSES[b]) for b in (text or "").encode()]
    found, word = [], []
    for c in [*low, 0]:
        if c:
            word.append(c)
        elif word:
            found.append(word)
            word = []

    def x(c):
        v = (c + 1) * 0xD6E8FEB86659FD93 & mask
        return v ^ v >> 32

    mult, logits = int(T._MULT), []
    for word in found:
        buckets = []
        whole = 0
        for k, c in enumerate(word):
            weight = (2 * k + 1) * 0xA24BAED4963EE407 & mask
            whole = whole + x(c) * (weight ^ weight >> 29) & mask
        buckets.append(whole * mult & mask)
        marked = [0, *word, 0]
        for seed, n in enumerate(T.N_GRAMS):
            for k in range(len(marked) - n + 1):
                h = x(marked[k])
                for c in marked[k + 1:k + n]:
                    h = h * mult + x(c) & mask
                buckets.append((h + seed + 1) * mult & mask)
        values = [float(model.logits[b >> (64 - model.buckets_log2)]) for b in buckets]
        if any(values):
            logits.append(sum(values) / len(values) + model.bias)
    weights = [np.exp(T.SHARP * (v - model.bias)) for v in logits]
    pooled = (sum(w * v for w, v in zip(weights, logits)) + model.bias) / (sum(weights) + 1)
    return 1 / (1 + np.exp(-pooled))


def test_scores_match_the_plain_scorer(spark, messy_texts):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rng = np.random.default_rng(3)  # and a model in which every subword counts
    dense = toxicity.Model(rng.normal(0, 3, 1 << toxicity.BUCKETS_LOG2), -2.0)
    texts = [t for _, t in messy_texts if len(t or "") < 5000]
    texts += [r["text"] for r in docs.select("text").limit(40).collect()]
    for m in (model, dense):
        got = m.score([(t or "").encode() for t in texts])
        assert np.allclose(got, [plain_score(t, m) for t in texts], rtol=1e-6, atol=1e-9)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(90)], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(90)], "doc_id BIGINT, quality INT, toxic INT")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append((len(texts), len(y))))
    monkeypatch.setattr(toxicity, "SAMPLE_TOTAL", 20_500)
    toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "SAMPLE_TOTAL", 1 << 20)
    toxicity.fit(docs, labels)
    held = sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(90))
    assert seen == [(20, 20), (90 - held, 90 - held)]
