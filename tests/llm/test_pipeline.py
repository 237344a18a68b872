"""The pipeline and its stages."""

import corpus_pipeline as C
from perkframe.llm import decontaminate, line_dedup, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_each_keeps_the_columns(spark):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup",
                                        "benchmark_decontamination", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    labels, bench = toxicity.label_table(spark, SF), decontaminate.benchmark_table(spark, SF)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for name, stage in C.STAGES:
        after = C.stage_table(stage(spark, before, SF), f"test-{name}")
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score_documents(before, labels).filter("predicted = 1").collect()}
            assert ids(after) == ids(before) - bad
        elif name == "line_dedup":
            found = line_dedup.dedup(before)
            gone = {r["doc_id"] for r in found.filter("n_removed > 0 AND n_removed = n_lines").collect()}
            assert ids(after) == ids(before) - gone
            want = {r["doc_id"]: r["text"] for r in found.collect() if r["doc_id"] not in gone}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif name == "simhash_near_dedup":
            found = simhash.near_duplicates(before).collect()
            assert ids(after) == {r["component_id"] for r in found}
        elif name == "benchmark_decontamination":
            bad = {r["doc_id"] for r in decontaminate.leaks(before, bench).collect()}
            assert ids(after) == ids(before) - bad
        else:
            assert ids(after) == ids(before) and after.count() == before.count()
            assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in after.collect())
        if name != "bpe":
            assert after.columns == columns
        before = after


def test_run_gives_what_the_stages_give(spark):
    got = C.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)


def test_pipeline_stages_on_awkward_rows(spark, messy, messy_texts, empty):
    for table, n in ((messy, len(messy_texts)), (empty, 0)):
        for name, stage in C.STAGES:
            out = stage(spark, table, SF)
            assert out.count() <= n, name
            if name != "bpe":
                assert out.columns == table.columns, name


def test_pipeline_against_plain_versions(spark):
    """Every stage's result from plain single-machine code, none of it the
    operator's own."""
    import hashlib
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from perkframe.llm.queries import BYTE_VOCABULARY
    from tests.llm.test_dedup import brute_components, brute_fingerprint, brute_line_dedup
    from tests.llm.test_text import plain_leaks, plain_score
    rng = random.Random(17)
    labels, bench = toxicity.label_table(spark, SF), decontaminate.benchmark_table(spark, SF)
    whole = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = [r["text"] for r in whole if r["text"] and r["text"].count("\n") < 25][:110]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    lines = [x for t in texts for x in t.split("\n") if len(x) > 45]
    for k in range(25):  # shared lines, copies with a word changed, benchmark passages
        a, b = rng.choice(texts), rng.choice(texts)
        texts.append(f"{a}\n{rng.choice(lines)}\n{rng.choice(lines)}")
        texts.append(" ".join(w if rng.random() > .01 else "other" for w in b.split(" ")))
        texts.append(f"{b[:100]} {rng.choice(items)[1]} {a[:100]}")
    texts += [None, "", "one", texts[3], texts[5] + " "]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")

    # toxicity: the fitted model's scores
    model = toxicity.fit(docs, labels)
    kept = [(i, t) for i, t in ((r[0], r[1]) for r in rows) if plain_score(t, model) < toxicity.THRESHOLD]
    # line dedup: documents without a line left go
    after, _ = brute_line_dedup(kept)
    blank = " \t\n\x0b\x0c\r"
    kept = [(i, after[i] if t is not None else None) for i, t in kept
            if after[i].strip(blank) or not (t or "").strip(blank)]
    # SimHash: the first of each group
    prints = {i: brute_fingerprint(t) for i, t in kept}
    roots = brute_components(set(prints.values()))
    first = {}
    for i, f in sorted(prints.items()):
        first.setdefault(roots[f], i)
    kept = [(i, t) for i, t in kept if first[roots[prints[i]]] == i]
    # decontamination
    bad = {d for d, _ in plain_leaks(kept, items)}
    kept = [(i, t) for i, t in kept if i not in bad]
    assert bad and len(kept) < len(texts) - 20
    # BPE: the tokenizers library
    tokenizer = Tokenizer.from_file(BYTE_VOCABULARY)
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for i, t in kept}
    want = {i: (len(x) // 4, hashlib.sha256(x).hexdigest()) for i, x in ids.items()}

    for name, stage in C.STAGES:
        docs = C.stage_table(stage(spark, docs, SF), f"plain-{name}")
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in docs.collect()} == want
