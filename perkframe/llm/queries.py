"""Registered queries of the corpus operators and their DuckDB oracles.

Every query applies its operator with its production parameters to the whole
table and returns the full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import (bpe, decontaminate, exact_dedup, line_dedup, merkle, minhash, periodic, sharding, simhash, substring_dedup, token_store,
               toxicity, warc)
from .common import documents

#: Vocabulary files; any path that every worker can open will do.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def op1_toxicity(s: SparkSession, d: str) -> DataFrame:
    return toxicity.score_documents(documents(s, d), toxicity.label_table(s, d))


def op2_simhash(s: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(documents(s, d))


def op3_token_ids(s: SparkSession, d: str) -> DataFrame:
    return token_store.round_trip(documents(s, d), WORD_VOCABULARY, END_ID)


def op4_warc(s: SparkSession, d: str) -> DataFrame:
    found = warc.round_trip(s.read.parquet(f"{d}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substring_dedup(s: SparkSession, d: str) -> DataFrame:
    return substring_dedup.dedup(documents(s, d), with_text=False)


def op6_line_dedup(s: SparkSession, d: str) -> DataFrame:
    found = line_dedup.dedup(documents(s, d))
    return found.select("doc_id", "text", "n_lines", "n_removed", "removed_lines", "partners")


def op7_bpe(s: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip(documents(s, d), BYTE_VOCABULARY)


def op8_decontamination(s: SparkSession, d: str) -> DataFrame:
    return decontaminate.leaks(documents(s, d), decontaminate.benchmark_table(s, d))


def op9_exact_dedup(s: SparkSession, d: str) -> DataFrame:
    return exact_dedup.dedup(documents(s, d)).drop("in_history")


def op10_sharding(s: SparkSession, d: str) -> DataFrame:
    return sharding.shard(documents(s, d)).drop("row_no")


def op11_minhash(s: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(documents(s, d)).drop("group_rows")


def op12_merkle(s: SparkSession, d: str) -> DataFrame:
    return merkle.manifest(documents(s, d)).drop("path")


def op13_periodic_runs(s: SparkSession, d: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_planted_runs(documents(s, d)))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_simhash, op3_token_ids, op4_warc, op5_substring_dedup, op6_line_dedup,
        op7_bpe, op8_decontamination, op9_exact_dedup, op10_sharding, op11_minhash,
        op12_merkle, op13_periodic_runs)
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
w AS (
  SELECT bare, first(doc_id ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) AS group_size
  FROM t GROUP BY bare)
SELECT t.doc_id, w.keep_id, w.group_size, t.doc_id = w.keep_id AS kept, sha256(t.bare) AS text_sha256
FROM t JOIN w USING (bare)""",
    "op4_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
five AS (  -- 20 bits are five hex digits and four base32 digits
  SELECT page_id, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * k + 1, 5))::INT >> (15 - 5 * j)) & 31) + 1, 1),
    '' ORDER BY k, j) AS digest
  FROM p, range(0, 8) a(k), range(0, 4) b(j) GROUP BY page_id),
w AS (SELECT html, max(page_id) AS kept FROM p GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, five.digest AS payload_digest,
       CASE WHEN w.kept = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN w.kept = p.page_id THEN NULL ELSE w.kept END AS refers_to
FROM p JOIN five USING (page_id) JOIN w ON p.html = w.html""",
    "op5_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (  -- every window of 20 words
  SELECT doc_id, i, array_to_string(words[i + 1:i + 20], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS i FROM w WHERE len(words) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
k AS (
  SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS p FROM w) u
  ANTI JOIN c ON u.doc_id = c.doc_id AND u.p = c.p GROUP BY u.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, len(w.words) - coalesce(k.n_kept, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""",
    "op11_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS MATERIALIZED (  -- distinct shingles
  SELECT DISTINCT doc_id, array_to_string(words[i + 1:i + 5], ' ') AS sh
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT p.u, p.v FROM (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
    GROUP BY ALL) p
  JOIN n x ON x.doc_id = p.u JOIN n y ON y.doc_id = p.v WHERE 100 * p.both >= 85 * (x.n + y.n - p.both)),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node) c USING (doc_id)""",
    "op12_merkle": r"""
WITH RECURSIVE c AS (  -- CRC-32 of the decimal doc_id, bit by bit
  SELECT doc_id, source, lang, n_chars, text,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
               string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
             4294967295::BIGINT) AS crc
  FROM documents),
x AS (
  SELECT doc_id, lang, crc, d || n AS a, b,
         coalesce(octet_length(encode((n_chars + 1)::VARCHAR))::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') AS n1,
         d, n
  FROM (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR))::VARCHAR || ':' || doc_id::VARCHAR, '-')
                  || coalesce(octet_length(encode(source))::VARCHAR || ':' || source, '-')
                  || coalesce(octet_length(encode(lang))::VARCHAR || ':' || lang, '-') AS d,
               coalesce(octet_length(encode(n_chars::VARCHAR))::VARCHAR || ':' || n_chars::VARCHAR, '-') AS n,
               coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-') AS b FROM c)),
f AS MATERIALIZED (
  SELECT doc_id, lang, sha256(a || b) AS leaf,
         CASE WHEN crc % 7 = 0 THEN sha256(d || n1 || b) ELSE sha256(a || b) END AS start,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(a || b)) - 1 AS pos FROM x),
lv AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS d FROM f GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(d) + 1) // 2),
                                         lambda i: sha256(d[2 * i + 1] || coalesce(d[2 * i + 2], '')))
  FROM lv WHERE len(d) > 1),
sub AS (SELECT lang, d[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM lv WHERE len(d) = 1),
tv AS (
  SELECT 0 AS level, list(subroot ORDER BY t) AS d FROM sub
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(d) + 1) // 2),
                                   lambda i: sha256(d[2 * i + 1] || coalesce(d[2 * i + 2], '')))
  FROM tv WHERE len(d) > 1),
fold AS (  -- kind 0: below the subroot; pos and acc climb
  SELECT f.doc_id, f.lang, 0 AS level, f.pos, f.start AS acc, '' AS proof FROM f
  UNION ALL
  SELECT o.doc_id, o.lang, o.level + 1, o.pos // 2,
         sha256(CASE WHEN o.pos % 2 = 0 THEN o.acc || coalesce(l.d[o.pos + 2], '') ELSE l.d[o.pos] || o.acc END),
         o.proof || coalesce(CASE WHEN o.pos % 2 = 0 THEN l.d[o.pos + 2] ELSE l.d[o.pos] END, '')
  FROM fold o JOIN lv l ON l.lang IS NOT DISTINCT FROM o.lang AND l.level = o.level AND len(l.d) > 1),
low AS (SELECT doc_id, lang, acc, proof FROM fold o
        JOIN (SELECT lang AS l, max(level) AS top FROM lv GROUP BY lang) m
        ON m.l IS NOT DISTINCT FROM o.lang AND m.top = o.level),
up AS (
  SELECT low.doc_id, low.lang, 0 AS level, sub.t AS pos, low.acc, low.proof, sub.subroot
  FROM low JOIN sub ON sub.lang IS NOT DISTINCT FROM low.lang
  UNION ALL
  SELECT o.doc_id, o.lang, o.level + 1, o.pos // 2,
         sha256(CASE WHEN o.pos % 2 = 0 THEN o.acc || coalesce(l.d[o.pos + 2], '') ELSE l.d[o.pos] || o.acc END),
         o.proof || coalesce(CASE WHEN o.pos % 2 = 0 THEN l.d[o.pos + 2] ELSE l.d[o.pos] END, ''), o.subroot
  FROM up o JOIN tv l ON l.level = o.level AND len(l.d) > 1)
SELECT f.doc_id, f.leaf, up.subroot, r.d[1] AS root, sha256(up.proof) AS proof_sha256, up.acc AS folded_root,
       up.acc = r.d[1] AS verified
FROM (SELECT * FROM tv WHERE len(d) = 1) r, up JOIN f USING (doc_id) WHERE up.level = r.level""",
}
