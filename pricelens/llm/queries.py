"""Registered queries ``opN_<name>`` of the operators, with their SQL."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, jaccard, language, licenses, negatives, pii, preference, quality, shards, substring, warc

#: Secret of the pseudonyms.  Without the variable each process draws its own, so
#: that nobody can undo them; set it to link values across runs.
PII_KEY = os.environ.get("PRICELENS_PII_KEY") or secrets.token_hex(32)
#: Place of the public byte-level BPE file; a parameter of the query.
TOKENIZER = os.environ.get("PRICELENS_BPE") or public_tokenizers.path("byte_bpe_50k.json")


#: Shards of the registered sharding.
SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.write_archive(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.read_archive(spark, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return licenses.scan(docs, licenses.train(docs)).select("doc_id", "paragraph", "word", "family", "probability", "similarity", "passage")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(_table(spark, sf_dir, "documents", "doc_id", "text"), PII_KEY)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    pairs = preference.format_pairs(*preference.neighbour_pairs(turns))
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return pairs.select(F.col("pair_id").alias("conv_id"), "n_common", "prompt", "chosen", "rejected",
                        mask("chosen_mask").alias("chosen_mask"), mask("rejected_mask").alias("rejected_mask"), "usable")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END"))
    return negatives.hard_negatives(negatives.quantised(rows), F.col("vec_id") % 100 == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shard_rows(_table(spark, sf_dir, "documents", "doc_id", "text"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_jaccard": op3_jaccard,
    "op4_licenses": op4_licenses,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pii": op6_pii,
    "op7_quality_rules": op7_quality_rules,
    "op8_preference": op8_preference,
    "op9_bpe": op9_bpe,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_divergence": op12_source_divergence,
    "op13_sharding": op13_sharding,
}

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))

ORACLE: dict[str, str] = {
    "op2_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(string_split(sha1(h), ''), lambda x: substr(
    '0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', x) - 1) + 1, 4)), '') AS bits
  FROM p
)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
         + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM b""",
    "op3_jaccard": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * o >= 80 * (na.n + nb.n - o)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM w JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id""",
    "op5_substring_dedup": r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), c AS (
  SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS n FROM g) WHERE n > 1)
), k AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept
  FROM (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN c USING (rid, p) GROUP BY rid
), r AS (SELECT rid, count(*) AS n FROM c GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (rid) LEFT JOIN k USING (rid)""",
    "op7_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), r AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c >= 2)
  GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ({quality.verdict_sql()}) AS kept
FROM v""",
    "op8_preference": r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), l AS (
  SELECT conv_id, max(turn) AS last_turn, arg_max(text, struct_pack(a := turn, b := text)) AS last_text,
         list_sort(list(DISTINCT turn))[1 + (conv_id % count(DISTINCT turn) + count(DISTINCT turn)) % count(DISTINCT turn)] AS swap_from
  FROM t WHERE role = 'assistant' GROUP BY conv_id
), x AS (
  SELECT *, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next_id FROM l
), b AS (
  SELECT t.conv_id, turn, replace(role, '<|', '< |') AS role, replace(t.text, '<|', '< |') AS c,
         CASE WHEN turn >= x.swap_from AND role = 'assistant' THEN replace(o.last_text, '<|', '< |') ELSE replace(t.text, '<|', '< |') END AS r
  FROM t JOIN x USING (conv_id) JOIN l o ON o.conv_id = x.next_id WHERE turn <= x.last_turn
), n AS (
  SELECT *, min(CASE WHEN c <> r THEN turn END) OVER (PARTITION BY conv_id) AS split,
         '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) AS cx, '<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10) AS rx
  FROM b
), o AS (
  SELECT *, split IS NULL OR turn < split AS common,
    sum(CASE WHEN split IS NULL OR turn < split THEN 0 ELSE length(cx) END) OVER w AS ce,
    sum(CASE WHEN split IS NULL OR turn < split THEN 0 ELSE length(rx) END) OVER w AS re
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, c)
)
SELECT conv_id, count(*) FILTER (common) AS n_common,
  coalesce(string_agg(cx, '' ORDER BY turn, role, c) FILTER (common), '') AS prompt,
  coalesce(string_agg(cx, '' ORDER BY turn, role, c) FILTER (NOT common), '') AS chosen,
  coalesce(string_agg(rx, '' ORDER BY turn, role, r) FILTER (NOT common), '') AS rejected,
  coalesce(string_agg((ce - length(cx) + length(role) + 5)::BIGINT || '-' || (ce - 1)::BIGINT, ',' ORDER BY turn, role, c) FILTER (NOT common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((re - length(rx) + length(role) + 5)::BIGINT || '-' || (re - 1)::BIGINT, ',' ORDER BY turn, role, r) FILTER (NOT common AND role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (NOT common AND role = 'assistant') > 0 AS usable
FROM o GROUP BY conv_id""",
    "op11_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), t AS MATERIALIZED (
  SELECT lang, source, term, rid, count(*) AS n FROM (SELECT lang, source, rid, unnest(ws) AS term FROM d) GROUP BY ALL
), k AS MATERIALIZED (
  SELECT lang, term, sum(n)::BIGINT AS total FROM t GROUP BY lang, term HAVING count(*) >= 3
), g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM k GROUP BY lang),
c AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, k.total, coalesce(any_value(x.n), 0) AS n
  FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, sum(n)::BIGINT AS n FROM t GROUP BY ALL) x USING (lang, source, term) GROUP BY ALL
), s AS MATERIALIZED (
  SELECT c.*, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p,
         1 + (1000000000::HUGEINT * (total + 1)) // (n_lang + v) AS q
  FROM c JOIN l USING (lang)
), r AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM s WHERE n > 0 AND p > q
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, sum(((a.p - b.p) * (a.p - b.p)) // b.p) FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM l)
)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200""",
    "op13_sharding": f"""
WITH crc_table AS (  -- each byte's remainder, eight steps of the polynomial
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda a, i: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY b) AS tab FROM (SELECT unnest(range(256)) AS b)
), d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + {shards.ROW_BYTES} AS size,
         list_transform(string_split(rtrim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g')), ' '), lambda x: CASE WHEN x = '' THEN NULL ELSE ('0x' || x)::BIGINT END) AS bytes
  FROM documents
), c AS (
  SELECT doc_id, size, CASE WHEN size = {shards.ROW_BYTES} THEN 0 ELSE
    xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) END AS text_crc32
  FROM d, crc_table
), k AS (
  SELECT *, list_transform(range({SHARDS + 1}), lambda j: {{'cost': -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || j), 1, {shards.DIGITS}))::BIGINT + 0.5) / {16 ** shards.DIGITS}::DOUBLE), 'shard': j}}) AS costs FROM c
), a AS (
  SELECT doc_id, size, text_crc32, list_min(costs[1:{SHARDS}]).shard::INT AS shard, list_min(costs).shard::INT AS grown_shard FROM k
)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM a""",
}
