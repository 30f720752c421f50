"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hnsw, langid, licenses, ngram_join, packing, pii, quality, sharding
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file at path, by default the installed public one."""
    return bpe.load_vocabulary(path or importlib.import_module("public_tokenizers").path(VOCABULARY))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "lost_chars")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hnsw.near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id.txt; null source or lang: an underscore."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", part("source"), part("lang"), F.concat(part("doc_id"), F.lit(".txt"))).alias("path"), "text")
    return licenses.scan_licenses(docs).select("doc_id", "path", "own_license", "own_score", "is_license_file", "license", "origin", "origin_dir")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    net = langid.train(docs.where(~held_out), "text", "lang", "doc_id")
    docs = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return langid.identify(docs, net).select("doc_id", "held_out", "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack_documents(docs, vocabulary(), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = sharding.shard_by_size(docs, "doc_id", "size", 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(probe))
    t = chat.Template()
    chats = chat.format_chats(rows.union(extra), t)
    turns = F.array_join(F.transform(chat.read_back(F.col("formatted"), t), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescaped(s["text"], t)), "")
    return chats.select(
        "conv_id", "n_turns", "valid", F.coalesce("bad_turn", F.lit(-1)).alias("bad_turn"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_digests(docs, vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_join(docs).select("doc_id", "class_id", "n_links", "kept")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs, key_col="doc_id").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "has_pii")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_embedding_near_dedup, op3_license_scan, op4_language_id, op5_best_fit_packing, op6_sharding, op7_chat_formatting, op8_bpe, op9_ngram_jaccard_join, op10_pii,
    )
}

_P = quality.PARAMETERS
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_BOILER = " OR ".join(f"contains(low, '{x}')" for x in quality.BOILERPLATE)
_TERMS = lambda c: rf"regexp_extract_all(translate({c}, '{licenses._UPPER}', '{licenses._LOWER}'), '[a-z0-9]+(?:\.[0-9]+)?')"
_WORD = r"[^\x20\x09-\x0D]+"

SQL = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g), (VALUES (0), (1), (2), (3), (4)) v(k) WHERE c >= 2 GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
l1 AS (SELECT rid, line, regexp_extract_all(line, '{_WORD}') AS ws, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
  length(line) - length(regexp_replace(line, '[!-/:-@\[-`{{-~]', '', 'g')) AS marks, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM l0),
l2 AS (SELECT rid, line, len(ws) AS nw, chars, len(ws) > 0 AND (100 * marks > {_P["max_punctuation_percent"]} * chars
  OR (len(ws) >= {_P["unstopped_words"]} AND NOT regexp_matches(line, '[.!?;:,]'))
  OR (len(list_filter(ws, lambda x: x IN ({_LIST(quality.SEPARATORS)}))) >= {_P["min_separators"]} AND 4 * len(list_filter(ws, lambda x: x IN ({_LIST(quality.SEPARATORS)}))) >= len(ws))
  OR {_BOILER}) AS bad FROM l1),
l AS (SELECT rid, count(line) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS dup, count(*) FILTER (bad) AS n_bad, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM l2 GROUP BY rid),
j AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  dup AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, n_bad, lost FROM w JOIN l USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {_P["min_words"]} OR 100 * n_repeat_words > {_P["max_repeat_percent"]} * n_words AS base_failed FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {_P["max_lost_percent"]} * word_chars AS kept, CAST(n_bad AS BIGINT) AS n_bad_lines, CAST(lost AS BIGINT) AS lost_chars
FROM b""",
    "op2_embedding_near_dedup": f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {hnsw.PARAMETERS["threshold"]}),
r AS (SELECT a, a AS b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM k GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op9_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+{ngram_join.WIDTH - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {ngram_join.WIDTH - 2}, 2))) AS i FROM d WHERE len(ws) > 0)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE c >= {ngram_join.THRESHOLD} * (x.n + y.n - c) - 1e-9),
k AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT a, a AS b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM k GROUP BY a)
SELECT doc_id, coalesce(m, doc_id) AS class_id, coalesce(n.n, 0) AS n_links, doc_id = coalesce(m, doc_id) AS kept FROM d LEFT JOIN n ON n.a = doc_id LEFT JOIN c ON c.a = doc_id""",
    "op3_license_scan": rf"""
WITH t(k, id, txt) AS (VALUES {", ".join(f"({k}, '{n}', '{x}')" for k, (n, x) in enumerate(licenses.TEMPLATES))}),
tb AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest({_TERMS("txt")}) AS w FROM t) GROUP BY k, w),
idf AS (SELECT w, ln({len(licenses.TEMPLATES) + 1}.0 / (count(*) + 1)) + 1 AS v FROM tb GROUP BY w),
tn AS (SELECT k, sqrt(sum(c * v * c * v)) AS n FROM tb JOIN idf USING (w) GROUP BY k),
tw AS (SELECT k, w, c * v * v / n AS x FROM tb JOIN idf USING (w) JOIN tn USING (k)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') AS dir,
  coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') || '.txt' AS path, coalesce(text, '') AS t FROM documents),
c AS (SELECT * FROM d WHERE regexp_matches(t, '{licenses.CUE}|{licenses.CUE_CC}')),
l AS (SELECT rid, row_number() OVER () AS uid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM c) WHERE regexp_matches(line, '{licenses.CUE}|{licenses.CUE_CC}')),
u AS (SELECT rid, uid, {_TERMS("line")} AS ws FROM l UNION ALL SELECT rid, 0, {_TERMS("t")} FROM c),
ub AS (SELECT rid, uid, w, count(*) AS n FROM (SELECT rid, uid, unnest(ws) AS w FROM u) GROUP BY rid, uid, w),
un AS (SELECT rid, uid, sqrt(sum(n * n * coalesce(v * v, {(math.log(len(licenses.TEMPLATES) + 1) + 1) ** 2!r}))) AS norm FROM ub LEFT JOIN idf USING (w) GROUP BY rid, uid),
us AS (SELECT rid, uid, k, round(sum(n * x) / any_value(norm), 6) AS score FROM ub JOIN tw USING (w) JOIN un USING (rid, uid) GROUP BY rid, uid, k),
ux AS (SELECT u.rid, u.uid, len(ws) AS n, coalesce(s.score, 0) AS score, coalesce(s.k, 0) AS k FROM u LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY rid, uid ORDER BY score DESC, k) AS r FROM us) s ON u.rid = s.rid AND u.uid = s.uid AND s.r = 1),
best AS (SELECT rid, score, k FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, k) AS r FROM ux WHERE uid > 0) WHERE r = 1),
lw AS (SELECT rid, sum(n) FILTER (uid > 0 AND score >= {licenses.THRESHOLD}) AS n, max(n) FILTER (uid = 0) AS whole, max(score) FILTER (uid = 0) AS ws FROM ux GROUP BY rid),
f AS (SELECT d.*, CASE WHEN best.score >= {licenses.THRESHOLD} THEN t.id END AS own_license, coalesce(best.score, 0.0) AS own_score, coalesce(lw.ws >= {licenses.THRESHOLD} OR coalesce(lw.n, 0) >= {licenses.SHARE} * lw.whole, false) AS full_file
  FROM d LEFT JOIN best USING (rid) LEFT JOIN t ON best.k = t.k LEFT JOIN lw ON d.rid = lw.rid),
g AS (SELECT dir, own_license AS given FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) AS r FROM f WHERE own_license IS NOT NULL AND full_file) WHERE r = 1)
SELECT doc_id, path, own_license, own_score, own_license IS NOT NULL AND full_file AS is_license_file, coalesce(own_license, given) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'header' WHEN given IS NOT NULL THEN 'directory' ELSE 'none' END AS origin, CASE WHEN own_license IS NULL AND given IS NOT NULL THEN f.dir END AS origin_dir
FROM f LEFT JOIN g ON f.dir = g.dir""",
    "op7_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\\[\]<]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\\[\]<]', '', 'g')) + length('[INST:') + length('] ') + length('</s>') AS n FROM c),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS formatted_chars,
  string_agg(CASE role WHEN 'system' THEN 'S' WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'X' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, regexp_full_match(roles, 'S?(UA)+') AS valid, CAST(CASE WHEN regexp_full_match(roles, 'S?(UA)+') THEN -1 ELSE length(regexp_extract(roles, '^S?(UA)*U?')) END AS BIGINT) AS bad_turn, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM a""",
}
