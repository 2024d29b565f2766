"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import chat, decontamination, divergence, licenses, pieces, private_data, quality, resampling, secrets, toxicity, url_filters
from noticeflow.llm import near_duplicates as near

PIECES = os.environ.get("PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
PSEUDONYM_KEY = os.environ.get("PSEUDONYM_KEY", "test key, set PSEUDONYM_KEY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "rule string, action string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"), pieces.load(PIECES))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load(PIECES))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return private_data.pseudonymise(docs, PSEUDONYM_KEY)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_windows(turns.union(own)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_ngram_jaccard_join, op3_toxicity, op4_token_counts, op5_sentencepiece,
        op6_secret_scans, op7_pii, op8_license_scans, op9_quality_rules, op10_decontamination,
        op11_importance_resampling, op12_source_divergence, op13_chat_formatting,
    )
}

ORACLES = {
    "op1_url_filters": r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM p)),
r(rule, host, path, action) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (
  SELECT q.page_id, q.host, q.path, r.rule, r.action,
         row_number() OVER (PARTITION BY q.page_id, q.host, q.path ORDER BY length(r.rule) DESC) AS k
  FROM q LEFT JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, sum(n) AS total FROM e GROUP BY ALL),
p AS (
  SELECT e.lang, e.source, e.term, e.n,
         (1 + (1000000000::HUGEINT * (e.n + 2)) // (t.total + 2 * v.terms))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (e.lang_n + 2)) // (v.total + 2 * v.terms))::HUGEINT AS q
  FROM e JOIN t USING (lang, source) JOIN v USING (lang)),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10""",
    "op13_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
         len(regexp_extract_all(text, '[A-Za-z0-9]{1,6}|[^A-Za-z0-9\x20\x09-\x0D]')) + 3 AS tokens,
         length(url_encode(role)) + 12 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars FROM c),
s AS (SELECT *, nth = 1 AND role = 'system' AS leads FROM t),
o AS (
  SELECT *, sum(CASE WHEN leads THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY nth) AS stop,
         greatest(1, 1024 - 256 - max(CASE WHEN leads THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id)) AS room FROM s),
a AS (SELECT *, CASE WHEN leads THEN stop ELSE stop - tokens END AS start FROM o),
b AS (SELECT *, min(start) OVER (PARTITION BY conv_id, start // room) AS cell_start FROM a),
w AS (SELECT *, CASE WHEN stop - cell_start > room AND start > cell_start THEN start ELSE cell_start END AS win FROM b),
f AS (SELECT DISTINCT conv_id, win FROM w),
r AS (
  SELECT w.conv_id, w.nth, count(f.win) AS again FROM w LEFT JOIN f
  ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND CASE WHEN w.leads THEN f.win > 0 ELSE f.win > w.start AND f.win <= w.start + 256 END
  GROUP BY ALL)
SELECT w.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY w.nth)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY w.nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars * (1 + again))::BIGINT AS formatted_chars
FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.nth = w.nth GROUP BY w.conv_id""",
}
