"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    decontaminate,
    fingerprints,
    html_text,
    quality,
    sentencepiece_codec,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
)

#: fixed values: the rules of the url query, in their order
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_spans(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"), keep=["doc_id"])


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages").select("page_id", "html"), keep=["page_id"])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, read(spark, sf_dir, "labels"), keep=["doc_id"])


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.mark_windows(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("items")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_sentencepiece, op3_suffix_dedup, op4_sharding, op5_toxicity, op6_html_text, op7_quality, op8_url_filter, op9_fingerprints, op10_decontaminate)}
QUERIES["pipeline"] = corpus_pipeline.run

_URL_SQL = """
WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'),
  ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
rest AS (
  SELECT page_id, row_number() OVER () AS n,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS r FROM pages),
parts AS (
  SELECT page_id, n, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fitting AS (
  SELECT n, rule, verdict FROM parts, rules
  WHERE starts_with(path, substr(rule, position('/' IN rule)))
    AND (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, position('/' IN rule) DESC, verdict DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fitting USING (n)
"""

_REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, length(h) // 2 AS n, 4096 * unnest(range(length(h) // 8192 + 1)) AS a, h FROM d),
p AS (SELECT doc_id, n, a, substr(h, 2 * a + 1, 2 * 4195) AS h FROM c),
w AS (SELECT doc_id, a, h, unnest(range(greatest(least(4096, n - 99 - a), 0))) AS s FROM p),
windows AS (SELECT doc_id, a + s AS s, substr(h, 2 * s + 1, 200) AS bytes FROM w),
again AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY bytes ORDER BY doc_id, s) > 1),
marked AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS fresh FROM again),
numbered AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked),
spans AS (SELECT doc_id, k, min(s) AS b, max(s) + 100 AS e FROM numbered GROUP BY doc_id, k),
pieces AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM spans),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last,
    string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS kept FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WINDOWS_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
parts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1) AS words FROM parts),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT doc_id, s, p.n, item_id FROM places p JOIN windows q ON p.n = q.n AND list_slice(p.w, p.s, p.s + p.n - 1) = q.words),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL = {"op3_suffix_dedup": _REPEATS_SQL, "op8_url_filter": _URL_SQL, "op10_decontaminate": _WINDOWS_SQL}
