"""The engine's input tables, made from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NOW = "2026-05-24T00:00:00Z"


def _day(month: str, day: str) -> str:
    return f"'2026-0' || CAST({month} AS STRING) || '-' || lpad(CAST({day} AS STRING), 2, '0') || 'T00:00:00Z'"


#: A manifest row for each document.
MANIFEST = f"""
SELECT 'https://' || source || '.example.org/' || lang || '/' || CAST(doc_id AS STRING) AS url,
  CASE lang WHEN 'en' THEN 'LIVING' WHEN 'fr' THEN 'CURRENT_FORMS' WHEN 'de' THEN 'FROZEN' ELSE 'NEWS' END AS tier,
  CASE WHEN doc_id % 4 = 0 THEN 'guide-' || CAST(doc_id % 13 AS STRING) END AS parent_guide,
  CASE WHEN doc_id % 11 = 0 THEN 'GONE' WHEN doc_id % 11 = 1 THEN 'FAILED' WHEN doc_id % 11 = 2 THEN 'UNSEEN' ELSE 'FRESH' END AS state,
  CASE WHEN doc_id % 3 = 0 THEN {_day("1 + doc_id % 5", "1 + doc_id % 28")} END AS sitemap_lastmod_seen,
  '2026-01-01T00:00:00Z' AS first_seen_at,
  CASE WHEN doc_id % 11 <> 2 THEN {_day("1 + doc_id % 5", "1 + (doc_id * 7) % 23")} END AS last_fetched_at,
  CASE WHEN doc_id % 11 <> 2 THEN {_day("1 + doc_id % 5", "1 + (doc_id * 5) % 23")} END AS last_attempted_at,
  CAST(200 AS INT) AS http_status, '"e' || CAST(doc_id % 97 AS STRING) || '"' AS http_etag, CAST(NULL AS STRING) AS http_last_modified,
  md5(text) AS raw_hash, CASE WHEN doc_id % 11 NOT IN (1, 2) THEN md5(text || 'c') END AS content_hash, CAST(NULL AS STRING) AS last_changed_at,
  CAST(doc_id % 6 AS INT) AS unchanged_streak, 'v1.0.0' AS crawler_version, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE 'E' END AS extractor_version,
  'v1' AS normalizer_version, CASE WHEN doc_id % 5 = 0 THEN 'v0' ELSE 'v1' END AS classifier_version,
  CASE WHEN doc_id % 17 = 0 THEN 'b1' END AS browser_version, CAST(doc_id % 25 AS INT) AS fail_count, CAST(NULL AS STRING) AS last_error
FROM documents
"""
#: Seeds: known urls, some with another tier or lastmod, some twice, and new ones.
SEEDS = f"""
SELECT doc_id AS seq, 'https://' || source || '.example.org/' || lang || '/' || CAST(CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000 ELSE doc_id END AS STRING) AS url,
  CASE WHEN doc_id % 9 = 0 THEN 'LIVING' WHEN lang = 'en' THEN 'LIVING' WHEN lang = 'fr' THEN 'CURRENT_FORMS' WHEN lang = 'de' THEN 'FROZEN' ELSE 'NEWS' END AS tier,
  CASE WHEN doc_id % 4 = 0 THEN 'guide-' || CAST(doc_id % 13 AS STRING) END AS parent_guide,
  CASE WHEN doc_id % 2 = 0 THEN {_day("1 + doc_id % 6", "1 + doc_id % 27")} END AS lastmod
FROM documents
"""
#: Fetch results of two thirds of the manifest.
FETCH_LOG = """
SELECT 'https://' || source || '.example.org/' || lang || '/' || CAST(doc_id AS STRING) AS url, 'FETCH' AS decision,
  CAST(CASE WHEN doc_id % 8 = 0 THEN 304 WHEN doc_id % 8 = 1 THEN 404 WHEN doc_id % 8 = 2 THEN 500 ELSE 200 END AS INT) AS status,
  '"n' || CAST(doc_id % 89 AS STRING) || '"' AS etag, CAST(NULL AS STRING) AS last_modified, md5(text) AS raw_hash, n_chars AS raw_bytes,
  '2026-05-24T00:00:00Z' AS fetched_at, CASE WHEN doc_id % 8 = 2 THEN 'http-500' END AS error, CAST(NULL AS STRING) AS browser_version, 'text/html' AS content_type, doc_id AS seq
FROM documents WHERE doc_id % 3 <> 0
"""
EXTRACT_LOG = """
SELECT 'https://' || source || '.example.org/' || lang || '/' || CAST(doc_id AS STRING) AS url, md5(text) AS raw_hash,
  CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN md5(text || 'c') ELSE md5(text || 'd') END END AS content_hash,
  left(text, 20) AS title, CAST(n_chars AS INT) AS n_chars, 'E' AS extractor_version, 'v1' AS normalizer_version,
  doc_id % 13 <> 0 AS ok, CASE WHEN doc_id % 13 = 0 THEN 'extract-failed-html' ELSE 'new-content-html' END AS reason, doc_id AS seq
FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 8 > 2
"""
#: Twelve runs over the events, each a slice of them; every fifth is not published.
RUNS = """
SELECT 'r' || lpad(CAST(k AS STRING), 2, '0') AS run_id, '2024-01-' || lpad(CAST(k + 1 AS STRING), 2, '0') || 'T00:00:00Z' AS started_at,
  '2024-01-' || lpad(CAST(k + 1 AS STRING), 2, '0') || 'T06:00:00Z' AS completed_at, CASE WHEN k % 5 = 4 THEN 'degraded' ELSE 'published' END AS status
FROM (SELECT DISTINCT event_id % 12 AS k FROM events) AS x
"""
#: A change log: an event changes the page of its user.
CHANGELOG = """
SELECT event_id % 12 * 10000000 + event_id AS seq, '2024-01-' || lpad(CAST(event_id % 12 + 1 AS STRING), 2, '0') || 'T05:00:00Z' AS ts,
  'https://www.example.org/' || event_type || '/' || CAST(user_id AS STRING) AS url,
  CASE WHEN value < 5 THEN 'gone' WHEN value < 15 THEN 'added' ELSE 'changed' END AS change_type,
  CASE WHEN value < 5 OR value >= 15 THEN 'h' || CAST(event_id % 3 AS STRING) END AS old_hash,
  CASE WHEN value >= 5 THEN 'h' || CAST(event_id % 5 AS STRING) END AS new_hash,
  'r' || lpad(CAST(event_id % 12 AS STRING), 2, '0') AS run_id,
  CASE WHEN user_id % 4 = 0 THEN 'FROZEN' ELSE 'LIVING' END AS tier
FROM events
"""
#: Published pages.
PAGES = """
SELECT 'https://' || source || '.example.org/' || lang || '/' || CAST(doc_id AS STRING) AS url, lang || '/' || source || '/' || CAST(doc_id AS STRING) || '.md' AS path,
  left(text, 20) AS title, 'general' AS audience, md5(text || 'c') AS content_hash, text AS body,
  CASE lang WHEN 'en' THEN 'LIVING' WHEN 'fr' THEN 'CURRENT_FORMS' WHEN 'de' THEN 'FROZEN' ELSE 'NEWS' END AS tier
FROM documents
"""
#: Cells of an agent evaluation.
CELLS = """
SELECT 'q' || CAST(event_id % 40 AS STRING) AS qid, 'u' || CAST(event_id % 5 AS STRING) AS use_case, event_type AS condition,
  CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE CAST(event_id % 5 AS DOUBLE) END AS score, event_id % 3 = 0 AS passed, user_id AS tokens,
  CASE WHEN event_id % 50 = 0 THEN 'timeout' END AS error
FROM events
"""


def standin(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above over the tables of a folder."""
    names = [t for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql]
    for t in names:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})
