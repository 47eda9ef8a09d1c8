"""Queries whose results go through stored tables and streams: versioned upserts, their ingestion as a stream, guarded runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upserts as U
from ..sources.versioned import TableSet
from ..streaming import ingest as IN
from .catalog import _HASH, _URL, _read, query

_arrived = lambda pages: pages.select(
    F.col("page_id").cast("string").alias("document_id"), "url", F.lit("").alias("title"), F.col("html").alias("text"), F.timestamp_seconds("page_id").alias("fetched_at"), F.coalesce(F.length("html") >= 500, F.lit(False)).alias("quality_ok"),
)
_KEYED = f"""k AS (SELECT page_id, CASE WHEN url IS NULL THEN '' ELSE {_URL} END AS url_key, {_HASH.replace('text', 'html')} AS content_hash, coalesce(length(html) >= 500, false) AS good, page_id % 2 AS batch FROM pages),
f0 AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN url_key = '' THEN page_id::VARCHAR ELSE url_key END ORDER BY page_id) AS version, lag(page_id) OVER (PARTITION BY CASE WHEN url_key = '' THEN page_id::VARCHAR ELSE url_key END ORDER BY page_id) AS before
    FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY page_id) AS nth FROM k WHERE batch = 0) WHERE nth = 1),
c0 AS (SELECT * FROM f0 QUALIFY url_key = '' OR version = max(version) OVER (PARTITION BY url_key)),
f1 AS (SELECT x.*, coalesce(c0.version, 0) + row_number() OVER (PARTITION BY CASE WHEN x.url_key = '' THEN x.page_id::VARCHAR ELSE x.url_key END ORDER BY x.page_id) AS version,
    coalesce(lag(x.page_id) OVER (PARTITION BY CASE WHEN x.url_key = '' THEN x.page_id::VARCHAR ELSE x.url_key END ORDER BY x.page_id), c0.page_id) AS before
    FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY page_id) AS nth FROM k WHERE batch = 1 AND content_hash NOT IN (SELECT content_hash FROM c0)) x LEFT JOIN c0 ON c0.url_key = x.url_key AND x.url_key <> '' WHERE x.nth = 1),
every AS (SELECT page_id, url_key, good, version, before FROM f0 UNION ALL SELECT page_id, url_key, good, version, before FROM f1)"""


@query(rf"""WITH {_KEYED} SELECT page_id::VARCHAR AS document_id, version::INTEGER AS document_version, coalesce(before::VARCHAR, '') AS previous_document_id,
url_key = '' OR version = max(version) OVER (PARTITION BY url_key) AS is_current, CASE WHEN good THEN 'active' ELSE 'quarantined' END AS record_state FROM every""")
def upserted_documents(spark, sf_dir):
    """Pages of even number are stored first, then those of odd number are upserted; a page of 500 characters passes."""
    pages, tables = _read(spark, sf_dir, "pages"), TableSet(spark, IN.own_folder(spark, "documents"))
    for batch in (0, 1):
        U.store_documents(tables, _arrived(pages.where(F.col("page_id") % 2 == batch)), ("pages", batch))
    return tables.read("documents").select("document_id", "document_version", "previous_document_id", "is_current", "record_state")


@query(rf"""WITH {_KEYED}, n AS (SELECT batch, count(*) AS n FROM k GROUP BY 1), d AS (SELECT 0 AS batch, version, count(*) AS n FROM f0 GROUP BY 2 UNION ALL SELECT 1, version, count(*) FROM f1 GROUP BY 2),
s AS (SELECT batch, CASE WHEN version = 1 THEN 'new' ELSE 'updated' END AS disposition, sum(n)::BIGINT AS n FROM d GROUP BY 1, 2)
SELECT 'pages-' || batch AS run, disposition, n FROM s UNION ALL SELECT 'pages-' || n.batch, 'duplicate_content', (n.n - coalesce(t.n, 0))::BIGINT FROM n LEFT JOIN (SELECT batch, sum(n) AS n FROM s GROUP BY 1) t USING (batch) WHERE n.n > coalesce(t.n, 0)""")
def ingestion_ledger(spark, sf_dir):
    pages, tables = _read(spark, sf_dir, "pages"), TableSet(spark, IN.own_folder(spark, "documents"))
    for batch in (0, 1):
        U.store_documents(tables, _arrived(pages.where(F.col("page_id") % 2 == batch)), ("pages", batch))
    return tables.read("ingested")


@query(rf"""WITH k AS (SELECT page_id, CASE WHEN url IS NULL THEN '' ELSE {_URL} END AS url_key, {_HASH.replace('text', 'html')} AS content_hash FROM pages),
f AS (SELECT *, CASE WHEN url_key = '' THEN page_id::VARCHAR ELSE url_key END AS chain FROM k QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY page_id) = 1),
v AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY page_id) AS version FROM f)
SELECT page_id::VARCHAR AS document_id, version::INTEGER AS document_version, url_key = '' OR version = max(version) OVER (PARTITION BY url_key) AS is_current FROM v""")
def ingested_documents(spark, sf_dir):
    """All pages as one batch of a stream of files."""
    tables = TableSet(spark, IN.own_folder(spark, "ingested"))
    pages = IN.stream_of(spark, f"{sf_dir}/pages.parquet", _read(spark, sf_dir, "pages").schema, files=1_000_000)
    IN.ingest_documents(_arrived(pages), tables, "pages")
    return tables.read("documents").select("document_id", "document_version", "is_current")


@query("""WITH o AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok FROM events), x AS (SELECT *, sum((NOT ok)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS failed,
max(CASE WHEN ok THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o)
SELECT user_id::VARCHAR AS source, event_id AS run_id, coalesce(failed = 3, false) AS tripped, coalesce(ts < last + INTERVAL 6 HOUR, false) AS suppressed FROM x""")
def guarded_runs(spark, sf_dir):
    """The events as a stream of runs: an error is a failure; all that waits is judged at the end."""
    schema = _read(spark, sf_dir, "events").schema
    runs = lambda: IN.stream_of(spark, f"{sf_dir}/events.parquet", schema, files=1_000_000).select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("run_id"), "ts", (F.col("event_type") != "error").alias("ok"))
    return IN.guard_runs(spark, runs, IN.own_folder(spark, "guard"), flush=True).select("source", "run_id", "tripped", "suppressed")
