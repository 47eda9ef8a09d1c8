"""Queries of the whole validation, over records made of documents: what documents lack follows from their sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import related as R
from ..operators import validation as VA
from .catalog import _quote, _read, query

_VOCABULARY = VA.Vocabulary(source_types=("src0", "src1", "src2", "src3", "src4", "src5"), statuses=("new", "resolved", "unverified"), risk_categories=("en", "de"), relief_terms=("license", "apache"), relief_status="resolved", unverified="unverified")
#: Both engines read these alike; t is the first line.
_RECORD = {
    "row": "doc_id + 1", "event_id": "CASE WHEN n_chars % 50 = 0 THEN '' WHEN n_chars % 40 = 1 THEN concat('', doc_id - 1) ELSE concat('', doc_id) END",
    "event_date": "CASE n_chars % 11 WHEN 0 THEN '' WHEN 1 THEN '2026-02-30' WHEN 2 THEN '1999-12-31' WHEN 3 THEN '2030-01-01' WHEN 4 THEN '2026/01/05' ELSE '2026-01-05' END",
    "collected_at": "CASE n_chars % 9 WHEN 0 THEN 'yesterday' WHEN 1 THEN '2026-01-06' ELSE '2026-01-06T10:00:00+08:00' END", "category": "lang", "title": "t", "summary": "substr(t, 1, CAST(n_chars % 40 AS INT))", "impact": "substr(t, 1, CAST(n_chars % 23 AS INT))",
    "affected_area": "CASE WHEN n_chars % 3 = 0 THEN '' ELSE source END", "affected_period": "CASE WHEN n_chars % 5 = 0 THEN '' ELSE 'today' END", "source_name": "CASE WHEN n_chars % 31 = 0 THEN '' ELSE source END", "source_type": "source",
    "source_url": "CASE n_chars % 8 WHEN 0 THEN '' WHEN 1 THEN 'ftp://a.org' WHEN 2 THEN 'https://a b.org' ELSE concat('https://', source, '.org/', doc_id) END", "status": "CASE n_chars % 6 WHEN 0 THEN 'resolved' WHEN 1 THEN 'unverified' WHEN 2 THEN 'odd' ELSE 'new' END",
    "related_event_id": "CASE n_chars % 10 WHEN 0 THEN concat('', doc_id) WHEN 1 THEN concat('', doc_id + 1) WHEN 2 THEN 'gone' ELSE '' END", "analyst_note": "CASE WHEN n_chars % 4 = 0 THEN 'seen' ELSE '' END",
}


def _records(spark, sf_dir):
    lines = _read(spark, sf_dir, "documents").withColumn("t", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    return lines.selectExpr(*[f"{x} AS {n}" for n, x in _RECORD.items()])


_strip = lambda c: f"trim(coalesce({c}, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_TEXTS = [n for n in _RECORD if n != "row"]
_RULES = [
    *[(f"{f} = ''", "error", "required_missing", f) for f in VA.REQUIRED],
    ("event_date <> '' AND day IS NULL", "error", "invalid_event_date", "event_date"), ("day > DATE '2026-06-01'", "warning", "future_event_date", "event_date"), ("day < DATE '2000-01-01'", "warning", "abnormal_event_date", "event_date"),
    ("collected_at = 'yesterday'", "warning", "invalid_collected_at", "collected_at"), (f"source_type <> '' AND source_type NOT IN ({', '.join(map(_quote, _VOCABULARY.source_types))})", "error", "invalid_source_type", "source_type"),
    ("status = 'odd'", "error", "invalid_status", "status"), ("source_url <> '' AND NOT regexp_matches(source_url, '^https?://[^/?#\\s][^\\s]*$')", "error", "invalid_source_url", "source_url"),
    ("(status = 'resolved' OR contains(title || ' ' || summary, 'license') OR contains(title || ' ' || summary, 'apache')) AND related_event_id = ''", "error", "relief_missing_relation", "related_event_id"), ("related_event_id <> '' AND related_event_id = event_id", "error", "self_relation", "related_event_id"),
    *[(f"{f} <> '' AND length(regexp_replace({f}, '\\s+', '', 'g')) < 10", "warning", f"short_{f}", f) for f in ("summary", "impact")],
    *[(f"category IN ('en', 'de') AND {f} = ''", "suggestion", f"{f}_missing", f) for f in ("affected_area", "affected_period")], ("status = 'unverified' AND analyst_note = ''", "suggestion", "verification_note_missing", "analyst_note"),
    ("related_event_id <> '' AND related_event_id <> event_id AND related_event_id NOT IN (SELECT event_id FROM d WHERE event_id <> '')", "error", "unknown_relation", "related_event_id"),
    ("event_id <> '' AND row > min(row) OVER (PARTITION BY event_id)", "error", "duplicate_event_id", "event_id"), ("title_key <> '' AND row > min(row) OVER (PARTITION BY title_key)", "error", "duplicate_title", "title"),
]
_ABSENT = [f for f in VA.FIELDS if f not in _RECORD]
ISSUES = f"""
r AS (SELECT {', '.join(f'{x} AS {n}' for n, x in _RECORD.items())} FROM (SELECT *, string_split(coalesce(text, ''), chr(10))[1] AS t FROM documents)),
d0 AS (SELECT row, {', '.join(f'{_strip(n)} AS {n}' for n in _TEXTS)} FROM r),
d AS (SELECT *, CASE WHEN regexp_full_match(event_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(event_date AS DATE) END AS day, regexp_replace(lower(title), '[^\\pL\\pN\\pM]+', '', 'g') AS title_key FROM d0),
found AS ({' UNION ALL '.join(f"SELECT row, event_id, {_quote(s)} AS severity, {_quote(c)} AS code, {_quote(f)} AS field FROM (SELECT *, ({w}) AS bad FROM d) WHERE bad" for w, s, c, f in _RULES)}
UNION ALL {' UNION ALL '.join(f"(SELECT 0, '', 'suggestion', 'schema_field_missing', {_quote(f)} FROM d LIMIT 1)" for f in _ABSENT)})"""


@query(f"WITH {ISSUES} SELECT * FROM found")
def record_issues(spark, sf_dir):
    return VA.issues(_records(spark, sf_dir), "2026-06-01", _VOCABULARY)


@query(f"""WITH {ISSUES}, s AS (SELECT count(*) AS total_records, round_even(sum({' + '.join(f"({f} <> '')::INTEGER" for f in VA.REQUIRED)}) / (count(*) * {len(VA.REQUIRED)}) * 100, 1) AS completeness_rate, count(*) FILTER (source_name = '' OR source_url = '') AS missing_source_count, count(*) FILTER (status = 'unverified') AS pending_verification_count FROM d)
SELECT s.*, (SELECT count(DISTINCT row) FROM found WHERE code IN ('duplicate_event_id', 'duplicate_title')) AS duplicate_record_count, (SELECT count(*) FROM found WHERE severity = 'error') AS errors, (SELECT count(*) FROM found WHERE severity = 'warning') AS warnings, (SELECT count(*) FROM found WHERE severity = 'suggestion') AS suggestions FROM s""")
def validation_report(spark, sf_dir):
    records = _records(spark, sf_dir)
    return VA.summary(records, VA.issues(records, "2026-06-01", _VOCABULARY), _VOCABULARY)


@query()
def similar_title_issues(spark, sf_dir):
    records = _records(spark, sf_dir)
    return VA.issues(records, "2026-06-01", _VOCABULARY, similar=R.similar_rows(records.select("row", "title"), "row", "title")).where("code = 'similar_title'")
