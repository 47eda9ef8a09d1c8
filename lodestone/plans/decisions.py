"""Queries over decisions of reviewers; the given tables hold none, so decisions follow from the numbers of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D
from .catalog import _read, query

_KINDS = "CASE doc_id % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'accept_modified' WHEN 2 THEN 'reject' WHEN 3 THEN 'body_issue' ELSE 'needs_second_review' END"
_REVIEW = {
    "decision": _KINDS, "title": "source", "new_title": "CASE WHEN doc_id % 2 = 0 THEN ' ' || source || ' ' WHEN doc_id % 3 = 0 THEN lang END", "duplicate_level": f"CASE WHEN doc_id % 11 = 0 THEN '{D.DUPLICATE}' END",
    "status": f"CASE WHEN doc_id % 7 = 0 THEN '{D.RESOLVED}' ELSE 'new' END", "related_event_id": "CASE WHEN doc_id % 14 = 0 THEN 'e' END", "source_opened": "doc_id % 13 <> 0", "facts_checked": "CASE WHEN doc_id % 17 <> 0 THEN doc_id % 19 <> 0 END",
}
_REVIEW_SQL = ", ".join(f"{sql} AS {name}" for name, sql in _REVIEW.items())


@query(f"""WITH r AS (SELECT doc_id, {_REVIEW_SQL} FROM documents), c AS (SELECT *, new_title IS NOT NULL AND trim(new_title) <> coalesce(title, '') AS edited FROM r),
d AS (SELECT *, decision IN ('accept', 'accept_modified') AS ok FROM c)
SELECT doc_id, CASE WHEN edited THEN 'title' ELSE '' END AS changed, CASE WHEN decision = 'accept' OR (decision = 'accept_modified' AND NOT edited) THEN 'accepted' WHEN decision = 'accept_modified' THEN 'modified_accepted' WHEN decision = 'reject' THEN 'rejected' ELSE decision END AS review_state,
CASE decision WHEN 'reject' THEN 'rejected' WHEN 'body_issue' THEN 'quarantined' ELSE 'active' END AS record_state, ok AS human_verified, decision = 'needs_second_review' AS requires_second_review,
concat_ws(',', CASE WHEN ok AND duplicate_level IS NOT NULL THEN 'duplicate' END, CASE WHEN ok AND status = '{D.RESOLVED}' AND related_event_id IS NULL THEN 'no_related_event' END,
CASE WHEN ok AND NOT coalesce(source_opened, false) THEN 'source_not_opened' END, CASE WHEN ok AND NOT coalesce(facts_checked, false) THEN 'facts_not_checked' END) AS refusals FROM d""")
def review_decisions(spark, sf_dir):
    reviews = _read(spark, sf_dir, "documents").select("doc_id", *[F.expr(sql).alias(name) for name, sql in _REVIEW.items()])
    out = D.decided(reviews, ["title"])
    return out.select("doc_id", F.array_join("changed", ",").alias("changed"), "review_state", "record_state", "human_verified", "requires_second_review", F.array_join("refusals", ",").alias("refusals"))


_BACKED = {"is_event": "page_id % 2 = 0", "reviewer": "CASE WHEN page_id % 3 = 0 THEN 'human' WHEN page_id % 3 = 1 THEN 'model' END", "name": "CASE WHEN page_id % 5 = 0 THEN ' ' ELSE url END", "seen": "CASE WHEN page_id % 7 <> 0 THEN 't' END"}
_BACKED_SQL = ", ".join(f"{sql} AS {name}" for name, sql in _BACKED.items())


@query(f"""WITH x AS (SELECT page_id, page_id % 4 < 2 AS evidence, {_BACKED_SQL} FROM pages), y AS (SELECT *, coalesce(reviewer, '') = 'human' AND trim(coalesce(name, '')) <> '' AND coalesce(seen, '') <> '' AS by_people FROM x)
SELECT page_id, by_people, CASE WHEN is_event AND evidence AND by_people THEN 'human_verified_event' WHEN is_event AND evidence THEN 'evidence_verified_event' ELSE 'quality_document_chunk' END AS tier FROM y""")
def retrieval_tiers(spark, sf_dir):
    rows = _read(spark, sf_dir, "pages").select("page_id", F.expr("page_id % 4 < 2").alias("evidence"), *[F.expr(sql).alias(name) for name, sql in _BACKED.items()])
    people = D.by_independent_people(F.col("reviewer"), F.col("name"), F.col("seen"), F.lit("read"), ["human"])
    return rows.withColumn("by_people", people).select("page_id", "by_people", D.retrieval_tier(F.col("is_event"), F.col("by_people"), F.col("evidence")).alias("tier"))


@query("""SELECT l.doc_id AS event_id, (DATE '2026-01-01' + (l.doc_id % 60)::INTEGER) AS event_date FROM labels l WHERE l.doc_id % 9 <> 0 AND l.doc_id % 60 BETWEEN 4 AND 40
AND l.doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 8 <> 0 AND n_chars >= 400)""")
def period_candidates(spark, sf_dir):
    state = F.when(F.col("doc_id") % 9 != 0, "active").otherwise("rejected")
    events = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.col("doc_id").alias("document_id"), state.alias("record_state"), F.expr("date_add(DATE '2026-01-01', cast(doc_id % 60 AS INT))").alias("event_date"))
    documents = _read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.lit("active").alias("record_state"), (F.col("doc_id") % 8 != 0).alias("is_current"), F.expr("CASE WHEN n_chars >= 400 THEN 'ok' ELSE 'thin' END").alias("quality_status")
    )
    return D.period_candidates(events, documents, "2026-01-05", "2026-02-10", "ok")


@query("""WITH r AS (SELECT c_nationkey AS nation, arg_max({'d': c_custkey % 5, 's': c_custkey % 4, 'a': c_custkey % 6 <> 0}, c_custkey) AS x FROM customer GROUP BY c_nationkey)
SELECT nation, x.d AS discovered, x.s AS success, x.d > 0 AND x.s >= 0.5 * x.d AS passed FROM r WHERE x.a""")
def phase_gates(spark, sf_dir):
    runs = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.expr("c_custkey % 5").alias("discovered"), F.expr("c_custkey % 4").alias("success"), F.expr("c_custkey % 6 <> 0").alias("active"))
    return D.phase_gate(runs, "nation", "c_custkey")
