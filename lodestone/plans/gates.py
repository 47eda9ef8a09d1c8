"""Queries of the gates: what the tables lack follows from scores, the quality gate, sizes of texts and suppliers' balances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import LATIN
from ..operators import events as E
from ..operators import gates as G
from ..operators import quality as QU
from .catalog import SCORED, _quote, _read, _scored, query
from .quality import ASSESSED, _documents

#: Both engines read these alike.
_EVENT = {
    "event_id": "event_id", "document_id": "event_id", "title": "title", "summary": "summary", "impact": "impact", "affected_area": "source", "category": "category", "source_name": "CASE WHEN confidence < 30 THEN '' ELSE source END", "reviewer_type": "CASE WHEN risk_score >= 20 THEN 'human_user' ELSE 'ai' END",
    "reviewer_name": "CASE WHEN opportunity_score >= 10 THEN 'Li' ELSE '' END", "human_verified": "risk_score >= 15", "review_state": "CASE WHEN status IN ('new', 'ongoing') THEN 'accepted' ELSE 'pending' END", "requires_second_review": "risk_score >= 90",
    "record_state": "CASE WHEN length(title) < 20 THEN 'quarantined' ELSE 'active' END", "duplicate_level": "CASE WHEN length(summary) % 40 = 7 THEN 'high' ELSE '' END",
}
_SOURCE = {
    "source_id": "s_suppkey", "commercial_reuse_status": "CASE WHEN s_acctbal < 0 THEN '禁止' WHEN s_acctbal < 3000 THEN '允许' ELSE '未明确' END", "terms_status": "CASE WHEN s_nationkey = 7 THEN '不允许' ELSE '允许' END", "customer_summary_allowed": "s_acctbal > 1000", "short_quote_allowed": "s_nationkey < 20",
    "internal_analysis_allowed": "s_nationkey <> 3", "enabled": "s_acctbal > -500", "crawl_allowed": "s_nationkey <> 11", "domain": "CASE WHEN s_nationkey = 4 THEN '' ELSE s_name END", "list_page_url": "concat(CASE WHEN s_nationkey = 5 THEN 'ftp' ELSE 'https' END, '://', s_name)",
    "robots_status": "CASE WHEN s_nationkey = 6 THEN 'unknown' ELSE 'allowed' END", "fulltext_redistribution_allowed": "s_acctbal > 9000", "raw_data_resale_allowed": "s_nationkey = 24",
}
_DIRECT, _POSSIBLE = ("license", "copyright"), ("ing", "que")
_columns = lambda fields: ", ".join(f"{x} AS {n}" for n, x in fields.items())
_sources = lambda spark, sf_dir: _read(spark, sf_dir, "supplier").selectExpr(*[f"{x} AS {n}" for n, x in _SOURCE.items()])
SOURCES = f"src AS (SELECT {_columns(_SOURCE)} FROM supplier)"


def _gated(spark, sf_dir, mode):
    """A document's quote is bound to the first document of its title; it holds where that has the same content."""
    events = _scored(spark, sf_dir).selectExpr(*[f"{x} AS {n}" for n, x in _EVENT.items()])
    docs = _documents(spark, sf_dir)
    good = QU.assess(docs, QU.LATIN_GATE).select("doc_id", F.col("processing_allowed").alias("quality_ok"))
    held = docs.join(good, "doc_id").select(
        F.col("doc_id").alias("document_id"), F.expr("CAST(substr(source, 4, 9) AS BIGINT)").alias("source_id"), F.lit("active").alias("record_state"), "quality_ok", F.expr("CASE WHEN source = 'src9' THEN '' ELSE concat('https://', source, '.org') END").alias("url"), F.lit(1).alias("document_version"),
        F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"), "title",
    )
    first = held.groupBy("title").agg(F.min_by("content_hash", "document_id").alias("h"))
    evidence = held.join(first, "title").select(F.col("document_id").alias("event_id"), (F.length("title") > 0).alias("verified"), "document_version", F.col("h").alias("content_hash"))
    return G.promotion_gate(events, held.drop("title"), _sources(spark, sf_dir), evidence, mode, _DIRECT, _POSSIBLE)


_REFUSED = "(commercial_reuse_status IN ('禁止', '不允许') OR terms_status IN ('禁止', '不允许'))"
_CHECKS = [
    ("reviewer_type <> 'human_user'", "reviewer_not_human"), ("NOT human_verified OR reviewer_name = ''", "no_traceable_review"), ("review_state <> 'accepted'", "review_not_accepted"), ("requires_second_review", "second_review_open"), ("record_state <> 'active'", "event_not_active"), ("NOT quality_ok", "document_quality"),
    ("url = ''", "url_incomplete"), ("source_name = ''", "source_name_missing"), ("duplicate_level = 'high'", "likely_duplicate"), ("NOT verified OR h <> content_hash", "evidence_not_located"), (_REFUSED, "terms_forbid"),
]
_reasons = lambda extra: "CASE WHEN has_source IS NULL THEN 'document_or_source_missing' ELSE array_to_string(list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{n}' END" for w, n in [*_CHECKS, extra]) + "], lambda x: x IS NOT NULL), ',') END"
_ANY = lambda terms: " OR ".join(f"contains(said, {_quote(t)})" for t in terms)
_GATED = f"""{SCORED}, {ASSESSED}, {SOURCES}, ev AS (SELECT {_columns(_EVENT)} FROM scored),
hd AS (SELECT x.doc_id AS document_id, CAST(substr(source, 4, 9) AS BIGINT) AS source_id, processing_allowed AS quality_ok, CASE WHEN source = 'src9' THEN '' ELSE 'https://' || source || '.org' END AS url, md5(coalesce(text, '')) AS content_hash, substr(string_split(coalesce(text, ''), chr(10))[1], 1, 120) AS key FROM documents x JOIN assessed USING (doc_id)),
g AS (SELECT ev.*, hd.quality_ok, hd.url, hd.content_hash, length(key) > 0 AS verified, first_value(content_hash) OVER (PARTITION BY key ORDER BY hd.document_id) AS h, src.source_id AS has_source, src.* EXCLUDE (source_id), concat_ws(' ', ev.title, ev.summary, ev.impact, ev.affected_area, ev.category) AS said
    FROM ev JOIN hd USING (document_id) LEFT JOIN src ON src.source_id = hd.source_id)"""


@query(f"""WITH {_GATED} SELECT event_id, {_reasons((f"NOT {_REFUSED} AND NOT internal_analysis_allowed", 'internal_use_not_allowed'))} AS reasons, {_reasons((f"NOT {_REFUSED} AND NOT (customer_summary_allowed AND short_quote_allowed)", 'customer_use_not_allowed'))} AS customer_reasons,
CASE WHEN {_ANY(_DIRECT)} THEN 'direct' WHEN {_ANY(_POSSIBLE)} THEN 'possible' ELSE 'none' END AS relevance FROM g""")
def promotion_reasons(spark, sf_dir):
    return _gated(spark, sf_dir, G.INTERNAL)


_PROBLEMS = f"""{SOURCES}, pr AS (SELECT source_id, 'crawl_gate' AS "check", 'fail' AS severity FROM src WHERE enabled AND crawl_allowed AND (domain = '' OR list_page_url NOT LIKE 'https://%' OR robots_status <> 'allowed')
UNION ALL SELECT source_id, CASE WHEN {_REFUSED} THEN 'report_gate' ELSE 'permission_risk' END, CASE WHEN {_REFUSED} THEN 'fail' ELSE 'warn' END FROM src WHERE ((customer_summary_allowed AND short_quote_allowed) OR fulltext_redistribution_allowed OR raw_data_resale_allowed) AND ({_REFUSED} OR commercial_reuse_status <> '允许'))"""


@query(f"WITH {_PROBLEMS} SELECT * FROM pr")
def source_permission_problems(spark, sf_dir):
    return G.source_problems(_sources(spark, sf_dir))


@query(f"""WITH {_PROBLEMS}, n AS (SELECT "check", any_value(severity) AS status, count(*) AS n FROM pr GROUP BY 1), w AS (SELECT unnest(['crawl_gate', 'report_gate', 'permission_risk']) AS "check")
SELECT w."check", coalesce(n.status, CASE WHEN w."check" = 'crawl_gate' AND NOT EXISTS (SELECT 1 FROM src WHERE enabled AND crawl_allowed) THEN 'warn' ELSE 'pass' END) AS status, coalesce(n.n, 0) AS n FROM w LEFT JOIN n USING ("check")""")
def source_permission_checks(spark, sf_dir):
    return G.source_checks(_sources(spark, sf_dir))


@query(f"""WITH {SCORED}, rp AS (SELECT DISTINCT source AS report_id, CASE CAST(substr(source, 4, 9) AS BIGINT) % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'internal' ELSE 'standard' END AS mode, CAST(substr(source, 4, 9) AS BIGINT) % 2 = 0 AS require_value FROM scored),
se AS (SELECT source AS report_id, CASE WHEN risk_level <> '低' THEN '高' END AS business_value, opportunity_score >= 40 AS core, confidence < 50 AS weak FROM scored WHERE risk_score + opportunity_score >= 60 AND event_date <= DATE '2026-01-03'),
s2 AS (SELECT report_id, count(*) AS n, count(business_value) AS valued, count(*) FILTER (core) AS cores, count(*) FILTER (weak) AS against FROM se GROUP BY 1)
SELECT report_id, CASE WHEN mode = 'customer' AND n > 0 AND against > 0 THEN 'preflight' WHEN require_value AND n > 0 AND valued = 0 THEN 'no_business_value' WHEN require_value AND n > 0 AND cores = 0 THEN 'no_core_event' WHEN coalesce(n, 0) = 0 AND mode <> 'standard' THEN 'no_events' ELSE 'made' END AS decision, coalesce(n, 0) AS n FROM rp LEFT JOIN s2 USING (report_id)""")
def report_decisions(spark, sf_dir):
    """A report for each source over the first days; events of little confidence stand against a customer's."""
    scored = _scored(spark, sf_dir)
    number = F.expr("CAST(substr(source, 4, 9) AS BIGINT)")
    reports = scored.select(F.col("source").alias("report_id"), F.when(number % 3 == 0, "customer").when(number % 3 == 1, "internal").otherwise("standard").alias("mode"), (number % 2 == 0).alias("require_value"), F.lit(False).alias("allow_empty")).distinct()
    chosen = E.between(scored, "2026-01-01", "2026-01-03").where("risk_score + opportunity_score >= 60").withColumn("report_id", F.col("source"))
    selected = chosen.select("report_id", "event_id", F.when(F.col("risk_level") != "低", "高").alias("business_value"), (F.col("opportunity_score") >= 40).alias("core"))
    return G.report_decisions(reports, selected, chosen.where("confidence < 50").groupBy("report_id").agg(F.count("*").alias("n")))


@query(f"""WITH {SCORED}, s0 AS (SELECT event_id, risk_score AS old_score, priority_score AS old_priority FROM scored), low AS (SELECT event_id, title, impact, lower(title || ' ' || summary || ' ' || impact) AS whole, category FROM t)
SELECT event_id, old_score, greatest(0, least(100, CASE category WHEN 'notice' THEN 45 WHEN 'weather' THEN 40 WHEN 'market' THEN 25 WHEN 'company' THEN 10 ELSE 10 END + CASE WHEN contains(whole, 'the') THEN 6 ELSE 0 END))::INTEGER AS new_score FROM s0 JOIN low USING (event_id)""")
def rescored_events(spark, sf_dir):
    """Events as they are stored, scored again by rules that have changed: only one low term is left."""
    from dataclasses import replace

    old = _scored(spark, sf_dir)
    rules = replace(LATIN, high={}, medium={}, low={"the": 6}, relief={})
    return E.rescored(old, rules).select("event_id", "old_score", F.col("risk_score").alias("new_score"))
