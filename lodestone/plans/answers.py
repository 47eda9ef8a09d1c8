"""Queries from questions to citations; the benchmark's items are the questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as AN
from ..operators import retrieval as R
from .catalog import SCORED, SQL, _quote, _read, _scored, query

_ROUTING = AN.Routing(
    intents={"resolved_risk": ("apache", "license"), "tender": ("ción", "que "), "opportunity": ("heit", "ung "), "current_risk": ("the ", "and ")}, filters={"resolved_risk": {"statuses": ("resolved",)}, "tender": {"categories": ("market",)}, "opportunity": {"opportunity_levels": ("高", "中"), "business_value": ("高",)}, "current_risk": {"statuses": ("new", "ongoing"), "risk_levels": ("高", "中", "低")}},
    places={"1": ("berth", "ingen"), "2": ("ner ",), "4": ("thon", "eaux"), "3": ("sch",)}, focus=("en ",), noise=("cookie", "subscribe"), resolved=("resolved",), default="operations",
)
_any = lambda text, terms: "(" + " OR ".join(f"contains({text}, {_quote(t)})" for t in terms) + ")"
_array = lambda xs: "[" + ", ".join(map(_quote, xs)) + "]"
_FILTERS = ", ".join("CASE intent " + " ".join(f"WHEN '{i}' THEN {_array(f[k])}" for i, f in _ROUTING.filters.items() if k in f) + f" ELSE CAST(NULL AS VARCHAR[]) END AS {k}" if any(k in f for f in _ROUTING.filters.values()) else f"CAST(NULL AS VARCHAR[]) AS {k}" for k in AN._KINDS)
ROUTES = f"""i AS (SELECT item_id AS query_id, CASE {' '.join(f"WHEN {_any('coalesce(text, chr(32))', ts)} THEN '{n}'" for n, ts in _ROUTING.intents.items())} ELSE 'operations' END AS intent, {_any("coalesce(text, '')", _ROUTING.focus)} AS focus FROM benchmark),
routes AS (SELECT query_id, intent, focus, intent = 'current_risk' AS exclude_resolved, {_FILTERS} FROM i)"""


def _routes(spark, sf_dir):
    return AN.routes(_read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), _ROUTING)


@query(f"WITH {ROUTES} SELECT query_id, intent, focus, exclude_resolved, {', '.join(f'''array_to_string({k}, ',') AS {k}''' for k in AN._KINDS)} FROM routes")
def question_routes(spark, sf_dir):
    return _routes(spark, sf_dir).select("query_id", "intent", "focus", "exclude_resolved", *[F.array_join(k, ",").alias(k) for k in AN._KINDS])


_TAKES = " AND ".join(f"({k} IS NULL OR coalesce(list_contains({k}, {c}), false))" for k, c in zip(AN._KINDS, ("status", "risk_level", "value", "category", "opportunity_level"), strict=True))


@query(f"WITH {SCORED}, {ROUTES}, e AS (SELECT *, CASE WHEN priority_score >= 20 THEN '高' END AS value, event_id IN (SELECT related_event_id FROM scored WHERE status = 'resolved' AND related_event_id IS NOT NULL) AS by_relation FROM scored) SELECT intent, count(*) AS n, count(DISTINCT event_id) AS events FROM routes JOIN e ON {_TAKES} AND NOT (exclude_resolved AND by_relation) GROUP BY intent")
def admitted_events(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    named = scored.where("status = 'resolved'").select(F.col("related_event_id").alias("event_id"), F.lit(True).alias("resolved_by_relation")).distinct()
    routed = _routes(spark, sf_dir)
    events = scored.withColumn("business_value", F.when(F.col("priority_score") >= 20, "高")).join(named, "event_id", "left")
    return AN.admitted(events, routed).join(routed.select("query_id", "intent"), "query_id").groupBy("intent").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


def _hits(spark, sf_dir):
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = R.bm25_topk(_read(spark, sf_dir, "documents"), queries)
    events = _scored(spark, sf_dir).select(F.col("event_id").alias("doc_id"), "title", F.col("summary").alias("text"), F.col("source").alias("area"), "category", "status", F.col("event_date").alias("published_at"))
    return found.join(events, "doc_id")


_LEVEL = "CASE " + " ".join(f"WHEN {_any('said', ts)} THEN {n}" for n, ts in _ROUTING.places.items()) + " ELSE 5 END"


@query(f"""WITH {SCORED}, {ROUTES}, hits AS ({SQL['bm25_topk']}),
h AS (SELECT hits.query_id, doc_id, score, event_date, status, intent, focus, concat_ws(' ', title, summary, source, category) AS said FROM hits JOIN scored ON event_id = doc_id JOIN routes USING (query_id)),
l AS (SELECT *, {_LEVEL} AS level FROM h WHERE NOT (intent = 'current_risk' AND (status = 'resolved' OR {_any('said', _ROUTING.noise)}))),
m AS (SELECT *, NOT focus OR level IN (1, 2) AS main FROM l WHERE NOT (focus AND level = 4))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY main DESC, level, score DESC, event_date DESC, doc_id))::INTEGER AS rank, doc_id, level, CASE WHEN main THEN 'main' ELSE 'background' END AS section, score FROM m""")
def routed_hits(spark, sf_dir):
    return AN.routed_hits(_hits(spark, sf_dir), _routes(spark, sf_dir), _ROUTING)


@query()
def hit_citations(spark, sf_dir):
    """Documents with their first line as bound quote where it is long enough; events are verified by people where their risk is high."""
    scored = _scored(spark, sf_dir)
    whole = _read(spark, sf_dir, "documents")
    version = F.md5(F.coalesce("text", F.lit("")))
    documents = whole.join(scored.select(F.col("event_id").alias("doc_id"), "title", F.col("event_date").alias("published_at")), "doc_id").select("doc_id", "title", F.col("source").alias("publisher"), "published_at", F.lit(1).alias("document_version"), version.alias("content_hash"), F.lit(True).alias("is_current"), F.lit("active").alias("record_state"))
    events = scored.select("event_id", F.col("event_id").alias("doc_id"), F.lit("active").alias("record_state"), (F.col("risk_score") >= 40).alias("human_verified"), (F.col("opportunity_score") >= 20).alias("evidence_verified"), F.lit("human_user").alias("reviewer_type"))
    line = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    evidence = whole.where(F.length(line) >= 60).select("doc_id", F.lit(1).alias("document_version"), version.alias("content_hash"), F.lit(0).alias("start_offset"), line.alias("quote"), F.lit(True).alias("verified"))
    return AN.citations(_hits(spark, sf_dir).select("query_id", "doc_id", "rank", "text"), documents, events, evidence)
