"""Queries over reviewed events, their sources, evidence and reports. What the given tables lack is derived from their keys, the same way in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.rules import LATIN, LATIN_VALUES
from ..operators import audits as A
from ..operators import changes as CH
from ..operators import events as E
from ..operators import reviews as RV
from ..operators import selection as S
from ..sources.scratch import kept, scratch, stored
from .catalog import _DONE, _GATE, SCORED, _case, _drafts, _quote, _read, _scored, quality_gate, query

_when = lambda sql: F.expr(sql)  # noqa: E731  conditions that both engines read alike
_FIELDS = {
    "human_verified": "event_id % 3 = 0", "evidence_verified": "event_id % 4 <> 0", "record_state": "CASE WHEN event_id % 11 = 0 THEN 'quarantined' ELSE 'active' END",
    "document_state": "CASE WHEN event_id % 19 = 3 THEN 'quarantined' ELSE 'active' END", "duplicate_level": "CASE WHEN event_id % 13 = 0 THEN 'high' WHEN event_id % 13 = 1 THEN 'possible' ELSE '' END",
    "source_url": "CASE WHEN source = 'src9' THEN '' ELSE 'https://' || source || '.example.org/' || event_id END", "source_id": "CAST(substr(source, 4, 9) AS BIGINT)", "report_included": "CASE WHEN event_id % 10 = 7 THEN '否' ELSE '' END",
}
_SOURCES = {
    "source_id": "s_suppkey", "name": "s_name", "enabled": "s_acctbal > 0", "priority": "CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'normal' END", "summary_allowed": "s_suppkey % 3 <> 0", "quote_allowed": "s_suppkey % 4 <> 1",
    "terms_status": "CASE WHEN s_suppkey % 7 = 6 THEN 'forbidden' ELSE 'allowed' END",
}
_columns = lambda fields: ", ".join(f"{x} AS {n}" for n, x in fields.items())


def _hits(text: str, terms, most: int = 0) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN contains({text}, {_quote(t)}) THEN {_quote(t)} END" for t in terms) + "], lambda x: x IS NOT NULL)"
    return f"{found}[1:{most}]" if most else f"len({found}) > 0"


def _value_sql() -> str:
    x, title, text = LATIN_VALUES, "coalesce(title, '')", "whole"
    operational = [t for t in x.impact if t not in x.weather]
    listed = lambda name: ", ".join(map(_quote, name))
    rules = [
        (f"{_hits(title, x.activity)} AND NOT ({_hits(title, operational)})", "低", "activity_title", _hits(title, x.activity, 3)), (f"{_hits(text, x.activity)} AND NOT ({_hits(text, x.impact)})", "低", "activity", _hits(text, x.activity, 3)),
        (f"category IN ({listed(x.safety)}) OR {_hits(text, x.impact)}", "高", "impact", _hits(text, x.impact, 4)), (f"category IN ({listed(x.trade)}) AND {_hits(text, x.business)}", "高", "trade", _hits(text, x.business, 4)),
        (f"category = {_quote(x.policy)} AND {_hits(text, x.business)}", "中", "policy", _hits(text, x.business, 4)), (f"category = {_quote(x.company)} AND {_hits(text, x.business)}", "中", "company", _hits(text, x.business, 4)),
        (_hits(text, x.business), "中", "business", _hits(text, x.business, 4)),
    ]
    case = lambda i, end: "CASE " + " ".join(f"WHEN {r[0]} THEN {_quote(r[i]) if i < 3 else f'array_to_string({r[i]}, {_quote(chr(0x3001))})'}" for r in rules) + f" ELSE {_quote(end)} END"
    return f"{case(1, '无关')} AS value, {case(2, 'none')} AS rule, {case(3, '')} AS hits"


VALUES = f"vals AS (SELECT event_id, {_value_sql()} FROM (SELECT *, concat_ws(chr(10), title, summary, impact) AS whole FROM scored))"
BUNDLE = f"{SCORED}, {VALUES}, ev AS (SELECT s.*, v.value AS business_value, {_columns({n: x.replace('event_id', 's.event_id') for n, x in _FIELDS.items()})} FROM scored s JOIN vals v USING (event_id))"
SOURCES = f"src AS (SELECT {_columns(_SOURCES)} FROM supplier)"


def _bundle(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("business_value", E.business_value(LATIN_VALUES)["value"]).select("*", *[_when(x).alias(n) for n, x in _FIELDS.items()])


def _sources(spark, sf_dir):
    return _read(spark, sf_dir, "supplier").select(*[_when(x).alias(n) for n, x in _SOURCES.items()])


_ACTIONS = {"resolved": "keep the history", "unverified": "check the original", "high_risk": "name an owner today", "high_opportunity": "check the terms", "medium_risk": "watch this week", "none": "file"}
_URGENT = {"notice": "check area and schedule", "weather": "check area and schedule"}
_RESOLVED = f"status IN ({_DONE})"


@query(f"""WITH {SCORED} SELECT event_id, CASE WHEN {_RESOLVED} THEN 'keep the history' WHEN status = 'unverified' THEN 'check the original' WHEN risk_level = '高' THEN {_case('category', {k: _quote(v) for k, v in _URGENT.items()}, _quote(_ACTIONS['high_risk']))}
WHEN opportunity_level = '高' THEN 'check the terms' WHEN risk_level = '中' THEN 'watch this week' ELSE 'file' END AS action,
CASE WHEN {_RESOLVED} THEN 'resolved' WHEN risk_level = '高' THEN 'day' WHEN risk_level = '中' THEN 'period' ELSE 'watch' END AS urgency FROM scored""")
def suggested_actions(spark, sf_dir):
    return _scored(spark, sf_dir).select("event_id", E.suggested_action(LATIN, _ACTIONS, _URGENT).alias("action"), E.urgency(LATIN).alias("urgency"))


@query(f"WITH {SCORED}, {VALUES} SELECT * FROM vals")
def business_values(spark, sf_dir):
    return _scored(spark, sf_dir).select("event_id", E.business_value(LATIN_VALUES).alias("x")).select("event_id", "x.*")


_PERIOD = ("2026-01-05", "2026-01-20")
_REPORT = f"event_date BETWEEN DATE '{_PERIOD[0]}' AND DATE '{_PERIOD[1]}' AND report_included <> '否' AND (risk_level <> '低' OR opportunity_level <> '低')"
_BEST = "priority_score DESC, opportunity_score DESC, event_date DESC, event_id"


@query(f"WITH {BUNDLE} SELECT event_id, event_date, priority_score FROM ev WHERE category IN ('company', 'notice') AND {_REPORT}")
def report_rows(spark, sf_dir):
    return S.report_rows(_bundle(spark, sf_dir), *_PERIOD, ["company", "notice"]).select("event_id", "event_date", "priority_score")


_CORE = "evidence_verified AND (confidence >= 60 OR human_verified) AND (business_value IS NULL OR business_value IN ('高', '中'))"


@query(f"""WITH {BUNDLE}, c AS (SELECT *, row_number() OVER (ORDER BY {_BEST})::INTEGER AS rank FROM ev WHERE {_CORE}) SELECT rank, event_id,
CASE WHEN NOT {_RESOLVED} AND risk_level <> '低' THEN 'risks' WHEN {_RESOLVED} THEN 'resolved' WHEN opportunity_level <> '低' THEN 'opportunities' ELSE 'watchlist' END AS report_group FROM c WHERE rank <= 5""")
def core_report_groups(spark, sf_dir):
    return S.core_groups(_bundle(spark, sf_dir), LATIN).select("rank", "event_id", "report_group")


@query(f"WITH {BUNDLE}, r AS (SELECT event_id, row_number() OVER (ORDER BY priority_score DESC, event_id)::INTEGER AS rank FROM ev WHERE NOT human_verified OR confidence < 60 OR duplicate_level <> '' OR risk_level <> '低') SELECT * FROM r WHERE rank <= 100")
def pending_attention(spark, sf_dir):
    return S.pending(_bundle(spark, sf_dir)).select("event_id", "rank")


@query(f"WITH {BUNDLE}, r AS (SELECT event_id, title, row_number() OVER (ORDER BY event_date DESC, title, event_id)::INTEGER AS rank FROM ev WHERE (contains(lower(title), 'ing') OR contains(lower(summary), 'ing')) AND category IN ('company', 'market') AND source_id IN (1, 2, 3)) SELECT * FROM r WHERE rank <= 200")
def event_browse(spark, sf_dir):
    order = [F.desc("event_date"), F.asc("title"), F.asc("event_id")]
    return S.browse(_bundle(spark, sf_dir), ["title", "summary"], "ing", {"category": ["company", "market"], "source_id": [1, 2, 3]}, order).select("event_id", "title", "rank")


@query(f"WITH {BUNDLE} SELECT event_id, risk_level, business_value FROM ev WHERE event_date BETWEEN DATE '2026-01-03' AND DATE '2026-01-25' AND status IN ('new', 'ongoing') AND risk_level IN ('高', '中') AND business_value IN ('高', '中') AND source_id = 3 AND evidence_verified")
def retrieval_filter(spark, sf_dir):
    equal = {"status": ["new", "ongoing"], "risk_level": ["高", "中"], "business_value": ["高", "中"], "source_id": 3}
    return S.matching(_bundle(spark, sf_dir), equal, "2026-01-03", "2026-01-25", flags=("evidence_verified",)).select("event_id", "risk_level", "business_value")


@query(f"WITH {BUNDLE}, r AS (SELECT event_id, opportunity_score, row_number() OVER (ORDER BY opportunity_score DESC, event_id)::INTEGER AS rank FROM ev WHERE event_date BETWEEN DATE '2026-01-05' AND DATE '2026-01-20' AND category = 'market' AND opportunity_level <> '低') SELECT * FROM r WHERE rank <= 20")
def opportunity_listing(spark, sf_dir):
    rows = S.matching(_bundle(spark, sf_dir), {"category": "market"}, *_PERIOD).where("opportunity_level <> '低'")
    return S.best(rows, [F.desc("opportunity_score"), F.asc("event_id")], 20).select("event_id", "opportunity_score", "rank")


@query(f"WITH {BUNDLE}, r AS (SELECT event_id, row_number() OVER (ORDER BY event_date DESC, event_id DESC)::INTEGER AS rank FROM ev) SELECT * FROM r WHERE rank <= 10")
def recent_events(spark, sf_dir):
    return S.best(_bundle(spark, sf_dir), [F.desc("event_date"), F.desc("event_id")], 10).select("event_id", "rank")


@query(f"WITH {BUNDLE} SELECT event_id FROM ev WHERE contains(lower(title), 'the') AND source_id IN (0, 1) AND status = 'new' AND risk_level = '低' AND NOT human_verified AND duplicate_level <> '' AND event_date >= DATE '2026-01-02'")
def library_filter(spark, sf_dir):
    rows = S.matching(_bundle(spark, sf_dir), {"source_id": [0, 1], "status": "new", "risk_level": "低"}, "2026-01-02")
    return rows.where("contains(lower(title), 'the') AND NOT human_verified AND duplicate_level <> ''").select("event_id")


@query(f"WITH {SOURCES} SELECT source_id, name FROM src WHERE enabled AND priority = 'high' AND source_id NOT IN (SELECT user_id FROM events WHERE ts::DATE = DATE '2024-01-30' AND user_id IS NOT NULL)")
def unchecked_sources(spark, sf_dir):
    last = _read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "ts")
    return S.unchecked(_sources(spark, sf_dir), last, "2024-01-30").select("source_id", "name")


@query("WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (ORDER BY ts DESC, event_id)::INTEGER AS rank FROM events WHERE ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND event_type IN ('error', 'purchase') AND contains(lower(coalesce(props, '')), '7')) SELECT event_id, user_id, rank FROM r WHERE rank <= 200")
def operation_history(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    rows = S.matching(rows, {}, "2024-01-10", "2024-01-20", "day")
    return S.browse(rows, ["props"], "7", {"event_type": ["error", "purchase"]}, [F.desc("ts"), F.asc("event_id")]).select("event_id", "user_id", "rank")


@query(f"WITH {BUNDLE}, {SOURCES} SELECT event_id, d.lang, src.name, e.priority_score FROM ev e JOIN documents d ON d.doc_id = e.event_id JOIN src USING (source_id)")
def event_bundle(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "lang")
    return _bundle(spark, sf_dir).select("event_id", "source_id", "priority_score").join(docs, "event_id").join(_sources(spark, sf_dir).select("source_id", "name"), "source_id").select("event_id", "lang", "name", "priority_score")


@query(f"WITH {BUNDLE} SELECT d.doc_id, e.event_id, e.category FROM documents d LEFT JOIN (SELECT * FROM ev WHERE record_state = 'active') e ON e.event_id = d.doc_id")
def document_events(spark, sf_dir):
    active = _bundle(spark, sf_dir).where("record_state = 'active'").select("event_id", "category")
    return _read(spark, sf_dir, "documents").select("doc_id").join(active, F.col("event_id") == F.col("doc_id"), "left")


_GATES = {
    "event_inactive": "record_state <> 'active'", "document_inactive": "document_state <> 'active'", "quality": "quality <> 'ok'", "evidence": "NOT evidence_verified", "summary_not_allowed": "NOT coalesce(summary_allowed, false)",
    "quote_not_allowed": "NOT coalesce(quote_allowed, false)", "terms_forbid": "coalesce(terms_status, '') = 'forbidden'", "duplicate": "duplicate_level = 'high'", "date_missing": "event_date IS NULL", "url_invalid": "NOT coalesce(starts_with(source_url, 'http'), false)",
}
_INTERNAL = {k: v for k, v in _GATES.items() if k not in ("summary_not_allowed", "quote_not_allowed", "terms_forbid", "date_missing")}
_GATED = f"{BUNDLE}, {SOURCES}, {_GATE}, gated AS (SELECT ev.*, gate.status AS quality, summary_allowed, quote_allowed, terms_status, src.name FROM ev JOIN gate ON doc_id = event_id LEFT JOIN src USING (source_id))"


def _gated(spark, sf_dir):
    quality = quality_gate(spark, sf_dir).select(F.col("doc_id").alias("event_id"), F.col("status").alias("quality"))
    return _bundle(spark, sf_dir).join(quality, "event_id").join(_sources(spark, sf_dir).select("source_id", "summary_allowed", "quote_allowed", "terms_status", "name"), "source_id", "left")


def _reasons(conditions: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in conditions.items()) + "], lambda x: x IS NOT NULL), ',')"


def _named(conditions: dict[str, str]) -> dict:
    return {n: F.expr(c.replace("starts_with", "startswith")) for n, c in conditions.items()}


@query(f"WITH {_GATED} SELECT event_id, {_reasons(_GATES)} AS reasons, {_reasons(_GATES)} = '' AS passed FROM gated")
def customer_gate(spark, sf_dir):
    return RV.gate(_gated(spark, sf_dir), "event_id", _named(_GATES))


@query(f"WITH {_GATED} SELECT event_id, {_reasons(_INTERNAL)} AS reasons, {_reasons(_INTERNAL)} = '' AS passed FROM gated")
def internal_gate(spark, sf_dir):
    return RV.gate(_gated(spark, sf_dir), "event_id", _named(_INTERNAL))


_BLOCK, _LIMIT = ("event_inactive", "document_inactive", "duplicate", "quality"), ("evidence", "summary_not_allowed", "terms_forbid")


@query(f"""WITH {_GATED}, r AS (SELECT event_id, {_reasons({n: _GATES[n] for n in _BLOCK + _LIMIT})} AS reasons, {_reasons({n: _GATES[n] for n in _BLOCK})} <> '' AS held FROM gated)
SELECT event_id, reasons, CASE WHEN reasons = '' THEN 'confirmed' WHEN held THEN 'blocked' ELSE 'report_ineligible' END AS outcome FROM r""")
def confirm_decisions(spark, sf_dir):
    named = _named(_GATES)
    return A.decision(_gated(spark, sf_dir), "event_id", {n: named[n] for n in _BLOCK}, {n: named[n] for n in _LIMIT})


_SEVERITY = {n: "warning" if n in ("quality", "duplicate") else "error" for n in _GATES}
_CHECKED = " UNION ALL ".join(f"SELECT '{n}' AS code, '{_SEVERITY[n]}' AS severity, count(*) FILTER ({c}) = 0 AS passed, count(*) FILTER ({c}) AS n, coalesce(array_to_string(list_sort(list(event_id) FILTER ({c}))[1:20], ','), '') AS details FROM gated" for n, c in _GATES.items())


@query(f"WITH {_GATED} {_CHECKED}")
def customer_preflight(spark, sf_dir):
    return A.preflight(_gated(spark, sf_dir), "event_id", {n: (_SEVERITY[n], c) for n, c in _named(_GATES).items()})


_MODES = {"standard": "record_state = 'active' AND evidence_verified", "internal": f"({_reasons(_INTERNAL)}) = ''", "customer": f"({_reasons(_GATES)}) = ''"}


@query(f"WITH {_GATED} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, event_id, name FROM gated WHERE {c}" for m, c in _MODES.items()))
def eligible_events(spark, sf_dir):
    rows = _gated(spark, sf_dir)
    fine = {m: ~_any(_named(c)) for m, c in (("internal", _INTERNAL), ("customer", _GATES))} | {"standard": F.expr(_MODES["standard"])}
    modes = F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in fine.items()]))
    return rows.select(F.explode(modes).alias("mode"), "event_id", "name")


def _any(conditions: dict):
    out = F.lit(False)
    for c in conditions.values():
        out = out | F.coalesce(c, F.lit(False))
    return out


_FIGURES = {"active": "record_state = 'active'", "quarantined": "record_state = 'quarantined'", "verified": "evidence_verified", "reviewed": "human_verified", "possible_duplicates": "duplicate_level <> ''", "high_risk": "risk_level = '高'", "no_source": "source_url = ''"}


@query(f"WITH {BUNDLE} " + " UNION ALL ".join(f"SELECT '{n}' AS figure, count(*) FILTER ({c}) AS n FROM ev" for n, c in _FIGURES.items()))
def state_audit(spark, sf_dir):
    return A.counts(_bundle(spark, sf_dir), {n: F.expr(c) for n, c in _FIGURES.items()})


_TODAY = {"events_today": "event_date = DATE '2026-01-15'", "pending_review": "NOT human_verified AND record_state = 'active'", "evidence_issues": "NOT evidence_verified AND record_state = 'active'", "quarantined": "record_state = 'quarantined'"}


@query(f"WITH {BUNDLE} " + " UNION ALL ".join(f"SELECT '{n}' AS figure, count(*) FILTER ({c}) AS n FROM ev" for n, c in _TODAY.items()))
def daily_home(spark, sf_dir):
    return A.counts(_bundle(spark, sf_dir), {n: F.expr(c) for n, c in _TODAY.items()})


_TABLES = ("documents", "pages", "events", "labels", "supplier")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in _TABLES))
def table_row_counts(spark, sf_dir):
    return A.table_rows({t: _read(spark, sf_dir, t) for t in _TABLES})


@query("SELECT 'documents' AS \"table\", (SELECT count(*) FROM documents) AS before, (SELECT count(*) FROM documents WHERE lang = 'en') AS after, (SELECT count(*) FROM documents WHERE lang = 'en') - (SELECT count(*) FROM documents) AS delta UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), 0, -(SELECT count(*) FROM labels)")
def restore_differences(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return A.table_differences(A.table_rows({"documents": docs, "labels": _read(spark, sf_dir, "labels")}), A.table_rows({"documents": docs.where("lang = 'en'")}))


@query("""SELECT count(*) AS calls, count(*) FILTER (event_type <> 'error') AS successes, round_even(avg(value), 4) AS mean_tokens, round_even(avg(user_id), 4) AS mean_ms, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS models,
round_even(count(*) FILTER (event_type <> 'error') / nullif(count(*), 0), 6) AS success_rate FROM events""")
def model_usage(spark, sf_dir):
    return A.usage(_read(spark, sf_dir, "events"), F.col("event_type") != "error", "value", "user_id", "event_type")


_EVIDENCE = "evidence AS (SELECT event_id, quote_no::INTEGER AS quote_no, quote, length(quote) % 3 <> 0 AS verified FROM (SELECT doc_id AS event_id, unnest(ls) AS quote, generate_subscripts(ls, 1) - 1 AS quote_no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1:3] AS ls FROM documents)))"


def _evidence(spark, sf_dir):
    lines = F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 3)
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.posexplode(lines).alias("quote_no", "quote")).withColumn("verified", F.length("quote") % 3 != 0)


@query(f"WITH {_EVIDENCE} SELECT event_id, count(*) AS quotes, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS failed, bool_and(verified) AS all_verified FROM evidence GROUP BY 1")
def evidence_audit(spark, sf_dir):
    return A.evidence_audit(_evidence(spark, sf_dir), "event_id", F.col("verified"))


@query(f"WITH {_EVIDENCE}, f AS (SELECT event_id, min_by(quote, quote_no) AS quote FROM evidence WHERE verified GROUP BY 1) SELECT doc_id AS event_id, coalesce(quote, substr(coalesce(text, ''), 1, 200)) AS quote FROM documents LEFT JOIN f ON event_id = doc_id")
def first_quotes(spark, sf_dir):
    first = _evidence(spark, sf_dir).where("verified").groupBy("event_id").agg(F.min_by("quote", "quote_no").alias("quote"))
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.lit(200)).alias("start"))
    return docs.join(first, "event_id", "left").select("event_id", F.coalesce("quote", "start").alias("quote"))


@query(f"WITH {_EVIDENCE} SELECT event_id, string_agg(quote, '；' ORDER BY quote_no) AS quotes FROM evidence WHERE verified GROUP BY 1")
def quote_lists(spark, sf_dir):
    return _evidence(spark, sf_dir).where("verified").groupBy("event_id").agg(F.expr("listagg(quote, '；') WITHIN GROUP (ORDER BY quote_no)").alias("quotes"))


@query(f"WITH {_EVIDENCE}, a AS (SELECT event_id, 0 AS quote_no, 'new' AS quote, event_id % 2 = 0 AS verified FROM (SELECT DISTINCT event_id FROM evidence WHERE event_id % 7 = 0)), r AS (SELECT * FROM evidence WHERE event_id % 7 <> 0 UNION ALL SELECT * FROM a) SELECT doc_id AS event_id, count(r.event_id) AS quotes, coalesce(bool_and(verified), false) AS evidence_verified FROM documents LEFT JOIN r ON r.event_id = doc_id GROUP BY 1")
def evidence_replaced(spark, sf_dir):
    evidence = _evidence(spark, sf_dir)
    fresh = evidence.where("event_id % 7 = 0").select("event_id").distinct().select("event_id", F.lit(0).alias("quote_no"), F.lit("new").alias("quote"), (F.col("event_id") % 2 == 0).alias("verified"))
    events = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"))
    return CH.evidence_flags(events, CH.replaced(evidence, fresh, "event_id"), "event_id")


_ASKED = {"useful": "CASE WHEN quality = 1 THEN 'yes' WHEN quality = 0 THEN 'no' END", "harmful": "CASE WHEN toxic = 1 THEN 'yes' WHEN toxic = 0 THEN 'no' END"}


@query("SELECT question, answer, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{q}' AS question, coalesce({x}, 'unknown') AS answer FROM labels" for q, x in _ASKED.items()) + ") GROUP BY 1, 2")
def feedback_counts(spark, sf_dir):
    return A.answers(_read(spark, sf_dir, "labels"), {q: F.expr(x) for q, x in _ASKED.items()})


@query("""WITH r AS (SELECT user_id AS event_id, ts, event_id AS id, event_type, value FROM events WHERE event_type <> 'signup' AND user_id IS NOT NULL), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, id DESC) AS i FROM r) WHERE i = 1),
c AS (SELECT count(*) AS reviewed, count(*) FILTER (event_type <> 'error') AS accepted, count(*) FILTER (event_type <> 'error' AND NOT value < 20) AS title, count(*) FILTER (event_type <> 'error' AND NOT (value >= 20 AND value < 90)) AS date FROM l)
SELECT reviewed, accepted, reviewed >= 50 AS enough, round_even(title / nullif(accepted, 0), 6) AS title_accuracy, round_even(date / nullif(accepted, 0), 6) AS date_accuracy FROM c""")
def review_accuracy(spark, sf_dir):
    changed = F.when(F.col("value") < 20, F.array(F.lit("title"), F.lit("summary"))).when(F.col("value") < 90, F.array(F.lit("event_date"))).otherwise(F.array().cast("array<string>"))
    rows = _read(spark, sf_dir, "events").where("event_type <> 'signup' AND user_id IS NOT NULL")
    reviews = rows.select(F.col("user_id").alias("event_id"), F.col("ts").alias("reviewed_at"), F.col("event_id").alias("review_id"), F.lit("human").alias("reviewer"), F.when(F.col("event_type") == "error", "reject").otherwise("accept").alias("decision"), changed.alias("changed"))
    return A.review_accuracy(reviews, {"title": ("title", "summary"), "date": ("event_date",)})


@query(f"WITH {BUNDLE}, tt AS (SELECT category, title, row_number() OVER (PARTITION BY category ORDER BY -priority_score, event_id) AS i FROM ev) SELECT category, count(*) AS n, count(*) FILTER (human_verified) AS verified, any_value(titles) AS titles FROM ev JOIN (SELECT category, string_agg(title, ',' ORDER BY i) AS titles FROM tt WHERE i <= 3 GROUP BY 1) USING (category) GROUP BY 1")
def group_summary(spark, sf_dir):
    rows = _bundle(spark, sf_dir).select("category", "title", "human_verified", (-F.col("priority_score")).alias("urgency"), "event_id")
    return A.summary(rows, "category", "title", ["urgency", "event_id"])


_LEAST = {"active": 10.0, "verified": 20.0, "reviewed": 1e9}


@query(f"WITH {BUNDLE}, m AS (" + " UNION ALL ".join(f"SELECT '{n}' AS figure, count(*) FILTER ({_FIGURES[n]}) AS n, {t}::DOUBLE AS threshold FROM ev" for n, t in _LEAST.items()) + ") SELECT *, n >= threshold AS passed, (SELECT bool_and(n >= threshold) FROM m) AS all_passed FROM m")
def readiness_thresholds(spark, sf_dir):
    return A.thresholds(state_audit(spark, sf_dir), "figure", "n", _LEAST)


@query(f"WITH {BUNDLE} SELECT event_id, CASE WHEN event_id % 50 = 1 THEN false ELSE human_verified END AS human_verified, CASE WHEN event_id % 50 = 1 THEN 'returned' ELSE document_state END AS document_state FROM ev")
def rejected_events(spark, sf_dir):
    rows = _bundle(spark, sf_dir).select("event_id", "human_verified", "document_state")
    return CH.reset(rows, rows.where("event_id % 50 = 1"), "event_id", {"human_verified": F.lit(False), "document_state": F.lit("returned")})


_CHANGES = "ch AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'update' WHEN doc_id % 9 = 1 THEN 'delete' ELSE 'insert' END AS op, 'zz' AS lang FROM documents WHERE doc_id % 9 < 3 UNION ALL SELECT doc_id + 100000000, CASE WHEN doc_id % 2 = 0 THEN 'insert' ELSE 'update' END, 'zz' FROM documents WHERE doc_id % 9 = 4)"


def _changes(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    own = docs.where("doc_id % 9 < 3").select("doc_id", F.expr("CASE WHEN doc_id % 9 = 0 THEN 'update' WHEN doc_id % 9 = 1 THEN 'delete' ELSE 'insert' END").alias("op"))
    other = docs.where("doc_id % 9 = 4").select((F.col("doc_id") + 100000000).alias("doc_id"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'insert' ELSE 'update' END").alias("op"))
    return own.unionByName(other).select("doc_id", "op", F.lit("zz").alias("lang"), F.lit("2026-02-01").alias("changed_at"))


@query(f"""WITH {_CHANGES}, t AS (SELECT doc_id, lang, '2026-01-01' AS touched FROM documents) SELECT * FROM t WHERE doc_id % 9 NOT IN (0, 1) UNION ALL SELECT doc_id, lang, '2026-02-01' FROM ch WHERE op = 'update' AND doc_id < 100000000
UNION ALL SELECT doc_id, lang, '2026-02-01' FROM ch WHERE op = 'insert' AND doc_id >= 100000000""")
def table_edits(spark, sf_dir):
    return CH.edited(_read(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("2026-01-01").alias("touched")), _changes(spark, sf_dir), "doc_id", "touched")


@query(f"WITH {_CHANGES} SELECT doc_id, op, (doc_id < 100000000)::BIGINT AS n FROM ch WHERE (op = 'insert') = (doc_id < 100000000)")
def refused_edits(spark, sf_dir):
    return CH.refused_changes(_read(spark, sf_dir, "documents"), _changes(spark, sf_dir), "doc_id")


@query("SELECT event_id, ts FROM events WHERE ts IS NULL OR ts + INTERVAL 14 DAY >= TIMESTAMP '2024-01-30 00:00:00'")
def log_retention(spark, sf_dir):
    return CH.unexpired(_read(spark, sf_dir, "events"), F.col("ts") + F.expr("INTERVAL 14 DAYS"), "2024-01-30 00:00:00").select("event_id", "ts")


@query(f"WITH {BUNDLE} SELECT doc_id AS report_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END::INTEGER AS n, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE (SELECT count(*) FROM ev WHERE event_id IN (doc_id, doc_id + 11) AND record_state = 'active') END AS active, CASE WHEN doc_id % 4 = 0 THEN true ELSE (SELECT count(*) FROM ev WHERE event_id IN (doc_id, doc_id + 11) AND record_state = 'active') = 0 END AS obsolete FROM documents")
def obsolete_reports(spark, sf_dir):
    ids = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array("doc_id", F.col("doc_id") + 11))
    reports = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), ids.alias("ids"))
    return CH.obsolete_reports(reports, _bundle(spark, sf_dir).select("event_id", "record_state"), "report_id", "ids", "event_id")


@query("""WITH c AS (SELECT doc_id // 5 AS batch, doc_id, sha256(coalesce(text, '')) AS h FROM documents), t AS (SELECT doc_id, h FROM c WHERE doc_id % 97 = 0)
SELECT batch, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM t) OR h IN (SELECT h FROM t)) AS blocked, count(*) FILTER (doc_id IN (SELECT doc_id FROM t) OR h IN (SELECT h FROM t)) = 0 AS promoted FROM c GROUP BY 1""")
def promotions(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.expr("doc_id DIV 5").alias("batch"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return CH.promoted(rows, rows.where("doc_id % 97 = 0"), ["doc_id", "h"], "batch")


@query("SELECT doc_id AS item_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30 AS taken FROM documents")
def source_budget(spark, sf_dir):
    items = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    return CH.within_budget(items, "source", [F.col("item_id")], 30).select("item_id", "source", "taken")


@query("""WITH d AS (SELECT doc_id, (DATE '2026-01-01' + (doc_id % 28)::INTEGER)::DATE AS day, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, CASE WHEN day NOT BETWEEN DATE '2026-01-05' AND DATE '2026-01-20' THEN 'archived_only' WHEN h IN (SELECT h FROM d WHERE doc_id < 50) THEN 'duplicate' ELSE 'new' END AS disposition FROM d""")
def late_arrivals(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.date_add(F.lit("2026-01-01").cast("date"), F.pmod("doc_id", F.lit(28)).cast("int")).alias("day"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return CH.dispositions(rows, *_PERIOD, "day", rows.where("doc_id < 50"), "h").select("doc_id", "disposition")


@query(f"WITH {BUNDLE}, r AS (SELECT event_id, row_number() OVER (ORDER BY event_date, event_id)::INTEGER AS rank FROM ev WHERE record_state = 'active' AND NOT human_verified AND evidence_verified) SELECT * FROM r WHERE rank <= 500")
def review_backlog(spark, sf_dir):
    rows = S.matching(_bundle(spark, sf_dir), {"record_state": "active", "human_verified": False}, flags=("evidence_verified",))
    return S.best(rows, [F.asc("event_date"), F.asc("event_id")], 500).select("event_id", "rank")


@query(f"WITH {BUNDLE} SELECT source_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY human_verified DESC, evidence_verified DESC, event_id) AS i FROM ev WHERE source_id IS NOT NULL) WHERE i = 1")
def best_citations(spark, sf_dir):
    order = [F.desc("human_verified"), F.desc("evidence_verified"), F.asc("event_id")]
    return S.per_key(_bundle(spark, sf_dir).where("source_id IS NOT NULL").select("source_id", "human_verified", "evidence_verified", "event_id"), "source_id", order, 1, F.col("event_id")).select("source_id", "event_id")


@query("SELECT source, lang, max(n_chars) + 1 AS next_version FROM documents GROUP BY 1, 2")
def report_versions(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy("source", "lang").agg((F.max("n_chars") + 1).alias("next_version"))


@query("SELECT source, doc_id, i::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS i FROM documents) WHERE i <= 5")
def recent_templates(spark, sf_dir):
    return S.per_key(_read(spark, sf_dir, "documents").select("source", "doc_id"), "source", [F.desc("doc_id")], 5, F.col("doc_id")).select("source", "doc_id", "rank")


@query(f"WITH {BUNDLE} SELECT event_id, 1 AS part FROM ev WHERE risk_level = '高' UNION ALL SELECT event_id, 2 FROM ev WHERE {_RESOLVED} AND event_id NOT IN (SELECT event_id FROM ev WHERE risk_level = '高')")
def concatenated_hits(spark, sf_dir):
    with scratch(spark):
        rows = stored(_bundle(spark, sf_dir).select("event_id", "risk_level", "status"), "hits")  # scored once for its three uses
        return kept(S.concat_new(rows.where("risk_level = '高'").select("event_id"), rows.where(F.col("status").isin(*LATIN.resolved)).select("event_id"), "event_id"), "concatenated-hits")


@query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def refused_ids(spark, sf_dir):
    events = _read(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("user_id"))
    return S.refused(events, _sources(spark, sf_dir).where("enabled").select(F.col("source_id").alias("user_id")), "user_id")


@query(f"WITH {BUNDLE} SELECT event_id, CASE WHEN human_verified AND event_id % 2 = 0 THEN 'human_verified' WHEN human_verified THEN 'machine_checked' ELSE 'unreviewed' END AS label FROM ev")
def review_labels(spark, sf_dir):
    return _bundle(spark, sf_dir).select("event_id", V.review_label(F.col("human_verified"), F.when(F.col("event_id") % 2 == 0, "human").otherwise("machine")).alias("label"))
