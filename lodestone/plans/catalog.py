"""The registered queries over the given tables, and the SQL that says what each must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import LATIN
from ..operators import curation as C
from ..operators import documents as D
from ..operators import events as E
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import reviews as RV
from ..operators import runs as RU
from ..streaming.counts import daily_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _drafts(spark: SparkSession, sf_dir: str, longest: int | None = 120) -> DataFrame:
    kind = F.when(F.col("source").isin("src0", "src1"), "official").when(F.col("source").isin("src2", "src3", "src4"), "press").otherwise("other")
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.pmod("doc_id", F.lit(28)).cast("int"))
    return E.draft_events(_read(spark, sf_dir, "documents"), LATIN, kind, day, F.when(F.pmod("doc_id", F.lit(5)) == 0, F.col("doc_id") - 1), longest)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score(_drafts(spark, sf_dir), LATIN)


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _has(text: str, term: str) -> str:
    return f"contains({text}, {_quote(term.lower())})"


def _sum(text: str, terms: dict) -> str:
    return "(" + " + ".join(f"CASE WHEN {_has(text, t)} THEN {p} ELSE 0 END" for t, p in terms.items()) + ")"


def _case(key: str, table: dict, default) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_quote(k)} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


def _list(text: str, terms) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_has(text, t)} THEN {_quote(t)} END" for t in terms) + "], lambda x: x IS NOT NULL), '、')"


def _clamp(x: str) -> str:
    return f"greatest(0, least(100, round_even({x}, 0)))::INTEGER"


def _level(x: str) -> str:
    return f"CASE WHEN {x} >= {LATIN.high_from} THEN '高' WHEN {x} >= {LATIN.medium_from} THEN '中' ELSE '低' END"


_COUNTS = {c: _sum("low", {t: 1 for t in terms}) for c, terms in LATIN.category_terms.items()}
_TOP = f"greatest({', '.join(_COUNTS.values())})"
_CATEGORY = f"CASE WHEN {_TOP} = 0 THEN '{LATIN.default_category}' " + " ".join(f"WHEN {n} = {_TOP} THEN '{c}'" for c, n in _COUNTS.items()) + " END"
_STATUS = "CASE " + " ".join(f"WHEN {' OR '.join(_has('low', t) for t in terms)} THEN '{s}'" for s, terms in LATIN.status_terms.items()) + f" ELSE '{LATIN.default_status}' END"
DRAFTS = f"""
b AS (SELECT doc_id AS event_id, substr(string_split(coalesce(text, ''), chr(10))[1], 1, 120) AS title, substr(coalesce(text, ''), 1, 600) AS summary, '' AS impact, source, lower(coalesce(text, '')) AS low FROM documents),
drafts AS (SELECT * EXCLUDE (low), {_CATEGORY} AS category, {_STATUS} AS status,
    CASE WHEN source IN ('src0', 'src1') THEN 'official' WHEN source IN ('src2', 'src3', 'src4') THEN 'press' ELSE 'other' END AS source_type,
    (DATE '2026-01-01' + (event_id % 28)::INTEGER)::DATE AS event_date, CASE WHEN event_id % 5 = 0 THEN event_id - 1 END AS related_event_id FROM b)"""
_RISKS = {**LATIN.high, **LATIN.medium, **LATIN.low}
SCORED = f"""{DRAFTS},
t AS (SELECT *, lower(title || ' ' || summary || ' ' || impact) AS whole FROM drafts),
s1 AS (SELECT *, {_clamp(_case('category', LATIN.risk_base, 10) + ' + ' + _sum('whole', _RISKS))} AS historical_risk_score,
    {_clamp(_case('category', LATIN.risk_base, 10) + ' + ' + _sum('whole', _RISKS) + ' + ' + _sum('whole', LATIN.relief))} AS risk_score,
    {_clamp(_case('category', LATIN.opportunity_base, 5) + ' + ' + _sum('whole', LATIN.opportunity))} AS opportunity_score,
    {_clamp('(' + _case('source_type', LATIN.confidence, 40) + ') * (' + _case('status', {k: f'{v}::DOUBLE' for k, v in LATIN.status_confidence.items()}, '1.0::DOUBLE') + ')')} AS confidence,
    {_list('whole', [*_RISKS, *LATIN.relief])} AS risk_terms, {_list('whole', LATIN.opportunity)} AS opportunity_terms FROM t),
scored AS (SELECT * EXCLUDE (whole), {_clamp('risk_score * (confidence::DOUBLE / 100.0::DOUBLE) * (' + _case('status', {k: f'{v}::DOUBLE' for k, v in LATIN.status_priority.items()}, '0.5::DOUBLE') + ')')} AS priority_score,
    {_level('risk_score')} AS risk_level, {_level('opportunity_score')} AS opportunity_level FROM s1)"""
_EVENT_COLUMNS = ["event_id", "title", "category", "status", "source_type", "event_date", "historical_risk_score", "risk_score", "opportunity_score", "confidence", "priority_score", "risk_terms", "opportunity_terms", "risk_level", "opportunity_level"]
_DONE = ", ".join(_quote(x) for x in LATIN.resolved)

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {SCORED} SELECT {', '.join(_EVENT_COLUMNS)} FROM scored")
def event_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select(_EVENT_COLUMNS)


@query(f"WITH {SCORED} SELECT event_id, title, priority_score, risk_terms FROM scored s WHERE status NOT IN ({_DONE}) AND priority_score >= 40 AND NOT EXISTS (SELECT 1 FROM scored r WHERE r.related_event_id = s.event_id AND r.status IN ({_DONE}))")
def current_risks_scored(spark, sf_dir):
    return E.current_risks(_scored(spark, sf_dir), LATIN).select("event_id", "title", "priority_score", "risk_terms")


@query(f"WITH {SCORED} SELECT event_id, historical_risk_score FROM scored WHERE status IN ({_DONE})")
def resolved_events(spark, sf_dir):
    return E.resolved_risks(_scored(spark, sf_dir), LATIN).select("event_id", "historical_risk_score")


@query(f"WITH {DRAFTS} SELECT category, status, count(*) AS n FROM drafts GROUP BY 1, 2")
def category_status(spark, sf_dir):
    return _drafts(spark, sf_dir).groupBy("category", "status").agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT event_id, event_date, opportunity_score FROM scored WHERE event_date BETWEEN DATE '2026-01-05' AND DATE '2026-01-12' AND opportunity_level <> '低'")
def opportunity_watch(spark, sf_dir):
    found = E.between(_scored(spark, sf_dir), "2026-01-05", "2026-01-12")
    return found.where("opportunity_level <> '低'").select("event_id", "event_date", "opportunity_score")


@query(f"""WITH {SCORED}, g AS (SELECT event_id, priority_score, opportunity_score, CASE WHEN status NOT IN ({_DONE}) AND risk_level <> '低' THEN 'risks' WHEN status IN ({_DONE}) THEN 'resolved' WHEN opportunity_level <> '低' THEN 'opportunities' ELSE 'watchlist' END AS report_group FROM scored)
SELECT report_group, rank::INTEGER AS rank, event_id FROM (SELECT *, row_number() OVER (PARTITION BY report_group ORDER BY priority_score DESC, opportunity_score DESC, event_id) AS rank FROM g) WHERE rank <= 5""")
def report_groups(spark, sf_dir):
    return E.report_groups(_scored(spark, sf_dir), LATIN).select("report_group", "rank", "event_id")


_ISSUES = f"""{DRAFTS}, k AS (SELECT event_id, regexp_replace(lower(title), '[^\\pL\\pN\\pM]+', '', 'g') AS key FROM drafts),
issues AS (SELECT event_id, 'error' AS severity, 'required_missing' AS code FROM drafts WHERE trim(title) = ''
UNION ALL SELECT event_id, 'warning', 'short_summary' FROM drafts WHERE length(summary) < 40
UNION ALL SELECT event_id, 'info', 'impact_missing' FROM drafts WHERE impact = ''
UNION ALL SELECT event_id, 'error', 'self_relation' FROM drafts WHERE related_event_id = event_id
UNION ALL SELECT event_id, 'warning', 'relief_missing_relation' FROM drafts WHERE status = 'resolved' AND related_event_id IS NULL
UNION ALL SELECT event_id, 'error', 'unknown_relation' FROM drafts WHERE related_event_id IS NOT NULL AND related_event_id NOT IN (SELECT event_id FROM drafts)
UNION ALL SELECT event_id, 'warning', 'duplicate_title' FROM (SELECT *, min(event_id) OVER (PARTITION BY key) AS first FROM k WHERE key <> '') WHERE event_id > first)"""


@query(f"WITH {_ISSUES} SELECT * FROM issues")
def event_validation_issues(spark, sf_dir):
    return E.validate(_drafts(spark, sf_dir), LATIN)


@query(f"WITH {_ISSUES} SELECT severity, code, count(*) AS n FROM issues GROUP BY 1, 2")
def validation_summary(spark, sf_dir):
    return E.validate(_drafts(spark, sf_dir), LATIN).groupBy("severity", "code").agg(F.count("*").alias("n"))


_HASH = r"sha256(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g'))"


@query(f"SELECT {_HASH} AS content_hash, min(doc_id) AS first_doc_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return D.exact_duplicates(_read(spark, sf_dir, "documents"))


_URL = r"CASE WHEN url LIKE '%://%' THEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) ELSE '' END"


@query(f"""WITH c AS (SELECT page_id, {_URL} AS url_key, md5(html) AS content_hash FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY url_key, content_hash ORDER BY page_id) AS nth FROM c),
v AS (SELECT *, sum((nth = 1)::INTEGER) OVER (PARTITION BY url_key ORDER BY page_id)::INTEGER AS document_version FROM n)
SELECT page_id, url_key, document_version, CASE WHEN nth > 1 THEN 'duplicate_content' WHEN document_version = 1 THEN 'new' ELSE 'updated' END AS disposition,
nth = 1 AND document_version = max(document_version) OVER (PARTITION BY url_key) AS is_current FROM v""")
def document_versions(spark, sf_dir):
    captures = _read(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("content_hash"))
    return D.versions(captures, "url", "page_id").select("page_id", "url_key", "document_version", "disposition", "is_current")


_GATE = r"""m AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS body FROM documents),
q AS (SELECT doc_id, length(body)::INTEGER AS text_characters, len(list_filter(string_split(t, chr(10)), lambda p: length(trim(p)) >= 20))::INTEGER AS effective_paragraphs,
    (""" + " + ".join(f"(length(lower(t)) - length(replace(lower(t), '{w}', ''))) // {len(w)}" for w in ("cookie", "subscribe", "menu", "login", "share")) + r""")::INTEGER AS navigation_hits,
    round_even(len(regexp_extract_all(body, '[\pL\pN]'))::DOUBLE / greatest(length(body), 1), 4) AS information_density, contains(t, chr(65533)) AS broken FROM m),
i AS (SELECT *, array_to_string(list_filter([CASE WHEN broken THEN 'encoding_anomaly' END, CASE WHEN text_characters < 30 OR (effective_paragraphs < 2 AND text_characters < 70) THEN 'thin_body' END, CASE WHEN navigation_hits >= 6 THEN 'navigation_noise' END, CASE WHEN text_characters >= 80 AND information_density < 0.55 THEN 'low_density' END], lambda x: x IS NOT NULL), ',') AS issues FROM q),
gate AS (SELECT doc_id, text_characters, effective_paragraphs, navigation_hits, information_density, issues, CASE WHEN issues = '' THEN 'ok' ELSE 'blocked' END AS status FROM i)"""


@query(f"WITH {_GATE} SELECT * FROM gate")
def quality_gate(spark, sf_dir):
    return D.quality_gate(_read(spark, sf_dir, "documents"))


@query(f"WITH {_GATE}, c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND status = 'ok') AS good_ok, count(*) FILTER (quality = 0 AND status <> 'ok') AS bad_blocked, count(*) FILTER (quality = 1) AS good FROM gate JOIN labels USING (doc_id) WHERE quality IS NOT NULL) SELECT *, round_even((good_ok + bad_blocked) / n, 6) AS accuracy FROM c")
def quality_vs_labels(spark, sf_dir):
    return M.label_accuracy(D.quality_gate(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "labels"))


@query(f"""WITH x AS (SELECT doc_id, 'secret' AS kind, unnest(list_distinct(regexp_extract_all(text, {_quote(T.SECRET)}))) AS value FROM documents
UNION ALL SELECT doc_id, 'email', unnest(list_distinct(regexp_extract_all(text, {_quote(T.EMAIL)}))) FROM documents) SELECT * FROM x""")
def secret_pii_scan(spark, sf_dir):
    return D.secret_scan(_read(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, {_quote(T.SECRET)}, '[secret]', 'g'), {_quote(T.EMAIL)}, '[email]', 'g') AS text FROM documents")
def redacted_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@query()
def document_chunks(spark, sf_dir):
    return D.chunks(_read(spark, sf_dir, "documents"))


@query(rf"""SELECT page_id, {_URL} AS url_key, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a href='))::INTEGER AS n_links FROM pages""")
def page_metadata(spark, sf_dir):
    return D.page_metadata(_read(spark, sf_dir, "pages"))


@query("""WITH h AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"#]+)"', 1) AS hs FROM pages),
x AS (SELECT page_id, unnest(hs) AS href, generate_subscripts(hs, 1) AS i FROM h), f AS (SELECT page_id, href, min(i) AS i FROM x GROUP BY 1, 2)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS position, href FROM f""")
def page_links(spark, sf_dir):
    return D.page_links(_read(spark, sf_dir, "pages"))


@query("""SELECT item_id, doc_id, CASE WHEN contains(d.text, b.text) THEN strpos(d.text, b.text) - 1 END::INTEGER AS start_offset, CASE WHEN contains(d.text, b.text) THEN strpos(d.text, b.text) - 1 + length(b.text) END::INTEGER AS end_offset,
CASE WHEN contains(d.text, b.text) THEN 'exact' ELSE 'whitespace_only' END AS method FROM benchmark b, documents d WHERE contains(d.text, b.text) OR contains(regexp_replace(d.text, '\\s+', '', 'g'), regexp_replace(b.text, '\\s+', '', 'g'))""")
def quote_location(spark, sf_dir):
    return R.locate_quotes(_read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "documents"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]{2,}') AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\pL\pN_]{2,}'))) AS term FROM benchmark),
p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT query_id, doc_id, round_even(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 10""")
def bm25_topk(spark, sf_dir):
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_topk(_read(spark, sf_dir, "documents"), queries)


@query("""WITH x AS (SELECT q.vec_id AS query_id, v.vec_id, round_even(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM x) WHERE rank <= 10""")
def vector_topk(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return R.vector_topk(vectors.select("vec_id", "embedding"), vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query("""SELECT s.s_suppkey AS source_id, count(e.event_id) AS runs, count(e.event_id) FILTER (event_type <> 'error') AS successes, round_even(coalesce(sum(value), 0), 4) AS value,
round_even(count(e.event_id) FILTER (event_type <> 'error') / nullif(count(e.event_id), 0), 6) AS success_rate FROM supplier s LEFT JOIN events e ON e.user_id = s.s_suppkey GROUP BY 1""")
def source_run_stats(spark, sf_dir):
    runs = _read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), (F.col("event_type") != "error").alias("ok"), "value")
    return M.source_run_statistics(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id")), runs)


@query("SELECT coalesce(nullif(trim(source), ''), 'unset') AS value, count(*) AS n FROM documents GROUP BY 1")
def source_counts(spark, sf_dir):
    return M.group_counts(_read(spark, sf_dir, "documents"), "source")


@query("WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY))::DATE AS day), c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (day)")
def day_histogram(spark, sf_dir):
    return M.daily_histogram(_read(spark, sf_dir, "events"), "2024-01-01", "2024-02-10")


@query("SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS before, count(*) FILTER (NOT ts < TIMESTAMP '2024-01-15') AS after, count(*) FILTER (NOT ts < TIMESTAMP '2024-01-15') - count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS delta FROM events GROUP BY 1")
def period_compare(spark, sf_dir):
    return M.compare_periods(_read(spark, sf_dir, "events"), "2024-01-15 00:00:00")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), l AS (SELECT user_id, max(i) FILTER (event_type <> 'error') AS ok FROM o GROUP BY 1)
SELECT user_id, count(*) AS failures FROM o JOIN l USING (user_id) WHERE event_type = 'error' AND i > coalesce(ok, 0) GROUP BY 1""")
def failure_counters(spark, sf_dir):
    return M.failure_streaks(_read(spark, sf_dir, "events"))


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS island FROM d),
r AS (SELECT user_id, island, max(day) AS last_day, count(*) AS days FROM i GROUP BY 1, 2) SELECT user_id, max(last_day) AS last_day, max_by(days, last_day) AS days FROM r GROUP BY 1""")
def run_day_streaks(spark, sf_dir):
    return M.day_streaks(_read(spark, sf_dir, "events"))


@query("SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_events(spark, sf_dir):
    return M.latest_per_key(_read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"))


@query("""WITH r AS (SELECT user_id, ts::DATE AS day, count(*) AS steps, count(*) FILTER (event_type = 'error') AS failures, round_even(sum(value), 4) AS value FROM events GROUP BY 1, 2)
SELECT *, CASE WHEN failures = steps THEN 'failed' WHEN failures > 0 THEN 'partially_succeeded' ELSE 'succeeded' END AS outcome FROM r""")
def run_outcomes(spark, sf_dir):
    steps = _read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    return RU.run_outcomes(steps, ["user_id", "day"], F.col("event_type") == "error", "value")


_SLOW = "(value IS NULL OR value < 10)"


@query(f"""SELECT event_type, n, failures, coalesce(reasons, '') AS reasons FROM (SELECT event_type, count(*) AS n, count(*) FILTER ({_SLOW}) AS failures FROM events GROUP BY 1)
LEFT JOIN (SELECT event_type, string_agg(props, ',' ORDER BY props) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY props) AS i FROM (SELECT DISTINCT event_type, props FROM events WHERE {_SLOW})) WHERE i <= 20 GROUP BY 1) USING (event_type)""")
def stage_statistics(spark, sf_dir):
    return RU.stage_statistics(_read(spark, sf_dir, "events"), "event_type", F.expr(_SLOW), "props")


@query("SELECT user_id, max(ts) AS last_beat FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 18:00:00' - INTERVAL 30 MINUTE")
def stale_runs(spark, sf_dir):
    return RU.stale_runs(_read(spark, sf_dir, "events"), "user_id", "ts", "2024-01-30 18:00:00", 30)


_LEGAL = {"signup": ("view", "click"), "view": ("click", "view", "error"), "click": ("purchase", "view", "error"), "purchase": ("view",), "error": ("view", "click", "error")}


@query("WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT * FROM l WHERE before IS NOT NULL AND NOT ("
       + " OR ".join(f"(before = '{a}' AND event_type IN ({', '.join(map(_quote, b))}))" for a, b in _LEGAL.items()) + ")")
def illegal_transitions(spark, sf_dir):
    states = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return RU.illegal_transitions(states, "user_id", ["ts", "event_id"], "event_type", _LEGAL).select("user_id", "event_id", "event_type", "before")


_CHECKS = {"success_rate": ("event_type <> 'error'", 0.75), "purchase_rate": ("event_type = 'purchase'", 0.25), "valued_rate": ("value > 0", 0.9)}


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"check\", round_even(count(*) FILTER ({c}) / nullif(count(*), 0), 6) AS value, {t}::DOUBLE AS threshold, coalesce(round_even(count(*) FILTER ({c}) / nullif(count(*), 0), 6) >= {t}, false) AS passed FROM events" for n, (c, t) in _CHECKS.items()))
def readiness_gates(spark, sf_dir):
    return RU.readiness(_read(spark, sf_dir, "events"), {n: (F.expr(c), t) for n, (c, t) in _CHECKS.items()})


@query("WITH d AS (SELECT ts::DATE AS day FROM events UNION SELECT o_orderdate::DATE FROM orders) SELECT count(*) AS run_days, greatest(0, 28 - count(*)) AS remaining FROM d WHERE day IS NOT NULL")
def four_week_eval(spark, sf_dir):
    return RU.run_days(_read(spark, sf_dir, "events"), _read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts")))


_STATES = {"error": "failed", "purchase": "succeeded", "signup": "queued", "view": "running", "click": "running"}


@query("WITH m AS (SELECT user_id, ts::DATE AS day, min({'ts': ts, 'event_id': event_id, 'event_type': event_type}) AS x, count(*) AS merged FROM events GROUP BY 1, 2) SELECT user_id, day, x.event_id AS event_id, " + "CASE x.event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STATES.items()) + " ELSE 'unknown' END AS event_type, merged FROM m")
def ledger_merge(spark, sf_dir):
    entries = _read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    return RU.merged_ledger(entries, ["user_id", "day"], ["ts", "event_id"], "event_type", _STATES).select("user_id", "day", "event_id", "event_type", "merged")


@query("""WITH l AS (SELECT user_id AS source_id, max(ts::DATE) AS last_day FROM events GROUP BY 1), s AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS frequency, s_acctbal > 0 AS enabled FROM supplier)
SELECT source_id, frequency, last_day FROM s LEFT JOIN l USING (source_id) WHERE enabled AND (last_day IS NULL OR (frequency = 'daily' AND last_day <> DATE '2024-01-30') OR (frequency = 'weekly' AND last_day <= DATE '2024-01-23'))""")
def due_sources(spark, sf_dir):
    sources = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_suppkey") % 2 == 0, "daily").otherwise("weekly").alias("frequency"), (F.col("s_acctbal") > 0).alias("enabled"))
    return RU.due(sources, _read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "ts"), "2024-01-30").select("source_id", "frequency", "last_day")


_REASONS = {"low_confidence": "confidence < 60", "low_value": "risk_level = '低' AND opportunity_level = '低'", "resolved": f"status IN ({_DONE})", "unrelated": "related_event_id IS NULL", "blank_title": "trim(title) = ''"}


@query(f"WITH {SCORED}, r AS (SELECT event_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _REASONS.items()) + "], lambda x: x IS NOT NULL), ',') AS reasons FROM scored) SELECT *, reasons = '' AS passed FROM r")
def gate_reasons(spark, sf_dir):
    return RV.gate(_scored(spark, sf_dir), "event_id", {n: F.expr(c) for n, c in _REASONS.items()})


@query(f"WITH {SCORED}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS reason, count(*) FILTER ({c}) AS n FROM scored" for n, c in _REASONS.items()) + ") SELECT * FROM c WHERE n > 0")
def reason_counts(spark, sf_dir):
    return RV.reason_counts(_scored(spark, sf_dir), {n: F.expr(c) for n, c in _REASONS.items()})


@query(f"WITH {DRAFTS}, c AS (SELECT count(*) AS n, coalesce(sum((trim(title) <> '')::INT + (trim(summary) <> '')::INT + (trim(impact) <> '')::INT + (related_event_id IS NOT NULL)::INT), 0)::BIGINT AS filled FROM drafts) SELECT *, round_even(100.0::DOUBLE * filled / nullif(n * 4, 0), 1) AS percent FROM c")
def completeness(spark, sf_dir):
    return RV.completeness(_drafts(spark, sf_dir), ["title", "summary", "impact", "related_event_id"])


@query("""WITH l AS (SELECT event_type, sha256('{"event_id":' || event_id || ',"user_id":' || user_id || ',"props":' || to_json(props)::VARCHAR || '}') AS line FROM events WHERE user_id IS NOT NULL AND props IS NOT NULL),
b AS (SELECT event_type, substr(line, 1, 3) AS block, count(*) AS n, sha256(string_agg(line, '' ORDER BY line)) AS digest FROM l GROUP BY 1, 2) SELECT event_type, sum(n)::BIGINT AS n, sha256(string_agg(digest, '' ORDER BY block)) AS digest FROM b GROUP BY 1""")
def delivery_snapshot(spark, sf_dir):
    return RV.snapshot(_read(spark, sf_dir, "events").where("user_id IS NOT NULL AND props IS NOT NULL"), "event_type", "event_id", ["user_id", "props"])


@query("WITH c AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN g.lang IS DISTINCT FROM d.lang THEN 'lang' END, CASE WHEN g.source IS DISTINCT FROM d.source THEN 'source' END], lambda x: x IS NOT NULL), ',') AS changed FROM documents d JOIN (SELECT doc_id + 1 AS doc_id, lang, source FROM documents) g USING (doc_id)) SELECT * FROM c WHERE changed <> ''")
def review_diff(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return RV.changed_fields(docs.withColumn("doc_id", F.col("doc_id") + 1), docs, "doc_id", ["lang", "source"])


@query(f"""WITH k AS ({SQL['bm25_topk']}), p AS (SELECT query_id, doc_id, rank, sum(length(coalesce(text, ''))) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS total FROM k JOIN documents USING (doc_id)) SELECT * FROM p WHERE total <= 12000""")
def context_pack(spark, sf_dir):
    sizes = _read(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    ranked = bm25_topk(spark, sf_dir).join(sizes, "doc_id")
    return RV.context_pack(ranked, "size", 12000).select("query_id", "doc_id", "rank", "total")


@query(f"""WITH a AS ({SQL['bm25_topk']}), b AS ({SQL['vector_topk']}), f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.vec_id) AS doc_id,
round_even(coalesce(0.25::DOUBLE + 0.55::DOUBLE / a.rank, 0) + coalesce(0.45::DOUBLE / b.rank, 0), 6) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.vec_id)
SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_topk(spark, sf_dir):
    return RV.fuse(bm25_topk(spark, sf_dir), vector_topk(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"))


_INTENTS = {"compare": ("compar", "versus"), "sources": ("source", "quelle"), "impact": ("effect", "tion"), "active": ("the", "der ")}


@query("SELECT conv_id, turn, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{t}')" for t in terms) + f" THEN '{n}'" for n, terms in _INTENTS.items()) + " ELSE 'general' END AS intent FROM conversations WHERE role = 'user'")
def routed_questions(spark, sf_dir):
    return RV.route(_read(spark, sf_dir, "conversations").where("role = 'user'"), "text", _INTENTS, "general").select("conv_id", "turn", "intent")


@query("SELECT event_id, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def model_output_parse(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").k.alias("k"))


@query("SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_daily(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    return daily_counts(spark, f"{sf_dir}/events.parquet*", events.schema)  # a pattern, since a stream takes no single file


@query("""WITH x AS (SELECT user_id, max_by({'ts': ts, 'id': event_id, 'event_type': event_type}, {'ts': ts, 'id': event_id}) AS e FROM events GROUP BY 1),
c AS (SELECT user_id, e.event_type AS status, e.ts AS seen_at, e.id % 3 = 0 AS hashed, e.id % 2 = 0 AS named, date_diff('day', e.ts::DATE, DATE '2024-02-02') AS age FROM x),
r AS (SELECT user_id, CASE WHEN status = 'purchase' THEN 'resolved' WHEN age > 30 AND hashed THEN 'old_with_hash' WHEN age > 7 THEN 'outside_week'
WHEN NOT named AND seen_at > TIMESTAMP '2024-02-02 00:00:00' - INTERVAL 24 HOUR THEN 'checked_today' ELSE 'conditional_check' END AS reason FROM c) SELECT *, reason = 'conditional_check' AS recheck FROM r""")
def recheck_policy(spark, sf_dir):
    last = M.latest_per_key(_read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"))
    part = lambda n: F.when(F.col("event_id") % n == 0, F.col("event_id").cast("string"))
    current = last.select("user_id", F.col("event_type").alias("status"), F.to_date("ts").alias("published"), F.col("ts").alias("checked_at"), part(3).alias("file_hash"), part(2).alias("validator"))
    return C.recheck_policy(current, "2024-02-02 00:00:00", resolved=("purchase",)).select("user_id", "reason", "recheck")


@query("SELECT event_id, user_id, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3, false) AS tripped FROM events")
def circuit_breaker(spark, sf_dir):
    runs = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return C.circuit_breaker(runs, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "tripped")


@query("""WITH l AS (SELECT *, max(ts) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events)
SELECT event_id, user_id, coalesce(ts < last + INTERVAL 6 HOUR, false) AS suppressed FROM l""")
def run_cooldown(spark, sf_dir):
    runs = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return C.cooldown(runs, "user_id", "ts", ["ts", "event_id"], F.col("event_type") != "error", 6 * 3600).select("event_id", "user_id", "suppressed")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase' AND value > 50) = 0")
def zero_yield_sources(spark, sf_dir):
    return C.zero_yield(_read(spark, sf_dir, "events"), "user_id", F.expr("event_type = 'purchase' AND value > 50"))


@query("""SELECT o_orderkey, 'o_orderstatus' AS field, 'value_not_allowed' AS issue FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'o_totalprice', 'basis_missing' FROM orders WHERE o_totalprice > 100000 AND NOT coalesce(o_orderstatus = 'F', false)""")
def compliance_values(spark, sf_dir):
    needs = {"o_totalprice": (F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F")}
    return C.value_issues(_read(spark, sf_dir, "orders"), "o_orderkey", {"o_orderstatus": ("F", "O")}, needs)


@query("""WITH p AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations), x AS (SELECT conv_id, turn, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM p),
k AS (SELECT *, trim(regexp_replace(line, '[ \\t\\r\\f]+', ' ', 'g')) AS key, (line_no < 2)::INT + (line_no >= n - 2)::INT AS edges FROM x), z AS (SELECT conv_id, count(*) AS pages FROM conversations GROUP BY 1),
r AS (SELECT conv_id, key, sum(edges) AS seen FROM k WHERE edges > 0 AND length(key) BETWEEN 2 AND 120 GROUP BY 1, 2)
SELECT conv_id, turn, line_no::INTEGER AS line_no, line, coalesce(pages >= 2 AND seen >= greatest(2, ceil(0.6 * pages)), false) AS removed FROM k JOIN z USING (conv_id) LEFT JOIN r USING (conv_id, key)""")
def page_margins(spark, sf_dir):
    return C.page_margins(_read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(f"SELECT page_id, position, href, CASE WHEN is_current THEN 'valid' ELSE 'version_mismatch' END AS status FROM ({SQL['page_links']}) JOIN ({SQL['document_versions']}) USING (page_id)")
def evidence_invalidation(spark, sf_dir):
    return C.invalidate(page_links(spark, sf_dir), document_versions(spark, sf_dir).where("NOT is_current"), "page_id")


@query(f"WITH {DRAFTS}, {_GATE} SELECT event_id, CASE WHEN g.status = 'blocked' THEN 'quarantined' ELSE 'active' END AS record_state, CASE WHEN g.status = 'blocked' THEN g.issues ELSE '' END AS reasons FROM drafts JOIN gate g ON event_id = doc_id")
def quarantine_cascade(spark, sf_dir):
    return C.quarantine(_drafts(spark, sf_dir), quality_gate(spark, sf_dir), "event_id", "doc_id")
