"""Gates with all their reasons: promotion of reviewed events, permissions of sources, whether a report may be made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import any_of

# Who counts as an independent human, what counts as accepted or refused, and the terms that say how an event concerns the region.
HUMANS, ACCEPTED, REFUSED, COMMERCIAL = ("human_user", "industry_reviewer"), ("accepted", "modified_accepted"), ("禁止", "不允许"), ("允许", "已确认允许")
DIRECT, POSSIBLE = ("青岛", "胶州湾", "前湾港", "董家口"), ("黄海", "山东", "港口", "海事", "航运", "物流")
CUSTOMER, INTERNAL = "customer", "internal"


def relevance(text: Column, direct: tuple[str, ...] = DIRECT, possible: tuple[str, ...] = POSSIBLE) -> Column:
    """direct, possible or none, by the first kind of which a term stands in the text."""
    return F.when(any_of(text, direct), "direct").when(any_of(text, possible), "possible").otherwise("none")


def _flag(name: str, default: bool = False) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(default))


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def source_refusal(mode: str, refused: tuple[str, ...] = REFUSED) -> Column:
    """Why a source (commercial_reuse_status, terms_status, customer_summary_allowed, short_quote_allowed, internal_analysis_allowed) may not be used in the mode; null if it may. An unset internal flag allows."""
    forbidden = _text("commercial_reuse_status").isin(*refused) | _text("terms_status").isin(*refused)
    out = F.when(forbidden, "terms_forbid")
    if mode == CUSTOMER:
        return out.when(~(_flag("customer_summary_allowed") & _flag("short_quote_allowed")), "customer_use_not_allowed")
    return out.when(~_flag("internal_analysis_allowed", True), "internal_use_not_allowed") if mode == INTERNAL else out


def promotion_gate(events: DataFrame, documents: DataFrame, sources: DataFrame, evidence: DataFrame, mode: str, direct: tuple[str, ...] = DIRECT, possible: tuple[str, ...] = POSSIBLE, refused: tuple[str, ...] = REFUSED) -> DataFrame:
    """(event_id, reasons, customer_reasons, relevance) of every event: the conditions that fail, in order, by commas, in the mode and for customers; '' where the gate holds.

    events: (event_id, document_id, title, summary, impact, affected_area, category, source_name, reviewer_type, reviewer_name, human_verified, review_state, requires_second_review, record_state, duplicate_level);
    documents, the current ones: (document_id, source_id, record_state, quality_ok, url, document_version, content_hash); sources: see source_refusal(), with source_id; evidence: (event_id, verified,
    document_version, content_hash). Evidence holds if there is some and all of it is verified in this version and content of the document. A missing document or source is the only reason.
    """
    held = documents.select("document_id", "source_id", F.col("record_state").alias("document_state"), "quality_ok", "url", F.col("document_version").alias("v"), F.col("content_hash").alias("h"), F.lit(True).alias("has_document"))
    rows = events.join(held, "document_id", "left").join(sources.withColumn("has_source", F.lit(True)), "source_id", "left")
    bound = evidence.select("event_id", _flag("verified").alias("verified"), F.col("document_version").alias("ev"), F.col("content_hash").alias("eh")).join(events.select("event_id", "document_id"), "event_id").join(held.select("document_id", "v", "h"), "document_id")
    good = bound.groupBy("event_id").agg(F.bool_and(F.col("verified") & F.col("ev").eqNullSafe(F.col("v")) & F.col("eh").eqNullSafe(F.col("h"))).alias("located"))
    rows = rows.join(good, "event_id", "left")
    state = lambda c: F.coalesce(F.nullif(_text(c), F.lit("")), F.lit("active"))
    checks = [
        (~_text("reviewer_type").isin(*HUMANS), "reviewer_not_human"), (~_flag("human_verified") | (_text("reviewer_name") == ""), "no_traceable_review"), (~_text("review_state").isin(*ACCEPTED), "review_not_accepted"), (_flag("requires_second_review"), "second_review_open"),
        (state("record_state") != "active", "event_not_active"), (state("document_state") != "active", "document_quarantined"), (~_flag("quality_ok"), "document_quality"), (~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)), "url_incomplete"), (_text("source_name") == "", "source_name_missing"),
        (_text("duplicate_level") == "high", "likely_duplicate"), (~_flag("located"), "evidence_not_located"),
    ]
    missing = ~(_flag("has_document") & _flag("has_source"))
    why = lambda m: F.when(missing, "document_or_source_missing").otherwise(F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks], source_refusal(m, refused))), ","))
    said = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "summary", "impact", "affected_area", "category")])
    return rows.select("event_id", why(mode).alias("reasons"), why(CUSTOMER).alias("customer_reasons"), relevance(said, direct, possible).alias("relevance"))


def source_problems(sources: DataFrame, allowed: tuple[str, ...] = COMMERCIAL, refused: tuple[str, ...] = REFUSED) -> DataFrame:
    """(source_id, check, severity): crawl_gate, fail: crawled by itself without a domain, a list page or leave by robots; report_gate, fail: refused by its terms but open to customers, as summaries with
    quotes or in full; permission_risk, warn: open to customers with its use not granted."""
    crawled = _flag("enabled") & _flag("crawl_allowed")
    no_gate = crawled & ((_text("domain") == "") | ~_text("list_page_url").rlike("^https?://") | (_text("robots_status") != "allowed"))
    is_open = (_flag("customer_summary_allowed") & _flag("short_quote_allowed")) | _flag("fulltext_redistribution_allowed") | _flag("raw_data_resale_allowed")
    forbidden = _text("commercial_reuse_status").isin(*refused) | _text("terms_status").isin(*refused)
    found = lambda bad, check, severity: F.when(bad, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity")))
    checks = F.array(found(no_gate, "crawl_gate", "fail"), found(is_open & forbidden, "report_gate", "fail"), found(is_open & ~forbidden & ~_text("commercial_reuse_status").isin(*allowed), "permission_risk", "warn"))
    return sources.select("source_id", F.explode(F.array_compact(checks)).alias("x")).select("source_id", "x.check", "x.severity")


def source_checks(sources: DataFrame, **options) -> DataFrame:
    """(check, status, n) of the three checks: fail or warn with the number of sources, else pass; a crawl gate without any source that is crawled is a warning with 0."""
    counts = source_problems(sources, **options).groupBy("check").agg(F.count("*").alias("n"))
    crawled = sources.agg(F.count_if(_flag("enabled") & _flag("crawl_allowed")).alias("crawled"))
    names = sources.sparkSession.createDataFrame([("crawl_gate", "fail"), ("report_gate", "fail"), ("permission_risk", "warn")], "check string, worst string")
    joined = names.join(counts, "check", "left").crossJoin(crawled)  # three rows with one
    n = F.coalesce("n", F.lit(0))
    return joined.select("check", F.when(n > 0, F.col("worst")).when((F.col("check") == "crawl_gate") & (F.col("crawled") == 0), "warn").otherwise("pass").alias("status"), n.alias("n"))


def report_decisions(reports: DataFrame, selected: DataFrame, blockers: DataFrame) -> DataFrame:
    """(report_id, decision, n) of reports (report_id, mode, require_value, allow_empty): made, or the first reason that blocks it.

    selected: (report_id, event_id, business_value, core), the events that the report's filter takes; blockers: (report_id, n), what a customer's preflight has against it. preflight: a customer report with events and
    blockers; no_business_value: value is required and no event has any (high or medium); no_core_event: value is required and none is core; no_events: a customer report without events, or an internal one
    that may not be empty. n: the number of events.
    """
    valued = F.count_if(F.coalesce(F.col("business_value").isin("高", "中"), F.lit(False)))
    sums = selected.groupBy("report_id").agg(F.count("*").alias("n"), valued.alias("valued"), F.count_if("core").alias("cores"))
    against = blockers.groupBy("report_id").agg(F.sum("n").alias("against"))
    rows = reports.join(sums, "report_id", "left").join(against, "report_id", "left").fillna(0, ["n", "valued", "cores", "against"])
    some, asks, customer = F.col("n") > 0, _flag("require_value"), F.col("mode") == CUSTOMER
    decision = (
        F.when(customer & some & (F.col("against") > 0), "preflight").when(asks & some & (F.col("valued") == 0), "no_business_value").when(asks & some & (F.col("cores") == 0), "no_core_event")
        .when(~some & (customer | ((F.col("mode") == INTERNAL) & ~_flag("allow_empty"))), "no_events").otherwise("made")
    )
    return rows.select("report_id", decision.alias("decision"), F.col("n").cast("long").alias("n"))
