"""Each reason of each gate alone."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import gates as G

EVENT = {"event_id": "e", "document_id": "d", "title": "港口通知", "summary": "", "impact": None, "affected_area": "", "category": "", "source_name": "s", "reviewer_type": "human_user", "reviewer_name": "Li", "human_verified": True, "review_state": "accepted", "requires_second_review": False, "record_state": "active", "duplicate_level": ""}
DOCUMENT = {"document_id": "d", "source_id": "s", "record_state": "active", "quality_ok": True, "url": "https://a.org", "document_version": 2, "content_hash": "h"}
SOURCE = {"source_id": "s", "commercial_reuse_status": "允许", "terms_status": "允许", "customer_summary_allowed": True, "short_quote_allowed": True, "internal_analysis_allowed": True}
PROOF = {"event_id": "e", "verified": True, "document_version": 2, "content_hash": "h"}


def frame(spark, *rows):
    kind = lambda k: "boolean" if isinstance(rows[0][k], bool) else "int" if isinstance(rows[0][k], int) else "string"
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {kind(k)}" for k in rows[0]))


def gate(spark, mode=G.INTERNAL, event={}, document={}, source={}, proofs=({},)):  # noqa: B006
    evidence = frame(spark, *[PROOF | p for p in proofs]) if proofs else frame(spark, PROOF).limit(0)
    return G.promotion_gate(frame(spark, EVENT).select(*[F.lit(event[c]).cast(t).alias(c) if c in event else F.col(c) for c, t in frame(spark, EVENT).dtypes]), *[frame(spark, base).select(*[F.lit(change[c]).cast(t).alias(c) if c in change else F.col(c) for c, t in frame(spark, base).dtypes]) for base, change in ((DOCUMENT, document), (SOURCE, source))], evidence, mode).first()


@pytest.mark.parametrize("change, reasons", [
    ({}, ""), ({"event": {"reviewer_type": "ai"}}, "reviewer_not_human"), ({"event": {"human_verified": None}}, "no_traceable_review"), ({"event": {"reviewer_name": " "}}, "no_traceable_review"), ({"event": {"review_state": "pending"}}, "review_not_accepted"),
    ({"event": {"requires_second_review": True}}, "second_review_open"), ({"event": {"record_state": "quarantined"}}, "event_not_active"), ({"event": {"record_state": None}}, ""), ({"document": {"record_state": "quarantined"}}, "document_quarantined"), ({"document": {"quality_ok": False}}, "document_quality"),
    ({"document": {"url": None}}, "url_incomplete"), ({"event": {"source_name": ""}}, "source_name_missing"), ({"event": {"duplicate_level": "high"}}, "likely_duplicate"), ({"proofs": ()}, "evidence_not_located"), ({"proofs": ({}, {"verified": False})}, "evidence_not_located"),
    ({"proofs": ({"document_version": 1},)}, "evidence_not_located"), ({"document": {"content_hash": "x"}}, "evidence_not_located"), ({"source": {"terms_status": "禁止"}}, "terms_forbid"), ({"source": {"internal_analysis_allowed": False}}, "internal_use_not_allowed"), ({"source": {"internal_analysis_allowed": None}}, ""),
    ({"mode": G.CUSTOMER, "source": {"short_quote_allowed": False}}, "customer_use_not_allowed"), ({"event": {"document_id": "gone"}}, "document_or_source_missing"), ({"document": {"source_id": "gone"}}, "document_or_source_missing"),
    ({"event": {"reviewer_type": None, "review_state": None}, "document": {"url": "x"}}, "reviewer_not_human,review_not_accepted,url_incomplete"),
])
def test_promotion_reasons(spark, change, reasons):
    got = gate(spark, **change)
    assert got.reasons == reasons and got.relevance == "possible"


def test_relevance_and_customer_reasons(spark):
    got = gate(spark, event={"title": "青岛港口"}, source={"short_quote_allowed": False})
    assert (got.reasons, got.customer_reasons, got.relevance) == ("", "customer_use_not_allowed", "direct") and gate(spark, event={"title": "x"}).relevance == "none"


def test_source_checks(spark):
    base = {"source_id": "s", "enabled": True, "crawl_allowed": True, "domain": "a.org", "list_page_url": "https://a.org", "robots_status": "allowed", "commercial_reuse_status": "允许", "terms_status": "允许", "customer_summary_allowed": True, "short_quote_allowed": True, "fulltext_redistribution_allowed": False, "raw_data_resale_allowed": False}
    rows = [base, base | {"source_id": "a", "domain": None}, base | {"source_id": "b", "robots_status": "unknown", "enabled": False}, base | {"source_id": "c", "terms_status": "禁止"}, base | {"source_id": "d", "commercial_reuse_status": None}, base | {"source_id": "e", "commercial_reuse_status": "禁止", "short_quote_allowed": False}, base | {"source_id": "f", "commercial_reuse_status": "禁止", "short_quote_allowed": False, "raw_data_resale_allowed": True}]
    table = frame(spark, *rows)
    assert {tuple(r) for r in G.source_problems(table).collect()} == {("a", "crawl_gate", "fail"), ("c", "report_gate", "fail"), ("d", "permission_risk", "warn"), ("f", "report_gate", "fail")}
    assert {tuple(r) for r in G.source_checks(table).collect()} == {("crawl_gate", "fail", 1), ("report_gate", "fail", 2), ("permission_risk", "warn", 1)}
    assert {tuple(r) for r in G.source_checks(table.where("false")).collect()} == {("crawl_gate", "warn", 0), ("report_gate", "pass", 0), ("permission_risk", "pass", 0)}


def test_report_decisions(spark):
    make = spark.createDataFrame
    reports = make([(1, "customer", True, False), (2, "customer", True, False), (3, "internal", True, False), (4, "internal", None, False), (5, "internal", False, True), (6, "customer", False, True), (7, "standard", True, False), (8, "customer", True, False)], "report_id int, mode string, require_value boolean, allow_empty boolean")
    selected = make([(1, 1, "高", True), (2, 1, "低", True), (2, 2, None, True), (3, 1, "中", False), (8, 1, "高", True), (8, 2, "高", False)], "report_id int, event_id int, business_value string, core boolean")
    got = {r.report_id: (r.decision, r.n) for r in G.report_decisions(reports, selected, make([(1, 2), (3, 1)], "report_id int, n int")).collect()}
    assert got == {1: ("preflight", 1), 2: ("no_business_value", 2), 3: ("no_core_event", 1), 4: ("no_events", 0), 5: ("made", 0), 6: ("no_events", 0), 7: ("made", 0), 8: ("made", 2)}
