"""Routing by the fixed vocabulary, hits in sections, citations."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers as A


@pytest.mark.parametrize("question, intent, focus", [
    ("青岛港当前有哪些风险", "current_risk", True), ("历史上的风险", "past_risk", False), ("已解除的预警", "resolved_risk", False), ("本期与上周对比", "comparison", False), ("最近的招标机会", "tender", False), ("有哪些商机", "opportunity", False),
    ("原文出处在哪", "source_check", False), ("行业长期趋势", "trend", False), ("码头作业情况", "operations", False), ("你好", "operations", False), (None, "operations", False),
])
def test_intents_in_order(spark, question, intent, focus):
    got = A.routes(spark.createDataFrame([(1, question)], "query_id long, text string")).first()
    want = A.FILTERS[intent]
    assert (got.intent, got.focus, got.exclude_resolved) == (intent, focus, intent == "current_risk")
    assert {k: tuple(got[k]) for k in A._KINDS if got[k] is not None} == want


def test_admitted_events(spark):
    routed = A.routes(spark.createDataFrame([(1, "当前风险"), (2, "已解除"), (3, "当前风险")], "query_id long, text string"))
    events = spark.createDataFrame([(1, "新增", "高", "高", "x", "低", None), (2, "解除", "高", "高", "x", "低", False), (3, "新增", "低", "高", "x", "低", False), (4, "新增", "高", "中", "x", "低", True), (5, "新增", "高", None, "x", "低", False)], "event_id long, status string, risk_level string, business_value string, category string, opportunity_level string, resolved_by_relation boolean")
    assert {tuple(r) for r in A.admitted(events, routed).collect()} == {(1, 1), (3, 1), (2, 2)}
    assert {tuple(r) for r in A.admitted(events.drop("resolved_by_relation"), routed).collect()} == {(1, 1), (3, 1), (2, 2), (1, 4), (3, 4)}


def test_hits_in_sections(spark):
    routed = A.routes(spark.createDataFrame([(1, "青岛当前风险"), (2, "行业趋势")], "query_id long, text string"))
    rows = [(q, d, t, "", None, "", s, x, day) for q in (1, 2) for d, t, s, x, day in [(1, "胶州湾大雾", "新增", 0.1, "2026-01-01"), (2, "黄海大风", "新增", 0.2, None), (3, "威海限航", "新增", 0.9, "2026-01-01"), (4, "山东全省", "新增", 0.5, "2026-01-01"), (5, "其他", "新增", 0.5, "2026-01-02"), (6, "青岛港解除", "解除", 0.9, None), (7, "青岛港党建参观", None, 0.9, None), (8, "其他", None, 0.5, "2026-01-02")]]
    hits = spark.createDataFrame(rows, "query_id long, doc_id long, title string, text string, area string, category string, status string, score double, published_at string")
    got = {}
    for r in A.routed_hits(hits, routed).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.level, r.section))
    assert got[1] == [(1, 1, "main"), (2, 2, "main"), (4, 3, "background"), (5, 5, "background"), (8, 5, "background")]
    assert [x[0] for x in got[2]] == [6, 7, 1, 2, 4, 3, 5, 8] and {x[2] for x in got[2]} == {"main"}


def test_citations(spark):
    hits = spark.createDataFrame([(1, 1, 2, "第二。"), (1, 1, 1, "第一句话。第二句话。"), (1, 2, 3, "x"), (1, 3, 4, "y"), (1, 4, 5, "z"), (2, 9, 1, "gone")], "query_id long, doc_id long, rank int, text string")
    docs = spark.createDataFrame([(1, "t", "p", "2026-01-05", 2, "h", True, "active"), (2, " ", None, "2026-01-05T10:00", 1, "h", True, "active"), (3, "t", "p", "", 1, "h", False, "active"), (4, None, "机构", None, 1, "h", True, "active")], "doc_id long, title string, publisher string, published_at string, document_version int, content_hash string, is_current boolean, record_state string")
    events = spark.createDataFrame([("e1", 1, "active", False, True, "human_user"), ("e2", 1, "active", True, False, "human_user"), ("e0", 1, "quarantined", True, True, "human_user"), ("e3", 2, "active", True, True, "ai")], "event_id string, doc_id long, record_state string, human_verified boolean, evidence_verified boolean, reviewer_type string")
    evidence = spark.createDataFrame([(1, 2, "h", 5, "later", True), (1, 2, "h", 1, "quote", True), (1, 1, "h", 0, "old version", True), (1, 2, "h", 0, "unverified", False), (4, 1, "x", 0, "other content", True)], "doc_id long, document_version int, content_hash string, start_offset int, quote string, verified boolean")
    got = {(r.query_id, r.doc_id): tuple(r)[2:] for r in A.citations(hits, docs, events, evidence).collect()}
    assert got == {(1, 1): ("t", "e2", "quote", True, "verified"), (1, 2): ("public source 2026-01-05", "e3", "x", False, "pending"), (1, 4): ("机构", None, "z", False, "pending")}
    assert A.citations(hits, docs, events, evidence.where(F.lit(False))).where("doc_id = 1").first().quote == "第一句话。第二句话。"
    assert A.citations(hits.where("false"), docs, events, evidence).collect() == []
