"""Every rule of the validation, alone."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.rules import LATIN, Rules, ValueLexicon
from lodestone.operators import events as E
from lodestone.operators import validation as V

GOOD = dict.fromkeys(V.FIELDS, "") | {
    "event_id": "E1", "event_date": "2026-01-05", "collected_at": "2026-01-06T10:00:00+08:00", "category": "企业动态", "title": "港口新航线开通公告", "summary": "某港口今日开通新的集装箱航线服务。", "impact": "预计对周边货主的运输安排有利。",
    "source_name": "某港", "source_type": "主流媒体", "source_url": "https://a.org/1", "status": "新增",
}


def found(spark, *records, **options):
    rows = [(i, *({**GOOD, "event_id": f"E{i}", "title": f"标题编号{i}", **r}).values()) for i, r in enumerate(records, 1)]
    table = spark.createDataFrame(rows, "row long, " + ", ".join(f"{f} string" for f in V.FIELDS))
    return [(r.row, r.severity, r.code, r.field) for r in V.issues(table, "2026-06-01", **options).collect()]


@pytest.mark.parametrize("change, severity, code, field", [
    *[({f: " \n"}, "error", "required_missing", f) for f in V.REQUIRED],
    ({"event_date": "2026-1-5"}, "error", "invalid_event_date", "event_date"), ({"event_date": "2026-02-30"}, "error", "invalid_event_date", "event_date"), ({"event_date": "2026-06-02"}, "warning", "future_event_date", "event_date"), ({"event_date": "1999-12-31"}, "warning", "abnormal_event_date", "event_date"),
    ({"collected_at": "yesterday"}, "warning", "invalid_collected_at", "collected_at"), ({"collected_at": "2026-13-01"}, "warning", "invalid_collected_at", "collected_at"), ({"source_type": "x"}, "error", "invalid_source_type", "source_type"), ({"status": "x"}, "error", "invalid_status", "status"),
    ({"source_url": "ftp://a.org"}, "error", "invalid_source_url", "source_url"), ({"source_url": "https://a b"}, "error", "invalid_source_url", "source_url"), ({"status": "解除"}, "error", "relief_missing_relation", "related_event_id"), ({"title": "航道恢复通行公告"}, "error", "relief_missing_relation", "related_event_id"),
    ({"related_event_id": "E1"}, "error", "self_relation", "related_event_id"), ({"related_event_id": "E9"}, "error", "unknown_relation", "related_event_id"), ({"summary": "太短了"}, "warning", "short_summary", "summary"), ({"impact": "太 短 了"}, "warning", "short_impact", "impact"),
    ({"category": "海上气象", "affected_period": "x"}, "suggestion", "affected_area_missing", "affected_area"), ({"category": "海上气象", "affected_area": "x"}, "suggestion", "affected_period_missing", "affected_period"), ({"status": "待核实"}, "suggestion", "verification_note_missing", "analyst_note"),
])
def test_each_rule_alone(spark, change, severity, code, field):
    assert found(spark, change) == [(1, severity, code, field)]


def test_rules_between_records(spark):
    assert found(spark, {}, {"event_id": "E1"}, {"title": "标题 编号1!"}) == [(2, "error", "duplicate_event_id", "event_id"), (3, "error", "duplicate_title", "title")]
    assert found(spark, {"related_event_id": "E2"}, {"related_event_id": "old"}, known=spark.createDataFrame([(" old ",)], "event_id string")) == []
    assert found(spark, {}, {}, similar=spark.createDataFrame([(1, 2), (1, 2)], "a long, b long")) == [(2, "warning", "similar_title", "title")]


def test_missing_fields_and_summary(spark):
    table = spark.createDataFrame([(1, "E1", "待核实"), (2, None, "新增")], "row long, event_id string, status string")
    got = V.issues(table, "2026-06-01")
    schema = got.where("code = 'schema_field_missing'")
    assert schema.count() == len(V.FIELDS) - 2 and schema.where("severity = 'error'").count() == len(V.REQUIRED) - 2
    report = V.summary(table, got).first()
    assert (report.total_records, report.completeness_rate, report.missing_source_count, report.pending_verification_count, report.duplicate_record_count) == (2, 13.6, 2, 1, 0)
    empty = table.where(F.lit(False))
    assert V.issues(empty, "2026-06-01").collect() == [] and V.summary(empty, V.issues(empty, "2026-06-01")).first().completeness_rate == 100.0


def test_a_term_inside_another_word_is_no_impact(spark):
    rows = spark.createDataFrame([(1, "公司防范重大风险", "", "其他"), (2, "明日有大风", "", "其他")], "event_id long, title string, summary string, category string").withColumn("impact", F.lit(""))
    got = {r.event_id: (r.x.value, r.x.hits) for r in rows.select("event_id", E.business_value(ValueLexicon()).alias("x")).collect()}
    assert got == {1: ("无关", ""), 2: ("高", "大风")}


@pytest.mark.parametrize("rules, status", [(Rules(), "解除"), (LATIN, "resolved")])
def test_resolved_drafts_need_a_relation_in_any_vocabulary(spark, rules, status):
    rows = spark.createDataFrame([(1, "t", "x" * 50, "i", status, "2026-01-01", None)], "event_id long, title string, summary string, impact string, status string, event_date string, related_event_id long")
    assert [r.code for r in E.validate(rows, rules).collect()] == ["relief_missing_relation"]
