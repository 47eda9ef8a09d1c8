import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.rules import Rules
from lodestone.operators import documents as D
from lodestone.operators import events as E

DAY = datetime.date(2026, 1, 2)
SCHEMA = "event_id long, title string, summary string, impact string, category string, status string, source string, source_type string, event_date date, related_event_id long"


def scored(spark, *rows):
    return E.score(spark.createDataFrame([(i, t, s, "", c, st, "", src, DAY, rel) for i, t, s, c, st, src, rel in rows], SCHEMA), Rules())


def test_scores_follow_the_rule_tables(spark):
    rows = {r.event_id: r for r in scored(spark, (1, "台风停航", "封港", "航行警告", "新增", "政府/监管机构", None), (2, "台风解除", "", "航行警告", "解除", "政府/监管机构", 1), (3, "重大风险", "", "企业动态", "新增", "其他", None)).collect()}
    assert rows[1].risk_score == 100 and rows[1].risk_level == "高" and rows[1].risk_terms == "停航、封港、台风"
    assert rows[2].historical_risk_score == 77 and rows[2].risk_score == 49 and rows[2].priority_score == 0
    assert rows[3].risk_score == 10 and rows[3].confidence == 40 and rows[3].priority_score == 4  # 重大风险 is no 大风


def test_resolved_events_supersede(spark):
    s = scored(spark, (1, "台风停航", "封港", "航行警告", "新增", "政府/监管机构", None), (2, "恢复", "", "航行警告", "解除", "政府/监管机构", 1), (3, "封港", "停航", "航行警告", "持续", "政府/监管机构", None))
    assert [r.event_id for r in E.current_risks(s, Rules()).collect()] == [3]
    assert [r.event_id for r in E.resolved_risks(s, Rules()).collect()] == [2]


def test_between_needs_an_order(spark):
    s = scored(spark, (1, "a", "", "企业动态", "新增", "其他", None))
    assert E.between(s, "2026-01-01", "2026-01-02").count() == 1
    with pytest.raises(ValueError):
        E.between(s, "2026-02-01", "2026-01-01")


def test_text_functions(spark):
    r = spark.range(1).select(
        T.normalize_url(F.lit("HTTP://A.com:80//x//y?q=1#z")).alias("url"), T.date_in(F.lit("发布于2024年5月6日")).alias("day"), T.date_in(F.lit("2024-13-40")).alias("none"),
        T.clamp(F.lit(2.5)).alias("half"), T.occurrences(F.lit("aaaa"), "aa").alias("n"), T.title_key(F.lit("港口 A-b_c!")).alias("key"), T.search_terms(F.lit("港口大雾 ab")).alias("terms"),
    ).first()
    assert r.url == "http://a.com/x/y?q=1" and r.day == datetime.date(2024, 5, 6) and r.none is None
    assert (r.half, r.n, r.key) == (2, 2, "港口abc") and r.terms == ["港口大雾", "港口", "口大", "大雾", "ab"]


def test_chunks_hold_every_sentence(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    parts = [r.chunk_text for r in D.chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), 200, 60).orderBy("chunk_index").collect()]
    assert all(any(f"number {i} is" in p for p in parts) for i in range(60)) and max(map(len, parts)) <= 200
    assert all(p in text for p in parts)


def test_versions_and_duplicates(spark):
    df = spark.createDataFrame([(1, "http://a/x", "h1"), (2, "HTTP://A/x#f", "h1"), (3, "http://a/x", "h2")], "page_id long, url string, content_hash string")
    assert [(r.disposition, r.document_version, r.is_current) for r in D.versions(df, "url", "page_id").orderBy("page_id").collect()] == [("new", 1, False), ("duplicate_content", 1, False), ("updated", 2, True)]
