"""The whole validation of an event table: every broken rule of every record, and what they sum up to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

# What an event record holds, what must be filled, and what its values may be.
FIELDS = (
    "event_id", "event_date", "collected_at", "category", "title", "summary", "impact", "affected_area", "affected_period", "source_name", "source_type", "source_url", "status", "related_event_id", "analyst_note",
    "workspace_id", "source_id", "intake_id", "human_confirmed_at", "ai_assisted", "last_modified_at", "report_included", "recommended_action",
)
REQUIRED = ("event_id", "event_date", "collected_at", "category", "title", "summary", "impact", "source_name", "source_type", "source_url", "status")
SOURCE_TYPES = ("政府/监管机构", "港口/企业官网", "交易所/行业机构", "主流媒体", "行业自媒体", "其他")
STATUSES = ("新增", "持续", "更新", "解除", "已结束", "待核实")
RISK_CATEGORIES, RELIEF_TERMS = ("航行警告", "海上气象", "港口作业"), ("解除", "恢复", "取消预警", "恢复正常")


@dataclass(frozen=True)
class Vocabulary:
    """The values that the rules name."""

    source_types: tuple = SOURCE_TYPES
    statuses: tuple = STATUSES
    risk_categories: tuple = RISK_CATEGORIES
    relief_terms: tuple = RELIEF_TERMS
    relief_status: str = "解除"
    unverified: str = "待核实"


def _cells(events: DataFrame) -> DataFrame:
    """(row, then FIELDS as stripped text); fields that are missing are empty."""
    has = set(events.columns)
    return events.select(F.col("row").cast("long").alias("row"), *[(T.strip(F.col(c).cast("string")) if c in has else F.lit("")).alias(c) for c in FIELDS])


def strict_date(c: Column) -> Column:
    """yyyy-MM-dd and nothing else, a day of the calendar; else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def issues(events: DataFrame, today: str, vocabulary: Vocabulary = Vocabulary(), known: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """(row, event_id, severity, code, field) for each broken rule.

    events: (row, then any of FIELDS): row is the record's number, from 1, and says which record comes first. A field that no record has is one issue of row 0 (an error where it is required).
    known: (event_id), ids outside the table that relations may name; similar: (a, b), rows b whose title is like that of an earlier row a, as near titles give them. Nulls count as
    empty. Errors: required_missing, duplicate_event_id, invalid_event_date, duplicate_title, invalid_source_type, invalid_status, invalid_source_url, relief_missing_relation, self_relation,
    unknown_relation; warnings: future_event_date, abnormal_event_date, invalid_collected_at, similar_title, short_summary, short_impact; suggestions: affected_area_missing,
    affected_period_missing, verification_note_missing. An empty table has none.
    """
    d, v = _cells(events), vocabulary
    c = F.col
    filled = lambda n: c(n) != ""
    day, date = strict_date(c("event_date")), F.lit(today).cast("date")
    stamp = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    stamped = c("collected_at").rlike(stamp) & F.try_to_date(F.substr("collected_at", F.lit(1), F.lit(10)), "yyyy-MM-dd").isNotNull()
    relief = (c("status") == v.relief_status) | V.any_of(F.concat_ws(" ", "title", "summary"), v.relief_terms)
    short = lambda n: filled(n) & (F.length(T.compact(c(n))) < 10)
    risky = c("category").isin(*v.risk_categories)
    rule = lambda bad, severity, code, field: F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(field).alias("field")))
    checks = [
        *[rule(c(f) == "", "error", "required_missing", f) for f in REQUIRED],
        rule(filled("event_date") & day.isNull(), "error", "invalid_event_date", "event_date"), rule(day > date, "warning", "future_event_date", "event_date"), rule(day < F.lit("2000-01-01").cast("date"), "warning", "abnormal_event_date", "event_date"),
        rule(filled("collected_at") & ~F.coalesce(stamped, F.lit(False)), "warning", "invalid_collected_at", "collected_at"),
        rule(filled("source_type") & ~c("source_type").isin(*v.source_types), "error", "invalid_source_type", "source_type"), rule(filled("status") & ~c("status").isin(*v.statuses), "error", "invalid_status", "status"),
        rule(filled("source_url") & ~V.valid_source_url(c("source_url")), "error", "invalid_source_url", "source_url"), rule(relief & ~filled("related_event_id"), "error", "relief_missing_relation", "related_event_id"),
        rule(filled("related_event_id") & (c("related_event_id") == c("event_id")), "error", "self_relation", "related_event_id"), rule(short("summary"), "warning", "short_summary", "summary"), rule(short("impact"), "warning", "short_impact", "impact"),
        rule(risky & ~filled("affected_area"), "suggestion", "affected_area_missing", "affected_area"), rule(risky & ~filled("affected_period"), "suggestion", "affected_period_missing", "affected_period"),
        rule((c("status") == v.unverified) & ~filled("analyst_note"), "suggestion", "verification_note_missing", "analyst_note"),
    ]
    named = lambda df, severity, code, field: df.select("row", "event_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(field).alias("field"))
    found = d.select("row", "event_id", F.explode(F.array_compact(F.array(*checks))).alias("x")).select("row", "event_id", "x.*")

    def repeated(key: Column, code: str, field: str) -> DataFrame:
        keyed = d.select("row", "event_id", key.alias("k")).where("k <> ''")
        first = keyed.groupBy("k").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
        return named(keyed.join(first, "k").where(c("row") > c("first")), "error", code, field)

    ids = d.where("event_id <> ''").select(c("event_id").alias("related_event_id"))
    if known is not None:
        ids = ids.union(known.select(T.strip(c("event_id").cast("string"))))
    unknown = d.where("related_event_id <> '' AND related_event_id <> event_id").join(ids.distinct(), "related_event_id", "left_anti")
    absent = [f for f in FIELDS if f not in events.columns]
    schema = d.limit(1).select(F.lit(0).cast("long").alias("row"), F.lit("").alias("event_id"), F.explode(F.array(*[F.struct(F.lit("error" if f in REQUIRED else "suggestion").alias("severity"), F.lit("schema_field_missing").alias("code"), F.lit(f).alias("field")) for f in absent or ("",)])).alias("x")).select("row", "event_id", "x.*")
    parts = [repeated(c("event_id"), "duplicate_event_id", "event_id"), repeated(T.title_key(c("title")), "duplicate_title", "title"), named(unknown, "error", "unknown_relation", "related_event_id")]
    if absent:
        parts.append(schema)
    if similar is not None:
        parts.append(named(d.join(similar.select(c("b").alias("row")).distinct(), "row", "left_semi"), "warning", "similar_title", "title"))
    for p in parts:
        found = found.unionByName(p)
    return found


def summary(events: DataFrame, found: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """One row: total_records, completeness_rate (percent of the required cells that are filled, to one place; 100 without records), duplicate_record_count, missing_source_count,
    pending_verification_count, and the errors, warnings and suggestions of issues()."""
    d = _cells(events)
    cells = sum((F.when(F.col(f) != "", 1).otherwise(0) for f in REQUIRED), F.lit(0))
    share = F.sum(cells) / (F.count("*") * len(REQUIRED)) * 100
    sums = d.agg(
        F.count("*").alias("total_records"), F.coalesce(F.bround(share, 1), F.lit(100.0)).alias("completeness_rate"), F.count_if((F.col("source_name") == "") | (F.col("source_url") == "")).alias("missing_source_count"), F.count_if(F.col("status") == vocabulary.unverified).alias("pending_verification_count"),
    )
    twice = found.where(F.col("code").isin("duplicate_event_id", "duplicate_title", "similar_title"))
    counts = found.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "suggestion")])
    return sums.crossJoin(twice.agg(F.countDistinct("row").alias("duplicate_record_count"))).crossJoin(counts)  # one row each
