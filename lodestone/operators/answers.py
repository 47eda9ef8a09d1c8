"""From a question to what may answer it: intents with their filters, hits in sections by place, citations with a quote."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import any_of
from .labels import sentence_excerpt

# What a question asks for, in order; the filters that follow; places in order, with their levels; noise; who is an independent human.
INTENTS = {
    "resolved_risk": ("已解除", "已经解除", "解除风险", "已经结束", "恢复正常"), "past_risk": ("历史风险", "历史上", "曾经", "过去风险"), "comparison": ("对比", "相比", "变化", "上周", "上一期"), "tender": ("招标", "采购", "中标", "供应商"), "opportunity": ("机会", "商机", "便利", "新航线", "数字化项目"),
    "source_check": ("出处", "来源", "原文", "核验"), "trend": ("长期", "趋势", "行业变化"), "operations": ("运营", "作业", "靠泊", "港口动态", "航线"), "current_risk": ("风险", "预警", "限航", "停航", "天气影响"),
}
VALUED = ("高", "中")
FILTERS = {
    "current_risk": {"statuses": ("新增", "持续", "更新", "待核实"), "risk_levels": VALUED, "business_value": VALUED}, "resolved_risk": {"statuses": ("解除", "已结束")}, "past_risk": {"risk_levels": VALUED, "business_value": VALUED}, "tender": {"categories": ("招标采购",)},
    "opportunity": {"opportunity_levels": VALUED, "business_value": VALUED}, "operations": {"categories": ("港口作业", "航线运价", "企业动态"), "business_value": VALUED}, "trend": {"business_value": VALUED}, "source_check": {"business_value": VALUED}, "comparison": {"business_value": VALUED},
}
PLACES = {"1": ("青岛港", "青岛辖区", "青岛海事局", "胶州湾", "青岛湾", "前湾港", "董家口"), "2": ("黄海", "黄海北部", "黄海中部", "黄海中南部"), "4": ("威海", "日照", "烟台", "潍坊", "东营", "滨州"), "3": ("山东",)}
FOCUS, NOISE = ("青岛",), ("党建", "党日", "荣誉", "获奖", "表彰", "培训", "青年活动", "参观", "慰问", "庆祝", "运动会")
HUMANS = ("human_user", "industry_reviewer")
_KINDS = ("statuses", "risk_levels", "business_value", "categories", "opportunity_levels")


@dataclass(frozen=True)
class Routing:
    """What routing looks up."""

    intents: dict = field(default_factory=lambda: INTENTS)
    filters: dict = field(default_factory=lambda: FILTERS)
    places: dict = field(default_factory=lambda: PLACES)
    focus: tuple = FOCUS
    noise: tuple = NOISE
    resolved: tuple = ("解除", "已结束")
    default: str = "operations"
    current: str = "current_risk"


def routes(questions: DataFrame, routing: Routing = Routing()) -> DataFrame:
    """(query_id, intent, focus, exclude_resolved, and a list or null for each kind of filter) of questions (query_id, text): the first intent, in order, of which a term stands in the text, else the default."""
    text = F.coalesce("text", F.lit(""))
    intent = F.lit(routing.default)
    for name, terms in reversed(routing.intents.items()):
        intent = F.when(any_of(text, terms), name).otherwise(intent)
    rows = questions.select("query_id", intent.alias("intent"), any_of(text, routing.focus).alias("focus"))

    def listed(kind: str) -> Column:
        out = F.lit(None).cast("array<string>")
        for name, held in routing.filters.items():
            if kind in held:
                out = F.when(F.col("intent") == name, F.array(*map(F.lit, held[kind]))).otherwise(out)
        return out.alias(kind)

    return rows.select("*", (F.col("intent") == routing.current).alias("exclude_resolved"), *[listed(k) for k in _KINDS])


def admitted(events: DataFrame, routed: DataFrame) -> DataFrame:
    """(query_id, event_id) of the events (event_id, status, risk_level, business_value, category, opportunity_level) that each route's filters take; a filter that is null takes all. Routes are a stated set; alike ones are compared once.
    An event that a resolving one names, where events have resolved_by_relation, isn't taken by a route that excludes those."""
    columns = dict(zip(_KINDS, ("status", "risk_level", "business_value", "category", "opportunity_level"), strict=True))
    kinds = routed.select("intent", F.col("exclude_resolved").alias("f_exclude"), *[F.col(k).alias(f"f_{k}") for k in _KINDS]).distinct()  # one for each intent
    fits = F.lit(True)
    for kind, column in columns.items():
        fits = fits & (F.col(f"f_{kind}").isNull() | F.coalesce(F.array_contains(F.col(f"f_{kind}"), F.col(column)), F.lit(False)))
    if "resolved_by_relation" in events.columns:
        fits = fits & ~(F.col("f_exclude") & F.coalesce(F.col("resolved_by_relation"), F.lit(False)))
    taken = events.join(F.broadcast(kinds), fits).select("intent", "event_id")  # as many rows as there are intents at most
    return routed.select("query_id", "intent").join(taken, "intent").select("query_id", "event_id")


def routed_hits(hits: DataFrame, routed: DataFrame, routing: Routing = Routing()) -> DataFrame:
    """(query_id, rank, doc_id, level, section, score) of hits (query_id, doc_id, title, text, area, category, status, score, published_at) in the order of an answer.

    level: of the first kind of place that is named, 5 without one. Current risks lose resolved hits and those about activities; a question with the focus loses level 4, and has levels 1 and 2 in the main section, the others in the
    background; without it all are main. Main first, then by level, score, date, the latest first, then doc_id.
    """
    said = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "text", "area", "category")])
    rows = hits.join(routed.select("query_id", "intent", "focus"), "query_id").withColumn("said", said)
    level = F.lit(5)
    for number, terms in reversed(routing.places.items()):
        level = F.when(any_of(F.col("said"), terms), int(number)).otherwise(level)
    now = F.col("intent") == routing.current
    gone = F.coalesce(F.col("status").isin(*routing.resolved), F.lit(False)) | any_of(F.col("said"), routing.noise)
    rows = rows.withColumn("level", level).where(~(now & gone) & ~(F.col("focus") & (F.col("level") == 4)))
    main = ~F.col("focus") | F.col("level").isin(1, 2)
    order = Window.partitionBy("query_id").orderBy(F.desc("main"), "level", F.desc_nulls_last("score"), F.desc_nulls_last("published_at"), "doc_id")
    return rows.withColumn("main", main).withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "doc_id", "level", F.when(F.col("main"), "main").otherwise("background").alias("section"), "score")


def citations(hits: DataFrame, documents: DataFrame, events: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, doc_id, title, event_id, quote, evidence_verified, review) of the distinct documents of hits (query_id, doc_id, rank, text): a row where the document is current and active.

    documents: (doc_id, title, publisher, published_at, document_version, content_hash, is_current, record_state); events: (event_id, doc_id, record_state, human_verified, evidence_verified, reviewer_type), of which the active one with most
    flags is cited, the smallest id of ties; evidence: (doc_id, document_version, content_hash, start_offset, quote, verified): the first verified quote of this version, else whole sentences of the text of its best rank. A document without a title is named by publisher and day.
    review: verified where an independent human set the flag, else pending.
    """
    docs = documents.where("is_current AND record_state = 'active'")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    order = F.struct((~flag("human_verified")).alias("a"), (~flag("evidence_verified")).alias("b"), "event_id")
    human = flag("human_verified") & F.coalesce(F.col("reviewer_type").isin(*HUMANS), F.lit(False))
    cited = events.where("record_state = 'active'").groupBy("doc_id").agg(F.min_by("event_id", order).alias("event_id"), F.min_by(human, order).alias("human"))
    quotes = evidence.where("verified").join(docs.select("doc_id", "document_version", "content_hash"), ["doc_id", "document_version", "content_hash"]).groupBy("doc_id").agg(F.min(F.struct("start_offset", "quote")).alias("q")).select("doc_id", F.col("q.quote").alias("bound"))
    first = hits.groupBy("query_id", "doc_id").agg(F.min_by("text", "rank").alias("text"))
    rows = first.join(docs, "doc_id").join(cited, "doc_id", "left").join(quotes, "doc_id", "left")
    title = F.coalesce(F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit("")), F.concat_ws(" ", F.coalesce(F.nullif("publisher", F.lit("")), F.lit("public source")), F.substr(F.col("published_at").cast("string"), F.lit(1), F.lit(10))))
    return rows.select("query_id", "doc_id", title.alias("title"), "event_id", F.coalesce("bound", sentence_excerpt(F.col("text"))).alias("quote"), F.col("bound").isNotNull().alias("evidence_verified"), F.when(flag("human"), "verified").otherwise("pending").alias("review"))
