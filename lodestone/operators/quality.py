"""The whole quality gate of a document, its fact slots, and the re-evaluation of near-template documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

# Menu terms, titles that say nothing, and the slots of a warning with the terms that it must hold.
NAVIGATION = ("首页", "网站首页", "新闻资讯", "集团概况", "业务服务", "信息公开", "联系我们", "网站地图", "返回顶部", "友情链接", "相关链接", "上一篇", "下一篇")
HOME_TITLES, SITE_WORD = ("首页", "网站首页"), "官网"
FACT_NEEDS, FACT_ONE_OF = "预警", ("海上风险", "海上大雾", "海上大风", "海浪")
FACTS = {
    "issue_number": r"第\s*(\d+)\s*期",
    "published_time": r"(20\d{2}年\d{1,2}月\d{1,2}日(?:\d{1,2}时(?:\d{1,2}分)?)?)",
    "risk_level": r"(红色|橙色|黄色|蓝色)预警",
    "area": r"(渤海海峡|渤海|黄海北部|黄海中部|黄海南部|山东半岛|山东沿海|我省各预报海区)",
    "weather_metric": r"(能见度(?:低于|不足)?\s*\d+\s*米|\d+\s*(?:到|～|-)\s*\d+\s*级风|阵风\s*\d+\s*(?:到|～|-)\s*\d+\s*级|浪高\s*\d+(?:\.\d+)?\s*米)",
    "valid_time": r"(?:预计[，,：:\s]*)([^。；\n]{2,60}(?:日|时|夜间|白天|前半夜))",
    "lifecycle": r"(解除|继续发布|发布|延期|调整|更新)",
}
ATTACHMENT = r"(?i)\.(?:pdf|docx?|xlsx?|zip|rar)\b"


@dataclass(frozen=True)
class GateRules:
    """What the gate looks up; each pattern of facts has one group."""

    navigation: tuple = NAVIGATION
    home_titles: tuple = HOME_TITLES
    site_word: str = SITE_WORD
    facts: dict | None = None
    fact_needs: str = FACT_NEEDS
    fact_one_of: tuple = FACT_ONE_OF
    near: float = 0.88


#: For tables of invented Latin-script prose.
LATIN_GATE = GateRules(("cookie", "subscribe", "menu", "login", "share"), ("home",), "official", {"license": r"(?i)(apache|mit|copyright)", "mail": r"([\w.]+@[\w.]+)", "link": r"(https?://[^\s]+)", "number": r"(\d{3,})", "capital": r"\s([A-Z][a-z]{3,})[ .,]"}, "", ("",))


def structured_facts(title: Column, text: Column, rules: GateRules = GateRules()) -> Column:
    """A map of the slots that are filled: each slot's distinct values in order of the text, joined by 、 and cut at 300. Empty unless the terms that a notice must hold occur."""
    whole = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    values = lambda p: F.substr(F.array_join(F.array_distinct(F.regexp_extract_all(whole, F.lit(p), F.lit(1))), "、"), F.lit(1), F.lit(300))
    slots = F.map_from_arrays(F.array(*[F.lit(n) for n in (rules.facts or FACTS)]), F.array(*[values(p) for p in (rules.facts or FACTS).values()]))
    applies = F.contains(whole, F.lit(rules.fact_needs)) & V.any_of(whole, rules.fact_one_of)
    return F.when(applies, F.map_filter(slots, lambda _, v: v != "")).otherwise(F.create_map().cast("map<string,string>"))


def fact_line(facts: Column) -> Column:
    """The facts as one text, in the order of their names; '' without any."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(facts)), lambda e: F.concat(e.key, F.lit("="), e.value)), "\n")


def _title_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\-_|·—]+", ""))


def assess(documents: DataFrame, rules: GateRules = GateRules(), sites: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, status, processing_allowed, report_allowed, issues, and the metrics) of each document.

    documents: (doc_id, title, text, published_at) and, where known, template_similarity (to its nearest sibling), facts_differ
    (whether a sibling with facts has others) and html_paragraphs. Processing issues: encoding (which ends the check), thin body, attachments only, navigation, density,
    template; a near template passes with four facts, a body of 180 characters and three paragraphs where facts differ. Report issues: a
    title that says nothing, no date. Status: encoding_anomaly, ok, body_failed or report_failed. Nulls count as empty.
    """
    has = set(documents.columns)
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in has else F.lit(default)
    title, text = T.strip(F.col("title")), T.strip(F.col("text"))
    bare = lambda c: F.length(T.compact(c))
    d = documents.select(
        "doc_id", title.alias("title"), text.alias("text"), T.compact(F.col("text")).alias("body"), T.strip(F.col("published_at").cast("string")).alias("published_at"),
        given("template_similarity", 0.0).cast("double").alias("similarity"), given("facts_differ", True).alias("facts_differ"), given("html_paragraphs", 0).cast("int").alias("html_paragraphs"),
    )
    count = lambda sizes, least: F.size(F.filter(sizes, lambda n: n >= least))
    # a column that several others read is made in a step of its own, so that it is made once
    d = d.withColumns({"sentences": F.split(F.col("text"), r"[。！？!?；;]+"), "attachment_count": F.regexp_count("text", F.lit(ATTACHMENT))})
    d = d.withColumn("sizes", F.transform("sentences", bare))
    factual = F.size(F.filter(F.zip_with("sentences", "sizes", lambda u, n: F.when(n >= 18, u)), lambda u: u.isNotNull() & ~u.rlike(ATTACHMENT)))
    factual = F.when(F.col("attachment_count") >= 2, factual).otherwise(0)  # asked for only beside two attachments
    hits = [T.occurrences(F.col("text"), t) for t in rules.navigation]
    n = F.length("body")
    d = d.withColumns({
        "encoding": V.encoding_of(F.concat(T.compact(F.col("title")), F.col("body"))), "text_characters": n, "facts": structured_facts(F.col("title"), F.col("text"), rules),
        "effective_paragraphs": F.greatest(count(F.transform(F.split(F.col("text"), r"[\r\n]+"), bare), 12), count(F.col("sizes"), 12), F.col("html_paragraphs")),
        "factual": factual, "navigation_hits": sum(hits, F.lit(0)), "repeated": F.greatest(*hits, F.lit(0)) >= 3,
        "navigation_ratio": sum((h * len(t) for h, t in zip(hits, rules.navigation, strict=True)), F.lit(0)) / F.greatest(F.lit(1), n),
        "information_density": F.regexp_count("body", F.lit(r"[\x{4e00}-\x{9fff}A-Za-z0-9]")) / F.greatest(F.lit(1), n), "title_key": _title_key(F.col("title")),
    })
    generic = (F.col("title_key") == "") | F.col("title_key").isin(*[*rules.home_titles, *map(str.lower, sites)]) | (F.contains("title", F.lit(rules.site_word)) & (F.length("title_key") <= 18))
    dated = F.col("published_at").rlike(r"^20\d{2}-\d{2}-\d{2}")
    near = F.col("similarity") >= rules.near
    warning = near & (F.size("facts") >= 4) & F.col("facts_differ") & (F.col("text_characters") >= 180) & (F.col("effective_paragraphs") >= 3) & (F.col("navigation_ratio") < 0.06)
    issue = lambda bad, name: F.when(bad, F.lit(name))
    processing = F.array_compact(F.array(
        issue((F.col("text_characters") < 30) | ((F.col("effective_paragraphs") < 2) & (F.col("text_characters") < 70)), "thin_body"), issue((F.col("attachment_count") >= 2) & (F.col("factual") == 0), "attachments_only"),
        issue(((F.col("navigation_hits") >= 6) & (F.col("navigation_ratio") >= 0.06)) | F.col("repeated"), "navigation_noise"), issue((F.col("text_characters") >= 80) & (F.col("information_density") < 0.55), "low_density"), issue(near & ~warning, "near_template"),
    ))
    report = F.array_compact(F.array(issue(generic, "generic_title"), issue(~dated, "date_missing")))
    d = d.withColumns({"processing": processing, "report": report, "generic_title": generic.cast("int"), "date_present": dated.cast("int"), "template_similarity_warning": warning.cast("int")})
    broken, fails, holds = F.col("encoding.bad"), F.size("processing") > 0, F.size("report") > 0
    return d.select(
        "doc_id", F.when(broken, "encoding_anomaly").when(fails, "body_failed").when(holds, "report_failed").otherwise("ok").alias("status"), (~broken & ~fails).alias("processing_allowed"), (~broken & ~fails & ~holds).alias("report_allowed"),
        F.when(broken, "encoding_anomaly").otherwise(F.array_join(F.concat("processing", "report"), ",")).alias("issues"), "text_characters", "effective_paragraphs", "attachment_count", "navigation_hits", F.bround("navigation_ratio", 4).alias("navigation_ratio"),
        F.bround("information_density", 4).alias("information_density"), F.bround("similarity", 4).alias("template_similarity"), "template_similarity_warning", F.size("facts").alias("structured_fact_count"),
        F.array_join(F.sort_array(F.map_keys("facts")), "、").alias("structured_fact_fields"), "generic_title", "date_present",
    )


def issue_counts(found: DataFrame) -> DataFrame:
    """(issue, n) of what assess() found. Documents without issues leave after the count: a filter before it would be pushed below the columns of assess(), which would be made twice."""
    each = found.select(F.explode_outer(F.array_remove(F.split("issues", ","), "")).alias("issue"))
    return each.groupBy("issue").agg(F.count("*").alias("n")).where("issue IS NOT NULL")


def with_siblings(documents: DataFrame, similarity: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """documents (doc_id, source, title, text, ...) with template_similarity, from similarity (doc_id, similarity), and facts_differ: whether
    another document of the source has facts in its text, and others than this one's title and text; also where the source has no other text."""
    own = fact_line(structured_facts(F.col("title"), F.col("text"), rules))
    held = documents.withColumns({"__own": own, "__line": fact_line(structured_facts(F.lit(""), F.col("text"), rules)), "__source": F.coalesce("source", F.lit("")), "__filled": (T.strip(F.col("text")) != "").cast("int")})
    lines = held.where("__line <> ''").groupBy("__source", "__line").agg(F.count("*").alias("n"))
    kinds = lines.groupBy("__source").agg(F.count("*").alias("__kinds"))
    texts = held.groupBy("__source").agg(F.sum("__filled").alias("__texts"))
    same = lines.select("__source", F.col("__line"), F.col("n").alias("__with_line"))
    alike = lines.select("__source", F.col("__line").alias("__own"), F.col("n").alias("__with_own"))
    out = held.join(same, ["__source", "__line"], "left").join(alike, ["__source", "__own"], "left").join(kinds.join(texts, "__source", "right"), "__source", "left")
    alone = F.coalesce(F.col("__with_line") == 1, F.lit(False)).cast("int")
    shared = (F.coalesce("__with_own", F.lit(0)) - (F.col("__line") == F.col("__own")).cast("int") > 0).cast("int")
    differs = (F.col("__texts") - F.col("__filled") <= 0) | (F.coalesce("__kinds", F.lit(0)) - alone - shared > 0)
    near = similarity.select("doc_id", F.col("similarity").alias("template_similarity"))
    return out.withColumn("facts_differ", differs).drop(*[c for c in out.columns if c.startswith("__")]).join(near, "doc_id", "left")


def reevaluate(documents: DataFrame, similarity: DataFrame, rules: GateRules = GateRules(), sites: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, old_similarity, new_status, processing_allowed, issues, structured_fact_count, structured_fact_fields, template_similarity_warning) of the
    quarantined documents that were near templates when last seen, assessed again beside all documents of their source; nothing is changed.

    documents: (doc_id, source, title, text, published_at, record_state, old_similarity), the current ones; similarity: see with_siblings().
    """
    again = with_siblings(documents, similarity, rules).where((F.col("record_state") == "quarantined") & (F.col("old_similarity") >= rules.near))
    found = assess(again.drop("old_similarity", "record_state"), rules, sites)
    old = documents.select("doc_id", "old_similarity")
    return found.join(old, "doc_id").select("doc_id", "old_similarity", F.col("status").alias("new_status"), "processing_allowed", "issues", "structured_fact_count", "structured_fact_fields", "template_similarity_warning")


def reevaluated(found: DataFrame) -> DataFrame:
    """One row: evaluated, still_quarantined, eligible."""
    return found.agg(F.count("*").alias("evaluated"), F.count_if(~F.col("processing_allowed")).alias("still_quarantined"), F.count_if("processing_allowed").alias("eligible"))
