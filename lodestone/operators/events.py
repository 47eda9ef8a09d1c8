"""Events: drafts from documents, explainable scores, risk lists, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import Rules, ValueLexicon


def _lookup(table: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _points(text: Column, terms: dict, rules: Rules) -> Column:
    return sum((F.when(T.contains(text, t, rules.patterns), F.lit(p)).otherwise(0) for t, p in terms.items()), F.lit(0))


def _found(text: Column, terms, rules: Rules) -> Column:
    return F.array_compact(F.array(*[F.when(T.contains(text, t, rules.patterns), F.lit(t)) for t in terms]))


def suggest_category(text: Column, rules: Rules) -> Column:
    """The category with most matched terms, the earlier of ties; none matched: the default."""
    text = F.lower(text)
    row = lambda n, order, name: F.struct(n.alias("n"), F.lit(order).alias("order"), F.lit(name).alias("name"))
    found = [row(sum((F.when(T.contains(text, t, rules.patterns), 1).otherwise(0) for t in terms), F.lit(0)), -i, name) for i, (name, terms) in enumerate(rules.category_terms.items())]
    return F.array_max(F.array(row(F.lit(0), 1, rules.default_category), *found))["name"]


def suggest_status(text: Column, rules: Rules) -> Column:
    """The first status, in order, any of whose terms occurs."""
    text, out = F.lower(text), F.lit(rules.default_status)
    for name, terms in reversed(rules.status_terms.items()):
        hit = F.lit(False)
        for t in terms:
            hit = hit | T.contains(text, t, rules.patterns)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def draft_events(documents: DataFrame, rules: Rules, source_type: Column, event_date: Column, related: Column, longest: int | None = 120) -> DataFrame:
    """A draft event for each document: its first line as title, at most `longest` characters of it or all, at most 600 characters as summary, category and status
    of the whole text, and the given source type, date and related event. Null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    title = F.substring_index(text, "\n", 1)
    return documents.select(
        F.col("doc_id").alias("event_id"), (title if longest is None else F.substr(title, F.lit(1), F.lit(longest))).alias("title"), F.substr(text, F.lit(1), F.lit(600)).alias("summary"), F.lit("").alias("impact"),
        suggest_category(text, rules).alias("category"), suggest_status(text, rules).alias("status"), "source", source_type.alias("source_type"), event_date.alias("event_date"), related.alias("related_event_id"),
    )


def suggested_action(rules: Rules, actions: dict[str, str], urgent: dict[str, str]) -> Column:
    """What to do about a scored event, the first rule that holds: resolved, unverified, high risk (of a category with an
    action of its own, or any), high opportunity, medium risk, or nothing. actions: by those names; urgent: by category."""
    high = _lookup(urgent, F.col("category"), actions["high_risk"])
    return (
        F.when(F.col("status").isin(*rules.resolved), actions["resolved"]).when(F.col("status") == rules.unverified, actions["unverified"]).when(F.col("risk_level") == "高", high)
        .when(F.col("opportunity_level") == "高", actions["high_opportunity"]).when(F.col("risk_level") == "中", actions["medium_risk"]).otherwise(actions["none"])
    )


def urgency(rules: Rules) -> Column:
    """resolved, or the urgency of the risk level: day, period or watch."""
    return F.when(F.col("status").isin(*rules.resolved), "resolved").when(F.col("risk_level") == "高", "day").when(F.col("risk_level") == "中", "period").otherwise("watch")


def business_value(lexicon: ValueLexicon) -> Column:
    """A struct (value, rule, hits) of title, summary, impact and category: the first of eight rules that holds.

    A title of mere activity, without an operational term, is low whatever the text says; so is activity without a term
    of high impact. Then categories of safety and any term of high impact are high, categories of trade with a business
    term too, and whatever else has a business term is medium; the rest is unrelated. hits: at most four of the terms.
    """
    title, text = F.coalesce("title", F.lit("")), F.concat_ws("\n", "title", "summary", "impact")
    holds = lambda x, t: x.rlike(lexicon.patterns[t]) if t in lexicon.patterns else F.contains(x, F.lit(t))
    hits = lambda x, terms: F.array_compact(F.array(*[F.when(holds(x, t), F.lit(t)) for t in terms]))
    low, high, business = hits(text, lexicon.activity), hits(text, lexicon.impact), hits(text, lexicon.business)
    title_low, title_high = hits(title, lexicon.activity), hits(title, [t for t in lexicon.impact if t not in lexicon.weather])
    rule = lambda value, name, found, n: F.struct(F.lit(value).alias("value"), F.lit(name).alias("rule"), F.array_join(F.slice(found, 1, n), "、").alias("hits"))
    some = lambda x: F.size(x) > 0
    return (
        F.when(some(title_low) & ~some(title_high), rule("低", "activity_title", title_low, 3)).when(some(low) & ~some(high), rule("低", "activity", low, 3))
        .when(F.col("category").isin(*lexicon.safety) | some(high), rule("高", "impact", high, 4)).when(F.col("category").isin(*lexicon.trade) & some(business), rule("高", "trade", business, 4))
        .when((F.col("category") == lexicon.policy) & some(business), rule("中", "policy", business, 4)).when((F.col("category") == lexicon.company) & some(business), rule("中", "company", business, 4))
        .when(some(business), rule("中", "business", business, 4)).otherwise(rule("无关", "none", F.array().cast("array<string>"), 4))
    )


def score(events: DataFrame, rules: Rules) -> DataFrame:
    """Explainable scores of title, summary and impact.

    Relief terms lower the current risk and not the historical one; priority is the current risk by confidence
    and status; all are rounded half to even into 0..100.
    """
    text = F.lower(F.concat_ws(" ", "title", "summary", "impact"))
    risk = {**rules.high, **rules.medium, **rules.low}
    out = events.withColumn("__text", text)
    t = F.col("__text")
    out = out.withColumns({
        "historical_risk_score": T.clamp(_lookup(rules.risk_base, F.col("category"), 10) + _points(t, risk, rules)),
        "risk_score": T.clamp(_lookup(rules.risk_base, F.col("category"), 10) + _points(t, risk, rules) + _points(t, rules.relief, rules)),
        "opportunity_score": T.clamp(_lookup(rules.opportunity_base, F.col("category"), 5) + _points(t, rules.opportunity, rules)),
        "confidence": T.clamp(_lookup(rules.confidence, F.col("source_type"), 40) * _lookup(rules.status_confidence, F.col("status"), 1.0)),
        "risk_terms": F.array_join(_found(t, [*risk, *rules.relief], rules), "、"),
        "opportunity_terms": F.array_join(_found(t, rules.opportunity, rules), "、"),
    })
    out = out.withColumn("priority_score", T.clamp(F.col("risk_score") * (F.col("confidence") / F.lit(100.0)) * _lookup(rules.status_priority, F.col("status"), 0.5)))
    out = out.withColumns({"risk_level": T.level(F.col("risk_score"), rules.high_from, rules.medium_from), "opportunity_level": T.level(F.col("opportunity_score"), rules.high_from, rules.medium_from)})
    return out.drop("__text")


def rescored(scored: DataFrame, rules: Rules) -> DataFrame:
    """Stored events with the scores that the rules give them now, and old_score, old_priority, old_level as they were; texts, categories and states stay."""
    was = {"old_score": F.col("risk_score"), "old_priority": F.col("priority_score"), "old_level": F.col("risk_level")}
    return score(scored.withColumns(was), rules)


def current_risks(scored: DataFrame, rules: Rules, least: int = 40) -> DataFrame:
    """Active events of at least so much priority that no resolving event points at."""
    resolving = scored.where(F.col("status").isin(*rules.resolved) & F.col("related_event_id").isNotNull()).select(F.col("related_event_id").alias("event_id"))
    return scored.where(~F.col("status").isin(*rules.resolved) & (F.col("priority_score") >= least)).join(resolving, "event_id", "left_anti")


def resolved_risks(scored: DataFrame, rules: Rules) -> DataFrame:
    return scored.where(F.col("status").isin(*rules.resolved))


def between(events: DataFrame, start: str, end: str, column: str = "event_date") -> DataFrame:
    """Rows dated within [start, end]; dates that can't be read drop out; start after end is an error."""
    if start > end:
        raise ValueError("start is after end")
    day = F.try_to_date(F.col(column).cast("string"))
    return events.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def report_groups(scored: DataFrame, rules: Rules, per_group: int = 5) -> DataFrame:
    """Each event in the first group it fits, the best few of each: risks, resolved, opportunities, watchlist."""
    from pyspark.sql.window import Window

    done = F.col("status").isin(*rules.resolved)
    group = F.when(~done & (F.col("risk_level") != "低"), "risks").when(done, "resolved").when(F.col("opportunity_level") != "低", "opportunities").otherwise("watchlist")
    # the best few of each part of a group first, so that no group meets in one task
    parts = Window.partitionBy("report_group", F.pmod(F.xxhash64("event_id"), F.lit(64))).orderBy(F.desc("priority_score"), F.desc("opportunity_score"), "event_id")
    whole = Window.partitionBy("report_group").orderBy(F.desc("priority_score"), F.desc("opportunity_score"), "event_id")
    top = scored.withColumn("report_group", group).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= per_group)
    return top.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= per_group)


def validate(events: DataFrame, rules: Rules = Rules(), least_summary: int = 40) -> DataFrame:
    """A row for each broken rule of drafts: (event_id, severity, code). See validation.issues() for the rules of whole records."""
    title = T.strip(F.col("title"))
    rule = lambda bad, severity, code: F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    checks = [
        rule(title == "", "error", "required_missing"), rule(F.col("event_date").isNull(), "error", "invalid_event_date"),
        rule(F.length(F.col("summary")) < least_summary, "warning", "short_summary"), rule(F.col("impact") == "", "info", "impact_missing"),
        rule(F.col("related_event_id") == F.col("event_id"), "error", "self_relation"),
        rule(F.col("status").isin(*rules.resolved) & F.col("related_event_id").isNull(), "warning", "relief_missing_relation"),
    ]
    row_rules = events.select("event_id", F.explode(F.array_compact(F.array(*checks))).alias("x")).select("event_id", "x.severity", "x.code")
    known = events.select(F.col("event_id").alias("related_event_id")).distinct()
    unknown = events.where("related_event_id IS NOT NULL").join(known, "related_event_id", "left_anti").select("event_id", F.lit("error").alias("severity"), F.lit("unknown_relation").alias("code"))
    keys = events.select("event_id", T.title_key(F.col("title")).alias("key")).where("key <> ''")
    first = keys.groupBy("key").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = keys.join(first, "key").where(F.col("event_id") > F.col("first")).select("event_id", F.lit("warning").alias("severity"), F.lit("duplicate_title").alias("code"))
    return row_rules.unionByName(unknown).unionByName(repeated)
