"""Counting what a collection holds and how it fares: states, evidence, usage, reviews, summaries. One scan a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reviews import gate


def counts(rows: DataFrame, figures: dict[str, Column]) -> DataFrame:
    """(figure, n): how many rows fulfil each condition, zero included."""
    one = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in figures.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), F.col(n).alias("n")) for n in figures])).alias("x")).select("x.*")


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()])


def table_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, before, after, delta) of two results of table_rows, tables of one side included."""
    both = before.withColumnRenamed("n", "before").join(after.withColumnRenamed("n", "after"), "table", "full")
    return both.select("table", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")]).withColumn("delta", F.col("after") - F.col("before"))


def usage(calls: DataFrame, ok: Column, tokens: str, ms: str, model: str) -> DataFrame:
    """One row: calls, successes, their rate, means and the distinct models, in order. Rates over nothing are null."""
    out = calls.agg(F.count("*").alias("calls"), F.count_if(F.coalesce(ok, F.lit(False))).alias("successes"), F.bround(F.avg(tokens), 4).alias("mean_tokens"), F.bround(F.avg(ms), 4).alias("mean_ms"), F.array_join(F.sort_array(F.collect_set(model)), ",").alias("models"))
    return out.withColumn("success_rate", F.bround(F.try_divide("successes", "calls"), 6))


def evidence_audit(evidence: DataFrame, document: str, located: Column) -> DataFrame:
    """(document, quotes, verified, failed, all_verified): an empty set of quotes is never verified, so it has no row."""
    out = evidence.groupBy(document).agg(F.count("*").alias("quotes"), F.count_if(located).alias("verified"))
    return out.withColumn("failed", F.col("quotes") - F.col("verified")).withColumn("all_verified", F.col("failed") == 0)


def answers(rows: DataFrame, questions: dict[str, Column]) -> DataFrame:
    """(question, answer, n): how often each question has each answer; a null answer is unknown."""
    pairs = F.array(*[F.struct(F.lit(q).alias("question"), F.coalesce(a, F.lit("unknown")).alias("answer")) for q, a in questions.items()])
    return rows.select(F.explode(pairs).alias("x")).select("x.*").groupBy("question", "answer").agg(F.count("*").alias("n"))


def review_accuracy(reviews: DataFrame, fields: dict[str, tuple[str, ...]], least: int = 50) -> DataFrame:
    """One row: the latest independent human review of each event, its decisions, and for each field the share of accepted
    reviews that changed none of its columns. reviews: (event_id, reviewed_at, review_id, reviewer, decision, changed array)."""
    rest = [c for c in reviews.columns if c not in ("event_id", "reviewed_at", "review_id")]
    last = reviews.where("reviewer = 'human'").groupBy("event_id").agg(F.max(F.struct("reviewed_at", "review_id", *rest)).alias("x")).select("event_id", "x.*")
    accepted = F.col("decision").isin("accept", "accept_modified")
    right = lambda names: F.count_if(accepted & ~F.arrays_overlap("changed", F.array(*map(F.lit, names))))
    out = last.agg(F.count("*").alias("reviewed"), F.count_if(accepted).alias("accepted"), *[right(names).alias(f) for f, names in fields.items()])
    rates = {f"{f}_accuracy": F.bround(F.try_divide(f, "accepted"), 6) for f in fields}
    return out.select("reviewed", "accepted", (F.col("reviewed") >= least).alias("enough"), *[c.alias(n) for n, c in rates.items()])


def summary(rows: DataFrame, group: str, title: str, order: list[str], most: int = 3) -> DataFrame:
    """(group, n, verified, titles): counts of each group and its first titles, joined by commas."""
    first = F.array_sort(F.collect_list(F.struct(*order, title)))
    counted = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if("human_verified").alias("verified"))
    from .selection import per_key

    top = per_key(rows, group, [F.col(c) for c in order], most, F.col(order[-1])).groupBy(group).agg(F.array_join(F.transform(first, lambda x: x[title]), ",").alias("titles"))
    return counted.join(top, group, "left")


def thresholds(metrics: DataFrame, name: str, value: str, gates: dict[str, float]) -> DataFrame:
    """(name, value, threshold, passed, all_passed): named figures against their least values; a null figure fails."""
    table = F.create_map(*[x for n, t in gates.items() for x in (F.lit(n), F.lit(float(t)))])
    out = metrics.select(name, value, table[F.col(name)].alias("threshold")).where("threshold IS NOT NULL")
    out = out.withColumn("passed", F.coalesce(F.col(value) >= F.col("threshold"), F.lit(False)))
    return out.join(F.broadcast(out.agg(F.bool_and("passed").alias("all_passed"))), F.lit(True))


def preflight(rows: DataFrame, key: str, checks: dict[str, tuple[str, Column]], most: int = 20) -> DataFrame:
    """(code, severity, passed, n, details): for each check how many rows fail it and the first keys of these, joined by commas.

    checks: code to (severity, failing condition). One scan; each task keeps at most `most` keys a check.
    """
    failed = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, (_, c) in checks.items()])))
    found = rows.select(key, failed.alias("code"))
    from .selection import per_key

    listed = per_key(found, "code", [F.col(key)], most, F.col(key)).groupBy("code").agg(F.array_join(F.sort_array(F.collect_list(key)), ",").alias("details"))
    table = rows.sparkSession.createDataFrame([(c, s) for c, (s, _) in checks.items()], "code string, severity string")
    out = table.join(found.groupBy("code").agg(F.count("*").alias("n")), "code", "left").join(listed, "code", "left")
    return out.select("code", "severity", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("details", F.lit("")).alias("details"))


def decision(rows: DataFrame, key: str, blocking: dict[str, Column], limiting: dict[str, Column]) -> DataFrame:
    """(key, reasons, outcome): blocked by any blocking reason, else report_ineligible by a limiting one, else confirmed."""
    out = gate(rows, key, blocking | limiting)
    held = F.arrays_overlap(F.split("reasons", ","), F.array(*map(F.lit, blocking)))
    return out.select(key, "reasons", F.when(F.col("passed"), "confirmed").when(held, "blocked").otherwise("report_ineligible").alias("outcome"))
