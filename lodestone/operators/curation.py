"""Keeping a collection in order: which sources to run or check again, repeated page margins, what a new version or a bad document takes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recheck_policy(current: DataFrame, now: str, mode: str = "recent", resolved: tuple[str, ...] = ("resolved",)) -> DataFrame:
    """current (status, published date, file_hash, validator, checked_at) with recheck boolean and reason.

    mode: force takes all, new_only none, recent those of the last week; a document without a date counts as old, one
    without a validator waits for 24 hours after its last check.
    """
    at = F.lit(now).cast("timestamp")
    age = F.coalesce(F.datediff(F.to_date(at), "published"), F.lit(9999))
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    reason = (
        F.when(F.coalesce(F.col("status").isin(*resolved), F.lit(False)), "resolved").when((age > 30) & filled("file_hash"), "old_with_hash").when(age > 7, "outside_week")
        .when(~filled("validator") & (F.col("checked_at") > at - F.expr("INTERVAL 24 HOURS")), "checked_today").otherwise("conditional_check")
    )
    if mode in ("force", "new_only"):
        reason = F.lit(mode)
    return current.withColumn("reason", reason).withColumn("recheck", F.col("reason").isin("force", "conditional_check"))


def circuit_breaker(runs: DataFrame, key: str, order: list[str], failed: Column, failures: int = 3) -> DataFrame:
    """runs with tripped: the runs just before, as many as given, all failed."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(-failures, -1)
    return runs.withColumn("tripped", F.coalesce(F.sum(failed.cast("int")).over(before) == failures, F.lit(False)))


def cooldown(runs: DataFrame, key: str, at: str, order: list[str], ok: Column, seconds: int) -> DataFrame:
    """runs with suppressed: an earlier run of the key succeeded less than so many seconds before."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(ok, F.col(at))).over(before)
    return runs.withColumn("suppressed", F.coalesce(F.col(at) < last + F.expr(f"INTERVAL {seconds} SECONDS"), F.lit(False)))


def zero_yield(items: DataFrame, source: str, qualified: Column) -> DataFrame:
    """(source, n) of sources with items none of which qualifies."""
    return items.groupBy(source).agg(F.count("*").alias("n"), F.count_if(qualified).alias("good")).where("good = 0").select(source, "n")


def value_issues(rows: DataFrame, key: str, domains: dict[str, tuple[str, ...]], needs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, field, issue): values outside their domain (null is not judged), and conditions without what they need; one scan."""
    outside = [F.when(~F.col(f).isin(*allowed), F.struct(F.lit(f).alias("field"), F.lit("value_not_allowed").alias("issue"))) for f, allowed in domains.items()]
    lacking = [F.when(c & ~F.coalesce(need, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit("basis_missing").alias("issue"))) for f, (c, need) in needs.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*outside, *lacking))).alias("x")).select(key, "x.*")


def page_margins(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, page, line_no, line, removed): lines that repeat as headers or footers of a document are marked.

    The first two and the last two lines of each page are counted, a line that is both twice; one of 2 to 120
    characters, white space squeezed, goes everywhere when it is counted on 60 percent of the pages and at least
    twice. Documents of one page keep all. Null texts are one empty line.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    rows = pages.select(document, page, F.size(lines).alias("n"), F.posexplode(lines).alias("line_no", "line"))
    rows = rows.withColumn("key", F.trim(F.regexp_replace("line", r"[ \t\r\f]+", " ")))
    edges = (F.col("line_no") < 2).cast("int") + (F.col("line_no") >= F.col("n") - 2).cast("int")
    counts = rows.where((edges > 0) & F.length("key").between(2, 120)).groupBy(document, "key").agg(F.sum(edges).alias("seen"))
    sizes = pages.groupBy(document).agg(F.count("*").alias("pages"))
    repeated = counts.join(sizes, document).where("pages >= 2 AND seen >= 2 AND 10 * seen >= 6 * pages").select(document, "key", F.lit(True).alias("repeated"))
    return rows.join(repeated, [document, "key"], "left").select(document, page, "line_no", "line", F.coalesce("repeated", F.lit(False)).alias("removed"))


def invalidate(evidence: DataFrame, superseded: DataFrame, key: str) -> DataFrame:
    """evidence with status: version_mismatch where its document has been superseded, else valid."""
    gone = superseded.select(key, F.lit("version_mismatch").alias("status")).distinct()
    return evidence.join(gone, key, "left").withColumn("status", F.coalesce("status", F.lit("valid")))


def quarantine(events: DataFrame, gated: DataFrame, event_key: str, document_key: str) -> DataFrame:
    """(event, record_state, reasons): events of documents that the gate blocks are quarantined with its reasons."""
    bad = gated.where("status = 'blocked'").select(F.col(document_key).alias(event_key), F.col("issues").alias("reasons"))
    out = events.select(event_key).join(bad, event_key, "left")
    return out.select(event_key, F.when(F.col("reasons").isNotNull(), "quarantined").otherwise("active").alias("record_state"), F.coalesce("reasons", F.lit("")).alias("reasons"))
