"""Label sheets and their context, filling of stored rows from a template, and short texts for reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import _units

#: States of a label and what a review queue shows for them.
STATES = {"已完成": "接受", "修改后完成": "修改后接受", "已驳回": "驳回", "需要第二人复核": "待二审", "正文有问题": "正文有问题"}
UNREVIEWED = "未审核"


def review_queue_status(reviewer: Column, state: Column, people: list[str]) -> Column:
    """What the queue shows for a label; unreviewed unless one of the given kinds of people set a known state."""
    shown = F.lit(UNREVIEWED)
    for name, text in STATES.items():
        shown = F.when(state == name, text).otherwise(shown)
    return F.when(F.coalesce(reviewer, F.lit("")).isin(people), shown).otherwise(UNREVIEWED)


def label_context(labels: DataFrame, documents: DataFrame, events: DataFrame, key: str = "document_id") -> DataFrame:
    """labels with a struct `document` and a struct `event`, null where there is none; one row per row of labels.

    documents and events are those that count (current, active). Of several rows of a key the smallest struct of the other
    columns, in their order, is taken, in a partial aggregate before the join; so a key with many rows moves one. Null keys meet nothing.
    """
    def one(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias(name))

    return labels.join(one(documents, "document"), key, "left").join(one(events, "event"), key, "left")


def filled_from_template(current: DataFrame, template: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns, origin, added, conflicting): stored rows with their missing or empty string columns taken from the template.

    A stored value always wins. origin is `template` for rows that only the template has, else `current`; added lists the columns that were
    filled, conflicting those whose values differ. Keys are unique on either side; null keys of either side stay as rows of their own.
    """
    mine, theirs = (rows.select(key, *columns, F.lit(True).alias(f"has_{key}")).alias(side) for rows, side in ((current, "mine"), (template, "theirs")))
    both = mine.join(theirs, F.col(f"mine.{key}") == F.col(f"theirs.{key}"), "full")
    value = lambda side, c: F.nullif(F.trim(F.col(f"{side}.{c}")), F.lit(""))
    listed = lambda test: F.array_compact(F.array(*[F.when(test(value("mine", c), value("theirs", c)), c) for c in columns]))
    return both.select(
        F.coalesce(f"mine.{key}", f"theirs.{key}").alias(key),
        *[F.coalesce(value("mine", c), value("theirs", c)).alias(c) for c in columns],
        F.when(F.col(f"mine.has_{key}"), "current").otherwise("template").alias("origin"),
        listed(lambda a, b: a.isNull() & b.isNotNull()).alias("added"),
        listed(lambda a, b: a != b).alias("conflicting"),
    )


def line_changes(previous: Column, current: Column, most: int = 12) -> Column:
    """The distinct lines that went (-) and then those that came (+), the first `most` of them. A set difference: moved lines don't show."""
    lines = lambda x: F.split(F.coalesce(x, F.lit("")), "\n")
    signed = lambda x, y, sign: F.transform(F.array_except(lines(x), lines(y)), lambda line: F.concat(F.lit(sign), line))
    return F.array_join(F.slice(F.concat(signed(previous, current, "-"), signed(current, previous, "+")), 1, most), "\n")


def sentence_excerpt(text: Column, maximum: int = 220) -> Column:
    """The first whole sentences of a text that fit `maximum` characters, one at least; empty for null and blank texts.
    A sentence longer than that is cut by clauses as chunks are."""
    text = F.coalesce(text, F.lit(""))

    def step(acc, unit):
        full = acc["full"] | ((F.length(acc["taken"]) > 0) & (F.length(acc["taken"]) + F.length(unit) > maximum))
        return F.struct(F.when(full, acc["taken"]).otherwise(F.concat(acc["taken"], unit)).alias("taken"), full.alias("full"))

    return F.trim(F.aggregate(_units(text, max(100, maximum)), F.struct(F.lit("").alias("taken"), F.lit(False).alias("full")), step, lambda x: x["taken"]))
