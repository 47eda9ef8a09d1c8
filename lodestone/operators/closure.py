"""What is connected: classes of a relation and the timelines of related events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import discard, kept, scratch, stored

#: A value that stands in more rows than this is looked up by broadcast; of n rows there are n / BUSY such values at most.
BUSY = 100_000


def _look_up(rows: DataFrame, column: str, table: DataFrame, value: str, busy: DataFrame) -> DataFrame:
    """rows with `value` of the row of table (id, value) that `column` names, null without one. busy: the ids that stand in many rows."""
    wanted = table.select(F.col("id").alias(column), value)
    hot = busy.select(F.col("id").alias(column))
    often = rows.join(F.broadcast(hot.join(wanted, column, "left")), column)
    return often.unionByName(rows.join(F.broadcast(hot), column, "left_anti").join(wanted, column, "left"))


def closure(edges: DataFrame, a: str, b: str, rounds: int = 200) -> DataFrame:
    """(id, root) of each value that stands in columns a or b: root is the smallest value that edges, taken both ways, reach.

    Each round gives a node that of its neighbours, or itself, whose hash in this round is smallest, and draws together what was given the
    same one; so about half the nodes of a chain go in a round, all but one of a star in two, and the tables halve with them. The maps
    of the rounds are put together from the last to the first. Minima are formed before rows move, and what many rows
    name is looked up by broadcast (see BUSY), so a node may hold a third of all edges.
    Rows where a or b is null join nothing; a value that meets itself alone is a class of its own. Repeated edges count once.
    """
    with scratch(edges.sparkSession):
        given = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct(), "edges")
        pairs = given.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        maps: list[DataFrame] = []
        for turn in range(rounds):
            both = pairs.union(pairs.select("v", "u"))
            rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
            near = both.groupBy("u").agg(F.min(rank("v")).alias("near"), F.count("*").alias("degree"))
            maps.append(stored(near.select(F.col("u").alias("id"), F.least("near", rank("u"))["x"].alias("parent"), "degree"), "parents"))
            if maps[-1].isEmpty():
                maps.pop()
                break
            busy = maps[-1].where(F.col("degree") > BUSY).select("id")
            ends = _look_up(pairs, "u", maps[-1], "parent", busy).select(F.col("parent").alias("p"), "v")
            ends = _look_up(ends, "v", maps[-1], "parent", busy).where("p <> parent")
            after = stored(ends.select(F.least("p", "parent").alias("u"), F.greatest("p", "parent").alias("v")).distinct(), "edges")
            if turn:
                discard(pairs)
            pairs = after
        else:
            raise RuntimeError(f"classes did not settle in {rounds} rounds")
        busy_in = lambda table, column: table.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > BUSY).select("id")
        ids = given.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        classes = ids.where(F.lit(False)).select("id", F.col("id").alias("root"))
        for step in reversed(maps):
            found = _look_up(step.select("id", "parent"), "parent", classes, "root", busy_in(step, "parent"))
            classes = stored(found.select("id", F.coalesce("root", "parent").alias("root")), "classes")
        least = classes.groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        least = stored(least.select(F.col("root").alias("id"), "least", "n"), "least-ids")
        named = _look_up(classes, "root", least, "least", least.where(F.col("n") > BUSY).select("id")).select("id", F.col("least").alias("root"))
        return kept(ids.join(named, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "classes")


def timelines(events: DataFrame, key: str, related: str, order: list[str], parts: int | None = None) -> DataFrame:
    """events, with timeline (the smallest key that relations reach, either way) and position (from 1, by `order`, then key) in it.

    `related` names another event or is null or blank; an event that isn't in the table still connects those that name it.
    Rows with a null or blank key are left out; rows that repeat a key stand side by side. Null order values come first.

    Events are sorted once over the cluster, by timeline and order; a position is what stands before in the same part of
    the sorted rows and in the parts before it, so a timeline of a third of all events isn't numbered by one task.
    """
    name = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    blank = name(key).isNull()
    with scratch(events.sparkSession):
        rows = events.where(~blank)
        partner = F.when(name(related).isNotNull(), F.col(related)).otherwise(F.col(key))
        roots = closure(rows.select(F.col(key).alias("a"), partner.alias("b")), "a", "b").toDF("__id", "timeline")
        sort = ["timeline", *order, key]
        found = rows.join(roots, F.col(key) == F.col("__id")).drop("__id")
        dealt = found.repartitionByRange(parts, *sort) if parts else found.repartitionByRange(*sort)
        held = stored(dealt.withColumn("__part", F.spark_partition_id()), "sorted-events")
        here = Window.partitionBy("__part", "timeline").orderBy(*sort[1:])
        earlier = Window.partitionBy("timeline").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        before = held.groupBy("timeline", "__part").agg(F.count("*").alias("n")).select("timeline", "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        placed = held.withColumn("position", F.row_number().over(here)).join(before, ["timeline", "__part"])
        return kept(placed.withColumn("position", (F.col("position") + F.col("before")).cast("long")).drop("__part", "before"), "timelines")


def timeline_of(events: DataFrame, seeds: DataFrame, key: str, related: str, order: list[str]) -> DataFrame:
    """(seed, then the columns of timelines()) of the events on the timeline of each seed, a column of keys; a seed that isn't in events has none."""
    whole = timelines(events, key, related, order)
    named = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    of = whole.select(F.col(key).alias("seed"), "timeline").distinct().join(named, "seed", "left_semi")
    return whole.join(of, "timeline")
