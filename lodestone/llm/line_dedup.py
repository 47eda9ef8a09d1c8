"""Line dedup by an exact set-similarity join, in DataFrame operations only."""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, kept, scratch, stored

#: A word in the prefixes of more lines than SLOTS is frequent; at most FREQUENT such words are told apart. BLOCK: how many values stand in one row while a table is put together.
SLOTS, FREQUENT, BLOCK = 1 << 14, 1 << 12, 1 << 10
PLACE = ["doc_id", "line_no"]
#: Bits of the table that says which lines are named in a pair; the tokens of others are not made.
BITS = 1 << 21
PARTS = 2
FEW = 48  # tokens up to which 64 cells tell sets apart
LONG = 15  # bytes from which on words rank alike
BLANK = " \t\r"


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line), in lower case, with spaces only between words."""
    text = F.lower(F.coalesce("text", F.lit("")))
    for blank in BLANK[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _token(word: Column) -> Column:
    """A 60-bit hash below four bits for the length; long words, which most often are rare, come first."""
    rank = F.lit(LONG // 2) - F.least(F.octet_length(word), F.lit(LONG))
    return F.call_function("shiftleft", rank.cast("long"), F.lit(60)).bitwiseOR(F.xxhash64(word).bitwiseAND((1 << 60) - 1))


def token_sets(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, tokens): the sorted tokens of the distinct words."""
    return lines.select(*PLACE, F.sort_array(F.array_distinct(F.array_remove(F.transform(F.split("line", " "), _token), _token(F.lit(""))))).alias("tokens"))


def token_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, node_a, node_b, tokens) of the lines with a word; the nodes are 128 bits that name the set."""
    lines = split_lines(docs).where(F.btrim("line") != "")  # a filter on the tokens would make them twice
    return token_sets(lines).select(*PLACE, F.xxhash64("tokens").alias("node_a"), F.xxhash64(F.lit(1), "tokens").alias("node_b"), "tokens")


def _listed(rows: DataFrame, index: str, value: str, label: str) -> DataFrame:
    """One row with the values of rows in the order of index, an array; of tables of a fixed size only. A plan reads it as a
    scalar subquery, so that neither the plan nor what the driver shows of it holds the values."""
    in_order = lambda key, x: F.transform(F.sort_array(F.collect_list(F.struct(key, x))), lambda r: r[x])
    blocks = rows.groupBy(F.floor(F.col(index) / BLOCK).alias("block")).agg(in_order(index, value).alias("part"))
    return stored(blocks.agg(F.flatten(in_order("block", "part")).alias("list")), label)


def _cells(tokens: Column | str) -> Column:
    """A bit for each of 64 cells, the parity of the tokens there: two sets differ in at least as many tokens as bits."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))))


def _parity(tokens: str) -> Column:
    """_cells() of all tokens and, of more than FEW, of one half of them, for so many fill the bits."""
    half = _cells(F.filter(tokens, lambda t: t.bitwiseAND(64) == 0))
    return F.struct(_cells(tokens).alias("every"), F.when(F.size(tokens) > FEW, half).otherwise(F.lit(0).cast("long")).alias("half"))


def first_lines(lines: DataFrame, percent: int, frequent: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, n, parity, prefix) of the first line of each set. prefix: the first n - ceil(percent * n / 100) + 1
    tokens in an order that all lines share, one of which two similar sets have in common; none for sets so small that only
    an equal one is similar. In that order frequent ones, an array, are last."""
    n = F.size("tokens")
    size = F.when(100 * n < percent * (n + 1), 0).otherwise(n + 1 - F.ceil(percent * n / 100).cast("int"))
    order = F.col("tokens") if frequent is None else F.concat(F.array_except("tokens", frequent.scalar()), F.array_intersect("tokens", frequent.scalar()))
    row = F.struct(*PLACE, n.alias("n"), _parity("tokens").alias("parity"), F.slice(order, F.lit(1), size).alias("prefix"))
    return lines.select("node_a", "node_b", row.alias("x")).groupBy("node_a", "node_b").agg(F.min("x").alias("x")).select("x.*")


def ordered_lines(lines: DataFrame, percent: int, tries: int = 3) -> DataFrame:
    """first_lines(), again with the words put last that too many prefixes hold, as long as there are more of these. The order of words never changes a result."""
    firsts, known, frequent = stored(first_lines(lines, percent), "first-lines"), None, None
    for _ in range(tries):
        found = firsts.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > SLOTS)
        found = stored(found if known is None else known.union(found).groupBy("token").agg(F.max("n").alias("n")), "frequent").orderBy(F.desc("n"), "token").limit(FREQUENT)
        if known is not None and found.count() == known.count() or found.isEmpty():
            break
        discard(firsts)
        known, frequent = found, stored(found.agg(F.sort_array(F.collect_list("token")).alias("list")), "frequent-list")
        firsts = stored(first_lines(lines, percent, frequent), "first-lines")
    return firsts


def _band(n: Column) -> Column:
    """The band of sizes of n; the next one begins half as far again."""
    return F.floor(F.log(n) / math.log(1.5)).cast("int")


def _may_be_similar(x: str, y: str, percent: int) -> Column:
    """Length and parity filters, x having no more words than y: they drop no pair whose Jaccard similarity reaches percent / 100."""
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    every, half = (F.col(f"{x}.parity.{k}").bitwiseXOR(F.col(f"{y}.parity.{k}")) for k in ("every", "half"))
    differ = F.when(F.col(f"{x}.n") > FEW, F.bit_count(half) + F.bit_count(every.bitwiseXOR(half))).otherwise(F.bit_count(every))
    return (percent * F.col(f"{y}.n") <= 100 * F.col(f"{x}.n")) & (differ <= both - 2 * F.ceil(percent * both / (100 + percent)))


ENDS = ["a_doc_id", "a_line_no", "b_doc_id", "b_line_no"]


def _ends(a: str, b: str) -> list[Column]:
    return [F.col(f"{side}.{c}").alias(n) for (side, c), n in zip([(s, c) for s in (a, b) for c in PLACE], ENDS, strict=True)]


def _bit(doc_id: Column, line_no: Column) -> tuple[Column, Column]:
    """The word and the bit in it that stand for a line in a table of BITS bits."""
    at = F.xxhash64(doc_id, line_no).bitwiseAND(BITS - 1)
    return F.shiftright(at, 6), at.bitwiseAND(63).cast("int")


def _met(lines: DataFrame, part: int, percent: int) -> DataFrame:
    """The distinct pairs (ENDS) of lines that share a token of their prefixes, pass the length, positional and parity filters and
    whose later one isn't settled; of every PARTSth token only, so that the disk holds the prefixes of one part at once."""
    shared = lambda n, m: F.ceil(percent * (n + m) / (100 + percent))
    tokens = lines.select(*PLACE, "n", "parity", "settled", F.posexplode("prefix").alias("pos", "token")).where(F.pmod("token", F.lit(PARTS)) == part)
    n, left, least = F.col("n"), F.col("n") - F.col("pos"), F.ceil(percent * F.col("n") / 100)
    key = lambda band: F.xxhash64("token", band).alias("key")
    x = tokens.where(left >= shared(n, n)).select("*", key(_band(n)))
    # a line meets shorter ones under the bands of their sizes
    y = tokens.withColumn("band", F.explode(F.sequence(_band(least), _band(n)))).where(left >= shared(n, F.greatest(least, F.floor(F.pow(F.lit(1.5), F.col("band"))))))
    x, y = x.alias("x"), y.select("*", key(F.col("band"))).alias("y")
    shorter = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.struct("x.doc_id", "x.line_no") < F.struct("y.doc_id", "y.line_no")))
    places = F.least(F.expr("x.n - x.pos"), F.expr("y.n - y.pos")) >= shared(F.col("x.n"), F.col("y.n"))
    swap = F.struct("x.doc_id", "x.line_no") > F.struct("y.doc_id", "y.line_no")
    open_ = ~F.when(swap, F.col("x.settled")).otherwise(F.col("y.settled"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & shorter & places & _may_be_similar("x", "y", percent) & open_)
    return met.select(*[F.when(swap, q).otherwise(p).alias(n) for p, q, n in zip(_ends("x", "y"), _ends("y", "x"), ENDS, strict=True)]).distinct()


def _earlier(both: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (ENDS) of rows (a, b), structs of a line, where a stands before b and the filters allow the similarity."""
    x, y = (F.struct(f("a.n", "b.n").alias("n"), F.col(f"{s}.parity").alias("parity")) for f, s in ((F.least, "a"), (F.greatest, "b")))
    before = F.struct("a.doc_id", "a.line_no") < F.struct("b.doc_id", "b.line_no")
    return both.withColumn("x", x).withColumn("y", y).where(before & _may_be_similar("x", "y", percent)).select(*_ends("a", "b")).distinct()


def _named_sets(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, tokens) of the lines that pairs (ENDS) name, and of few others.

    A table of fixed size says which lines may be named, so that the tokens of most others are not made.
    """
    named = pairs.select(*ENDS[:2]).union(pairs.select(*ENDS[2:])).toDF(*PLACE)
    word, bit = _bit(F.col("doc_id"), F.col("line_no"))
    words = named.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    every = words.union(pairs.sparkSession.range(BITS // 64).select("id", F.lit(0).cast("long")))
    table = _listed(every.groupBy("word").agg(F.bit_or("bits").alias("bits")), "word", "bits", "named-bits")
    maybe = F.call_function("shiftright", F.get(table.scalar(), word.cast("int")), bit).bitwiseAND(1) == 1
    sets = stored(token_sets(split_lines(docs).where(maybe)), "named-lines")
    discard(table)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The later lines b of pairs (ENDS) whose token sets reach the similarity."""
    for side, columns in (("a", ENDS[:2]), ("b", ENDS[2:])):
        pairs = pairs.join(sets.toDF(*columns, f"{side}_tokens"), columns)
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    alike = pairs.where(100 * shared >= percent * (F.size("a_tokens") + F.size("b_tokens") - shared))
    return stored(alike.select(*ENDS[2:]).toDF(*PLACE).distinct(), "settled-lines")


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_lines, removed): how many lines each document has and the sorted numbers, from 0, of those to remove.

    A line goes when an earlier line, by (doc_id, line number), has the same set of words or one whose Jaccard
    similarity is at least percent / 100, whether or not that line itself goes. Words are what spaces, tabs and
    carriage returns separate, in lower case; lines without any stay. A set takes part with its first line only: its later lines go anyway.

    Words are ordered by length, the long ones first, but those that too many prefixes hold come last. Each line first
    meets the earliest line of as many words under each of three tokens of its prefix; those that match it are settled.
    Then all lines meet that share a token of their prefixes and pass the length, positional and parity filters, if
    the later one isn't settled; two of its partners are tried before the rest. So most lines of a group of near copies
    don't meet pairwise. Tokens are made again from the texts where they are compared, and never stored for all lines.

    Null texts are one empty line; rows with a null doc_id are not in the result; rows that repeat a doc_id are one document:
    their lines share numbers and decisions, and n_lines is the most of them. Other columns are not read. An
    empty table gives no rows. Words are 60-bit hashes beside their length (two different ones of a length are equal with probability 2^-60), sets of lines are named by 128 bits.
    """
    with scratch(docs.sparkSession):
        docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        firsts = ordered_lines(token_lines(docs), percent)

        line = [*PLACE, "n", "parity"]
        size = F.size("prefix")  # the first words of a near copy are often those that it alone has, so some from further on too
        some = F.array_distinct(F.array(*[F.get("prefix", (size * i / 3).cast("int") if i < 3 else size - 1) for i in (1, 2, 3)]))
        rare = firsts.select("n", F.struct(*line).alias("b"), F.explode(some).alias("token"))
        near = rare.withColumn("a", F.first("b").over(Window.partitionBy("token", "n").orderBy("b.doc_id", "b.line_no")))
        pairs = stored(_earlier(near.select("a", "b"), percent), "line-pairs")
        sets = _named_sets(pairs, docs)
        settled = _verified(pairs, sets, percent)
        discard(pairs)
        discard(sets)

        flagged = firsts.join(settled.withColumn("settled", F.lit(True)), PLACE, "left").select(*line, F.coalesce("settled", F.lit(False)).alias("settled"), "prefix")
        pairs = [stored(_met(flagged, part, percent), "similar-prefixes") for part in range(PARTS)]
        pairs = stored(functools.reduce(DataFrame.union, pairs).distinct(), "line-pairs")
        sets = _named_sets(pairs, docs)
        few = pairs.groupBy(*ENDS[2:]).agg(F.min(F.struct(*ENDS[:2])).alias("a"), F.max(F.struct(*ENDS[:2])).alias("z"))
        few = few.select(F.explode(F.array_distinct(F.array("a", "z"))).alias("a"), *ENDS[2:]).select("a.*", *ENDS[2:])
        similar = _verified(few, sets, percent)
        similar = similar.union(_verified(pairs.join(similar.toDF(*ENDS[2:]), ENDS[2:], "left_anti").join(few, ENDS, "left_anti"), sets, percent)).union(settled)

        stay = firsts.select(*PLACE).join(similar, PLACE, "left_anti").groupBy("doc_id").agg(F.collect_set("line_no").alias("stay"))
        lines = F.split(F.coalesce("text", F.lit("")), "\n")
        worded = F.filter(F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) != "", i)), lambda i: i.isNotNull())
        every = docs.select("doc_id", F.size(lines).alias("n_lines"), worded.alias("worded")).groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("worded")).alias("worded"))
        none = F.array().cast("array<int>")
        gone = F.sort_array(F.array_except("worded", F.coalesce("stay", none)))
        return kept(every.join(stay, "doc_id", "left").select("doc_id", "n_lines", gone.alias("removed")), "removed-lines")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs, with all their rows and columns, whose text has lost the lines of removed_lines; a document that loses all
    has an empty text. A column n_chars, where there is one, follows the text. Null texts, rows with a null doc_id and
    rows that lose nothing stay as they are; repeated rows and rows that share a doc_id stay and lose the same lines; columns of any name are kept.
    An empty table gives no rows."""
    name = f"removed_{uuid.uuid4().hex}"  # no column of docs has it
    gone = removed_lines(docs, **options).where(F.size("removed") > 0).select(F.col("doc_id").alias(f"{name}_of"), F.col("removed").alias(name))
    lines = F.split(F.col("text"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(name))
    text = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    changed = docs.join(gone, docs.doc_id == gone[f"{name}_of"], "left")
    lost = F.col(name).isNotNull() & F.col("text").isNotNull()
    columns = {"text": F.when(lost, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(lost, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return changed.select(*[columns[c].alias(c) if c in columns else docs[c] for c in docs.columns])
