"""Quotes that don't stand in their document: candidates for them, why they fail, and what is noted for a reviewer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .drafts import _bounds, _counts, _ratio_from

# The spans that are offered, the thresholds of the classes, and a name that quotes have put for others.
SENTENCE, PARAGRAPH = re.compile(r"[^。！？；\n]{4,}[。！？；]?"), re.compile(r"[^\n]{8,}")
CLOSE, REWRITTEN = 0.92, 0.55
RENAMED = ("黄海中南部",)
_CANDIDATE = "struct<start_offset: long, end_offset: long, similarity: double, text: string>"
_PIECE = "struct<start_offset: long, end_offset: long>"


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of the sentences of a text, stripped, then of its paragraphs, whose offsets take their white space in; each pair of offsets once."""
    found = []
    for m in SENTENCE.finditer(text):
        part = m[0].strip()
        if len(part) >= 4:
            start = m.start() + m[0].index(part)
            found.append((start, start + len(part), part))
    found += [(m.start(), m.end(), m[0].strip()) for m in PARAGRAPH.finditer(text) if m[0].strip()]
    return list({(a, b): (a, b, t) for a, b, t in reversed(found)}.values())[::-1]


def best_spans(quote: str, offered: list[tuple[int, int, str]], counts: np.ndarray, most: int) -> list[tuple[int, int, float, str]]:
    """The `most` spans with the largest share of matching blocks, rounded to four places, the earlier offered of ties: taken by the bound that characters set until none can pass."""
    bound = _bounds(_counts([quote])[0], counts)
    best: list[tuple] = []
    for i in np.argsort(-bound, kind="stable").tolist():
        least = -best[most - 1][0] - 0.00006 if len(best) >= most else 0.0
        if bound[i] < least:
            break
        best = sorted([*best, (-round(_ratio_from(quote, offered[i][2], least), 4), i)])[:most]
    return [(*offered[i][:2], -s, offered[i][2]) for s, i in best]


def pieces(quote: str, text: str) -> list[tuple[int, int]]:
    """Where the sentences of a quote stand in a text, white space aside, in order of the quote: (start, end) of those that do; a later one
    is looked for behind the one before first."""
    places = [i for i, c in enumerate(text) if not c.isspace()]
    whole, out, after = "".join(text[i] for i in places), [], 0
    for part in "".join(quote.split()).replace("；", "。").split("。"):
        at = whole.find(part, after) if part else -1
        at = whole.find(part) if part and at < 0 else at
        if at >= 0:
            after = at + len(part)
            out.append((places[at], places[after - 1] + 1))
    return out


def _judged(most: int, renamed: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, offered, counts = None, [], _counts([])
        for batch in batches:
            rows = []
            for name, quote, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                quote, text = (quote or "").strip(), text or ""
                if text != last:
                    last, offered = text, spans(text)
                    counts = _counts([t for _, _, t in offered])
                found = best_spans(quote, offered, counts, most) if quote else []
                top = found[0][2] if found else 0.0
                placed = pieces(quote, text)
                bare, whole = "".join(quote.split()), "".join(text.split())
                change = any(t in bare and t not in whole for t in renamed)
                reason = "meaning_change" if change else "close" if top >= CLOSE else "rewritten" if top >= REWRITTEN else "stitched" if placed else "none"
                rows.append({"quote_id": name, "reason": reason, "meaning_change": change, "candidates": [dict(zip(("start_offset", "end_offset", "similarity", "text"), c, strict=True)) for c in found], "pieces": [{"start_offset": a, "end_offset": b} for a, b in placed]})
            kind = pa.list_(pa.struct([("start_offset", pa.int64()), ("end_offset", pa.int64()), ("similarity", pa.float64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("quote_id", pa.int64()), ("reason", pa.string()), ("meaning_change", pa.bool_()), ("candidates", kind), ("pieces", pa.list_(pa.struct([("start_offset", pa.int64()), ("end_offset", pa.int64())])))]))

    return run


def judged(quotes: DataFrame, documents: DataFrame, most: int = 3, renamed: tuple[str, ...] = RENAMED) -> DataFrame:
    """(quote_id, reason, meaning_change, candidates, pieces) of quotes (quote_id long, document_id, quote) beside their documents (document_id, text).

    candidates: the sentences and paragraphs of the document most like the quote, suggestions that are never verified by this. reason: meaning_change if a name of `renamed` stands in the
    quote only; close from 0.92 on, rewritten from 0.55 on; stitched if a sentence of the quote stands in the document as it is, at `pieces`; else none. Quotes meet their
    own document only; a quote whose document is missing is left out. Null texts and quotes count as empty.
    """
    pairs = quotes.select(F.col("quote_id").cast("long").alias("quote_id"), "document_id", "quote").join(documents.select("document_id", "text"), "document_id")
    tasks = int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, so that small tables aren't drawn together into one task
    ordered = pairs.repartition(tasks, "document_id").sortWithinPartitions("document_id").select("quote_id", "quote", "text")
    return ordered.mapInArrow(_judged(most, renamed), f"quote_id long, reason string, meaning_change boolean, candidates array<{_CANDIDATE}>, pieces array<{_PIECE}>")


def candidates(quotes: DataFrame, documents: DataFrame, most: int = 3) -> DataFrame:
    """(quote_id, rank, start_offset, end_offset, similarity, text, reason): the candidates of judged(), one a row."""
    found = judged(quotes, documents, most)
    return found.select("quote_id", "reason", F.posexplode("candidates").alias("at", "c")).select("quote_id", (F.col("at") + 1).alias("rank"), "c.start_offset", "c.end_offset", "c.similarity", "c.text", "reason")


def issues(evidence: DataFrame, documents: DataFrame, events: DataFrame, renamed: tuple[str, ...] = RENAMED) -> DataFrame:
    """The unverified rows of evidence (evidence_id long, event_id, document_id, quote_text, verification_status) with what judged() says, the title of their event and a suggested action:
    extract_again where the meaning changes, else choose_candidate. Rows whose document (document_id, text) or event (event_id, title) is missing are left out."""
    open_ = evidence.where(~F.coalesce(F.col("verification_status") == "verified", F.lit(False)))
    found = judged(open_.select(F.col("evidence_id").alias("quote_id"), "document_id", F.col("quote_text").alias("quote")), documents, renamed=renamed).withColumnRenamed("quote_id", "evidence_id")
    named = open_.join(events.select("event_id", F.col("title").alias("event_title")), "event_id").join(found, "evidence_id")
    return named.withColumn("action", F.when(F.col("meaning_change"), "extract_again").otherwise("choose_candidate"))


def refreshed(evidence: DataFrame, found: DataFrame) -> DataFrame:
    """evidence with candidate_start_offset, candidate_end_offset, candidate_text, candidate_score and repair_status: the best candidate of issues() where it has a row (-1, -1, '' and 0 without candidates), else null; the columns are replaced if they are there."""
    best = F.get("candidates", F.lit(0))
    noted = found.select(
        "evidence_id", F.coalesce(best["start_offset"], F.lit(-1)).alias("candidate_start_offset"), F.coalesce(best["end_offset"], F.lit(-1)).alias("candidate_end_offset"), F.coalesce(best["text"], F.lit("")).alias("candidate_text"),
        F.coalesce(best["similarity"], F.lit(0.0)).alias("candidate_score"), F.lit("needs_human_review").alias("repair_status"),
    )
    return evidence.drop(*noted.columns[1:]).join(noted, "evidence_id", "left")
