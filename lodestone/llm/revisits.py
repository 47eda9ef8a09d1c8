"""WARC: not-modified revisits resolved by an as-of join to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only

#: The headers that a 304 answer may carry for the stored response (RFC 9110, 15.4.5), and Last-Modified.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Fixed value: query parameters that only track, as a pattern of their names.
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """host + path + query: scheme, www., default port, fragment, tracking parameters and a final slash dropped, host lower-cased, parameters sorted."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def plain_headers(headers: Column) -> Column:
    """Names lower-cased; of names that then clash the first stays; null is empty."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e.key)))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.filter(entries, lambda e: F.lower(e.key) == n)[0].value))


def _validated(mine: Column, theirs: Column) -> Column:
    """True, false, or null where no validator is on both sides: ETags compare weakly, else Last-Modified exactly."""
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    return F.coalesce(tag(mine) == tag(theirs), mine["last-modified"] == theirs["last-modified"])


def resolve_revisits(records: DataFrame, slice_rows: int = 200_000) -> DataFrame:
    """(record_id, url_key, refers_to, outcome, headers, payload_digest), a row for each revisit of records.

    records: (record_id, url, ts long, status int, headers map<string,string>, payload_digest). Status 200 is a
    full response, 304 a revisit, others are ignored. A revisit refers to the latest response of its canonical
    URL with an earlier ts; of equal ts the largest record_id. outcome: resolved; validator_mismatch; no_validator
    (none on both sides); no_earlier_response. Only a resolved revisit gets headers (the response's, overridden
    by the permitted ones of the revisit) and the response's digest.

    Time is cut at quantiles into slices of about slice_rows records. Within a URL and slice a window looks
    back; what came before the slice is the largest response of each earlier one, so the captures of one hot URL
    are spread over tasks and only one row a slice meets again.

    Null urls have key '' no more than they share a resource: they, null ts and null record_ids of responses
    never match (such revisits get no_earlier_response). Null headers are empty. Repeated rows are resolved
    each. Other columns are not read. An empty table gives no rows.
    """
    records = only(records, "record_id", "url", "ts", "status", "headers", "payload_digest")
    rows = records.where(F.col("status").isin(200, 304)).select(
        "record_id", F.coalesce(canonical_url(F.col("url")), F.lit("")).alias("url_key"), F.col("ts").cast("long").alias("ts"), (F.col("status") == 304).alias("revisit"), plain_headers(F.col("headers")).alias("own"), "payload_digest"
    )
    n, cuts = rows.agg(F.count("*").alias("n"), F.percentile_approx("ts", [i / 64 for i in range(1, 64)], 1000).alias("cuts")).first()
    cuts = sorted(set(cuts or []))[:: max(1, 64 * slice_rows // max(n, 1))] if n > slice_rows else []
    piece = sum((F.when(F.col("ts") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    full = ~F.col("revisit") & F.col("ts").isNotNull() & F.col("record_id").isNotNull() & (F.col("url_key") != "")
    rows = rows.withColumn("piece", piece).withColumn("answer", F.when(full, F.struct("ts", "record_id", F.to_json("own").alias("held"), "payload_digest")))
    earlier = Window.partitionBy("url_key", "piece").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("answer").over(earlier)).where("revisit")
    last = rows.groupBy("url_key", "piece").agg(F.max("answer").alias("answer"))
    before = last.select("url_key", "piece", F.max("answer").over(Window.partitionBy("url_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    found = near.join(before, ["url_key", "piece"], "left").withColumn("hit", F.when(F.col("ts").isNotNull() & (F.col("url_key") != ""), F.coalesce("near", "before")))
    found = found.withColumn("held", F.from_json("hit.held", "map<string,string>")).withColumn("same", _validated(F.col("own"), F.col("held")))
    done = F.col("hit").isNotNull() & F.coalesce(F.col("same"), F.lit(False))
    outcome = F.when(F.col("hit").isNull(), "no_earlier_response").when(F.col("same").isNull(), "no_validator").when(~F.col("same"), "validator_mismatch").otherwise("resolved")
    fresh = F.map_filter("own", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("held", lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    return found.select("record_id", "url_key", F.col("hit.record_id").alias("refers_to"), outcome.alias("outcome"), F.when(done, merged).alias("headers"), F.when(done, F.col("hit.payload_digest")).alias("payload_digest"))
