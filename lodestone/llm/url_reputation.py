"""URL filter: rules first, then empirical-Bayes reputation of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, kept, only, scratch, stored

#: Labels that registries sell names under, so that they and the last label form the suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: (verdict, host, start of the path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    two = (F.size(labels) >= 3) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL) & (F.length(F.try_element_at(labels, F.lit(-1))) == 2)
    return F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    return F.when(F.length(suffix) - F.length(F.replace(suffix, F.lit("."), F.lit(""))) == 1, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(level: DataFrame, mean: str) -> float:
    """The weight of the prior, by the method of moments for a beta-binomial: 1/rho - 1, where rho is what outcomes within a group have in common."""
    var = F.col(mean) * (1 - F.col(mean))
    x = level.agg(F.sum((F.col("bad") - F.col("n") * F.col(mean)) ** 2 - F.col("n") * var), F.sum(F.col("n") * (F.col("n") - 1) * var)).first()
    rho = min(0.5, max(0.01, x[0] / x[1])) if x[1] else 0.01
    return 1 / rho - 1


def host_reputation(outcomes: DataFrame, z: float = 1.645, top_strength: float = 2.0) -> DataFrame:
    """(host, n, bad, mean, lower): the posterior share of bad pages of each host and its lower bound.

    outcomes: (host, n, bad), a row for each host, with n = bad = 0 where nothing is labelled. Counts shrink
    from host to registered domain to suffix to the whole: each level's prior is a beta whose mean is the
    posterior mean above it and whose weight fits the beta-binomial spread of that level.
    """
    hosts = outcomes.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    x = hosts.agg(F.sum("bad"), F.sum("n")).first()
    overall = ((x[0] or 0) + 0.5) / ((x[1] or 0) + 1)
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = suffixes.select("suffix", ((F.col("bad") + top_strength * overall) / (F.col("n") + top_strength)).alias("above"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    weight = _strength(domains, "above")
    domains = domains.select("domain", ((F.col("bad") + weight * F.col("above")) / (F.col("n") + weight)).alias("above"))
    hosts = hosts.join(domains, "domain")
    weight = _strength(hosts, "above")
    mean = (F.col("bad") + weight * F.col("above")) / (F.col("n") + weight)
    return hosts.select("host", "n", "bad", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (F.col("n") + weight + 1))).alias("lower"))


def url_filter(pages: DataFrame, outcomes: DataFrame, most_bad: float = 0.5, z: float = 1.645, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, lower), a row for each row of pages (page_id, url).

    outcomes: (page_id, bad 0/1). A page under a rule gets the rule's verdict; any other is blocked when the
    posterior lower bound of its host's share of bad pages exceeds most_bad, so little evidence blocks nothing.

    A url that is null or has no :// has an empty host and path, fits no rule, and belongs to the host ''. Null
    page_ids and pages without an outcome are judged and teach nothing; null outcomes are ignored; of several
    outcomes of a page the worst counts; repeated rows each count. Other columns are not read. Hot hosts are
    counted map-side and their join is left to AQE. An empty table gives no rows.
    """
    with scratch(pages.sparkSession):
        urls = only(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        worst = only(outcomes, "page_id", "bad").where("bad is not null").groupBy("page_id").agg(F.max("bad").cast("double").alias("bad"))
        counts = urls.join(worst, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
        known = stored(host_reputation(stored(counts, "hosts"), z), "reputation")
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        out = urls.join(known.select("host", "mean", "lower"), "host").select(
            "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("lower") > most_bad, "block").otherwise("allow")).alias("verdict"), "mean", "lower"
        )
        return kept(out, "judged-pages")
