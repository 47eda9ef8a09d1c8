"""Text, date and URL expressions. Null and '' both mean missing; all stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECRET = r"sk-[A-Za-z0-9_-]{8,}|(?i:bearer)\s+[A-Za-z0-9._-]{12,}|AKIA[0-9A-Z]{16}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d ()-]{7,}\d"


#: What (?U)\s takes.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space at the ends; null is ''."""
    return F.trim(F.coalesce(x, F.lit("")), F.lit(SPACES))


def content_hash(x: Column) -> Column:
    """sha256 of the text with line ends made equal and the ends stripped."""
    return F.sha2(strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n")), 256)


def normalize_url(url: Column) -> Column:
    """Scheme and host lower-cased, default port and fragment dropped, runs of / in the path squeezed, query kept."""
    part = lambda n: F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", n)
    host = F.lower(part(2))
    host = F.when(F.lower(part(1)) == "http", F.regexp_replace(host, r":80$", "")).when(F.lower(part(1)) == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    return F.when(part(2) == "", F.lit("")).otherwise(F.concat(F.lower(part(1)), F.lit("://"), host, F.regexp_replace(part(3), "/+", "/"), part(4)))


def date_in(x: Column) -> Column:
    """The first date like 2024-5-6, 2024/5/6 or 2024年5月6日 as a date; null if there is none or it is none in the calendar."""
    pattern = r"(20\d{2})[年./-](\d{1,2})[月./-](\d{1,2})"
    part = lambda n: F.regexp_extract(x, pattern, n)
    return F.try_to_date(F.concat(part(1), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")


def title_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)[\W_]+", "")


def compact(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")


def occurrences(x: Column, term: str) -> Column:
    """How often the term stands in the text, not overlapping."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(term), F.lit("")))) / len(term)).cast("int")


def clamp(x: Column) -> Column:
    """0 to 100, halves to the even neighbour."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(x))).cast("int")


def level(score: Column, high: int, medium: int) -> Column:
    return F.when(score >= high, "高").when(score >= medium, "中").otherwise("低")


def contains(text: Column, term: str, patterns: dict[str, str] | None = None) -> Column:
    """The term as a substring, ignoring case, or by its pattern; text is lower-cased already."""
    if patterns and term in patterns:
        return text.rlike(patterns[term])
    return F.contains(text, F.lit(term.lower()))


def host_allowed(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    ok = F.lit(False)
    for d in domains:
        ok = ok | (host == d) | F.endswith(host, F.lit(f".{d}"))
    return ok


def index_terms(x: Column) -> Column:
    """The terms of a text in order, with repeats: runs of two or more CJK or word characters; CJK runs of four or more give their bigrams too."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[一-鿿]{2,}|[a-zA-Z0-9_]{2,}"), F.lit(0))
    cut = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^[一-鿿]{4,}$"), F.concat(F.array(r), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))).otherwise(F.array(r))))
    return F.when(x.rlike(r"[一-鿿]{4}"), cut).otherwise(runs)  # without such a run there is nothing to cut


def search_terms(x: Column) -> Column:
    """The distinct terms of index_terms(), in order."""
    return F.array_distinct(index_terms(x))


def redact(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, SECRET, "[secret]"), EMAIL, "[email]")
