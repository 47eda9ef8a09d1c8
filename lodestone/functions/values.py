"""Expressions that check and normalise single values: URLs, lists, labels, parsed model output. Null counts as ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EMAIL, strip

# Characters of wrongly decoded text, and patterns of personal data.
MOJIBAKE = "åäçÃ�"
PERSONAL = (r"\b1[3-9]\d{9}\b", r"\b\d{17}[0-9Xx]\b", EMAIL, r"(?:手机号|身份证|家庭住址|私人邮箱|客户内部|非公开数据)\s*[:：]")
API_KEY, BEARER, LOCAL_PATH = r"(?i)\bsk-[A-Za-z0-9_-]{8,}\b", r"(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;]+", r"(?i)[A-Z]:\\(?:[^\\\s]+\\)+[^\s]*"
# What an error text says of a source, in order.
ERROR_CLASSES = {
    "permission_review": ("robots", "条款", "许可"),
    "manual_only": ("javascript", "微信", "登录", "验证码"),
    "needs_adapter": ("选择器", "结构", "0条", "未发现链接", "合格正文0", "正文质量"),
    "disabled": ("明确禁止", "暂停"),
}


def any_of(text: Column, terms) -> Column:
    """Any of the terms stands in the text."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def first_class(text: Column, classes: dict[str, tuple[str, ...]], default) -> Column:
    """The first class, in order, any of whose terms stands in the lower-cased text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(default) if isinstance(default, str) else default
    for name, terms in reversed(classes.items()):
        out = F.when(any_of(low, terms), F.lit(name)).otherwise(out)
    return out


def valid_source_url(url: Column) -> Column:
    """http or https, a host, no white space."""
    return F.coalesce(strip(url).rlike(r"^https?://[^/?#\s][^\s]*$"), F.lit(False))


def url_policy(url: Column) -> Column:
    """ok, or the first rule that forbids a request: white_space, scheme, host, credentials, port, local_host, local_address.

    Addresses are IPv4 literals; names are not resolved.
    """
    value = strip(url)
    authority = F.regexp_extract(value, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    port = F.try_to_number(F.nullif(F.regexp_extract(authority, r":(\d{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("long")
    octet = lambda i: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int")
    a, b = octet(1), octet(2)
    private = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    return (
        F.when((value == "") | value.rlike(r"\s"), "white_space").when(~value.rlike(r"^(?i)https?://"), "scheme").when(host == "", "host").when(F.contains(authority, F.lit("@")), "credentials")
        .when(authority.rlike(r":\d+$") & ~F.coalesce(port.between(1, 65535), F.lit(False)), "port").when(host.rlike(r"^localhost$|\.(localhost|local|internal)$"), "local_host").when(F.coalesce(private, F.lit(False)), "local_address").otherwise("ok")
    )


def string_list(x: Column) -> Column:
    """The parts between commas, semicolons, 、, bars and line ends, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[,，;；、|\n]+"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def confidence(x: Column) -> Column:
    """A label (high 0.85, medium 0.65, low 0.35) or the first number, as a percentage above 1; null without either."""
    text = F.lower(strip(x))
    number = F.regexp_extract(text, r"\d+(?:\.\d+)?", 0).try_cast("double")
    label = F.when(text.isin("high", "高"), 0.85).when(text.isin("medium", "中"), 0.65).when(text.isin("low", "低"), 0.35)
    return F.coalesce(label, F.when((number > 1) & (number <= 100), number / 100).otherwise(number))


def encoding_anomaly(title: Column, text: Column) -> Column:
    """A struct (bad, count, ratio): a replacement character, or five suspicious ones that make 1.2 percent."""
    return encoding_of(F.regexp_replace(F.concat(F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))), r"(?U)\s+", ""))


def encoding_of(sample: Column) -> Column:
    """The same of a title and a text without white space."""
    count = (F.length(sample) - F.length(F.regexp_replace(sample, f"[{MOJIBAKE}]", ""))).cast("int")
    ratio = count / F.greatest(F.length(sample), F.lit(1))
    return F.struct((F.contains(sample, F.lit("�")) | ((count >= 5) & (ratio >= 0.012))).alias("bad"), count.alias("count"), F.bround(ratio, 4).alias("ratio"))


def personal_data(x: Column) -> Column:
    """Whether the text holds a mobile number, an identity number, an e-mail address or a labelled private field."""
    text, out = F.coalesce(x, F.lit("")), F.lit(False)
    for p in PERSONAL:
        out = out | text.rlike(p)
    return out


def redact_log(x: Column, limit: int = 300) -> Column:
    """Keys, bearer headers and local paths hidden, cut to `limit` characters."""
    out = F.regexp_replace(F.coalesce(x, F.lit("")), API_KEY, "sk-****")
    return F.substr(F.regexp_replace(F.regexp_replace(out, BEARER, "$1****"), LOCAL_PATH, "[path]"), F.lit(1), F.lit(limit))


def first_sentence(x: Column, most: int = 180) -> Column:
    """The first sentence of 4 to `most` characters with its mark, as it stands in the text; without one the first line of 4 characters; else ''."""
    text = F.coalesce(x, F.lit(""))
    whole = F.regexp_extract(text, r"(?:^|[。！？!?；;\n])([^。！？!?；;\n]{4,}+[。！？!?；;][”’\"'」』]?)", 1)  # tried at the ends of sentences only, so in one pass
    found = F.regexp_extract(whole, r"[^。！？!?；;\n]{4,%d}[。！？!?；;][”’\"'」』]?$" % most, 0)
    line = F.get(F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= 4), F.lit(0))
    return F.trim(F.coalesce(F.nullif(found, F.lit("")), F.substr(line, F.lit(1), F.lit(most)), F.lit("")))


def excerpt(quotes: Column, failure: Column, note: Column, limit: int = 220) -> Column:
    """The bound quotes, or why they failed, or the quote of a note, or a fixed text."""
    text = lambda c: F.nullif(strip(c), F.lit(""))
    noted = F.nullif(F.trim(F.regexp_extract(F.coalesce(note, F.lit("")), r"证据片段[：:]\s*(.+?)(?:\s+证据片段未通过|\s+重复候选[：:]|\s+人工QA复核[：:]|$)", 1)), F.lit(""))
    short = lambda c, n: F.substr(c, F.lit(1), F.lit(n))
    return F.coalesce(short(text(quotes), limit), F.concat(F.lit("需回原文核验："), short(text(failure), max(20, limit - 8))), short(noted, limit), F.lit("未保存可定位证据片段，需回到原文核验。"))


def noted_quotes(note: Column, most: int = 5) -> Column:
    """The quotes of a note: its segment after 证据片段, cut at ｜, those of 4 characters and more."""
    segment = F.regexp_extract(F.coalesce(note, F.lit("")), r"证据片段[：:]\s*([\s\S]+?)(?:\s+证据片段未通过|\s+重复候选[：:]|\s+人工QA复核[：:]|$)", 1)
    return F.slice(F.filter(F.transform(F.split(segment, "｜"), lambda q: F.trim(q)), lambda q: F.length(q) >= 4), 1, most)


def json_object(x: Column, kind: str) -> Column:
    """The object as a map, empty where it can't be read."""
    return F.coalesce(F.from_json(F.coalesce(x, F.lit("")), f"map<string,{kind}>"), F.create_map().cast(f"map<string,{kind}>"))


def strict_object(x: Column, allowed: tuple[str, ...], kind: str = "map<string,string>") -> Column:
    """A struct (ok, error, data): a JSON object, in a code fence or not, with none but the allowed keys."""
    body = F.regexp_replace(strip(x), r"^```[a-z]*\s*|\s*```$", "")
    keys = F.json_object_keys(body)
    error = F.when(keys.isNull(), "not_an_object").when(F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0, "unknown_field")
    return F.struct(error.isNull().alias("ok"), F.coalesce(error, F.lit("")).alias("error"), F.when(error.isNull(), F.from_json(body, kind)).alias("data"))


def review_label(verified: Column, reviewer: Column) -> Column:
    """human only where the flag stands and a human set it."""
    return F.when(F.coalesce(verified, F.lit(False)) & F.coalesce(reviewer == "human", F.lit(False)), "human_verified").when(F.coalesce(verified, F.lit(False)), "machine_checked").otherwise("unreviewed")
