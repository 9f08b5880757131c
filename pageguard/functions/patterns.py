"""Patterns and lookup values for personal data, as Spark columns use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. White space and word boundaries are spelt out, because Java's \s and \b differ from the ones meant here.
SPACE = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = rf"(\+\d{{1,3}}[{SPACE}.-]?)?(\(?\d{{2,4}}\)?[{SPACE}.-]?)?\d{{3,4}}[{SPACE}.-]?\d{{3,4}}{BOUNDARY}"
CARD = rf"{BOUNDARY}(?:\d[ -]?){{13,19}}{BOUNDARY}"
IPV4 = rf"{BOUNDARY}(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d){BOUNDARY}"
NAME_LABEL = r"(?i)\b(name|passenger|patient|customer|guest)\b"
NAME_VALUE = rf"^[A-Z][a-z]+([{SPACE}][A-Z][a-z]+){{1,2}}$"
CONFIDENCE = {"EMAIL": 0.98, "CARD": 0.95, "PHONE": 0.80, "IP_ADDRESS": 0.90, "SENSITIVE_URL_PARAM": 0.70, "NAME": 0.60}
SENSITIVE_QUERY_KEYS = ["token", "access_token", "auth", "password", "pwd", "email", "ssn", "api_key", "apikey", "key", "session", "sid"]
LOG_KEYS = ["value", "text", "password", "email", "phone", "card", "cardNumber", "ssn", "name", "dob", "screenshot", "dataUrl", "raw"]
LINE_MARK = "[REDACTED - sensitive text on this line]"
REDACTED = "[REDACTED]"
#: Hits whose places are summed up in one go.
_BLOCK = 64


def trim(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def found(text: Column, pattern: str) -> Column:
    """All whole matches, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def found_if(guard: Column, text: Column, pattern: str) -> Column:
    """found(), where a cheap test says that there can be a match."""
    return F.when(guard, found(text, pattern)).otherwise(F.array().cast("array<string>"))


def emails(text: Column) -> Column:
    return found_if(F.contains(text, F.lit("@")), text, EMAIL)


def phones(text: Column) -> Column:
    hits = found_if(text.rlike(r"\d{3}"), text, PHONE)
    return F.filter(hits, lambda m: F.length(digits(m)).between(7, 15))


def cards(text: Column) -> Column:
    hits = found_if(text.rlike(r"\d[ -]?\d[ -]?\d"), text, CARD)
    return F.filter(hits, lambda m: F.length(digits(m)).between(13, 19) & luhn(digits(m)))


def ipv4s(text: Column) -> Column:
    return found_if(text.rlike(r"\d\.\d"), text, IPV4)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check sum of a string of digits holds."""
    parts = F.transform(F.reverse(F.split(number, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def with_places(df: DataFrame, name: str, text: Column, pattern: str, guard: Column | None = None) -> DataFrame:
    """df with an array `name` of the pattern's matches and their 0-based places in code points: match, start.

    Each step is a column of its own, so that both regular expressions run once a text. Places are running sums inside
    blocks of _BLOCK hits, on top of the blocks' own running sums: no step is quadratic in a text's hits.
    """
    none = F.array().cast("array<string>")
    if_any = lambda c: c if guard is None else F.when(guard, c).otherwise(none)
    hits, blocks, base = (f"_{name}_{x}" for x in ("hits", "blocks", "base"))
    own = df.withColumns({hits: if_any(found(text, pattern)), blocks: if_any(F.split(text, pattern, -1))})
    # The last gap, after all hits, is left out.
    own = own.withColumn(hits, F.zip_with(hits, F.slice(blocks, 1, F.size(hits)), lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap"))))
    places = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    own = own.withColumn(blocks, F.transform(places, lambda i: F.slice(hits, i * _BLOCK + 1, _BLOCK)))
    size = lambda x: x["gap"] + F.length(x["match"])
    total = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + size(x))
    own = own.withColumn(base, F.aggregate(F.transform(blocks, total), F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<match:string,start:int>>").alias("out"))

    def inside(block: Column, first: Column) -> Column:
        step = lambda s, x: F.struct((s["end"] + size(x)).alias("end"), F.concat(s["out"], F.array(F.struct(x["match"].alias("match"), (s["end"] + x["gap"]).alias("start")))).alias("out"))
        return F.aggregate(block, start.withField("end", first), step, lambda s: s["out"])

    return own.withColumn(name, F.flatten(F.zip_with(blocks, F.slice(base, 1, F.size(blocks)), inside))).drop(hits, blocks, base)


def js_round(x: Column) -> Column:
    """Halves go up, for negative numbers too."""
    return F.floor(x + 0.5)
