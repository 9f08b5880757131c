"""Personal data in text columns: items, offsets, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageguard.functions import masking, patterns, urls
from pageguard.functions.patterns import CONFIDENCE

_KINDS = {
    "EMAIL": (patterns.emails, masking.mask_email),
    "CARD": (patterns.cards, masking.mask_card),
    "PHONE": (patterns.phones, masking.mask_phone),
    "IP_ADDRESS": (patterns.ipv4s, masking.mask_ip),
}


def items(text: Column, kinds: list[str] | None = None) -> Column:
    """Array of type, match, masked and confidence: the union of all kinds' hits, which may overlap."""

    def of(kind: str) -> Column:
        find, hide = _KINDS[kind]
        return F.transform(find(text), lambda m: F.struct(F.lit(kind).alias("type"), m.alias("match"), hide(m).alias("masked"), F.lit(CONFIDENCE[kind]).alias("confidence")))

    return F.concat(*(of(k) for k in kinds or _KINDS))


def detect(df: DataFrame, id_col: str, text_col: str, kinds: list[str] | None = None) -> DataFrame:
    """One row per item. Texts are scanned once; rows without items go before the explode."""
    found = df.select(id_col, items(F.col(text_col), kinds).alias("_items")).where(F.size("_items") > 0)
    return found.select(id_col, F.explode("_items").alias("_item")).select(id_col, "_item.*")


def has_items(text: Column) -> Column:
    return F.size(items(text)) > 0


def _with_raw(df: DataFrame, text: Column) -> DataFrame:
    """df with an array of raw hits (start, match) for each kind, in a column of its name."""
    raw = {
        "EMAIL": (patterns.EMAIL, F.contains(text, F.lit("@"))),
        "CARD": (patterns.CARD, text.rlike(r"\d[ -]?\d[ -]?\d")),
        "PHONE": (patterns.PHONE, text.rlike(r"\d{3}")),
        "IP_ADDRESS": (patterns.IPV4, text.rlike(r"\d\.\d")),
    }
    for kind, (pattern, guard) in raw.items():
        df = patterns.with_places(df, kind, text, pattern, F.coalesce(guard, F.lit(False)))
    return df


def offsets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """type, start (0-based code point) and match of every raw pattern hit, before length and checksum tests."""
    own = _with_raw(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), F.col("_text"))

    def typed(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("type"), x["start"].alias("start"), x["match"].alias("match")))

    return own.select(F.col("_id").alias(id_col), F.explode(F.concat(*map(typed, _KINDS))).alias("_item")).select(id_col, "_item.*")


def with_placed_items(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with items() of the text in a column, each with its start (0-based code point): raw hits that pass the tests."""
    own = _with_raw(df, F.col(text_col))

    def placed(kind: str) -> Column:
        find, hide = _KINDS[kind]
        passed = find(F.col(text_col))
        hits = F.filter(kind, lambda x: F.array_contains(passed, x["match"]))
        return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("type"), x["match"].alias("match"), hide(x["match"]).alias("masked"), F.lit(CONFIDENCE[kind]).alias("confidence"), x["start"].alias("start")))

    return own.withColumn(name, F.concat(*map(placed, _KINDS))).drop(*_KINDS)


def bare_name(label: Column, value: Column, seen: Column) -> Column:
    """Whether a field labelled like a name holds two or three capitalised words, and no name was seen in it."""
    ok = label.rlike(patterns.NAME_LABEL) & patterns.trim(value).rlike(patterns.NAME_VALUE) & ~seen
    return F.coalesce(ok, F.lit(False))


def redact_value(value: Column) -> Column:
    return F.when(has_items(value), F.lit(patterns.REDACTED)).otherwise(value)


def redact_line(text: Column) -> Column:
    return F.when(has_items(text), F.lit(patterns.LINE_MARK)).otherwise(F.substring(text, 1, 300))


def url_item(href: Column, base: Column) -> Column:
    """type, masked, confidence and params of a link whose query has secret keys, else null."""
    full = urls.normalised(urls.resolve(patterns.trim(href), base))
    keys = urls.sensitive_keys(full)
    item = F.struct(F.lit("SENSITIVE_URL_PARAM").alias("type"), urls.masked_url(full).alias("masked"), F.lit(CONFIDENCE["SENSITIVE_URL_PARAM"]).alias("confidence"), keys.alias("params"))
    return F.when(href.isNotNull() & (href != "") & (F.size(keys) > 0), item)
