"""Queries on personal data in text, URLs and form values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageguard.functions import masking, patterns, urls
from pageguard.functions.geometry import in_viewport
from pageguard.operators import detect, rendered
from pageguard.operators.layout import text_box
from pageguard.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _kind(kind: str):
    return lambda spark, sf_dir: detect.detect(_docs(spark, sf_dir), "doc_id", "text", [kind])


def mask_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(_docs(spark, sf_dir), "doc_id", "text").drop("match")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_all(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n_items"), F.countDistinct("doc_id").alias("n_docs"))


def pii_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.offsets(_docs(spark, sf_dir), "doc_id", "text").withColumn("start", F.col("start").cast("long"))


def match_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-pixel boxes of all raw hits that lie in the viewport, in text set at a fixed pitch."""
    hits = detect.offsets(_docs(spark, sf_dir), "doc_id", "text")
    box = text_box(F.col("start"), F.length("match"))
    kept = hits.where(in_viewport(box, F.lit(1280.0), F.lit(720.0)))
    return kept.select("doc_id", "type", *(patterns.js_round(c).alias(n) for n, c in zip(box._fields, box)))


def range_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where all raw hits lie in texts that are laid out in lines of 80 characters of 8 x 16 pixels; null if off the screen."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.lit(0).alias("node_id"), "text")
    n = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 80).cast("int"))).alias("n")
    lines = docs.where(F.length("text") > 0).select("page_id", "node_id", F.length("text").alias("size"), n).withColumn("start", F.col("n") * 80).withColumn("end", F.least(F.col("start") + 80, F.col("size")))
    at = {"x": F.lit(0), "y": F.col("n") * 16, "width": (F.col("end") - F.col("start")) * 8, "height": F.lit(16)}
    lines = lines.select("page_id", "node_id", "start", "end", *(c.cast("double").alias(k) for k, c in at.items()))
    views = docs.select("page_id", F.lit(600).alias("width"), F.lit(4800).alias("height")).distinct()
    hits = detect.offsets(docs, "page_id", "text").select("page_id", F.lit(0).alias("node_id"), "start", (F.col("start") + F.length("match")).alias("end")).distinct()
    out = rendered.range_boxes(hits, rendered.Layout(lines.limit(0), lines, views))
    return out.select(F.col("page_id").alias("doc_id"), *(F.col(c).cast("long").alias(c) for c in ("start", "end")), *(F.col(f"bbox.{c}").alias(c) for c in ("x", "y", "width", "height")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), patterns.trim(F.col("raw")).alias("text")).where("text <> ''")


def redact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line", detect.redact_line(F.col("text")).alias("text"))


def redact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line as the value of a form control."""
    return _docs(spark, sf_dir).select("doc_id", detect.redact_value(F.split_part("text", F.lit("\n"), F.lit(1))).alias("value"))


def redact_line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of each document as the value of a form control."""
    return _lines(spark, sf_dir).select("doc_id", "line", detect.redact_value(F.col("text")).alias("value"))


def bare_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "nation").select("n_nationkey", F.initcap("n_name").alias("value"), F.when(F.col("n_nationkey") % 3 == 0, "Full name").when(F.col("n_nationkey") % 3 == 1, "Guest").otherwise("City").alias("label"))
    named = detect.bare_name(F.col("label"), F.col("value"), F.lit(False))
    return fields.select("n_nationkey", named.alias("is_name"), F.when(named, masking.mask_name(patterns.trim(F.col("value")))).alias("masked"))


def flagged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(detect.has_items(F.col("text"))).select("doc_id", "lang", "source")


def clean_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(~detect.has_items(F.col("text"))).groupBy("lang").agg(F.count("*").alias("n_docs"))


def no_pii_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in conversations by role."""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(F.size(detect.items(F.col("text")))).alias("n_items"), F.count("*").alias("n_turns"))


def scan_http_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = urls.is_http(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.when(~ok, "unsupported_scheme").alias("error"))


def url_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs with a query added by page_id, so that some carry secret keys."""
    extra = F.element_at(F.array(*map(F.lit, ["", "?token=abc&email=a%40b.co", "?q=1&Session=9", "?page=2", "?api%5Fkey=z&next=/x"])), (F.col("page_id") % 5 + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), extra).alias("href"), "url")
    item = detect.url_item(F.col("href"), F.col("url"))
    return pages.select("page_id", item.isNotNull().alias("flagged"), item["masked"].alias("masked"), F.array_join(item["params"], ",").alias("params"))


def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every <a href> of a page against its URL, with a flag for secret query keys."""
    hrefs = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    links = table(spark, sf_dir, "pages").select("page_id", "url", hrefs.alias("href"))
    return links.groupBy("page_id", urls.resolve(F.col("href"), F.col("url")).alias("target")).agg(F.count("*").alias("n_links"))


def dataurl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names as image data URLs, every fifth one broken."""
    body = F.base64(F.encode(F.col("r_name"), "UTF-8"))
    url = F.when(F.col("r_regionkey") % 5 == 4, F.concat(F.lit("data:text/plain;base64,"), body)).otherwise(F.concat(F.lit("data:image/png;base64,"), body))
    mime, raw = urls.data_url_parts(url)
    return table(spark, sf_dir, "region").select("r_regionkey", mime.alias("mime"), F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha256"))


QUERIES = {
    "mask_all": mask_all,
    "pii_email": _kind("EMAIL"),
    "pii_phone": _kind("PHONE"),
    "pii_card": _kind("CARD"),
    "pii_ipv4": _kind("IP_ADDRESS"),
    "pii_counts": pii_counts,
    "pii_offsets": pii_offsets,
    "match_boxes": match_boxes,
    "range_boxes": range_boxes,
    "redact_lines": redact_lines,
    "redact_values": redact_values,
    "redact_line_values": redact_line_values,
    "bare_name": bare_name,
    "flagged_docs": flagged_docs,
    "clean_docs": clean_docs,
    "no_pii_in_turns": no_pii_in_turns,
    "scan_http_pages": scan_http_pages,
    "url_flags": url_flags,
    "resolve_links": resolve_links,
    "dataurl_parse": dataurl_parse,
}

_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SPACE_SQL = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_PHONE = rf"(\+\d{{1,3}}[{SPACE_SQL}.-]?)?(\(?\d{{2,4}}\)?[{SPACE_SQL}.-]?)?\d{{3,4}}[{SPACE_SQL}.-]?\d{{3,4}}\b"
_CARD = r"\b(?:\d[ -]?){13,19}\b"
_IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
_EMAILS = f"""select {{id}}, 'EMAIL' as type, m as match,
  case when length(split_part(m, '@', 1)) <= 2 then repeat('*', length(split_part(m, '@', 1)))
    else left(m, 1) || repeat('*', length(split_part(m, '@', 1)) - 2) || right(split_part(m, '@', 1), 1) end || '@' || split_part(m, '@', 2) as masked,
  0.98::double as confidence from (select {{id}}, unnest(regexp_extract_all({{text}}, '{_EMAIL}', 0)) as m from {{src}})"""
_PHONES = f"""select {{id}}, 'PHONE' as type, m as match, repeat('*', length(d) - 2) || right(d, 2) as masked, 0.8::double as confidence
  from (select {{id}}, m, regexp_replace(m, '[^0-9]', '', 'g') as d from (select {{id}}, unnest(regexp_extract_all({{text}}, '{_PHONE}', 0)) as m from {{src}}))
  where length(d) between 7 and 15"""
_CARDS = f"""select {{id}}, 'CARD' as type, m as match, '**** **** **** ' || right(d, 4) as masked, 0.95::double as confidence
  from (select {{id}}, m, regexp_replace(m, '[ -]', '', 'g') as d from (select {{id}}, unnest(regexp_extract_all({{text}}, '{_CARD}', 0)) as m from {{src}}))
  where length(d) between 13 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda i:
    (substr(d, length(d) + 1 - i, 1)::int * (2 - i % 2)) // 10 + (substr(d, length(d) + 1 - i, 1)::int * (2 - i % 2)) % 10)) % 10 = 0"""
_IPS = f"""select {{id}}, 'IP_ADDRESS' as type, m as match, repeat('*', length(split_part(m, '.', 1))) || '.' || repeat('*', length(split_part(m, '.', 2)))
  || '.' || split_part(m, '.', 3) || '.' || split_part(m, '.', 4) as masked, 0.9::double as confidence
  from (select {{id}}, unnest(regexp_extract_all({{text}}, '{_IP}', 0)) as m from {{src}})"""
_DOC = {"id": "doc_id", "text": "text", "src": "documents"}


def _over(sql: str, **names: str) -> str:
    for k, v in names.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def _all(**names: str) -> str:
    return " union all ".join(_over(s, **names) for s in (_EMAILS, _PHONES, _CARDS, _IPS))


_LINES = f"""select * from (select doc_id, g - 1 as line, regexp_replace(split_part(text, chr(10), g::int), '^[{SPACE_SQL}]+|[{SPACE_SQL}]+$', '', 'g') as text
  from (select doc_id, text, unnest(range(1, length(text) - length(replace(text, chr(10), '')) + 2)) as g from documents)) where text <> ''"""
_OFFSETS = " union all ".join(
    f"""select doc_id, '{k}' as type, (list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0))::bigint as start, ms[i] as match
  from (select doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) as i from (select doc_id, regexp_extract_all(text, '{p}', 0) as ms, string_split_regex(text, '{p}') as gaps from documents))"""
    for k, p in (("EMAIL", _EMAIL), ("CARD", _CARD), ("PHONE", _PHONE), ("IP_ADDRESS", _IP))
)

ORACLE_SQL = {
    "mask_all": f"select doc_id, type, masked, confidence from ({_all(**_DOC)})",
    "pii_email": _over(_EMAILS, **_DOC),
    "pii_phone": _over(_PHONES, **_DOC),
    "pii_card": _over(_CARDS, **_DOC),
    "pii_ipv4": _over(_IPS, **_DOC),
    "pii_counts": f"select type, count(*) as n_items, count(distinct doc_id) as n_docs from ({_all(**_DOC)}) group by type",
    "pii_offsets": _OFFSETS,
    "match_boxes": f"""select doc_id, type, start % 80 * 8 as x, start // 80 * 16 as y, length(match) * 8 as width, 16::bigint as height from ({_OFFSETS}) where start // 80 * 16 < 720 and start % 80 * 8 < 1280""",
    "range_boxes": f"""with h as (select distinct doc_id, start, start + length(match) as "end" from ({_OFFSETS})),
      p as (select *, start // 80 as a, ("end" - 1) // 80 as b from h),
      r as (select *, case when a = b then start % 80 * 8 else 0 end as x, a * 16 as y, case when a = b then ("end" - start) * 8 else 640 end as width, (b - a + 1) * 16 as height from p)
      select doc_id, start, "end", case when ok then x end as x, case when ok then y end as y, case when ok then width end as width, case when ok then height end as height
      from (select *, y < 4800 and x < 600 as ok from r)""",
    "redact_lines": f"""with lines as ({_LINES}), keyed as (select doc_id * 1000000 + line as k, * from lines),
      hit as (select distinct k from ({_all(id="k", text="text", src="keyed")}))
      select doc_id, line, case when hit.k is not null then '{patterns.LINE_MARK}' else substr(text, 1, 300) end as text from keyed left join hit using (k)""",
    "redact_values": f"""with firsts as (select doc_id, split_part(text, chr(10), 1) as value from documents),
      hit as (select distinct doc_id from ({_all(id="doc_id", text="value", src="firsts")}))
      select doc_id, case when hit.doc_id is not null then '[REDACTED]' else value end as value from firsts left join hit using (doc_id)""",
    "redact_line_values": f"""with lines as ({_LINES}), keyed as (select doc_id * 1000000 + line as k, * from lines),
      hit as (select distinct k from ({_all(id="k", text="text", src="keyed")}))
      select doc_id, line, case when hit.k is not null then '[REDACTED]' else text end as value from keyed left join hit using (k)""",
    "bare_name": """with f as (select n_nationkey, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') as value from nation)
      select n_nationkey, n_nationkey % 3 < 2 and regexp_matches(value, '^[A-Z][a-z]+(\\s[A-Z][a-z]+){1,2}$') as is_name,
      case when n_nationkey % 3 < 2 and regexp_matches(value, '^[A-Z][a-z]+(\\s[A-Z][a-z]+){1,2}$') then left(value, 1) || repeat('*', length(value) - 1) end as masked from f""",
    "flagged_docs": f"select doc_id, lang, source from documents where doc_id in (select doc_id from ({_all(**_DOC)}))",
    "clean_docs": f"select lang, count(*) as n_docs from documents where doc_id not in (select doc_id from ({_all(**_DOC)})) group by lang",
    "no_pii_in_turns": f"""with t as (select conv_id * 1000 + turn as k, role, text from conversations), i as ({_all(id="k", text="text", src="t")}), n as (select k, count(*) as n from i group by k)
      select role, coalesce(sum(n.n), 0)::bigint as n_items, count(*) as n_turns from t left join n using (k) group by role""",
    "scan_http_pages": "select page_id, url, case when regexp_matches(coalesce(url, ''), '^https?:') then null else 'unsupported_scheme' end as error from pages",
    "url_flags": """with p as (select page_id, regexp_replace(url, '[?#].*$', '') as head from pages)
      select page_id, page_id % 5 in (1, 2, 4) as flagged,
      case when page_id % 5 in (1, 2, 4) then head || case when regexp_matches(head, '^[a-z]+://[^/]*$') then '/' else '' end || '?...' end as masked,
      case page_id % 5 when 1 then 'token,email' when 2 then 'Session' when 4 then 'api_key' end as params from p""",
    "resolve_links": """with l as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages),
      r as (select page_id, case when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then href when href[1:2] = '//' then regexp_extract(url, '^[a-z]+:') || href
        when href[1] = '/' then regexp_extract(url, '^[a-z]+://[^/?#]*') || href when href[1] = '?' then regexp_extract(url, '^[^?#]*') || href
        when href[1] = '#' then regexp_extract(url, '^[^#]*') || href
        else regexp_extract(url, '^[a-z]+://[^/?#]*') || case when regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') end || href end as target from l)
      select page_id, target, count(*) as n_links from r group by all""",
    "dataurl_parse": """select r_regionkey, case when r_regionkey % 5 <> 4 then 'image/png' end as mime, case when r_regionkey % 5 <> 4 then strlen(r_name) end::bigint as n_bytes,
      case when r_regionkey % 5 <> 4 then sha256(r_name) end as sha256 from region""",
}
