"""Queries on pages with forms, hidden parts and controls.

The given pages hold no controls, so each customer's row is put into the HTML of a page of its own. The SQL never sees
that HTML: it says from the customer's columns what the page shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageguard.operators import page
from pageguard.sources import html
from pageguard.sources.tables import spread, table

BASE = "https://shop.example.org/account/form"
#: {k}, {m}, {name}, {segment} and {balance} are filled from columns; {on} and {off} are attributes that some pages have.
TEMPLATE = """<!DOCTYPE html><html><head><title>Account {m}</title><style>p{margin:0}</style></head><body><form id="f">
<p>  Segment of {segment}<p>Write to c{k}@example.com</p>
<input id="mail" value="c{k}@example.com" placeholder="Mail"><input type="password" value="secret {m}"><input type="hidden" value="{m}">
<input type="checkbox"{on}><select aria-label="Segment"><option value="1">None</option><option value="2" selected>{segment}</option></select>
<input aria-label="Full name" value="Ann {name}"><textarea>Balance {balance}</textarea><button{off}>Save {m}</button><button aria-disabled="true">Send</button></form>
<div style="display:none"><button>gone</button><p>secret {m}</p></div><div hidden><a href="/gone">gone</a></div>
<div style="color: red; visibility: hidden"><button>unseen</button><b>unseen</b> <i style="visibility: visible">seen {m}</i></div>
<p style="opacity: 0">faint</p><noscript>none</noscript>
<ul><li>one<li data-testid="second">two {m}<li>three</ul><div role="tab">Tab {m}</div><span style="cursor: pointer">Card {m}</span>
<section style="cursor: pointer" tabindex="-1">odd</section><a href="/reset?token={m}">Reset</a><a id="dup" href="#a">first</a><a id="dup" href="#b">second</a></body></html>"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    filled = {
        "k": k.cast("string"),
        "m": (k % 1000).cast("string"),
        "name": F.initcap("c_mktsegment"),
        "segment": F.col("c_mktsegment"),
        "balance": F.floor(F.abs("c_acctbal")).cast("string"),
        "on": F.when(k % 2 == 0, " checked").otherwise(""),
        "off": F.when(k % 3 == 0, " disabled").otherwise(""),
    }
    text = F.lit(TEMPLATE)
    for name, value in filled.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    rows = spread(table(spark, sf_dir, "customer").select(k.cast("long").alias("page_id"), "c_custkey", "c_mktsegment", "c_acctbal"), "page_id")
    # A customer's row is short beside its page: the customers' size says nothing of what a broadcast of pages takes.
    return rows.hint("merge").select("page_id", F.lit(BASE).alias("url"), text.alias("html"))


def _nodes(pages: DataFrame) -> DataFrame:
    """The node table. Pages are dealt by page_id before they are parsed, and what follows goes by page_id: each query goes
    through it once, so it is neither written nor shuffled.
    """
    return html.nodes(pages)


def form_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible controls: kinds, labels, values that may be passed on, and whether they can be used."""
    out = page.elements(_nodes(_pages(spark, sf_dir)))
    return out.select("page_id", "element_id", "type", "text", "aria_label", "placeholder", "value", "href", "enabled")


def form_text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown text in order, with its leading blanks and the control that it belongs to."""
    runs = page.runs_of(_nodes(_pages(spark, sf_dir)))
    place = F.row_number().over(page.Window.partitionBy("page_id").orderBy("node_id")).cast("long")
    return runs.select("page_id", place.alias("place"), "text", F.col("lead_ws").cast("long").alias("lead_ws"), "element_id")


def form_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive items of text, links and values, with the control that holds them."""
    pages = _pages(spark, sf_dir)
    items = page.items_of(pages, _nodes(pages))
    return items.select("page_id", "type", "masked", F.round(F.col("confidence").cast("double"), 2).alias("confidence"), "element_id")


def form_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors of the controls and of the list."""
    found = page.selectors(page.numbered(_nodes(_pages(spark, sf_dir))), ["tag", "element_id"])
    return found.where("tag = 'li' or element_id is not null").select("page_id", "element_id", "selector")


def form_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of a page found again, by their selectors, in a later state of it without its button to save and its list."""
    pages = _pages(spark, sf_dir)
    later = _nodes(pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<button[^>]*>Save .*?</button>", ""), "(?s)<ul>.*?</ul>", "")))
    now = page.selectors(page.numbered(_nodes(pages)), ["element_id"]).where("element_id is not null")
    return page.resolve_again(now, page.selectors(later)).select("page_id", "element_id", F.col("new_node").isNotNull().alias("found"))


def form_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of what is extracted of each page."""
    pages = _pages(spark, sf_dir)
    return page.extraction(pages, _nodes(pages)).select("page_id", "n_elements", "n_visible_text", "n_sensitive_items")


def form_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each page's details report, and its counts as lines of their own."""
    pages = _pages(spark, sf_dir)
    report = page.details(page.extraction(pages, _nodes(pages)))
    counts = [F.struct(F.lit(n).alias("tag"), F.col(c).cast("string").alias("line")) for n, c in (("elements", "n_elements"), ("sensitive", "n_sensitive"))]
    parts = F.map_from_arrays(F.array(*map(F.lit, ("count", "element", "sensitive"))), F.array(F.array(*counts), F.col("elements"), F.col("sensitive")))
    return report.select("page_id", F.explode(parts).alias("part", "lines")).select("page_id", "part", F.inline("lines"))


QUERIES = {f.__name__: f for f in (form_elements, form_text_runs, form_items, form_selectors, form_rejoin, form_extraction, form_details)}

_C = f"c as (select c_custkey as page_id, c_custkey as k, c_custkey % 1000 as m, c_mktsegment as segment, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as name, floor(abs(c_acctbal))::bigint as balance from customer)"
#: Controls in order: type, text, aria-label, placeholder, value, href, enabled, selector, whether it is there later.
_CONTROLS = [
    ("'input:text'", "'[REDACTED]'", "null", "'Mail'", "'[REDACTED]'", "null", "true", "'#mail'", "true"),
    ("'input:password'", "''", "null", "null", "null", "null", "true", "'#f > input:nth-of-type(2)'", "true"),
    ("'input:checkbox'", "''", "null", "null", "case when k % 2 = 0 then 'checked' else 'unchecked' end", "null", "true", "'#f > input:nth-of-type(4)'", "true"),
    ("'select'", "'Segment'", "'Segment'", "null", "segment", "null", "true", "'#f > select:nth-of-type(1)'", "true"),
    ("'input:text'", "'Full name'", "'Full name'", "null", "'Ann ' || name", "null", "true", "'#f > input:nth-of-type(5)'", "true"),
    ("'textarea'", "'Balance ' || balance", "null", "null", "'Balance ' || balance", "null", "true", "'#f > textarea:nth-of-type(1)'", "true"),
    ("'button'", "'Save ' || m", "null", "null", "null", "null", "k % 3 <> 0", "'#f > button:nth-of-type(1)'", "true"),
    ("'button'", "'Send'", "null", "null", "null", "null", "false", "'#f > button:nth-of-type(2)'", "false"),
    ("'role:tab'", "'Tab ' || m", "null", "null", "null", "null", "true", "'html > body:nth-of-type(1) > div:nth-of-type(4)'", "true"),
    ("'section'", "'odd'", "null", "null", "null", "null", "true", "'html > body:nth-of-type(1) > section:nth-of-type(1)'", "true"),
    ("'link'", "'Reset'", "null", "null", "null", "'/reset?token=' || m", "true", "'html > body:nth-of-type(1) > a:nth-of-type(1)'", "true"),
    ("'link'", "'first'", "null", "null", "null", "'#a'", "true", "'html > body:nth-of-type(1) > a:nth-of-type(2)'", "true"),
    ("'link'", "'second'", "null", "null", "null", "'#b'", "true", "'html > body:nth-of-type(1) > a:nth-of-type(3)'", "true"),
    ("'span'", "'Card ' || m", "null", "null", "null", "null", "true", "'html > body:nth-of-type(1) > span:nth-of-type(1)'", "true"),
]
#: Shown text in order: text, leading blanks, control. A line break of the template is a leading blank.
_RUNS = [
    ("'Account ' || m", 0, "null"),
    ("'Segment of ' || segment", 2, "null"),
    ("'Write to c' || k || '@example.com'", 0, "null"),
    ("'None'", 0, "3"),
    ("segment", 0, "3"),
    ("'Balance ' || balance", 0, "5"),
    ("'Save ' || m", 0, "6"),
    ("'Send'", 0, "7"),
    ("'seen ' || m", 0, "null"),
    ("'one'", 0, "null"),
    ("'two ' || m", 0, "null"),
    ("'three'", 0, "null"),
    ("'Tab ' || m", 0, "8"),
    ("'Card ' || m", 0, "13"),
    ("'odd'", 0, "9"),
    ("'Reset'", 0, "10"),
    ("'first'", 0, "11"),
    ("'second'", 0, "12"),
]
_MASKED = "case when len('c' || k) <= 2 then repeat('*', len('c' || k)) else 'c' || repeat('*', len('c' || k) - 2) || (k % 10) end || '@example.com'"


def _rows(select: list[str]) -> str:
    return f"with {_C} " + " union all ".join(f"select page_id, {s} from c" for s in select)


ORACLE_SQL = {
    "form_elements": _rows([f"{i}::bigint as element_id, {t} as type, {x} as text, {a}::varchar as aria_label, {p}::varchar as placeholder, {v}::varchar as value, {h}::varchar as href, {e} as enabled" for i, (t, x, a, p, v, h, e, _, _) in enumerate(_CONTROLS)]),
    "form_text_runs": _rows([f"{i + 1}::bigint as place, {t} as text, {n}::bigint as lead_ws, {e}::bigint as element_id" for i, (t, n, e) in enumerate(_RUNS)]),
    "form_items": _rows([
        f"'EMAIL' as type, {_MASKED} as masked, 0.98::double as confidence, null::bigint as element_id",
        f"'EMAIL', {_MASKED}, 0.98, 0",
        "'SENSITIVE_URL_PARAM', 'https://shop.example.org/reset?...', 0.7, 10",
        "'NAME', 'A' || repeat('*', len(name) + 3), 0.6, 4",
    ]),
    "form_selectors": _rows([f"{i}::bigint as element_id, {s} as selector" for i, (*_, s, _) in enumerate(_CONTROLS)] + ["null, 'html > body:nth-of-type(1) > ul:nth-of-type(1) > li:nth-of-type(1)'", "null, '[data-testid=\"second\"]'", "null, 'html > body:nth-of-type(1) > ul:nth-of-type(1) > li:nth-of-type(3)'"]),
    "form_rejoin": _rows([f"{i}::bigint as element_id, {f} as found" for i, (*_, f) in enumerate(_CONTROLS)]),
    "form_details": _rows(
        [f"'element' as part, {t} as tag, '[{i}] ' || coalesce(nullif({x}, ''), nullif({p}, ''), nullif({a}, ''), '(no label)') as line" for i, (t, x, a, p, *_) in enumerate(_CONTROLS)]
        + [f"'count', 'elements', '{len(_CONTROLS)}'", "'count', 'sensitive', '4'", *[f"'sensitive', 'EMAIL', {_MASKED} || '  (confidence 98%)'"] * 2]
        + ["'sensitive', 'SENSITIVE_URL_PARAM', 'https://shop.example.org/reset?...  (confidence 70%)'", "'sensitive', 'NAME', 'A' || repeat('*', len(name) + 3) || '  (confidence 60%)'"]
    ),
    "form_extraction": _rows([f"{len(_CONTROLS)}::bigint as n_elements, {len(_RUNS)}::bigint as n_visible_text, 4::bigint as n_sensitive_items"]),
}
