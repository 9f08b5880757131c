"""Rules of pages' own stylesheets, as joins on the node table.

Only what decides whether and how something is shown is looked at: PROPERTIES. Selectors of tags, ids, classes, attributes
(present, or equal to a value), descendants and children count; rules with anything else (pseudo-classes, siblings) and
rules inside @media and the like are left out. Linked stylesheets are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageguard.operators.page import attr

PROPERTIES = ("display", "visibility", "opacity", "cursor")

_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_PART = re.compile(r"\s*(>?)\s*((?:\*|[a-zA-Z][\w-]*)?(?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:=(?:\"[^\"]*\"|'[^']*'|[\w-]+))?\])*)")
_PIECE = re.compile(r"([#.])([\w-]+)|\[([\w-]+)(?:=(?:\"([^\"]*)\"|'([^']*)'|([\w-]+)))?\]")


def selector_parts(selector: str) -> list[dict] | None:
    """A selector's parts from left to right: child (of the part before, not any ancestor), tag, and tests; None if it has others."""
    out, at, text = [], 0, selector.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m or not m[2] or m[1] and not out:
            return None
        if out and not m[1] and not text[at].isspace():
            return None
        tag = re.match(r"[a-zA-Z][\w-]*", m[2])
        tests = []
        for p in _PIECE.finditer(m[2]):
            value = next((v for v in p.groups()[3:] if v is not None), None)
            tests.append(p[1] + p[2] if p[1] else f"[{p[3].lower()}]" if value is None else f"[{p[3].lower()}={value}]")
        out.append({"child": bool(m[1]), "tag": tag[0].lower() if tag else None, "tests": tests})
        at = m.end()
    return out or None


def _without_blocks(css: str) -> str:
    """css without comments and without @-rules and what is in their braces."""
    css, out, at = _COMMENT.sub(" ", css), [], 0
    while (start := css.find("@", at)) >= 0:
        out.append(css[at:start])
        brace, end = css.find("{", start), css.find(";", start)
        if 0 <= end and (brace < 0 or end < brace):
            at = end + 1
            continue
        depth, at = 1, brace + 1 if brace >= 0 else len(css)
        while at < len(css) and depth:
            depth += (css[at] == "{") - (css[at] == "}")
            at += 1
    return "".join([*out, css[at:]])


def css_rules(css: str | None) -> list[tuple[int, list[dict], int, list[tuple[str, str, bool]]]]:
    """Of each selector of each rule: its place, parts, specificity, and declarations (property, value, important)."""
    out = []
    for n, (selectors, body) in enumerate(_RULE.findall(_without_blocks(css or ""))):
        found = []
        for line in body.split(";"):
            name, colon, value = line.partition(":")
            if colon and name.strip().lower() in PROPERTIES:
                value, mark, _ = value.partition("!")
                found.append((name.strip().lower(), value.strip().lower(), "important" in line.lower() and bool(mark)))
        for selector in selectors.split(",") if found else ():
            parts = selector_parts(selector)
            if parts:
                tests = [t for p in parts for t in p["tests"]]
                weight = 10_000 * sum(t[0] == "#" for t in tests) + 100 * sum(t[0] != "#" for t in tests) + sum(p["tag"] is not None for p in parts)
                out.append((n, parts, weight, found))
    return out


_PARTS = "array<struct<child:boolean,tag:string,tests:array<string>>>"
_RULES = f"rule long, parts {_PARTS}, weight int, declared array<struct<name:string,value:string,important:boolean>>"


def sheet_rules(nodes: DataFrame) -> DataFrame:
    """page_id, rule (in the order of the page's rules), parts, weight and declared of the <style> elements' rules."""
    sheets = nodes.where("kind = 'text'").join(nodes.where("tag = 'style'").select("page_id", F.col("node_id").alias("parent_id")), ["page_id", "parent_id"], "left_semi")
    kind = nodes.schema["page_id"].dataType.simpleString()
    part_type = pa.list_(pa.struct([("child", pa.bool_()), ("tag", pa.string()), ("tests", pa.list_(pa.string()))]))
    declared_type = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("important", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, (node << 20) + k, parts, weight, [dict(zip(("name", "value", "important"), d)) for d in found]) for i, (node, css) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) for k, (_, parts, weight, found) in enumerate(css_rules(css))]
            cols = list(zip(*rows)) if rows else [()] * 5
            made = [pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), part_type, pa.int32(), declared_type))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *made], names=["page_id", "rule", "parts", "weight", "declared"])

    return sheets.select("page_id", "node_id", "text").mapInArrow(run, f"page_id {kind}, {_RULES}")


def matches(nodes: DataFrame, rules: DataFrame, most_parts: int) -> DataFrame:
    """page_id, rule and node_id of the elements that each rule's selector fits.

    An element's marks are its tag, `*`, and its tests (id, classes, attributes); a part of a rule is joined with elements on
    one of its own marks and then tested in full. Parts are followed from the left, most_parts of them: what fits a part
    must lie in (or right in) what fits the one before.
    """
    el = nodes.where("kind = 'element'")
    classes = F.transform(F.filter(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), lambda c: c != ""), lambda c: F.concat(F.lit("."), c))
    names = F.map_keys("attrs")
    tests = F.concat(F.when(attr("id") != "", F.array(F.concat(F.lit("#"), attr("id")))).otherwise(F.array().cast("array<string>")), classes, F.transform(names, lambda n: F.concat(F.lit("["), n, F.lit("]"))), F.transform(names, lambda n: F.concat(F.lit("["), n, F.lit("="), F.element_at("attrs", n), F.lit("]"))))
    own = el.select("page_id", "node_id", "parent_id", "path", "tag", F.array_distinct(tests).alias("has"))
    marked = own.select("page_id", "node_id", "parent_id", "path", "tag", "has", F.explode(F.array_distinct(F.concat(F.array(F.lit("*"), F.col("tag")), "has"))).alias("mark"))
    parts = rules.select("page_id", "rule", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    parts = parts.withColumn("mark", F.coalesce(F.try_element_at("part.tests", F.lit(1)), "part.tag", F.lit("*")))
    fits = marked.join(parts, ["page_id", "mark"]).where((F.col("part.tag").isNull() | (F.col("part.tag") == F.col("tag"))) & (F.size(F.array_except("part.tests", "has")) == 0))
    fits = fits.select("page_id", "rule", "n", "k", F.col("part.child").alias("child"), "node_id", "parent_id", "path")
    reached = fits.where("k = 0").select("page_id", "rule", "n", "node_id")
    done = reached.where("n = 1").select("page_id", "rule", "node_id")
    for k in range(1, most_parts):
        above = reached.where(F.col("n") > k).select("page_id", "rule", F.col("node_id").alias("over"))
        below = fits.where(F.col("k") == k).select("page_id", "rule", "n", "node_id", "parent_id", "child", F.explode("path").alias("over"))
        below = below.where((F.col("over") != F.col("node_id")) & (~F.col("child") | (F.col("over") == F.col("parent_id"))))
        reached = below.join(above, ["page_id", "rule", "over"], "left_semi").select("page_id", "rule", "n", "node_id").distinct()
        done = done.unionByName(reached.where(F.col("n") == k + 1).select("page_id", "rule", "node_id"))
    return done


def with_stylesheets(nodes: DataFrame, most_parts: int = 3) -> DataFrame:
    """nodes whose style attribute also says what their page's stylesheets declare for them.

    Of declarations of one property the first counts wherever styles are read, so important ones of sheets stand before the
    inline ones and all others after, each by specificity and then by place, the last first. Rules of more than most_parts
    parts are left out.
    """
    rules = sheet_rules(nodes).where(F.size("parts") <= most_parts)
    found = matches(nodes, rules, most_parts).join(rules.select("page_id", "rule", "weight", F.explode("declared").alias("d")), ["page_id", "rule"])
    each = F.struct((-F.col("weight")).alias("weight"), (-F.col("rule")).alias("rule"), F.concat("d.name", F.lit(":"), "d.value").alias("text"), F.col("d.important").alias("important"))
    listed = found.groupBy("page_id", "node_id").agg(F.sort_array(F.collect_list(each)).alias("_declared"))
    text = lambda important: F.array_join(F.transform(F.filter("_declared", lambda d: d["important"] == important), lambda d: d["text"]), ";")
    style = F.array_join(F.filter(F.array(text(True), F.coalesce(attr("style"), F.lit("")), text(False)), lambda s: s != ""), ";")
    kept = F.map_filter("attrs", lambda k, _: k != "style")
    out = nodes.join(listed, ["page_id", "node_id"], "left")
    return out.withColumn("attrs", F.when(F.col("_declared").isNull(), F.col("attrs")).otherwise(F.map_concat(kept, F.create_map(F.lit("style"), style)))).select(*nodes.columns)
