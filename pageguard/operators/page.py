"""What a page shows: visible interactive elements, text runs, selectors, sensitive items.

Works on the node table. Styles are inline ones, and those of the page's own stylesheets where the nodes come from
stylesheets.with_stylesheets. With a rendered.Layout, only what lies in the viewport and is not covered counts, and
elements, runs and items have boxes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageguard.functions import masking, patterns
from pageguard.operators import detect, rendered, tree
from pageguard.operators.rendered import Layout
from pageguard.sources.tables import written

# Roles and tags of interactive elements, and parents whose text is never shown.
ROLES = ["button", "link", "tab", "menuitem", "checkbox", "radio", "combobox", "switch", "option"]
CLICKABLE_TAGS = ["div", "span", "li", "section", "article"]
SKIPPED_PARENTS = ["script", "style", "noscript", "template", "svg"]
TEST_ATTRIBUTES = ["data-testid", "data-test", "data-qa"]


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def has_attr(name: str) -> Column:
    return F.coalesce(F.map_contains_key("attrs", name), F.lit(False))


def style(name: str) -> Column:
    """The value that the style attribute gives a property, or an empty text; the pattern is for elements that have one."""
    found = F.lower(F.trim(F.regexp_extract(attr("style"), rf"(?i)(?:^|;)\s*{name}\s*:\s*([^;!]*)", 1)))
    return F.when(attr("style").isNull(), "").otherwise(found)


def own_style_visible() -> Column:
    opacity = F.coalesce(style("opacity").try_cast("double"), F.lit(1.0))
    hidden = (style("display") == "none") | style("visibility").isin("hidden", "collapse") | (opacity == 0) | has_attr("hidden")
    return ~(hidden | ((F.col("tag") == "input") & (F.lower(F.coalesce(attr("type"), F.lit(""))) == "hidden")))


def candidate_pass() -> Column:
    """Of interactive elements 0 (by tag, role or attribute) or 1 (by a pointer cursor), else null."""
    tag = F.col("tag")
    direct = tag.isin("button", "input", "textarea", "select") | ((tag == "a") & has_attr("href")) | has_attr("onclick") | F.coalesce(attr("role").isin(ROLES), F.lit(False)) | has_attr("tabindex")
    pointer = tag.isin(CLICKABLE_TAGS) & (style("cursor") == "pointer") & (F.coalesce(attr("tabindex"), F.lit("")) != "-1")
    return F.when(direct, 0).when(pointer, 1)


def element_kind() -> Column:
    tag = F.col("tag")
    return (
        F.when(tag == "input", F.concat(F.lit("input:"), F.lower(F.coalesce(F.nullif(attr("type"), F.lit("")), F.lit("text")))))
        .when(tag == "a", "link")
        .when(tag.isin("button", "select", "textarea"), tag)
        .when(F.coalesce(attr("role"), F.lit("")) != "", F.concat(F.lit("role:"), attr("role")))
        .otherwise(tag)
    )


def _marked(nodes: DataFrame, layout: Layout | None = None) -> DataFrame:
    """nodes with element_id of visible interactive elements (dense from 0 in each page), boxless (what has no box), and up
    (tree.enclosing, whose owners are these elements).

    Nodes come in document order and an element's end with last_id, so what hides all in it is a running maximum. All goes
    by page_id: nodes that are dealt by it are not shuffled.
    """
    el, here = F.col("kind") == "element", tree.in_order()
    whole = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shown = ["bbox"] if layout is not None else []
    if layout is not None:
        nodes = nodes.join(rendered.on_top(nodes.where(el), layout).select("page_id", "node_id", "bbox"), ["page_id", "node_id"], "left")
    covered = lambda hides: F.coalesce(F.max(F.when(el & hides, F.col("last_id"))).over(here) >= F.col("node_id"), F.lit(False))
    no_box = F.col("tag").isin(SKIPPED_PARENTS) | (style("display") == "none") | has_attr("hidden")
    out = nodes.withColumns({"_pass": F.when(el, candidate_pass()), "_covered": covered(~own_style_visible()), "boxless": covered(no_box)})
    found = F.col("_pass").isNotNull() & ~F.col("_covered")
    for c in shown:
        found = found & F.col(c).isNotNull()
    out = out.withColumn("_found", found)
    of = lambda k: F.count(F.when(F.col("_found") & (F.col("_pass") == k), 1))
    number = F.when(F.col("_pass") == 0, of(0).over(here)).otherwise(of(0).over(whole) + of(1).over(here)) - 1
    out = out.withColumn("element_id", F.when(F.col("_found"), number))
    faint = F.coalesce(style("opacity").try_cast("double"), F.lit(1.0)) == 0
    bits = {tree.OWNER: F.col("element_id").isNotNull(), tree.OPTION: F.col("tag") == "option", tree.FAINT: faint, tree.SHOWN: (style("visibility") != "") & ~_hiding(), tree.HIDDEN: _hiding()}
    mark = F.when(el, sum((F.when(is_so, bit).otherwise(0) for bit, is_so in bits.items()), F.lit(0))).otherwise(0).cast("int")
    return out.withColumn("up", tree.enclosing(mark, F.col("element_id"))).drop("_pass", "_covered", "_found")


def numbered(nodes: DataFrame) -> DataFrame:
    """The elements among the nodes with element_id, that of elements() or null."""
    return _marked(nodes.where("kind = 'element'")).drop("up", "boxless")


def _hiding() -> Column:
    return style("visibility").isin("hidden", "collapse")


def _is_run() -> Column:
    """Of _marked's rows with `bare`: text that is shown by styles."""
    by_style = ~F.col("boxless") & ~F.coalesce(F.col("up.faint") == F.col("parent_id"), F.lit(False)) & ~F.coalesce("up.hidden", F.lit(False))
    return F.coalesce((F.col("kind") == "text") & (F.col("bare") != "") & F.col("parent_id").isNotNull() & by_style, F.lit(False))


def _bare() -> Column:
    return F.when(F.col("kind") == "text", F.regexp_replace("text", rf"^[{patterns.SPACE}]+|[{patterns.SPACE}]+$", ""))


def _lead() -> Column:
    return F.length(F.regexp_extract("text", rf"^[{patterns.SPACE}]*", 0))


def _parts(nodes: DataFrame, compat: bool = False, layout: Layout | None = None, runs: bool = True) -> DataFrame:
    """Rows of elements() and, with runs, of runs_with_elements(), told apart by is_run, in one pass over the nodes.

    A text goes to the elements around it that are looked for, an option to them too, and nothing to other ancestors.
    """
    marked = _marked(nodes, layout).withColumn("bare", _bare())
    element, text, option = F.col("element_id").isNotNull(), F.col("kind") == "text", F.coalesce(F.col("tag") == "option", F.lit(False))
    run = _is_run() if runs else F.lit(False)
    none = F.array().cast("array<int>")
    bbox = ["bbox"] if layout is not None else []
    has = {"type": element_kind(), "given": attr("type"), "value": attr("value"), "checked": has_attr("checked"), "label": attr("aria-label"), "aria_disabled": attr("aria-disabled"), "disabled": has_attr("disabled"), "placeholder": attr("placeholder"), "href": attr("href")}
    # What a row says of itself, and what it tells those around it.
    own = F.struct(run.alias("is_run"), "path", "tag", F.when(run, F.col("up.near")).otherwise(F.col("element_id")).alias("element_id"), F.when(run, F.col("bare")).alias("bare"), F.when(run, _lead()).alias("lead_ws"), *(F.when(element, c).alias(n) for n, c in has.items()), *bbox)
    t = F.when(text, F.struct(F.col("node_id").alias("at"), "text", F.col("up.options").alias("options")))
    o = F.when(option, F.struct(has_attr("selected").alias("chosen"), (-F.col("node_id")).alias("back"), attr("value").alias("value")))
    to = F.concat(F.when(element | run, F.array("node_id")).otherwise(none), F.when(text | option, F.col("up.owners")).otherwise(none))
    told = marked.select("page_id", "node_id", F.when(element | run, own).alias("own"), t.alias("t"), o.alias("o"), to.alias("path")).where(F.size("path") > 0)
    told = told.select("page_id", "node_id", "own", "t", "o", F.explode("path").alias("key"))
    self_ = F.col("node_id") == F.col("key")
    told = told.groupBy("page_id", F.col("key").alias("node_id")).agg(F.max(F.when(self_, F.col("own"))).alias("own"), F.sort_array(F.collect_list(F.when(~self_, F.col("t")))).alias("t"), F.max(F.when(~self_, F.col("o"))).alias("o"))
    joined = lambda ts: F.trim(F.array_join(F.transform(ts, lambda x: x["text"]), ""))
    inner = F.when(F.size("t") > 0, joined(F.col("t"))).alias("inner")
    of_option = F.filter("t", lambda x: F.array_contains(x["options"], -F.col("o.back")))
    return _described(told.select("page_id", "node_id", "own.*", inner, F.when(F.size(of_option) > 0, joined(of_option)).alias("option_text"), F.col("o.value").alias("option_value")), compat, bbox)


def _described(found: DataFrame, compat: bool, bbox: list[str]) -> DataFrame:
    """_parts's rows from what their elements have and hold."""
    tag, kind, is_run = F.col("tag"), F.lower(F.coalesce(F.col("given"), F.lit("text"))), F.col("is_run")
    blank = lambda c: F.nullif(c, F.lit(""))
    raw = (
        F.when((tag == "input") & (kind == "password"), F.lit(None).cast("string"))
        .when((tag == "input") & kind.isin("checkbox", "radio"), F.when(F.col("checked"), "checked").otherwise("unchecked"))
        .when(tag == "input", blank(F.col("value")))
        .when(tag == "select", F.coalesce(blank(F.col("option_text")), blank(F.col("option_value"))))
        .when(tag == "textarea", blank(F.col("inner")))
    )
    live = F.when(tag == "input", F.col("value")).when(tag == "select", F.coalesce(F.col("option_value"), F.col("option_text"))).when(tag == "textarea", F.col("inner"))
    if not compat:
        live = F.when((tag == "input") & (kind == "password"), F.lit(None)).otherwise(live)
    label = F.substring(F.coalesce(blank(F.col("label")), blank(live), blank(F.col("inner")), F.lit("")), 1, 200)
    enabled = ~(F.col("disabled") | (F.coalesce("aria_disabled", F.lit("")) == "true"))
    out = found.select("page_id", "node_id", "path", "tag", "element_id", "type", F.when(is_run, F.col("bare")).otherwise(label).alias("text"), F.col("label").alias("aria_label"), "placeholder", F.when(~is_run, raw).alias("raw_value"), F.when(tag == "a", F.col("href")).alias("href"), enabled.alias("enabled"), *bbox, "is_run", "lead_ws", F.col("bare").alias("run_text"))
    out = out.withColumn("value", detect.redact_value(F.col("raw_value")))
    return out if compat else out.withColumn("text", F.when(is_run, F.col("text")).otherwise(detect.redact_value(F.col("text"))))


def elements(nodes: DataFrame, compat: bool = False, layout: Layout | None = None) -> DataFrame:
    """Visible interactive elements with dense ids from 0 in each page; with a layout, those in view and not covered, with bbox.

    value is withheld for passwords and replaced where a pattern finds personal data in it; unless compat, so is text.
    extraction() also replaces bare names and what a tagger sees.
    """
    return _parts(nodes, compat, layout, runs=False).drop("is_run", "lead_ws", "run_text")


def text_runs(nodes: DataFrame, layout: Layout | None = None) -> DataFrame:
    """page_id, node_id, path, text (trimmed) and lead_ws of elements' text that has a box and is not hidden by a style.

    With a layout: of text of which a part lies in the viewport, with bbox.

    Nothing under display:none, the hidden attribute or a skipped tag has a box; visibility is inherited from the nearest
    element that sets it; opacity counts at the text's parent only.
    """
    shown = _marked(nodes).withColumn("bare", _bare()).where(_is_run())
    out = shown.select("page_id", "node_id", "path", F.col("bare").alias("text"), _lead().alias("lead_ws"))
    return out if layout is None else rendered.shown_runs(out, layout)


def runs_of(nodes: DataFrame) -> DataFrame:
    """text_runs with element_id, that of the nearest of elements() around each, or null: in one pass over the nodes."""
    shown = _marked(nodes).withColumn("bare", _bare()).where(_is_run())
    return shown.select("page_id", "node_id", "path", F.col("bare").alias("text"), _lead().alias("lead_ws"), F.col("up.near").alias("element_id"))


def runs_with_elements(runs: DataFrame, elements_: DataFrame) -> DataFrame:
    """runs with element_id: that of the nearest ancestor in the element table, or null."""
    owners = elements_.select("page_id", F.col("node_id").alias("over"), "element_id", F.size("path").alias("depth"))
    near = runs.select("page_id", "node_id", F.explode("path").alias("over")).join(owners, ["page_id", "over"]).groupBy("page_id", "node_id").agg(F.max_by("element_id", "depth").alias("element_id"))
    return runs.join(near, ["page_id", "node_id"], "left")


def selectors(nodes: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """page_id, node_id, selector: the first unique one of id, test attribute, path from an id, and the path from html.

    kept: further columns of the nodes.
    """
    escape = lambda c: F.regexp_replace(c, r"([^\w-])", r"\\$1")
    el = nodes.where("kind = 'element'")
    by_id = F.when(attr("id") != "", F.concat(F.lit("#"), escape(attr("id"))))
    by_test = F.coalesce(*[F.when(attr(a) != "", F.concat(F.lit(f'[{a}="'), escape(attr(a)), F.lit('"]'))) for a in TEST_ATTRIBUTES])
    out = el.select("page_id", "node_id", "last_id", "tag", by_id.alias("by_id"), by_test.alias("by_test"), *(F.col(c).alias(f"kept_{c}") for c in kept or []))
    out = out.withColumn("place", tree.places(F.col("by_id"))).withColumns({"full": F.col("place.full"), "short": F.coalesce("place.short", "place.full")})
    once = lambda c: F.when(F.col(c).isNotNull() & (F.count(c).over(Window.partitionBy("page_id", c)) == 1), F.col(c))
    return out.select("page_id", "node_id", F.coalesce(once("by_id"), once("by_test"), once("short"), F.col("full")).alias("selector"), *(F.col(f"kept_{c}").alias(c) for c in kept or []))


def resolve_again(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old selectors in a new snapshot: page_id, selector, old_node, new_node (the first match, or null if it is gone), and
    old's further columns. Both are put into one table and grouped, which pages dealt alike do not need a shuffle for.
    """
    kept = [c for c in old.columns if c not in ("page_id", "selector", "node_id")]
    both = old.select("page_id", "selector", F.col("node_id").alias("old_node"), F.lit(None).cast("int").alias("new"), *kept)
    both = both.unionByName(new.select("page_id", "selector", F.lit(None).cast("int").alias("old_node"), F.col("node_id").alias("new"), *(F.lit(None).cast(old.schema[c].dataType).alias(c) for c in kept)))
    first = both.withColumn("new_node", F.min("new").over(Window.partitionBy("page_id", "selector")))
    return first.where("old_node is not null").select("page_id", "selector", "old_node", "new_node", *kept)


Tagger = Callable[[DataFrame], DataFrame]
_ITEMS = "array<struct<type:string,match:string,masked:string,confidence:double,start:int>>"


def with_tags(elements_: DataFrame, runs: DataFrame, tagger: Tagger | None) -> tuple[DataFrame, DataFrame]:
    """Elements and runs with `tagged` (what the tagger finds in their value or text) and `failed` (it could not look).

    tagger: from rows of id and text to ner.text_items's rows. It gets the texts of runs and the values of elements once, in
    one table; what it finds is written down, so that everything after reads one result. A text that has a row whose
    ner_status is not `ok` has failed.
    """
    if tagger is None:
        plain = lambda df: df.withColumns({"tagged": F.array().cast(_ITEMS), "failed": F.lit(False)})
        return plain(elements_), plain(runs)
    key = lambda of_value: F.struct("page_id", "node_id", F.lit(of_value).alias("of_value")).alias("id")
    texts = runs.select(key(False), "text").unionByName(elements_.where("raw_value is not null").select(key(True), F.col("raw_value").alias("text")))
    hits = tagger(texts)
    status = F.coalesce("ner_status", F.lit("ok")) if "ner_status" in hits.columns else F.lit("ok")
    start = F.col("start") if "start" in hits.columns else F.lit(None)
    item = F.struct("type", "match", "masked", F.col("confidence").cast("double").alias("confidence"), start.cast("int").alias("start"))
    own = hits.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("type").isNotNull(), item))).alias("tagged"), F.bool_or(status != "ok").alias("failed"))
    own = written(own.select("id.*", "tagged", "failed"))

    def joined(df: DataFrame, of_value: bool) -> DataFrame:
        mine = own.where(F.col("of_value") == of_value).drop("of_value")
        return df.join(mine, ["page_id", "node_id"], "left").withColumns({"tagged": F.coalesce("tagged", F.array().cast(_ITEMS)), "failed": F.coalesce("failed", F.lit(False))})

    return joined(elements_, True), joined(runs, False)


def sensitive_items(pages: DataFrame, nodes: DataFrame, elements_: DataFrame, runs: DataFrame, tagger: Tagger | None = None, layout: Layout | None = None) -> DataFrame:
    """page_id, type, masked, confidence, element_id: of text runs, of links' URLs, and of form values.

    The tagger's items join those of the patterns, and a value in which it has seen a name is not taken for a bare one again.
    Elements and runs may come from with_tags already. With a layout there is bbox too: of the match in its line or lines
    (null if that is off the screen; of the whole run where a tagger does not say where), or of the element.
    """
    if "tagged" not in runs.columns:
        elements_, runs = with_tags(elements_, runs, tagger)
    bbox = ["bbox"] if layout is not None else []
    item = lambda df, found, *cols: df.select("page_id", "element_id", *cols, F.explode(found).alias("i"))
    flat = lambda df: df.select("page_id", "i.type", "i.masked", "i.confidence", "element_id", *bbox)
    no_start = lambda found: F.transform(found, lambda i: F.struct(*(i[c].alias(c) for c in ("type", "match", "masked", "confidence")), F.lit(None).cast("int").alias("start")))
    if layout is None:
        of_text = item(runs, F.concat(no_start(detect.items(F.col("text"))), "tagged"))
    else:
        placed = item(detect.with_placed_items(runs, "text", "_items"), F.concat("_items", "tagged"), "node_id", "lead_ws", F.col("bbox").alias("of_run"))
        placed = placed.withColumn("start", (F.col("i.start") + F.col("lead_ws")).cast("int")).withColumn("end", (F.col("start") + F.length("i.match")).cast("int"))
        known = rendered.range_boxes(placed.where("start is not null").select("page_id", "node_id", "start", "end").distinct(), layout)
        of_text = placed.join(known, ["page_id", "node_id", "start", "end"], "left").withColumn("bbox", F.when(F.col("start").isNull(), F.col("of_run")).otherwise(F.col("bbox")))
    links = elements_.where("href is not null").join(pages.select("page_id", "url"), "page_id").select("page_id", "element_id", *bbox, detect.url_item(F.col("href"), F.col("url")).alias("i")).where("i is not null")
    name = F.struct(F.lit("NAME").alias("type"), F.lit("").alias("match"), masking.mask_name(patterns.trim(F.col("raw_value"))).alias("masked"), F.lit(patterns.CONFIDENCE["NAME"]).alias("confidence"))
    named = detect.bare_name(field_label(), F.col("raw_value"), F.exists("tagged", lambda i: i["type"] == "NAME"))
    bare = F.when(named, F.array(name)).otherwise(F.filter(F.array(name), lambda _: F.lit(False)))
    of_values = item(elements_.where("raw_value is not null"), F.concat(no_start(F.concat(detect.items(F.col("raw_value")), bare)), "tagged"), *bbox)
    return flat(of_text).unionByName(flat(links)).unionByName(flat(of_values))


_SHORT_ITEMS = "array<struct<type:string,masked:string,confidence:double,element_id:long>>"


def _row_items() -> Column:
    """Of one of _parts's rows: the items of its text or value, and a bare name."""
    name = F.struct(F.lit("NAME").alias("type"), F.lit("").alias("match"), masking.mask_name(patterns.trim(F.col("raw_value"))).alias("masked"), F.lit(patterns.CONFIDENCE["NAME"]).alias("confidence"))
    named = detect.bare_name(field_label(), F.col("raw_value"), F.lit(False))
    # Patterns look at one column, so that they stand in the plan once.
    found = F.concat(detect.items(F.col("_looked_at")), F.filter(F.array(name), lambda _: named))
    return F.transform(found, lambda i: _short(i, F.col("element_id"))).cast(_SHORT_ITEMS)


def _short(item: Column, element_id: Column) -> Column:
    return F.struct(item["type"].alias("type"), item["masked"].alias("masked"), item["confidence"].cast("double").alias("confidence"), element_id.alias("element_id"))


def _with_row_items(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """_parts's rows with _items: sensitive_items's of each."""
    # Patterns look at one column, and a link's item is made in a column of its own: inside a lambda it would be made anew
    # for each of its fields.
    looked_at = F.coalesce(F.when(F.col("is_run"), F.col("run_text")).otherwise(F.col("raw_value")), F.lit(""))
    rows = parts.withColumn("_looked_at", looked_at).join(pages.select("page_id", "url"), "page_id", "left")
    rows = rows.withColumn("_link", F.when(F.col("href").isNotNull(), detect.url_item(F.col("href"), F.col("url"))))
    rows = rows.withColumns({"_items": _row_items(), "_link": F.when(F.col("_link").isNotNull(), F.array(_short(F.col("_link"), F.col("element_id")))).cast(_SHORT_ITEMS)})
    return rows.withColumn("_items", F.when(F.col("_link").isNull(), F.col("_items")).otherwise(F.concat("_items", "_link"))).drop("_looked_at", "_link", "url")


def items_of(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """sensitive_items without a tagger and a layout, in one pass over the nodes."""
    rows = _with_row_items(_parts(nodes), pages)
    # An inner explode would be given a filter that repeats all that its list is made of.
    return rows.select("page_id", F.explode_outer("_items").alias("i")).where("i is not null").select("page_id", "i.*")


def field_label() -> Column:
    return F.coalesce(F.nullif("aria_label", F.lit("")), F.nullif("placeholder", F.lit("")), F.lit(""))


def withheld(elements_: DataFrame, runs: DataFrame, tagger: Tagger | None = None) -> tuple[DataFrame, DataFrame]:
    """Elements and runs with values, the texts made of them, and lines replaced where there is a bare name, the tagger sees
    an item, or the tagger has failed. An element's text that comes from such lines is replaced too.
    """
    if "tagged" not in runs.columns:
        elements_, runs = with_tags(elements_, runs, tagger)
    unlabelled = F.coalesce(F.nullif("aria_label", F.lit("")), F.lit("")) == ""
    seen = F.col("failed") | (F.size("tagged") > 0)
    lines = runs.where(seen).select("page_id", F.explode("path").alias("node_id")).distinct().withColumn("over", F.lit(True))
    own = elements_.join(lines, ["page_id", "node_id"], "left") if tagger is not None else elements_.withColumn("over", F.lit(False))
    mark = F.col("raw_value").isNotNull() & (detect.bare_name(field_label(), F.col("raw_value"), F.lit(False)) | seen)
    own = own.withColumn("_mark", F.coalesce(mark, F.lit(False)))
    hide = lambda c, when: F.when(when, F.lit(patterns.REDACTED)).otherwise(F.col(c))
    from_lines = F.coalesce("over", F.lit(False)) & (F.col("text") != "")
    own = own.withColumns({"value": hide("value", F.col("_mark")), "text": hide("text", unlabelled & (F.col("_mark") | from_lines))}).drop("_mark", "over")
    return own, runs.withColumn("text", F.when(seen, F.lit(patterns.LINE_MARK)).otherwise(F.col("text")))


def extraction(pages: DataFrame, nodes: DataFrame, tagger: Tagger | None = None, layout: Layout | None = None) -> DataFrame:
    """One row per page: url, elements, visible_text and sensitive_items as arrays, their counts, and ner_status.

    A value or line with an item of any kind is replaced: by a pattern, a bare name, or what the tagger sees. Where the
    tagger could not look, the whole value or line is; ner_status is then `failed` (`off`: no tagger).
    """
    if tagger is None and layout is None:
        return _extracted(pages, nodes)
    # Elements and runs are read many times below; each is made once.
    if layout is None:
        parts = written(_parts(nodes))
        el, runs = parts.where("not is_run").drop("is_run", "lead_ws", "run_text"), parts.where("is_run").select("page_id", "node_id", "path", "text", "lead_ws", "element_id")
    else:
        el = written(elements(nodes, layout=layout))
        runs = written(runs_with_elements(text_runs(nodes, layout), el))
    el, runs = with_tags(el, runs, tagger)
    items = sensitive_items(pages, nodes, el, runs, tagger, layout)
    bbox = ["bbox"] if layout is not None else []
    el, runs = withheld(el, runs, tagger)
    listed = lambda df, name, *cols: df.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    shown = runs.withColumn("text", detect.redact_line(F.col("text")))
    out = pages.select("page_id", "url").join(listed(el, "elements", "element_id", "type", "text", "aria_label", "placeholder", "value", "href", "enabled", *bbox), "page_id", "left")
    out = out.join(listed(shown, "visible_text", "node_id", "text", "element_id", *bbox), "page_id", "left").join(listed(items, "sensitive_items", "type", "masked", "confidence", "element_id", *bbox), "page_id", "left")
    status = F.lit("off").alias("ner_status")
    if tagger is not None:
        bad = runs.where("failed").select("page_id").union(el.where("failed").select("page_id")).distinct().withColumn("bad", F.lit(True))
        out = out.join(bad, "page_id", "left")
        status = F.when(F.col("bad"), "failed").otherwise("ok").alias("ner_status")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    empty = lambda c: F.greatest(size(c), F.lit(0)).alias(f"n_{c}")
    return out.select("page_id", "url", "elements", "visible_text", "sensitive_items", *map(empty, ("elements", "visible_text", "sensitive_items")), status)


def _extracted(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """extraction without a tagger and a layout, in one pass over the nodes: a page's rows are gathered where they are."""
    rows = _with_row_items(_parts(nodes), pages)
    unlabelled = F.coalesce(F.nullif("aria_label", F.lit("")), F.lit("")) == ""
    mark = F.col("raw_value").isNotNull() & detect.bare_name(field_label(), F.col("raw_value"), F.lit(False))
    hide = lambda c, when: F.when(when, F.lit(patterns.REDACTED)).otherwise(F.col(c)).alias(c)
    element = F.when(~F.col("is_run"), F.struct("element_id", "type", hide("text", unlabelled & mark), "aria_label", "placeholder", hide("value", mark), "href", "enabled"))
    run = F.when(F.col("is_run"), F.struct("node_id", F.when(F.size("_items") > 0, F.lit(patterns.LINE_MARK)).otherwise(F.substring("text", 1, 300)).alias("text"), "element_id"))
    gathered = rows.select("page_id", element.alias("e"), run.alias("r"), "_items").groupBy("page_id").agg(F.sort_array(F.collect_list("e")).alias("elements"), F.sort_array(F.collect_list("r")).alias("visible_text"), F.sort_array(F.flatten(F.collect_list("_items"))).alias("sensitive_items"))
    out = pages.select("page_id", "url").join(gathered, "page_id", "left")
    lists = ("elements", "visible_text", "sensitive_items")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)).cast("long"), F.lit(0)).alias(f"n_{c}")
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)  # noqa: E731  a page without any has no list
    return out.select("page_id", "url", *map(some, lists), *map(size, lists), F.lit("off").alias("ner_status"))


#: Rows of the details report's list of elements.
MOST_ROWS = 25


def details(extracted: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """page_id, n_elements, n_sensitive, elements (tag, line and, with a layout, box of the first `most`) and sensitive (tag and
    line of all items) of extraction's rows: what a details panel shows of each page.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    boxed = "bbox" in extracted.select(F.inline("elements")).columns
    box = lambda e: [F.format_string("bbox: [%d, %d, %d, %d]", *(e["bbox"][c] for c in ("x", "y", "width", "height"))).alias("box")] if boxed else []
    label = lambda e: F.coalesce(blank(e["text"]), blank(e["placeholder"]), blank(e["aria_label"]), F.lit("(no label)"))
    element = lambda e: F.struct(e["type"].alias("tag"), F.concat(F.lit("["), e["element_id"].cast("string"), F.lit("] "), label(e)).alias("line"), *box(e))
    share = lambda i: patterns.js_round(i["confidence"].cast("double") * 100).cast("string")
    item = lambda i: F.struct(i["type"].alias("tag"), F.concat(i["masked"], F.lit("  (confidence "), share(i), F.lit("%)")).alias("line"))
    none = lambda c: F.coalesce(F.col(c), F.array().cast(extracted.schema[c].dataType))
    first = F.transform(F.slice(none("elements"), 1, most), element).alias("elements")
    return extracted.select("page_id", "n_elements", F.col("n_sensitive_items").alias("n_sensitive"), first, F.transform(none("sensitive_items"), item).alias("sensitive"))
