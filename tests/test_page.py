"""Node trees, elements, runs and selectors of small pages."""

from pyspark.sql import functions as F

from pageguard.operators import page
from pageguard.plans import pages as plans
from pageguard.sources import html

FORM = """<!DOCTYPE html><html><body><p>one<p>two <b>bold</b>
<ul><li>a<li>b</ul><script>var x = "</p><a href='no'>";</script>
<form><input id="user" value="jane.doe@example.com" placeholder="Mail"><input type="password" value="hunter2">
<input type="checkbox" checked><input type="hidden" value="x"><select aria-label="Full name"><option value="1">No card</option><option value="2" selected>John Doe</option></select>
<textarea>Call me at +91 9876500000</textarea><button disabled>Go</button></form>
<div style="display:none"><button>hidden</button><p>secret</p></div><span style="cursor: pointer">card</span>
<a href="/reset?token=1" data-testid="t1">Reset</a><a id="dup" href="#">x</a><a id="dup" href="#">y</a></body></html>"""


def frames(spark, *pages):
    df = spark.createDataFrame([(i, "https://site.org/p", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return df, html.nodes(df).persist()


def test_tree_closes_by_implication():
    tags = {n["node_id"]: n["tag"] for n in html.parse(FORM)}
    paths = [[tags[i] for i in n["path"]] for n in html.parse(FORM) if n["kind"] == "element"]
    assert ["html", "body", "p"] in paths and ["html", "body", "p", "p"] not in paths
    assert paths.count(["html", "body", "ul", "li"]) == 2
    assert not any(p[-1] == "a" and "script" in p for p in paths)
    assert html.parse(None) == [] and html.parse("") == []


def test_elements(spark):
    _, nodes = frames(spark, FORM)
    rows = {r["element_id"]: r for r in page.elements(nodes).collect()}
    kinds = [rows[i]["type"] for i in sorted(rows)]
    assert kinds == ["input:text", "input:password", "input:checkbox", "select", "textarea", "button", "link", "link", "link", "span"]
    assert rows[0]["value"] == "[REDACTED]" and rows[0]["text"] == "[REDACTED]"
    assert rows[1]["value"] is None and rows[1]["text"] == ""
    assert rows[2]["value"] == "checked" and rows[3]["value"] == "John Doe" and rows[4]["value"] == "[REDACTED]"
    assert not rows[5]["enabled"] and rows[5]["text"] == "Go"
    compat = {r["element_id"]: r for r in page.elements(nodes, compat=True).collect()}
    assert compat[0]["text"] == "jane.doe@example.com"


def test_runs_and_extraction(spark):
    pages, nodes = frames(spark, FORM, None)
    runs = [r["text"] for r in page.text_runs(nodes).orderBy("node_id").collect()]
    assert "bold" in runs and not any("var x" in r for r in runs)
    out = {r["page_id"]: r for r in page.extraction(pages, nodes).collect()}
    found = {(i["type"], i["masked"]) for i in out[0]["sensitive_items"]}
    assert ("SENSITIVE_URL_PARAM", "https://site.org/reset?...") in found and ("NAME", "J*******") in found and ("EMAIL", "j******e@example.com") in found
    assert "jane.doe" not in str(out[0]) and out[1]["n_elements"] == 0 and out[1]["n_visible_text"] == 0


def test_selectors(spark):
    _, nodes = frames(spark, FORM)
    tags = {n["node_id"]: n for n in html.parse(FORM)}
    rows = {r["node_id"]: r["selector"] for r in page.selectors(nodes).collect()}
    assert len(set(rows.values())) == len(rows)
    by = {rows[i]: tags[i] for i in rows}
    assert by["#user"]["tag"] == "input" and by['[data-testid="t1"]']["tag"] == "a"
    assert [s for s, n in by.items() if n["attrs"].get("id") == "dup"] == ["html > body:nth-of-type(1) > a:nth-of-type(2)", "html > body:nth-of-type(1) > a:nth-of-type(3)"]


def test_every_tag_is_counted(spark, tmp_path):
    small = "<p>one<p>two<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><div><span>x</span><a href='#'>y</a></div>"
    spark.createDataFrame([(1, "u", small), (2, "u", "<p>x<br>"), (3, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["tag"]: r["n"] for r in plans.all_tag_counts(spark, str(tmp_path)).collect()}
    assert got == {"p": 3, "ul": 1, "li": 2, "table": 1, "tr": 2, "td": 3, "div": 1, "span": 1, "a": 1, "br": 1}


def test_tagged_items_of_runs_and_values(spark):
    text = "<p>hello ann lee</p><input aria-label='Full name' value='Bob Ray'><input aria-label='Guest' value='Cy Poe'>"
    pages = spark.createDataFrame([(1, "http://a/", text)], "page_id long, url string, html string")
    nodes = html.nodes(pages)

    def tagger(df):
        hits = df.where("text like '%ann lee%' or text = 'Bob Ray'")
        return hits.select("id", F.lit("NAME").alias("type"), F.lit("x").alias("match"), F.lit("tagged").alias("masked"), F.lit(0.9).alias("confidence"))

    el = page.elements(nodes)
    runs = page.runs_with_elements(page.text_runs(nodes), el)
    got = sorted((r["masked"], r["confidence"]) for r in page.sensitive_items(pages, nodes, el, runs, tagger).collect())
    plain = sorted((r["masked"], r["confidence"]) for r in page.sensitive_items(pages, nodes, el, runs).collect())
    assert got == [("C*****", 0.6), ("tagged", 0.9), ("tagged", 0.9)]
    assert plain == [("B******", 0.6), ("C*****", 0.6)]


def test_withheld_names_and_tagged_values(spark):
    page_html = """<html><body><input aria-label="Guest" value="John Doe"><input placeholder="Your name" value="Jane Roe"><input value="zorp here">
<p>zorp line</p><p>plain line</p></body></html>"""
    pages, nodes = frames(spark, page_html)
    plain = page.extraction(pages, nodes).collect()[0]
    assert [(e["text"], e["value"]) for e in plain["elements"]] == [("Guest", "[REDACTED]"), ("[REDACTED]", "[REDACTED]"), ("zorp here", "zorp here")]

    def tagger(df):
        return df.where("text like '%zorp%'").select("id", F.lit("PLACE").alias("type"), F.lit("zorp").alias("match"), F.lit("z***").alias("masked"), F.lit(0.9).alias("confidence"))

    tagged = page.extraction(pages, nodes, tagger).collect()[0]
    assert [e["value"] for e in tagged["elements"]] == ["[REDACTED]"] * 3 and "zorp" not in str(tagged["elements"])
    assert [r["text"] for r in tagged["visible_text"]] == ["[REDACTED - sensitive text on this line]", "plain line"]
    assert {i["type"] for i in tagged["sensitive_items"]} == {"NAME", "PLACE"}


def test_text_without_a_box_is_left_out(spark):
    page_html = """<div style="display:none"><p>a<b style="visibility:visible">b</b></p></div><div hidden><i>c</i></div>
<div style="visibility:hidden">d<p>e<b style="visibility: visible">f</b></p></div><div style="opacity:0">g<p>h</p></div><template><p>i</p></template>"""
    _, nodes = frames(spark, page_html)
    assert [r["text"] for r in page.text_runs(nodes).orderBy("node_id").collect()] == ["f", "h"]
