"""Layouts, stylesheets and suppression against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pageguard.operators import boxes, ner, page, rendered, stylesheets
from pageguard.plans import tagging
from pageguard.sources import html

URL = "http://a/"


def frames(spark, *pages):
    df = spark.createDataFrame([(i, URL, h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return df, html.nodes(df).persist()


def layout_of(spark, boxes_, lines, views):
    box = "page_id long, node_id int, x double, y double, width double, height double, z int"
    line = "page_id long, node_id int, start int, end int, x double, y double, width double, height double"
    return rendered.Layout(spark.createDataFrame(boxes_, box), spark.createDataFrame(lines, line), spark.createDataFrame(views, "page_id long, width double, height double"))


def test_a_covered_button_leaves_the_element_ids(spark):
    pages, nodes = frames(spark, "<body><div><button>under</button></div><button>free <b>x</b></button><a href='#'>off</a><div>cover</div></body>")
    at = {(n["tag"], n["node_id"]): n["node_id"] for n in html.parse(pages.first()["html"]) if n["kind"] == "element"}
    ids = {tag: [i for (t, i) in at if t == tag] for tag, _ in at}
    rects = [(ids["body"][0], 0, 0, 800, 600), (ids["div"][0], 0, 0, 200, 50), (ids["button"][0], 10, 10, 100, 30), (ids["button"][1], 300, 10, 100, 30), (ids["b"][0], 300, 10, 100, 30), (ids["a"][0], 900, 10, 50, 20), (ids["div"][1], 0, 0, 250, 100)]
    layout = layout_of(spark, [(0, i, *map(float, r), z) for z, (i, *r) in enumerate(rects)], [], [(0, 800.0, 600.0)])
    assert [r["text"] for r in page.elements(nodes).orderBy("element_id").collect()] == ["under", "free x", "off"]
    rows = page.elements(nodes, layout=layout).collect()
    assert [(r["element_id"], r["text"], tuple(r["bbox"])) for r in rows] == [(0, "free x", (300, 10, 100, 30))]


def test_top_elements_of_random_layouts(spark):
    rng = random.Random(2)
    nodes, placed, views = [], [], []
    for p in range(12):
        width, height = rng.choice([(300.0, 200.0), (1000.0, 700.0)])
        views.append((p, width, height))
        paths = {}
        for i in range(40):
            parent = rng.choice([None, *paths])
            paths[i] = (paths[parent] if parent is not None else []) + [i]
            nodes.append((p, i, paths[i]))
            if rng.random() < 0.9:
                placed.append((p, i, float(rng.randint(-200, 900)), float(rng.randint(-200, 700)), float(rng.choice([0, 5, 120, 400])), float(rng.choice([5, 60, 300])), rng.random()))
    order = sorted(range(len(placed)), key=lambda k: placed[k][6])
    placed = [(*placed[k][:6], z) for z, k in enumerate(order)]
    layout = layout_of(spark, placed, [], views)
    got = {(r["page_id"], r["node_id"]) for r in rendered.on_top(spark.createDataFrame(nodes, "page_id long, node_id int, path array<int>"), layout).collect()}
    path, want = {(p, i): x for p, i, x in nodes}, set()
    for p, width, height in views:
        own = [b for b in placed if b[0] == p and b[4] > 0 and b[5] > 0 and b[3] + b[5] > 0 and b[2] + b[4] > 0 and b[3] < height and b[2] < width]
        for _, i, x, y, w, h, _ in own:
            cx, cy = min(max(x + w / 2, 0), width - 1), min(max(y + h / 2, 0), height - 1)
            over = [b for b in own if b[2] <= cx < b[2] + b[4] and b[3] <= cy < b[3] + b[5]]
            top = max(over, key=lambda b: b[6])[1] if over else None
            if top is None or i in path[p, top] or top in path[p, i]:
                want.add((p, i))
    assert got == want and 0 < len(want) < len(placed)


def test_ranges_over_lines(spark, monkeypatch):
    monkeypatch.setattr(rendered, "BUCKET", 7)
    rng = random.Random(3)
    lines, ranges = [], set()
    for p in range(6):
        at, y = 0, 0.0
        for _ in range(12):
            n = rng.randint(1, 20)
            lines.append((p, 5, at, at + n, float(rng.randint(0, 50)), y, n * 8.0, 16.0))
            at, y = at + n, y + rng.choice([16.0, 20.0, 200.0])
        ranges |= {(p, 5, a, a + rng.choice([1, 3, 30, 90])) for a in (rng.randrange(at) for _ in range(25))}
    views = [(p, 150.0, 300.0) for p in range(6)]
    layout = layout_of(spark, [], lines, views)
    rows = rendered.range_boxes(spark.createDataFrame(sorted(ranges), "page_id long, node_id int, start int, end int"), layout).collect()
    want = {}
    for p, n, a, b in ranges:
        parts = [(x + (max(a, s) - s) * w / (e - s), y, x + (min(b, e) - s) * w / (e - s), y + h) for q, _, s, e, x, y, w, h in lines if q == p and a < e and b > s]
        x1, y1, x2, y2 = min(c[0] for c in parts), min(c[1] for c in parts), max(c[2] for c in parts), max(c[3] for c in parts)
        want[p, a, b] = (int(x1 + 0.5), int(y1 + 0.5), int(x2 - x1 + 0.5), int(y2 - y1 + 0.5)) if y1 < 300 and x1 < 150 else None
    got = {(r["page_id"], r["start"], r["end"]): tuple(r["bbox"]) if r["bbox"] else None for r in rows}
    assert got == want and None in want.values() and len(rows) == len(ranges)


def test_items_have_boxes(spark):
    text = "  mail jane@example.com and jane@example.com now"
    pages, nodes = frames(spark, f"<body><p>{text}</p><p>bab far</p><input value='x@y.org'></body>")
    tree = html.parse(pages.first()["html"])
    first, far = (n["node_id"] for n in tree if n["kind"] == "text")
    field = next(n["node_id"] for n in tree if n["tag"] == "input")
    lines = [(0, first, 0, 30, 10.0, 0.0, 240.0, 16.0), (0, first, 30, len(text), 10.0, 16.0, (len(text) - 30) * 8.0, 16.0), (0, far, 0, 7, 0.0, 5000.0, 56.0, 16.0)]
    layout = layout_of(spark, [(0, field, 5.0, 50.0, 90.4, 20.6, 1)], lines, [(0, 800.0, 600.0)])
    out = page.extraction(pages, nodes, lambda df: ner.text_items(df, "id", "text", tagging.rule_vocabulary(), tagging.rule_model, on_failure="status"), layout).first()
    found = sorted((i["type"], tuple(i["bbox"]) if i["bbox"] else None) for i in out["sensitive_items"] if i["type"] == "EMAIL")
    # The second address goes on in the next line.
    a, b = text.index("jane"), text.rindex("jane")
    assert found == sorted([("EMAIL", (10 + a * 8, 0, 16 * 8, 16)), ("EMAIL", (10, 0, 240, 32)), ("EMAIL", (5, 50, 90, 21))]) and b < 30 < b + 16
    assert [tuple(r["bbox"]) for r in out["visible_text"]] == [(10, 0, 240, 32)] and out["n_elements"] == 1
    assert all(i["bbox"] is not None for i in out["sensitive_items"])


SHEET = """/* .shown {display: none} */ @import url(x.css); @media print { p { display: none } .gone { color: red } }
.gone, #off { display: none } p.faint{opacity:0;color:red} nav > a { visibility: hidden } nav b a { visibility: visible }
div .deep span { cursor: pointer; } [data-x=yes] { display: none } a:hover { display: none } .loud { display: none !important }
.twice { display: none } .twice { display: block } p.twice { display: none } #keep { display: inline }"""


def test_rules_of_stylesheets(spark):
    body = """<nav><a href="#1">1</a><b><a href="#2">2</a></b></nav><button class="gone">3</button><button id="off">4</button><p class="faint">f</p><p class="shown">s</p>
<div><i class="deep"><em><span>5</span></em></i></div><button data-x="yes">6</button><button data-x="no">7</button><button class="loud" style="display: block">8</button>
<button class="gone" style="display: block">9</button><button class="twice">10</button><p class="twice">t</p><p class="twice gone" id="keep">k</p>"""
    _, nodes = frames(spark, f"<head><style>{SHEET}</style></head><body>{body}</body>", f"<body>{body}</body>", "<style>a{display:none}</style><a href='#'>x</a>")
    styled = stylesheets.with_stylesheets(nodes)
    shown = lambda p: [r["text"] for r in page.elements(styled).where(F.col("page_id") == p).orderBy("element_id").collect()]
    assert shown(0) == ["2", "7", "9", "10", "5"] and shown(1) == ["1", "2", "3", "4", "6", "7", "8", "9", "10"] and shown(2) == []
    runs = [r["text"] for r in page.text_runs(styled).where("page_id = 0").orderBy("node_id").collect()]
    assert runs == ["2", "s", "5", "7", "9", "10", "k"]
    assert styled.count() == nodes.count() and styled.columns == nodes.columns


def test_selectors_are_read():
    assert stylesheets.selector_parts("div > p.a#b [x='y z']") == [{"child": False, "tag": "div", "tests": []}, {"child": True, "tag": "p", "tests": [".a", "#b"]}, {"child": False, "tag": None, "tests": ["[x=y z]"]}]
    assert all(stylesheets.selector_parts(s) is None for s in ("", "a:hover", "a + b", "> a", "a::before", "p ~ q", "a,b"))
    assert [(r[1][0]["tag"], r[2]) for r in stylesheets.css_rules("b{} i, u.x#y { display: none } @font-face { display: none } q { color: red }")] == [("i", 1), ("u", 10_101)]
    assert stylesheets.css_rules(None) == [] and stylesheets.css_rules("p { display: none") == [] and stylesheets.css_rules("@media { p {") == []


def folded(rows, threshold, top_k):
    def iou(a, b):
        w, h = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])), max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if a[2] * a[3] + b[2] * b[3] - w * h > 0 else 0.0

    kept, cells = [], {}
    for _, i, *r, c in sorted(rows, key=lambda r: (-r[6], r[1])):
        near = {k for x in range(int(r[0] // 50) - 1, int((r[0] + r[2]) // 50) + 2) for y in range(int(r[1] // 50) - 1, int((r[1] + r[3]) // 50) + 2) for k in cells.get((x, y), ())}
        if len(kept) < top_k and not any(iou(kept[k][1], r) >= threshold for k in near):
            for x in range(int(r[0] // 50), int((r[0] + r[2]) // 50) + 1):
                for y in range(int(r[1] // 50), int((r[1] + r[3]) // 50) + 1):
                    cells.setdefault((x, y), []).append(len(kept))
            kept.append((i, r))
    return [i for i, _ in kept]


@pytest.mark.parametrize("n,size,at_once", [(300, 300, 0), (300, 300, 10**6), (50_000, 6000, 20_000)])
def test_suppression_by_rounds_is_the_fold(spark, n, size, at_once):
    rng = random.Random(n + at_once)
    made = [(1, i, float(rng.randint(0, size)), float(rng.randint(0, size)), float(rng.choice([0, 20, 40, 60])), float(rng.choice([20, 40, 50])), rng.randint(0, 200) / 200) for i in range(n)]
    made += [(2, i, *r[2:]) for i, r in enumerate(made[:40])]
    df = spark.createDataFrame(made, "g long, i long, x double, y double, width double, height double, confidence double")
    out = boxes.suppress_by_rounds(df, "g", top_k=n - 10, at_once=at_once).collect()
    for g in (1, 2):
        assert [r["i"] for r in sorted(out, key=lambda r: r["rank"]) if r["g"] == g] == folded([r for r in made if r[0] == g], boxes.NMS_THRESHOLD, n - 10)
    if n < 1000:
        assert sorted(map(tuple, out)) == sorted(map(tuple, boxes.suppress(df, "g", top_k=n - 10).select(*out[0].asDict()).collect()))
