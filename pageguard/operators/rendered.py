"""Pages with a layout: boxes of elements, line boxes of text, and what follows from them.

A browser's layout is an input. Boxes and lines are in viewport pixels; joins on them go by grid cells and by buckets of a
text's places, never over all pairs of a page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageguard.functions.geometry import Rect, in_viewport
from pageguard.functions.patterns import js_round

#: Code points of a text in one bucket of the join of ranges with lines.
BUCKET = 512
CELL = 128


@dataclass(frozen=True)
class Layout:
    """Tables of pages' layouts.

    boxes: page_id, node_id, x, y, width, height and z of elements, z being their place in the stacking order (unique in a
    page, higher on top). lines: page_id, node_id, start, end, x, y, width, height of text nodes' lines, start and end being
    0-based code points of the node's whole text. viewports: page_id, width, height.
    """

    boxes: DataFrame
    lines: DataFrame
    viewports: DataFrame

    def views(self) -> DataFrame:
        size = lambda c: F.col(c).cast("double").alias(f"view_{c[0]}")
        return self.viewports.select("page_id", size("width"), size("height"))


def _box(r: Rect) -> Column:
    """A rectangle in whole pixels, halves up."""
    return F.struct(*(js_round(c).alias(n) for n, c in zip(Rect._fields, r)))


def in_view(df: DataFrame, layout: Layout, r: str) -> Column:
    return in_viewport(Rect.of(r), F.col("view_w"), F.col("view_h"))


def range_boxes(ranges: DataFrame, layout: Layout) -> DataFrame:
    """ranges (page_id, node_id, start, end: code points of a text node) with bbox: where they lie, null if off the screen.

    A range over several lines has the rectangle that holds its parts; a part of a line is cut out at an even pitch. Ranges
    and lines meet on buckets of BUCKET code points; a pair counts in the one where both first are, so it is found once.
    """
    key = ["page_id", "node_id", "start", "end"]
    buckets = lambda: F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / BUCKET)))
    asked = ranges.where("end > start").select("page_id", "node_id", F.col("start").alias("from"), F.col("end").alias("to"), buckets().alias("bucket"))
    lines = layout.lines.where("end > start").select(*key, F.struct(*Rect._fields).alias("r"), buckets().alias("bucket"))
    met = asked.join(lines, ["page_id", "node_id", "bucket"]).where((F.col("from") < F.col("end")) & (F.col("to") > F.col("start")))
    met = met.where(F.floor(F.greatest("from", "start") / BUCKET) == F.col("bucket"))
    pitch = F.col("r.width") / (F.col("end") - F.col("start"))
    left = F.col("r.x") + (F.greatest("from", "start") - F.col("start")) * pitch
    right = F.col("r.x") + (F.least("to", "end") - F.col("start")) * pitch
    whole = met.groupBy("page_id", "node_id", "from", "to").agg(F.min(left).alias("x"), F.min("r.y").alias("y"), F.max(right).alias("right"), F.max(F.col("r.y") + F.col("r.height")).alias("bottom"))
    whole = whole.select("page_id", "node_id", F.col("from").alias("start"), F.col("to").alias("end"), F.struct("x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height")).alias("r"))
    seen = whole.join(layout.views(), "page_id")
    return ranges.join(seen.where(in_view(seen, layout, "r")).select(*key, _box(Rect.of("r")).alias("bbox")), key, "left")


def shown_runs(runs: DataFrame, layout: Layout) -> DataFrame:
    """Runs of which some part lies in the viewport, with bbox, the rectangle that holds all their lines."""
    lines = layout.lines.groupBy("page_id", "node_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"))
    r = F.struct("x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"))
    own = runs.join(lines.select("page_id", "node_id", r.alias("r")), ["page_id", "node_id"]).join(layout.views(), "page_id")
    return own.where(in_view(own, layout, "r")).select(*runs.columns, _box(Rect.of("r")).alias("bbox"))


def on_top(nodes: DataFrame, layout: Layout) -> DataFrame:
    """page_id, node_id and bbox of elements that lie in the viewport and are not covered at their centre.

    nodes: page_id, node_id and path of elements. What counts is the element of the highest z over the centre, which is kept
    inside the viewport: it must be the element itself, lie in it, or contain it. With nothing there, the element counts.
    Centres and boxes meet on the grid cells of the viewport that a box touches.
    """
    placed = layout.boxes.select("page_id", "node_id", "z", F.struct(*(F.col(c).cast("double").alias(c) for c in Rect._fields)).alias("r"))
    placed = placed.join(nodes.select("page_id", "node_id", "path"), ["page_id", "node_id"]).join(layout.views(), "page_id")
    placed = placed.where(in_view(placed, layout, "r"))
    edge = lambda low, size, view: F.sequence(F.floor(F.greatest(low, F.lit(0.0)) / CELL), F.floor(F.least(low + size, view - 1) / CELL))
    r = Rect.of("r")
    over = placed.withColumn("cx", F.explode(edge(r.x, r.width, F.col("view_w")))).withColumn("cy", F.explode(edge(r.y, r.height, F.col("view_h"))))
    over = over.select("page_id", "cx", "cy", F.struct("z", "node_id", "path").alias("o"), "r")
    at = lambda low, size, view: F.least(F.greatest(low + size / 2, F.lit(0.0)), view - 1)
    centres = placed.withColumn("px", at(r.x, r.width, F.col("view_w"))).withColumn("py", at(r.y, r.height, F.col("view_h")))
    centres = centres.select("page_id", "node_id", "px", "py", F.floor(F.col("px") / CELL).alias("cx"), F.floor(F.col("py") / CELL).alias("cy"))
    inside = (F.col("px") >= r.x) & (F.col("px") < r.x + r.width) & (F.col("py") >= r.y) & (F.col("py") < r.y + r.height)
    tops = centres.join(over, ["page_id", "cx", "cy"]).where(inside).groupBy("page_id", "node_id").agg(F.max_by("o", "o.z").alias("o"))
    out = placed.join(tops, ["page_id", "node_id"], "left")
    good = F.array_contains("o.path", F.col("node_id")) | F.array_contains("path", F.col("o.node_id"))
    return out.where(F.coalesce(good, F.lit(True))).select("page_id", "node_id", _box(r).alias("bbox"))
