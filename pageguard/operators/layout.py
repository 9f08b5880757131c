"""What lies on top of what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageguard.functions.geometry import Rect, drawable, in_viewport, to_screenshot


def text_box(start: Column, length: Column, columns: int = 80, char: int = 8, line: int = 16) -> Rect:
    """Where a match lies in text set at a fixed pitch: a stand-in for a browser's layout of the match's first line."""
    x, y = F.pmod(start, F.lit(columns)) * char, F.floor(start / columns) * line
    return Rect(x.cast("double"), y.cast("double"), (length * char).cast("double"), F.lit(float(line)))


def topmost(boxes: DataFrame, group: str, z: str, view_w: float, view_h: float, cell: int = 128, path: str | None = None) -> DataFrame:
    """group, z, top and on_top: the box of the highest z over each box's centre, and whether it is the box itself.

    The centre is kept inside the viewport. With `path` (array of ancestors' z and the own), a top box that contains the
    other, or lies in it, counts as well. Boxes are joined with centres of their group on the grid cells that they touch.
    """
    cells = lambda low, size, view: F.sequence(F.floor(F.greatest(low, F.lit(0.0)) / cell), F.floor(F.least(low + size, F.lit(view - 1)) / cell))
    # No centre lies outside the viewport: a box's cells are those inside it, however large the box.
    shown = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("x") <= view_w - 1) & (F.col("y") <= view_h - 1) & (F.col("x") + F.col("width") > 0) & (F.col("y") + F.col("height") > 0)
    over = boxes.where(shown).withColumn("cx", F.explode(cells(F.col("x"), F.col("width"), view_w))).withColumn("cy", F.explode(cells(F.col("y"), F.col("height"), view_h)))
    over = over.select(group, "cx", "cy", F.struct(F.col(z).alias("z"), *([F.col(path).alias("path")] if path else [])).alias("o"), "x", "y", "width", "height")
    px = F.least(F.greatest(F.col("x") + F.col("width") / 2, F.lit(0.0)), F.lit(view_w - 1))
    py = F.least(F.greatest(F.col("y") + F.col("height") / 2, F.lit(0.0)), F.lit(view_h - 1))
    centres = boxes.select(group, F.col(z).alias("own"), px.alias("px"), py.alias("py")).withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    inside = (F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("width")) & (F.col("py") >= F.col("y")) & (F.col("py") < F.col("y") + F.col("height"))
    tops = centres.join(over, [group, "cx", "cy"]).where(inside).groupBy(group, F.col("own").alias(z)).agg(F.max("o").alias("o"))
    out = boxes.select(group, z, *([path] if path else [])).join(tops, [group, z], "left")
    good = F.col("o.z") == F.col(z)
    if path:
        good = good | F.array_contains(F.col("o.path"), F.col(z)) | F.array_contains(F.col(path), F.col("o.z"))
    return out.select(group, z, F.col("o.z").alias("top"), F.coalesce(good, F.lit(True)).alias("on_top"))


def on_screenshots(boxes: DataFrame, viewports: DataFrame, images: DataFrame, page: str) -> DataFrame:
    """boxes (page and any keys, r a rectangle in page pixels) with visible and m, the rectangle in the page's screenshot.

    viewports and images hold one row a page with width and height; Spark broadcasts them where they are small. A box of
    a page without either, or without a drawable part in the image, has a null m; without a viewport it is not visible.
    """
    sized = lambda df, prefix: df.select(page, F.col("width").cast("double").alias(f"{prefix}_w"), F.col("height").cast("double").alias(f"{prefix}_h"))
    out = boxes.join(sized(viewports, "view"), page, "left").join(sized(images, "image"), page, "left")
    r = Rect.of("r")
    size = [F.col(c) for c in ("view_w", "view_h", "image_w", "image_h")]
    out = out.withColumn("visible", in_viewport(r, *size[:2])).withColumn("m", to_screenshot(r, *size).struct())
    whole = size[0].isNotNull() & size[2].isNotNull() & drawable(Rect.of("m"))
    return out.withColumn("m", F.when(whole, F.col("m"))).drop("view_w", "view_h", "image_w", "image_h")
