"""Overlap and suppression of boxes, and decoding of detector outputs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageguard.functions.geometry import Rect, iou
from pageguard.sources.tables import written

SCORE_THRESHOLD = 0.50
NMS_THRESHOLD = 0.30
TOP_K = 5000
MODEL_SIZE = 640
#: How much larger the grid's cells are from scale to scale.
FACTOR = 16


def overlapping_pairs(boxes: DataFrame, group: str, threshold: float = NMS_THRESHOLD, cell: int = 128) -> DataFrame:
    """group, a, b, iou of pairs of boxes i < j of a group with at least this overlap.

    boxes: group, i, x, y, width, height. Boxes are dealt to the grid cells that they touch and joined on the cell; a pair
    counts in the cell of the corner where its intersection begins, so it is found once. Cells are FACTOR times wider (or
    higher) at each scale, and a box spans at most FACTOR + 1 of them at its own, however large it is. Where boxes overlap
    by the threshold, neither is more than 1 / threshold times wider or higher than the other: each is dealt to the scales
    of its possible partners too, and a pair counts at the larger one's.
    """
    most = 1.001 / max(threshold, 1e-9)
    own = lambda size: F.greatest(F.lit(0), F.ceil(F.log(size / cell) / math.log(FACTOR)) - 1).cast("int")
    scales = lambda size: F.explode(F.sequence(own(size), own(size * most)))
    place = lambda v, k: F.floor(v / (cell * F.pow(F.lit(float(FACTOR)), k)))
    steps = lambda low, size, k: F.explode(F.sequence(place(low, k), place(low + size, k)))
    dealt = boxes.where("width > 0 and height > 0").withColumn("kx", scales(F.col("width"))).withColumn("ky", scales(F.col("height")))
    dealt = dealt.withColumn("cx", steps(F.col("x"), F.col("width"), F.col("kx"))).withColumn("cy", steps(F.col("y"), F.col("height"), F.col("ky")))
    keys = [group, "kx", "ky", "cx", "cy"]
    left = dealt.select(*keys, F.col("i").alias("a"), F.struct("x", "y", "width", "height").alias("p"))
    right = dealt.select(*keys, F.col("i").alias("b"), F.struct("x", "y", "width", "height").alias("q"))
    begins = (place(F.greatest("p.x", "q.x"), F.col("kx")) == F.col("cx")) & (place(F.greatest("p.y", "q.y"), F.col("ky")) == F.col("cy"))
    larger = (own(F.greatest("p.width", "q.width")) == F.col("kx")) & (own(F.greatest("p.height", "q.height")) == F.col("ky"))
    share = iou(Rect.of("p"), Rect.of("q"))
    # Dealt boxes are many times their table: by its size they would be broadcast, and be held whole by every task.
    return left.join(right.hint("merge"), keys).where("a < b").where(begins & larger).select(group, "a", "b", share.alias("iou")).where(F.col("iou") >= threshold)


def suppress(boxes: DataFrame, group: str, threshold: float = NMS_THRESHOLD, top_k: int = TOP_K) -> DataFrame:
    """Greedy non-maximum suppression in each group: the boxes that stay, best first, at most top_k.

    boxes: group, i, x, y, width, height, confidence. A group is one image's detections over the score threshold, which
    the detector's anchors bound; equal scores go by i. suppress_by_rounds gives the same for groups without a bound.
    """
    box = F.struct(F.col("confidence"), (-F.col("i")).alias("back"), F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    listed = boxes.groupBy(group).agg(F.sort_array(F.collect_list(box), asc=False).alias("all"))

    def fold(kept: Column, b: Column) -> Column:
        near = F.exists(kept, lambda k: iou(Rect(k["x"], k["y"], k["width"], k["height"]), Rect(b["x"], b["y"], b["width"], b["height"])) >= threshold)
        return F.when(near | (F.size(kept) >= top_k), kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("all", F.filter("all", lambda _: F.lit(False)), fold)
    out = listed.select(group, F.posexplode(kept).alias("rank", "b"))
    return out.select(group, (F.col("rank") + 1).cast("long").alias("rank"), (-F.col("b.back")).alias("i"), "b.x", "b.y", "b.width", "b.height", "b.confidence")


def suppress_by_rounds(boxes: DataFrame, group: str, threshold: float = NMS_THRESHOLD, top_k: int = TOP_K, at_once: int = 200_000) -> DataFrame:
    """The same rows as suppress, for groups of any size: nothing gathers a group's boxes.

    Overlapping pairs come from the grid join. In each round the boxes that no undecided better one overlaps stay, and those
    that they overlap go; what is decided leaves the pairs, so rounds get smaller. Once at_once pairs or fewer are left, each
    group's are walked through in order in one task. Greedy suppression has one result, so the order of rounds is of no
    account.
    """
    real = boxes.where("width > 0 and height > 0")
    score = real.select(group, "i", "confidence")
    side = lambda name: score.select(group, F.col("i").alias(name), F.col("confidence").alias(f"c_{name}"))
    pairs = overlapping_pairs(real, group, threshold).join(side("a"), [group, "a"]).join(side("b"), [group, "b"])
    first = (F.col("c_a") > F.col("c_b")) | ((F.col("c_a") == F.col("c_b")) & (F.col("a") < F.col("b")))
    better, worse, of_better = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a")), F.greatest("c_a", "c_b")
    left = written(pairs.select(group, better.alias("better"), worse.alias("worse"), of_better.alias("score")))
    gone = None
    while True:
        n = left.count()
        if n <= at_once:
            kinds = f"`{group}` {left.schema[group].dataType.simpleString()}, worse {left.schema['worse'].dataType.simpleString()}"
            more = left.groupBy(group).applyInPandas(_walk(group), kinds)
            gone = more if gone is None else gone.unionByName(more)
            break
        losers = left.select(group, F.col("worse").alias("better")).distinct()
        lost = written(left.join(losers, [group, "better"], "left_anti").select(group, "worse").distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        rest = left.join(lost, [group, "worse"], "left_anti").join(lost.withColumnRenamed("worse", "better"), [group, "better"], "left_anti")
        left = written(rest.select(*left.columns))
    kept = boxes.join(written(gone).withColumnRenamed("worse", "i"), [group, "i"], "left_anti")
    best = Window.partitionBy(group).orderBy(F.desc("confidence"), "i")
    out = kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top_k)
    return out.select(group, "rank", "i", "x", "y", "width", "height", "confidence")


def _walk(group: str):
    """Of one group's pairs, the boxes that go: pairs in the order of their better boxes."""

    def walk(pairs: pd.DataFrame) -> pd.DataFrame:
        out: set = set()
        for _, better, worse in pairs.sort_values(["score", "better"], ascending=[False, True])[["score", "better", "worse"]].itertuples(index=False):
            if better not in out:
                out.add(worse)
        return pd.DataFrame({group: pairs[group].iloc[0], "worse": list(out)})

    return walk


def decode_faces(tensors: DataFrame, group: str, stride: int, cells: int, image_w: float, image_h: float, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Boxes in screenshot pixels from one stride's cls, obj (arrays of cells * cells) and bbox (4 values a cell) scores.

    Scores under the threshold go before the box arithmetic.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    scored = tensors.select(group, "bbox", F.posexplode(F.arrays_zip("cls", "obj")).alias("cell", "s"))
    scored = scored.select(group, "bbox", "cell", F.sqrt(unit(F.col("s.cls")) * unit(F.col("s.obj"))).alias("confidence")).where(F.col("confidence") >= threshold)
    at = lambda k: F.get("bbox", F.col("cell") * 4 + k)
    sx, sy = image_w / MODEL_SIZE, image_h / MODEL_SIZE
    cx, cy = (F.col("cell") % cells + at(0)) * stride, (F.floor(F.col("cell") / cells) + at(1)) * stride
    w, h = F.exp(at(2)) * stride, F.exp(at(3)) * stride
    x = F.greatest(F.lit(0.0), F.least(F.lit(image_w), (cx - w / 2) * sx))
    y = F.greatest(F.lit(0.0), F.least(F.lit(image_h), (cy - h / 2) * sy))
    out = scored.select(group, F.col("cell").cast("long").alias("i"), x.alias("x"), y.alias("y"), (w * sx).alias("w"), (h * sy).alias("h"), "confidence")
    out = out.select(group, "i", "x", "y", F.least("w", F.lit(image_w) - F.col("x")).alias("width"), F.least("h", F.lit(image_h) - F.col("y")).alias("height"), "confidence")
    return out.where("width > 0 and height > 0")
