"""Queries on boxes. Layout and detector outputs have no table, so they are derived from part and embeddings by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageguard.functions.geometry import Rect, clamp, drawable, face_pixels, in_viewport, legacy_face_pixels, pad, scale, to_screenshot
from pageguard.functions.patterns import js_round
from pageguard.operators import boxes
from pageguard.operators.layout import on_screenshots, topmost
from pageguard.sources.tables import spread, table

VIEW_W, VIEW_H, IMAGE_W, IMAGE_H = 1280.0, 720.0, 1920.0, 1080.0


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    cols = {"x": k * 37 % 1600 - 150, "y": k * 53 % 1000 - 120, "width": F.col("p_size") * 3 % 140 - 5, "height": k % 90 - 2}
    return parts.select("p_partkey", F.struct(*(c.cast("double").alias(n) for n, c in cols.items())).alias("r"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    cols = {"x": k * 37 % 500, "y": k * 53 % 400, "width": 40 + F.col("p_size") * 4, "height": 40 + F.col("p_size") * 3}
    conf = (k * 7919 % 1000 / 1000.0).alias("confidence")
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.floor(k / 25).alias("image_id"), k.alias("i"), *(c.cast("double").alias(n) for n, c in cols.items()), conf)


def _flat(r: Rect, digits: int = 6) -> list:
    return [F.round(c.cast("double"), digits).alias(n) for n, c in zip(Rect._fields, r)]


def viewport_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rects(spark, sf_dir).select("p_partkey", in_viewport(Rect.of("r"), F.lit(VIEW_W), F.lit(VIEW_H)).alias("visible"))


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded, scaled and clamped rectangles."""
    r = clamp(scale(pad(Rect.of("r"), F.lit(2.5)), F.lit(0.5), F.lit(0.25)), F.lit(VIEW_W), F.lit(VIEW_H))
    return _rects(spark, sf_dir).select("p_partkey", *_flat(r))


def map_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = to_screenshot(Rect.of("r"), F.lit(VIEW_W), F.lit(VIEW_H), F.lit(IMAGE_W), F.lit(IMAGE_H))
    return _rects(spark, sf_dir).select("p_partkey", r.struct().alias("m")).where(drawable(Rect.of("m"))).select("p_partkey", *_flat(Rect.of("m")))


def screenshot_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of pages in their screenshots, by tables of viewports and of images; one page in seven has no image."""
    pages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page"))
    views = pages.select("page", (960 + F.col("page") * 32).alias("width"), (540 + F.col("page") * 18).alias("height"))
    images = pages.where("page % 7 != 3").select("page", ((960 + F.col("page") * 32) * (1 + F.col("page") % 3)).alias("width"), ((540 + F.col("page") * 18) * (1 + F.col("page") % 2)).alias("height"))
    rects = _rects(spark, sf_dir).withColumn("page", (F.col("p_partkey") % 27).cast("long"))
    return on_screenshots(rects, views, images, "page").select("p_partkey", "page", "visible", *_flat(Rect.of("m")))


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    cols = {"x": k * 7919 % 100000 / 50.0, "y": k * 104729 % 100000 / 90.0, "width": F.col("p_size") * 1.7, "height": F.col("p_size") * 2.3}
    return table(spark, sf_dir, "part").select("p_partkey", F.struct(*(c.cast("double").alias(n) for n, c in cols.items())).alias("r"))


def face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = face_pixels(Rect.of("r"), F.lit(IMAGE_W), F.lit(IMAGE_H))
    return _faces(spark, sf_dir).select("p_partkey", r.struct().alias("m")).where("m.width > 0 and m.height > 0").select("p_partkey", *_flat(Rect.of("m")))


def face_boxes_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = legacy_face_pixels(Rect.of("r"), F.lit(IMAGE_W), F.lit(IMAGE_H))
    return _faces(spark, sf_dir).select("p_partkey", *_flat(r))


def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page boxes and face boxes of one canvas together."""
    dom = map_boxes(spark, sf_dir).withColumn("kind", F.lit("dom"))
    return dom.unionByName(face_boxes(spark, sf_dir).withColumn("kind", F.lit("face"))).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(F.col("width") * F.col("height")), 2).alias("area"))


def rounded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout boxes in whole pixels, halves up."""
    cols = [js_round(F.col(f"r.{f}") / 4 - 7.5).alias(f) for f in Rect._fields]
    return _rects(spark, sf_dir).select("p_partkey", *cols)


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.overlapping_pairs(_boxes(spark, sf_dir), "image_id").withColumn("iou", F.round("iou", 9))


def nms_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.suppress(_boxes(spark, sf_dir).where(F.col("confidence") >= boxes.SCORE_THRESHOLD), "image_id").select("image_id", "rank", "i", "confidence")


def nms_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes by rounds of local maxima, as for images of any number of boxes."""
    found = _boxes(spark, sf_dir).where(F.col("confidence") >= boxes.SCORE_THRESHOLD)
    return boxes.suppress_by_rounds(found, "image_id", at_once=100).select("image_id", "rank", "i", "confidence")


def yunet_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 score maps of a detector with stride 80."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    raw = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    shift = lambda n: F.concat(F.slice("e", n + 1, 64 - n), F.slice("e", 1, n))
    tensors = raw.select("vec_id", F.transform("e", lambda v: v + 0.5).alias("cls"), F.transform(shift(7), lambda v: v + 0.6).alias("obj"), F.flatten(F.array("e", shift(1), shift(2), shift(3))).alias("bbox"))
    out = boxes.decode_faces(tensors, "vec_id", 80, 8, IMAGE_W, IMAGE_H)
    return out.select("vec_id", "i", *(F.round(c, 4).alias(c) for c in (*Rect._fields, "confidence")))


def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each box is the topmost at its own centre; later keys lie on top."""
    return topmost(_boxes(spark, sf_dir).withColumnRenamed("i", "z"), "image_id", "z", VIEW_W, VIEW_H)


QUERIES = {f.__name__: f for f in (viewport_filter, geometry, map_boxes, screenshot_boxes, face_boxes, face_boxes_legacy, redaction_boxes, rounded_boxes, iou_pairs, nms_boxes, nms_rounds, yunet_decode, hit_test)}

_RECTS = "rects as (select p_partkey, (p_partkey * 37 % 1600 - 150)::double as x, (p_partkey * 53 % 1000 - 120)::double as y, (p_size * 3 % 140 - 5)::double as w, (p_partkey % 90 - 2)::double as h from part)"
_FACES = "faces as (select p_partkey, p_partkey * 7919 % 100000 / 50.0::double as x, p_partkey * 104729 % 100000 / 90.0::double as y, p_size * 1.7::double as w, p_size * 2.3::double as h from part)"
_BOXES = "boxes as (select p_partkey // 25 as image_id, p_partkey as i, (p_partkey * 37 % 500)::double as x, (p_partkey * 53 % 400)::double as y, (40 + p_size * 4)::double as w, (40 + p_size * 3)::double as h, p_partkey * 7919 % 1000 / 1000.0::double as confidence from part)"
_MAPPED = """mapped as (select p_partkey, greatest(0, x * 1.5 - 6) as x1, greatest(0, y * 1.5 - 6) as y1, least(1920, x * 1.5 - 6 + w * 1.5 + 12) as x2, least(1080, y * 1.5 - 6 + h * 1.5 + 12) as y2 from rects),
  mapped_ok as (select p_partkey, x1::double as x, y1::double as y, (x2 - x1)::double as width, (y2 - y1)::double as height from mapped where x2 > x1 and y2 > y1)"""
_FACED = """faced as (select p_partkey, greatest(0, least(1920, floor(x - 10))) as x1, greatest(0, least(1080, floor(y - 10))) as y1, ceil(x + w + 10) as r, ceil(y + h + 10) as b from faces),
  faced_ok as (select p_partkey, x1::double as x, y1::double as y, (greatest(x1, least(1920, r)) - x1)::double as width, (greatest(y1, least(1080, b)) - y1)::double as height from faced
    where greatest(x1, least(1920, r)) > x1 and greatest(y1, least(1080, b)) > y1)"""
_IOU = "(case when {a}.w * {a}.h + {b}.w * {b}.h - {i} > 0 then {i} / ({a}.w * {a}.h + {b}.w * {b}.h - {i}) else 0 end)"


def _iou(a: str, b: str) -> str:
    inner = f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    return _IOU.format(a=a, b=b, i=inner)


ORACLE_SQL: dict[str, str] = {
    "viewport_filter": f"with {_RECTS} select p_partkey, w > 0 and h > 0 and y + h > 0 and x + w > 0 and y < 720 and x < 1280 as visible from rects",
    "geometry": f"""with {_RECTS}, p as (select p_partkey, (x - 2.5) * 0.5 as x, (y - 2.5) * 0.25 as y, (w + 5) * 0.5 as w, (h + 5) * 0.25 as h from rects)
      select p_partkey, round(greatest(0, x), 6)::double as x, round(greatest(0, y), 6)::double as y, round(greatest(0, least(1280, x + w) - greatest(0, x)), 6)::double as width,
      round(greatest(0, least(720, y + h) - greatest(0, y)), 6)::double as height from p""",
    "map_boxes": f"with {_RECTS}, {_MAPPED} select * from mapped_ok",
    "face_boxes": f"with {_FACES}, {_FACED} select * from faced_ok",
    "face_boxes_legacy": f"""with {_FACES} select p_partkey, greatest(0, floor(x - 4))::double as x, greatest(0, floor(y - 4))::double as y,
      least(1920 - greatest(0, floor(x - 4)), ceil(w + 8))::double as width, least(1080 - greatest(0, floor(y - 4)), ceil(h + 8))::double as height from faces""",
    "redaction_boxes": f"""with {_RECTS}, {_MAPPED}, {_FACES}, {_FACED}, u as (select 'dom' as kind, * from mapped_ok union all select 'face' as kind, * from faced_ok)
      select kind, count(*) as n, round(sum(width * height), 2) as area from u group by kind""",
    "rounded_boxes": f"with {_RECTS} select p_partkey, floor(x / 4 - 7)::bigint as x, floor(y / 4 - 7)::bigint as y, floor(w / 4 - 7)::bigint as width, floor(h / 4 - 7)::bigint as height from rects",
    "iou_pairs": f"with {_BOXES} select a.image_id, a.i as a, b.i as b, round({_iou('a', 'b')}, 9)::double as iou from boxes a join boxes b on a.image_id = b.image_id and a.i < b.i where {_iou('a', 'b')} >= 0.3",
    "screenshot_boxes": f"""with {_RECTS}, v as (select n_nationkey::bigint as page, 960.0::double + n_nationkey * 32 as vw, 540.0::double + n_nationkey * 18 as vh from nation),
      j as (select r.*, p_partkey % 27 as page, vw, vh, case when v.page % 7 != 3 then vw * (1 + v.page % 3) end as iw, case when v.page % 7 != 3 then vh * (1 + v.page % 2) end as ih from rects r left join v on v.page = p_partkey % 27),
      s as (select *, iw / vw as sx, ih / vh as sy, 4 * (iw / vw + ih / vh) / 2 as pad from j),
      m as (select *, greatest(0, x * sx - pad) as x1, greatest(0, y * sy - pad) as y1, least(iw, x * sx - pad + w * sx + pad * 2) as x2, least(ih, y * sy - pad + h * sy + pad * 2) as y2 from s),
      k as (select *, coalesce(x2 > x1 and y2 > y1, false) as ok from m)
      select p_partkey, page::bigint as page, coalesce(w > 0 and h > 0 and y + h > 0 and x + w > 0 and y < vh and x < vw, false) as visible,
      case when ok then round(x1, 6)::double end as x, case when ok then round(y1, 6)::double end as y, case when ok then round(x2 - x1, 6)::double end as width, case when ok then round(y2 - y1, 6)::double end as height from k""",
    "nms_boxes": f"""with recursive {_BOXES}, ranked as (select *, row_number() over (partition by image_id order by confidence desc, i) as n from boxes where confidence >= 0.5),
      walk as (select image_id, n, [{{'i': i, 'x': x, 'y': y, 'w': w, 'h': h, 'c': confidence}}] as kept from ranked where n = 1 union all
        select r.image_id, r.n, case when len(list_filter(k.kept, lambda q: {_iou('q', 'r')} >= 0.3)) > 0 then k.kept else list_append(k.kept, {{'i': r.i, 'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h, 'c': r.confidence}}) end
        from walk k join ranked r on r.image_id = k.image_id and r.n = k.n + 1),
      final as (select image_id, arg_max(kept, n) as kept from walk group by image_id), o as (select image_id, kept, unnest(range(1, len(kept) + 1)) as rank from final)
      select image_id, rank, kept[rank].i as i, kept[rank].c as confidence from o""",
    "yunet_decode": """with c as (select vec_id, embedding as e, unnest(range(64)) as i from embeddings),
      v as (select vec_id, i, e, e[i + 1]::double + 0.5 as cls, e[(i + 7) % 64 + 1]::double + 0.6 as obj from c),
      b as (select vec_id, i, sqrt(greatest(0, least(1, cls)) * greatest(0, least(1, obj))) as s, [e[(i * 4 + k + (i * 4 + k) // 64) % 64 + 1]::double for k in range(4)] as d from v),
      g as (select vec_id, i, s, (i % 8 + d[1]) * 80 as cx, (i // 8 + d[2]) * 80 as cy, exp(d[3]) * 80 as w, exp(d[4]) * 80 as h from b where s >= 0.5),
      p as (select vec_id, i, s, greatest(0, least(1920, (cx - w / 2) * 3)) as x, greatest(0, least(1080, (cy - h / 2) * 1.6875)) as y, w * 3 as w, h * 1.6875 as h from g)
      select vec_id, i, round(x, 4)::double as x, round(y, 4)::double as y, round(least(w, 1920 - x), 4)::double as width, round(least(h, 1080 - y), 4)::double as height, round(s, 4)::double as confidence from p
      where least(w, 1920 - x) > 0 and least(h, 1080 - y) > 0""",
    "hit_test": f"""with {_BOXES}, c as (select *, least(greatest(x + w / 2, 0), 1279) as cx, least(greatest(y + h / 2, 0), 719) as cy from boxes),
      t as (select a.image_id, a.i, max(b.i) as top from c a join boxes b on a.image_id = b.image_id and a.cx >= b.x and a.cx < b.x + b.w and a.cy >= b.y and a.cy < b.y + b.h group by all)
      select a.image_id, a.i as z, t.top, coalesce(t.top = a.i, true) as on_top from boxes a left join t on t.image_id = a.image_id and t.i = a.i""",
}
ORACLE_SQL["nms_rounds"] = ORACLE_SQL["nms_boxes"]
