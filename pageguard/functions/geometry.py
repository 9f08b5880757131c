"""Rectangles in page and screenshot pixels, as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    x: Column
    y: Column
    width: Column
    height: Column

    @classmethod
    def of(cls, struct: str) -> Rect:
        return cls(*(F.col(f"{struct}.{f}") for f in cls._fields))

    def struct(self) -> Column:
        return F.struct(*(c.cast("double").alias(f) for f, c in zip(self._fields, self)))


def in_viewport(r: Rect, width: Column, height: Column) -> Column:
    ok = (r.width > 0) & (r.height > 0) & (r.y + r.height > 0) & (r.x + r.width > 0) & (r.y < height) & (r.x < width)
    return F.coalesce(ok, F.lit(False))


def clamp(r: Rect, width: Column, height: Column) -> Rect:
    x, y = F.greatest(F.lit(0.0), r.x), F.greatest(F.lit(0.0), r.y)
    right, bottom = F.least(width, r.x + r.width), F.least(height, r.y + r.height)
    return Rect(x, y, F.greatest(F.lit(0.0), right - x), F.greatest(F.lit(0.0), bottom - y))


def pad(r: Rect, by: Column) -> Rect:
    return Rect(r.x - by, r.y - by, r.width + by * 2, r.height + by * 2)


def scale(r: Rect, sx: Column, sy: Column) -> Rect:
    return Rect(r.x * sx, r.y * sy, r.width * sx, r.height * sy)


def to_screenshot(r: Rect, view_w: Column, view_h: Column, image_w: Column, image_h: Column, padding: float = 4.0) -> Rect:
    """A page box in screenshot pixels, grown by padding at the mean scale and cut at the image."""
    sx, sy = image_w / view_w, image_h / view_h
    return clamp(pad(scale(r, sx, sy), F.lit(padding) * ((sx + sy) / 2)), image_w, image_h)


def face_pixels(r: Rect, image_w: Column, image_h: Column, padding: int = 10) -> Rect:
    """Whole pixels around a padded face, outward, cut at the image."""
    cut = lambda v, low, high: F.greatest(low, F.least(high, v))
    zero = F.lit(0.0)
    x, y = cut(F.floor(r.x - padding), zero, image_w), cut(F.floor(r.y - padding), zero, image_h)
    right, bottom = cut(F.ceil(r.x + r.width + padding), x, image_w), cut(F.ceil(r.y + r.height + padding), y, image_h)
    return Rect(x, y, right - x, bottom - y)


def legacy_face_pixels(r: Rect, image_w: Column, image_h: Column, padding: int = 4) -> Rect:
    """The older rule: origin floored at 0, size rounded up with both paddings, cut at the edge."""
    x, y = F.greatest(F.lit(0.0), F.floor(r.x - padding)), F.greatest(F.lit(0.0), F.floor(r.y - padding))
    return Rect(x, y, F.least(image_w - x, F.ceil(r.width + 2 * padding)), F.least(image_h - y, F.ceil(r.height + 2 * padding)))


def iou(a: Rect, b: Rect) -> Column:
    """Intersection over union, 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a.x + a.width, b.x + b.width) - F.greatest(a.x, b.x))
    h = F.greatest(F.lit(0.0), F.least(a.y + a.height, b.y + b.height) - F.greatest(a.y, b.y))
    union = a.width * a.height + b.width * b.height - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def drawable(r: Rect) -> Column:
    """Finite numbers and a positive size."""
    ok = (r.width > 0) & (r.height > 0)
    for c in r:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.coalesce(ok, F.lit(False))
