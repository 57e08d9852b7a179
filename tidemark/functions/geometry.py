"""Boxes as four columns x1, y1, x2, y2 in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.intervals import overlap_seconds, safe_div

Box = tuple[Column, Column, Column, Column]


def corners(box: Column) -> Box:
    return tuple(F.get(box, F.lit(k)) for k in range(4))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0), b[2] - b[0]) * F.greatest(F.lit(0), b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    return overlap_seconds(a[0], a[2], b[0], b[2]) * overlap_seconds(a[1], a[3], b[1], b[3])


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return safe_div(both, area(a) + area(b) - both)


def centre_distance(a: Box, b: Box) -> Column:
    return F.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def area_ratio(a: Box, b: Box) -> Column:
    return safe_div(F.least(area(a), area(b)), F.greatest(area(a), area(b)))


def visible_ratio(b: Box, width: Column, height: Column) -> Column:
    """The share of a box that is inside its frame."""
    return safe_div(intersection(b, (F.lit(0), F.lit(0), width, height)), area(b))


def centre_bucket(b: Box, width: Column, height: Column, cells: int = 20) -> Column:
    at = lambda lo, hi, size: F.rint((lo + hi) / 2 / size * cells).cast("int")
    return F.struct(at(b[0], b[2], width).alias("x"), at(b[1], b[3], height).alias("y"))


def crop_status(b: Box, width: Column, height: Column, least: float = 0.35) -> Column:
    return (
        F.when(b[0].isNull() | b[1].isNull() | b[2].isNull() | b[3].isNull(), "no_bbox")
        .when(~F.coalesce((width > 0) & (height > 0), F.lit(False)), "missing_frame_dimensions")
        .when((b[2] <= b[0]) | (b[3] <= b[1]), "invalid_bbox")
        .when(visible_ratio(b, width, height) < least, "low_visible_ratio")
        .otherwise("ok")
    )


def base_crop(width: Column, height: Column) -> Column:
    """Shares of width and height of the largest 9:16 crop."""
    wide = width * 16 > height * 9
    return F.struct(F.when(wide, height * 9.0 / (width * 16)).otherwise(F.lit(1.0)).alias("width"), F.when(wide, F.lit(1.0)).otherwise(width * 16.0 / (height * 9)).alias("height"))
