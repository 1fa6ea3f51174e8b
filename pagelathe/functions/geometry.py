"""Boxes as structs (x0, y0, x1, y1) of integers. Every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def _pixels(value: Column, extent: Column, scale: float) -> Column:
    """Single precision, half away from zero."""
    return F.round((value.cast("float") / F.lit(scale).cast("float")).cast("float") * extent.cast("float")).cast("int")


def from_fraction(b: Column, width: Column, height: Column, scale: float = 1.0) -> Column:
    """A box in parts of the page, of scale parts, in pixels."""
    return box(*[_pixels(b[c], width if c[0] == "x" else height, scale) for c in ("x0", "y0", "x1", "y1")])


def sanitized(b: Column, width: Column, height: Column) -> Column:
    """Corners in order, within the page."""
    ends = lambda f, a: f(b[f"{a}0"], b[f"{a}1"])
    held = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
    return box(held(ends(F.least, "x"), width), held(ends(F.least, "y"), height), held(ends(F.greatest, "x"), width), held(ends(F.greatest, "y"), height))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0)).cast("long") * F.greatest(b["y1"] - b["y0"], F.lit(0)).cast("long")


def intersection(a: Column, b: Column) -> Column:
    wide = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0)).cast("long")
    return wide * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0)).cast("long")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def keep_by_iou(boxes: Column, threshold: float) -> Column:
    """The structs of an array that overlap no struct kept before them by more than threshold; field box is the box."""
    none = F.filter(boxes, lambda x: F.lit(False))
    clash = lambda kept, b: F.exists(kept, lambda k: iou(k["box"], b["box"]) > threshold)
    return F.aggregate(boxes, none, lambda kept, b: F.when(clash(kept, b), kept).otherwise(F.concat(kept, F.array(b))))


def bounds(points: Column) -> Column:
    """The box around an array of structs (x, y)."""
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def translated(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy)


def polygon_bounds(corners: Column) -> Column:
    """The box around a flat list of 4 numbers, two corners, or 8, four corners; null for other lengths."""
    even, odd = F.filter(corners, lambda _, k: k % 2 == 0), F.filter(corners, lambda _, k: k % 2 == 1)
    around = F.struct(F.array_min(even).alias("x0"), F.array_min(odd).alias("y0"), F.array_max(even).alias("x1"), F.array_max(odd).alias("y1"))
    return F.when(F.size(corners).isin(4, 8), around)


def pixels_to_points(b: Column, dpi: Column, left: Column, top: Column) -> Column:
    """A box of a crop in pixels, in points of the page that it was cut from; a resolution of 0 counts as 72."""
    scale = F.when(dpi > 0, F.lit(72.0) / dpi).otherwise(F.lit(1.0))
    return F.struct(*[(b[c] * scale + (left if c[0] == "x" else top)).alias(c) for c in ("x0", "y0", "x1", "y1")])
