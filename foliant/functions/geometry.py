"""Box algebra over struct columns (x_min, y_min, x_max, y_max)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x_min, y_min, x_max, y_max) -> Column:
    return F.struct(x_min.alias("x_min"), y_min.alias("y_min"), x_max.alias("x_max"), y_max.alias("y_max"))


def area(b: Column) -> Column:
    return F.greatest(b["x_max"] - b["x_min"], F.lit(0.0)) * F.greatest(b["y_max"] - b["y_min"], F.lit(0.0))


def intersects(a: Column, b: Column) -> Column:
    """Touching boxes intersect."""
    return (a["x_min"] <= b["x_max"]) & (b["x_min"] <= a["x_max"]) & (a["y_min"] <= b["y_max"]) & (b["y_min"] <= a["y_max"])


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"])
    h = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    inter = intersection_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """The share of a that lies in b."""
    return F.when(area(a) > 0, intersection_area(a, b) / area(a)).otherwise(0.0)


def merge(a: Column, b: Column) -> Column:
    return box(F.least(a["x_min"], b["x_min"]), F.least(a["y_min"], b["y_min"]), F.greatest(a["x_max"], b["x_max"]), F.greatest(a["y_max"], b["y_max"]))


def contains_point(b: Column, x: Column, y: Column) -> Column:
    """Closed on all sides."""
    return (x >= b["x_min"]) & (x <= b["x_max"]) & (y >= b["y_min"]) & (y <= b["y_max"])


def contains_half_open(b: Column, x: Column, y: Column) -> Column:
    """The library's ``in``: upper edges are outside."""
    return (x >= b["x_min"]) & (x < b["x_max"]) & (y >= b["y_min"]) & (y < b["y_max"])


def flip_y(y: Column, height: Column, page_height: Column) -> Column:
    """y-down to y-up and back."""
    return page_height - y - height
