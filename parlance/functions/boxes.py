"""Boxes and points on a page as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.numbers import round_half_even


def norm_box(
    x0: Column, top: Column, x1: Column, bottom: Column, width: Column, height: Column
) -> Column:
    """Box clipped to the page and scaled to [0, 1]; null when nothing is left."""

    def clip(value: Column, size: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(size, value.cast("double")))

    left, right = clip(x0, width), clip(x1, width)
    upper, lower = clip(top, height), clip(bottom, height)
    given = x0.isNotNull() & top.isNotNull() & x1.isNotNull() & bottom.isNotNull()
    return F.when(
        given & (width > 0) & (height > 0) & (right > left) & (lower > upper),
        F.struct(
            (left / width).alias("x0"),
            (upper / height).alias("y0"),
            (right / width).alias("x1"),
            (lower / height).alias("y1"),
        ),
    )


def box_area(box: Column) -> Column:
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])


def round_points(points: Column) -> Column:
    """Corner points rounded to 2 decimals; null unless there are exactly four."""
    rounded = F.transform(points, lambda p: F.transform(p, lambda v: round_half_even(v, 2)))
    whole = F.forall(points, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull())
    return F.when((F.size(points) == 4) & whole, rounded)


def _mean(points: Column, axis: int) -> Column:
    total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(axis)))
    return total / F.size(points)


def centre(points: Column, width: Column, height: Column) -> Column:
    """Mean of the corner points in page units; null without a box or a page size."""
    ok = points.isNotNull() & (F.size(points) > 0) & (width > 0) & (height > 0)
    return F.when(
        ok,
        F.struct(
            (_mean(points, 0) / width).alias("x"),
            (_mean(points, 1) / height).alias("y"),
        ),
    )


def point_in_box(point: Column, x0: Column, y0: Column, x1: Column, y1: Column, pad: float) -> Column:
    inside_x = (point["x"] >= x0 - pad) & (point["x"] <= x1 + pad)
    inside_y = (point["y"] >= y0 - pad) & (point["y"] <= y1 + pad)
    return F.coalesce(inside_x & inside_y, F.lit(False))


def out_of_bounds(
    left: Column, top: Column, w: Column, h: Column, page_w: Column, page_h: Column,
    tolerance: int = 2000,
) -> Column:
    """A shape that leaves the page by more than the tolerance on any side."""
    return (
        (left < -tolerance)
        | (top < -tolerance)
        | (left + w > page_w + tolerance)
        | (top + h > page_h + tolerance)
    )
