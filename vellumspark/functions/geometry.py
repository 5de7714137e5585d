"""Box expressions over structs of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]), F.lit(1e-6))


def intersection(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    return intersection(a, b) / F.least(area(a), area(b))


def cover(inner: Column, outer: Column) -> Column:
    """Intersection over the inner area."""
    return intersection(inner, outer) / area(inner)


def centre_inside(inner: Column, outer: Column) -> Column:
    x, y = (inner["x0"] + inner["x1"]) / 2, (inner["y0"] + inner["y1"]) / 2
    return x.between(outer["x0"], outer["x1"]) & y.between(outer["y0"], outer["y1"])


def quad_to_rect(quad: Column) -> Column:
    """array<array<double>> of corners to a box; null if empty or malformed."""
    xs, ys = F.transform(quad, lambda p: F.get(p, 0)), F.transform(quad, lambda p: F.get(p, 1))
    ok = (F.size(quad) > 0) & ~F.exists(quad, lambda p: F.get(p, 0).isNull() | F.get(p, 1).isNull())
    return F.when(ok, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def rect_of(numbers: Column) -> Column:
    """array<double> of x0, y0, x1, y1 to a box; null if there are fewer."""
    return F.when(F.size(numbers) >= 4, box(*(F.get(numbers, k) for k in range(4))))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def scaled(b: Column, sx, sy) -> Column:
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def shifted(b: Column, dx, dy) -> Column:
    return box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy)


def from_bottom_left(b: Column, height) -> Column:
    a, c = height - b["y0"], height - b["y1"]
    return box(F.least(b["x0"], b["x1"]), F.least(a, c), F.greatest(b["x0"], b["x1"]), F.greatest(a, c))


def snapped(v: Column, grid: float) -> Column:
    """To the nearest multiple of the grid, halves to the even one."""
    return F.bround(v / grid) * grid


def alignment(line: Column, block: Column) -> Column:
    w = F.greatest(block["x1"] - block["x0"], F.lit(1.0))
    left, right = (line["x0"] - block["x0"]) / w, (block["x1"] - line["x1"]) / w
    return F.when((left > 0.08) & (right > 0.08) & (F.abs(left - right) < 0.08), "CENTER").when((right < 0.03) & (left > 0.15), "RIGHT").otherwise("LEFT")


def label_line(class_id: Column, b: Column, width, height) -> Column:
    """The line of a label file: class, centre and size as shares of the page, six decimals."""
    shares = (b["x0"] + b["x1"]) / 2 / width, (b["y0"] + b["y1"]) / 2 / height, F.abs(b["x1"] - b["x0"]) / width, F.abs(b["y1"] - b["y0"]) / height
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, *(F.bround(v, 6) for v in shares))  # halves to even, as C formats them
