"""Column functions on boxes: struct<x0, y0, x1, y1: double>, y growing downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def from_array(a: Column) -> Column:
    """A box from four numbers; zeros where there are fewer."""
    return F.when(F.size(a) >= 4, box(*[F.get(a, F.lit(k)) for k in range(4)])).otherwise(box(0, 0, 0, 0))


def from_polygon(points: Column) -> Column:
    """The box around an array of points (arrays of x and y)."""
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def _shared(a: Column, b: Column, low: str, high: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))


def iou(a: Column, b: Column) -> Column:
    inside = _shared(a, b, "x0", "x1") * _shared(a, b, "y0", "y1")
    union = width(a) * height(a) + width(b) * height(b) - inside
    return F.when(union > 0, inside / union).otherwise(0.0)


def vertical_overlap(a: Column, b: Column) -> Column:
    """Shared height over the lesser height."""
    least = F.least(height(a), height(b))
    return F.when(least > 0, _shared(a, b, "y0", "y1") / least).otherwise(0.0)


def horizontal_overlap(a: Column, b: Column) -> Column:
    least = F.least(width(a), width(b))
    return F.when(least > 0, _shared(a, b, "x0", "x1") / least).otherwise(0.0)


def part_of_line(b: Column, start: Column, end: Column, length: Column) -> Column:
    """The share of a line's box between two character offsets."""
    w, n = b["x1"] - b["x0"], F.greatest(F.lit(1), length)
    return box(b["x0"] + start / n * w, b["y0"], b["x0"] + end / n * w, b["y1"])


def right_distance(target: Column, other: Column, *, most: float, overlap: float = 0.3) -> Column:
    """How far ``other`` is to the right on the same baseline; null if it is not."""
    ahead, off = other["x0"] - target["x1"], F.abs(center_y(target) - center_y(other))
    level = (vertical_overlap(target, other) >= overlap) | (off <= F.greatest(F.lit(10.0), (height(target) + height(other)) / 2 * 0.6))
    return F.when((ahead >= -10.0) & (ahead <= most) & level, F.hypot(F.greatest(F.lit(0.0), ahead), off))


def below_distance(target: Column, other: Column, *, most: float, overlap: float = 0.2) -> Column:
    """How far ``other`` is below in the same column; null if it is not."""
    down, off = other["y0"] - target["y1"], F.abs(target["x0"] - other["x0"])
    aligned = (horizontal_overlap(target, other) >= overlap) | (off <= 100.0)
    return F.when((down >= -5.0) & (down <= most) & aligned, F.hypot(off * 0.5, F.greatest(F.lit(0.0), down)))


def neighbor_score(distance: Column, most: float) -> Column:
    return F.greatest(F.lit(0.5), 1.0 - distance / most)


def equal_columns(b: Column, labels: Column) -> Column:
    """Array of (label, x0, x1): the box's width dealt out equally to the labels."""
    step = (b["x1"] - b["x0"]) / F.greatest(F.lit(1), F.size(labels))
    return F.transform(labels, lambda t, i: F.struct(t.alias("label"), (b["x0"] + i * step).alias("x0"), (b["x0"] + (i + 1) * step).alias("x1")))


def reading_order(items: Column) -> Column:
    """Items (structs with ``bbox``) by bands from top to bottom, from left to right inside a band.

    Items are taken by their upper edge; each joins the first band whose first item lies level with
    it, or opens a band.
    """
    by_top = F.array_sort(F.transform(items, lambda x, i: F.struct(x["bbox"]["y0"].alias("y0"), i.alias("i"), x.alias("item"))))

    def put(bands: Column, x: Column) -> Column:
        b = x["item"]["bbox"]

        def level(band: Column) -> Column:
            first = F.get(band, F.lit(0))["item"]["bbox"]
            near = F.abs(center_y(b) - center_y(first)) <= F.greatest(F.lit(8.0), (height(b) + height(first)) / 2 * 0.5)
            return near | (vertical_overlap(b, first) > 0.4)

        fits = F.transform(bands, level)
        at = F.array_position(fits, F.lit(True))
        joined = F.transform(bands, lambda band, i: F.when(i + 1 == at, F.concat(band, F.array(x))).otherwise(band))
        return F.when(at > 0, joined).otherwise(F.concat(bands, F.array(F.array(x))))

    empty = F.filter(F.transform(by_top, lambda x: F.array(x)), lambda band: F.lit(False))
    bands = F.aggregate(by_top, empty, put)
    inside = F.transform(bands, lambda band: F.array_sort(F.transform(band, lambda x: F.struct(x["item"]["bbox"]["x0"].alias("x0"), x["y0"].alias("y0"), x["i"].alias("i"), x["item"].alias("item")))))
    return F.transform(F.flatten(inside), lambda x: x["item"])
