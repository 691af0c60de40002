"""Box expressions. A box is a struct or four columns x, y, w, h; its far edges are x + w and y + h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vertical bands of a page whose running matter is a header or a page number.
HEADER_BAND, FOOTER_BAND = 0.20, 0.80
#: Confidence bands.
GOOD, FAIR = 80, 50
PATCH_PAD = 3


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def x2(b: Column) -> Column:
    return b["x"] + b["w"]


def y2(b: Column) -> Column:
    return b["y"] + b["h"]


def centre_x(b: Column) -> Column:
    return b["x"] + b["w"] / 2.0


def centre_y(b: Column) -> Column:
    return b["y"] + b["h"] / 2.0


def holds_centre(outer: Column, inner: Column) -> Column:
    """Whether the inner box's centre lies in the outer box, edges included."""
    return centre_x(inner).between(outer["x"], x2(outer)) & centre_y(inner).between(outer["y"], y2(outer))


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share, 0 if none."""
    wide = F.greatest(F.lit(0), F.least(x2(a), x2(b)) - F.greatest(a["x"], b["x"]))
    return wide * F.greatest(F.lit(0), F.least(y2(a), y2(b)) - F.greatest(a["y"], b["y"]))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def iou(a: Column, b: Column) -> Column:
    """Shared area over united area; 0 for disjoint boxes."""
    return F.when(overlap(a, b) == 0, F.lit(0.0)).otherwise(overlap(a, b) / (area(a) + area(b) - overlap(a, b)))


def contained(inner: Column, outer: Column) -> Column:
    """Share of the inner box's area that the outer box covers; 0 for an empty box."""
    return F.when(area(inner) == 0, F.lit(0.0)).otherwise(overlap(inner, outer) / area(inner))


def edge_gap(a: Column, b: Column) -> Column:
    """Least distance between the edges of two boxes; 0 if they meet."""
    dx = F.greatest(F.lit(0), a["x"] - x2(b), b["x"] - x2(a)).cast("double")
    dy = F.greatest(F.lit(0), a["y"] - y2(b), b["y"] - y2(a)).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def scaled_back(left: Column, top: Column, width: Column, height: Column, scale: Column) -> Column:
    """A word's box on the unscaled page: truncated, at least one pixel wide and high."""
    def cut(c):
        return (c / scale).cast("int")

    return box(cut(left), cut(top), F.greatest(F.lit(1), cut(width)), F.greatest(F.lit(1), cut(height)))


def running_matter(b: Column, page_height: Column) -> Column:
    """What an abandoned region is, by the height of its centre."""
    return F.when(centre_y(b) < HEADER_BAND * page_height, "header").when(centre_y(b) > FOOTER_BAND * page_height, "page_number").otherwise("other")


def clamped(b: Column, page_w: Column, page_h: Column, pad: int = PATCH_PAD) -> Column:
    """The box with a margin, cut to the page; null if nothing is left."""
    left, top = F.greatest(F.lit(0), b["x"] - pad), F.greatest(F.lit(0), b["y"] - pad)
    right, bottom = F.least(page_w, x2(b) + pad), F.least(page_h, y2(b) + pad)
    return F.when((right > left) & (bottom > top), box(left, top, right - left, bottom - top))


def of_polygon(points: Column) -> Column:
    """The upright box around an array of (x, y) points, as x0, y0, x1, y1."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def united(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Column:
    """Aggregate: the box around all boxes of a group, at least one pixel wide and high."""
    left, top = F.min(x), F.min(y)
    return box(left, top, F.greatest(F.lit(1), F.max(F.col(x) + F.col(w)) - left), F.greatest(F.lit(1), F.max(F.col(y) + F.col(h)) - top))


def confidence_band(conf: Column) -> Column:
    return F.when(conf >= GOOD, "good").when(conf >= FAIR, "fair").otherwise("poor")


def hue_distance(a: Column, b: Column) -> Column:
    """Distance of two hues on a circle of 180."""
    return F.least(F.abs(a - b), 180 - F.abs(a - b))


def poly_basis(x: Column, y: Column) -> Column:
    """1, x, x², x³, y, yx, yx², y²."""
    return F.array(F.lit(1.0), x, x * x, x * x * x, y, y * x, y * x * x, y * y)
