"""Frames and pages: choosing frames, finding gutters in profiles, cutting pages, splitting figures, blocks, dewarp fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, poly_basis
from .ordering import moving_average, runs, split_by_gaps, suppress, xy_cut

AREA_SHARE = 0.70
BAND, VALLEY, PINCH, AGREE = (0.30, 0.70), 0.55, 0.11, 0.03
SMOOTH_INK, SMOOTH_EXTENT = 0.02, 0.04
MARGINS = {"ink": 0.010, "pinch": 0.020}
SEAM, SEAM_LEAST, SEAM_SHARE, PART_LEAST = 0.90, 8, 0.012, 0.06
LINES_LEAST, PIXELS_LEAST, CLAMP = 6, 3.0, 0.06


def partition_frames(frames: DataFrame, by: list[str], share: float = AREA_SHARE) -> DataFrame:
    """frames (idx, area, sharpness) with role: base for the sharpest of those near the largest area, else full or closeup.

    Two aggregates by ``by`` and joins, so a group's frames need not be sorted in one place."""
    most = frames.groupBy(*by).agg(F.max("area").alias("_most"))
    marked = frames.join(most, by).withColumn("_full", F.col("area") >= share * F.col("_most"))
    base = marked.filter("_full").groupBy(*by).agg(F.max_by("idx", F.struct("sharpness", -F.col("idx"))).alias("_base"))
    role = F.when(F.col("idx") == F.col("_base"), "base").when(F.col("_full"), "full").otherwise("closeup")
    return marked.join(base, by).withColumn("role", role).drop("_most", "_full", "_base")


def fuse_method(full: Column, closeups: Column) -> Column:
    return F.when(full + closeups == 1, "single").when(closeups > 0, "sharpest+stitch").otherwise("sharpest")


def smoothed(profile: DataFrame, by: list[str], value: str, width: int) -> DataFrame:
    return profile.withColumn(value, moving_average(by, "x", value, width) if width > 1 else F.col(value))


def detect_gutter(profile: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, method, ratio, depth, corroborated) from profiles (x, ink, extent, light, width), smoothed before.

    The ink valley in the middle band decides if it is deep against the page's texty columns; else the
    pinch of the page's extent if deep against the band's outer fifths; else there is no gutter. First
    minima win. Groups are pages; each is one aggregate."""
    lo, hi = (F.col("width") * BAND[0]).cast("int"), F.greatest((F.col("width") * BAND[1]).cast("int"), (F.col("width") * BAND[0]).cast("int") + 1)
    inside = (F.col("x") >= lo) & (F.col("x") < hi)
    fifth = F.greatest(F.lit(1), F.floor((hi - lo) / 5))
    edge = inside & ((F.col("x") < lo + fifth) | (F.col("x") >= hi - fifth))

    def least(value):
        return F.min(F.when(inside, F.struct(value, "x")))

    top = profile.groupBy(*by).agg(F.max("ink").alias("_top"))
    texty = F.col("ink") > F.when(F.col("_top") > 0, 0.05 * F.col("_top")).otherwise(0.0)
    facts = profile.join(top, by).groupBy(*by).agg(
        F.max("width").alias("w"), least("ink").alias("i"), least("extent").alias("e"), least("light").alias("l"),
        F.coalesce(F.median(F.when(texty, F.col("ink"))), F.lit(0.0)).alias("page_ink"), F.median(F.when(edge, F.col("extent"))).alias("edge_extent"),
    )
    ratio = F.when(F.col("page_ink") > 0, F.col("i.ink") / F.col("page_ink")).otherwise(1.0)
    depth = F.when(F.col("edge_extent") > 0, 1.0 - F.col("e.extent") / F.col("edge_extent")).otherwise(0.0)
    by_ink, by_pinch = (F.col("page_ink") > 0) & (F.col("ratio") < VALLEY), F.col("depth") >= PINCH
    tol = (F.col("w") * AGREE).cast("int")
    agrees = (F.abs(F.col("l.x") - F.col("e.x")) <= tol) | (F.abs(F.col("i.x") - F.col("e.x")) <= tol)
    found = facts.withColumns({"ratio": ratio, "depth": depth})
    return found.select(*by, F.when(by_ink, F.col("i.x")).when(by_pinch, F.col("e.x")).alias("x"), F.when(by_ink, "ink").when(by_pinch, "pinch").otherwise("none").alias("method"), "ratio", "depth", agrees.alias("corroborated"))


def cut_margin(width: Column, method: Column) -> Column:
    return F.when(method == "pinch", (width * MARGINS["pinch"]).cast("int")).otherwise((width * MARGINS["ink"]).cast("int"))


def cut_pages(images: DataFrame, gutter: str = "gutter", margin: str = "margin") -> DataFrame:
    """A row for each page of an image (width, height): the whole if there is no gutter, else two that overlap by the margin."""
    g, m, w, h = F.col(gutter), F.col(margin), F.col("width"), F.col("height")

    def page(name, left, right):
        return F.struct(F.lit(name).alias("subpage"), box(left.cast("int"), F.lit(0), (right - left).cast("int"), h.cast("int")).alias("box"))

    halves = F.array(page("left", F.lit(0), F.least(w, g + m)), page("right", F.greatest(F.lit(0), g - m), w))
    return images.withColumn("_p", F.explode(F.when(g.isNull(), F.array(page("single", F.lit(0), w))).otherwise(halves))).select("*", "_p.*").drop("_p")


def figure_bands(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, h): the parts of figures cut at seams, from rows (y, background, height, width).

    A row is a seam if its background share is at least SEAM; an inner run of seams tall enough is a cut at
    its middle. A part shrinks to its first and last row that is no seam, and goes if it is too small a
    share of the figure. Figures with fewer than two parts do not appear: they stay whole."""
    size = rows.groupBy(*by).agg(F.max("height").alias("height"))
    seams = runs(rows, by, "y", F.col("background") >= SEAM).join(size, by)
    tall = F.greatest(F.lit(SEAM_LEAST), F.floor(F.col("height") * SEAM_SHARE))
    cuts = seams.filter((F.col("start") > 0) & (F.col("end") < F.col("height")) & (F.col("end") - F.col("start") >= tall))
    cuts = cuts.select(*by, F.floor((F.col("start") + F.col("end")) / 2).alias("cut")).groupBy(*by).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    inner = rows.filter(F.col("background") < SEAM).join(cuts, by)
    part = F.size(F.filter("cuts", lambda c: c <= F.col("y")))
    bands = inner.groupBy(*by, part.alias("part")).agg(F.min("y").alias("y"), (F.max("y") - F.min("y") + 1).alias("h"), F.max("height").alias("height"))
    kept = bands.filter(F.col("h") >= PART_LEAST * F.col("height"))
    enough = kept.groupBy(*by).count().filter("count >= 2").select(*by)
    return kept.join(enough, by, "left_semi").select(*by, "y", "h")


def split_figures(dets: DataFrame, bands: DataFrame, by: list[str]) -> DataFrame:
    """Detections (det, label, bbox, ...) with figures that have bands replaced by these; all others pass."""
    met = dets.join(bands.select(*by, "det", F.col("y").alias("_y"), F.col("h").alias("_h")), [*by, "det"], "left")
    cut = F.col("_y").isNotNull() & (F.col("label") == "figure")
    part = box(F.col("bbox.x"), (F.col("bbox.y") + F.col("_y")).cast("int"), F.col("bbox.w"), F.col("_h").cast("int"))
    return met.withColumn("bbox", F.when(cut, part).otherwise(F.col("bbox"))).drop("_y", "_h")


def blocks_of(dets: DataFrame, page: list[str]) -> DataFrame:
    """Detections (det, label, bbox, conf, page_w, page_h) as blocks: suppressed, then ranked by recursive cuts."""
    kept = suppress(dets, page)
    facts = dets.select(*page, "det", "label", "page_w", "page_h")
    rows = kept.join(facts, [*page, "det"]).withColumnRenamed("det", "block")
    return rows.join(xy_cut(rows, page), [*page, "block"])


def whole_page(pages: DataFrame, blocks: DataFrame, page: list[str]) -> DataFrame:
    """Blocks of all pages; one that has none gets a block as large as itself."""
    met = pages.select(*page, F.col("page_w").alias("_w"), F.col("page_h").alias("_h")).join(blocks, page, "left")
    none = F.col("block").isNull()
    return met.withColumns({"bbox": F.when(none, box(F.lit(0), F.lit(0), F.col("_w").cast("int"), F.col("_h").cast("int"))).otherwise(F.col("bbox")), "label": F.when(none, "other").otherwise(F.col("label")), "rank": F.coalesce("rank", F.lit(0)), "block": F.coalesce("block", F.lit(0))}).drop("_w", "_h")


def degenerate(b: Column, page_w: Column, page_h: Column) -> Column:
    return (b["w"] >= 0.95 * page_w) & (b["h"] >= 0.95 * page_h)


def classical_columns(profile: DataFrame, by: list[str], floor: float, gap: int) -> DataFrame:
    """(by, start, end): columns of text from an ink profile (x, ink); rows within one are found the same way."""
    return split_by_gaps(profile, by, "x", "ink", F.lit(floor), gap)


def displacement_terms(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, xtx, xty, n, rms0): normal equations of the points (line, x, y in 0..1) of each page's baselines.

    The target is a line's median y less y; sums alone are shuffled, whatever the number of points."""
    target = F.median("y").over(Window.partitionBy(*by, "line")) - F.col("y")
    rows = points.withColumn("_t", target).withColumn("_b", poly_basis(F.col("x"), F.col("y")))
    return rows.groupBy(*by).agg(
        F.array(*[F.array(*[F.sum(F.col("_b")[i] * F.col("_b")[j]) for j in range(8)]) for i in range(8)]).alias("xtx"),
        F.array(*[F.sum(F.col("_b")[i] * F.col("_t")) for i in range(8)]).alias("xty"),
        F.countDistinct("line").alias("lines"), F.max(F.abs("_t")).alias("largest"),
    )


def fit_displacement(terms: DataFrame, by: list[str]) -> DataFrame:
    """(by, coefficients, lines, largest): least squares of the normal equations, the smallest solution if they leave a choice."""

    @F.pandas_udf("array<double>")
    def solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.stack(a), np.asarray(b), rcond=None)[0].tolist() for a, b in zip(xtx, xty)])

    return terms.select(*by, solve("xtx", "xty").alias("coefficients"), "lines", "largest")


def dewarp_method(lines: Column, largest_px: Column) -> Column:
    """Whether a page is straightened: too few lines or too little to move leave it as it is."""
    return F.when((lines < LINES_LEAST) | (largest_px < PIXELS_LEAST), "identity").otherwise("classical")
