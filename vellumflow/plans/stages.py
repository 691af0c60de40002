"""The stages of a page as whole plans over tables of pages: fuse, split, dewarp, layout, words, and the A/B arms.

What needs a camera, a model or a recogniser (feature matches, detections, words) comes in as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import poly_basis
from ..functions.scalars import frame_name, orientation
from ..functions.text import normalize_text, tokenize
from ..operators import layout, metrics, spatial
from .assemble import attach_words

#: Matches that a close-up's homography must rest on, and the range of its determinant.
INLIERS_LEAST, DETERMINANT = 15, (0.05, 20.0)


def ingest(frames: DataFrame, by: list[str]) -> DataFrame:
    """(by, source, n_frames, frames, warnings): a row for each capture, its frames in order with what turned them.

    ``frames`` is (by, idx, path, suffix, skipped, width, height, sharpness, exif, hint, baseline, baseline_conf, osd,
    osd_conf); a raw file that was skipped is a warning, and its number stays free."""
    o = orientation(F.col("hint"), F.col("baseline"), F.col("baseline_conf"), F.col("osd"), F.col("osd_conf"), F.col("width"), F.col("height"))
    rows = frames.withColumns({"o": o, "file": F.regexp_extract("path", r"([^/]+)$", 1)})
    turned = F.col("o.rotate") % 180 != 0
    frame = F.struct(
        frame_name(F.col("idx"), F.lit(".png")).alias("name"), F.col("file").alias("source"), F.when(turned, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(turned, F.col("width")).otherwise(F.col("height")).alias("height"),
        "sharpness", F.col("exif").alias("exif_orientation"), F.col("osd").alias("osd_rotate"), "osd_conf", F.col("o.rotate").alias("applied_rotate"), F.col("o.method").alias("orient_method"),
    )
    said = F.when(F.col("skipped"), F.array(F.concat(F.lit("raw frame skipped: "), "file"))).otherwise(F.col("o.warnings"))
    kept = F.array_sort(F.collect_list(F.when(~F.col("skipped"), F.struct("idx", frame.alias("f")))))
    found = rows.groupBy(*by).agg(F.transform(kept, lambda x: x["f"]).alias("frames"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", said.alias("w")))), lambda x: x["w"])).alias("warnings"), F.min(F.regexp_replace("path", r"/[^/]+$", "")).alias("source"))
    return found.select(*by, "source", F.size("frames").alias("n_frames"), "frames", "warnings")


def stitched(good: Column, inliers: Column, determinant: Column, least: int = INLIERS_LEAST) -> Column:
    """struct(matched, inliers, note): whether a close-up was found on its base, from what matching features gave.

    ``good`` is null without enough features, ``determinant`` null without a homography."""
    low, high = DETERMINANT
    note = (
        F.when(good.isNull(), "too few features").when(good < least, F.concat(F.lit("only "), good, F.lit(" good matches")))
        .when(determinant.isNull(), "no homography").when(inliers < least, F.concat(F.lit("only "), inliers, F.lit(" inliers")))
        .when((determinant <= low) | (determinant >= high), F.concat(F.lit("degenerate homography (det="), F.format_string("%.3f", determinant), F.lit(")"))).otherwise("ok")
    )
    found = F.when(good.isNull(), 0).when(good < least, good).when(determinant.isNull(), 0).otherwise(inliers)
    return F.struct((note == "ok").alias("matched"), found.cast("int").alias("inliers"), note.alias("note"))


def fuse(frames: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_frames, anchor_source, method, fullspread_frames, closeups): a row for each page's capture.

    ``frames`` is (by, idx, name, area, sharpness), ``matches`` (by, idx, good, inliers, determinant) of close-ups."""
    roles = layout.partition_frames(frames, by).join(matches, [*by, "idx"], "left")
    s = stitched(F.col("good"), F.col("inliers"), F.col("determinant"))
    rows = roles.withColumn("s", F.when(F.col("role") == "closeup", F.struct("idx", F.struct("name", s["matched"].alias("matched"), s["inliers"].alias("inliers"), s["note"].alias("note")).alias("c"))))

    def names(role):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("idx", "name")))), lambda x: x["name"])

    closeups = F.transform(F.array_sort(F.collect_list("s")), lambda x: x["c"])
    found = rows.groupBy(*by).agg(F.count("*").alias("n_frames"), names("base")[0].alias("anchor_source"), names("full").alias("fullspread_frames"), closeups.alias("closeups"))
    some = F.exists("closeups", lambda c: c["matched"])
    method = F.when(F.col("n_frames") == 1, "single").when(some, "sharpest+stitch").otherwise("sharpest")
    return found.select(*by, F.col("n_frames").cast("int").alias("n_frames"), "anchor_source", method.alias("method"), "fullspread_frames", "closeups")


def split(profile: DataFrame, images: DataFrame, by: list[str]) -> DataFrame:
    """(by, gutter_x, confident, method, ratio, pinch_depth, corroborated, subpage, box), a row for each page of an image.

    ``profile`` is (by, x, ink, extent, light, width), smoothed, ``images`` (by, width, height)."""
    found = layout.detect_gutter(profile, by).withColumnRenamed("depth", "pinch_depth")
    rows = images.join(found, by).withColumns({"gutter": F.col("x"), "margin": layout.cut_margin(F.col("width"), F.col("method"))})
    pages = layout.cut_pages(rows)
    return pages.select(*by, F.col("x").cast("int").alias("gutter_x"), F.col("x").isNotNull().alias("confident"), "method", F.round("ratio", 3).alias("ratio"), F.round("pinch_depth", 3).alias("pinch_depth"), F.coalesce("corroborated", F.lit(False)).alias("corroborated"), "subpage", "box")


def dewarp(points: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """(by, method, n_lines, max_disp_px, fit_rms_px, applied, coefficients) of every page.

    ``points`` is (by, line, x, y) of baselines in shares of the page, ``pages`` (by, height). Pages with too few
    lines or too little to move stay as they are; those without lines have no fit."""
    fit = layout.fit_displacement(layout.displacement_terms(points, by), by)
    middle = points.groupBy(*by, "line").agg(F.median("y").alias("middle"))
    basis = poly_basis(F.col("x"), F.col("y"))
    moved = F.aggregate(F.zip_with("coefficients", basis, lambda c, b: c * b), F.lit(0.0), lambda s, v: s + v)
    rest = points.join(middle, [*by, "line"]).join(fit, by).select(*by, F.pow(F.col("middle") - F.col("y") - moved, 2).alias("e"))
    rms = rest.groupBy(*by).agg(F.sqrt(F.avg("e")).alias("rms"))
    found = pages.join(fit.join(rms, by), by, "left").withColumns({"n_lines": F.coalesce("lines", F.lit(0)).cast("int"), "px": F.coalesce(F.col("largest") * F.col("height"), F.lit(0.0))})
    method = layout.dewarp_method(F.col("n_lines"), F.col("px"))
    enough = F.col("n_lines") >= layout.LINES_LEAST
    return found.select(
        *by, method.alias("method"), "n_lines", F.when(enough, F.round("px", 2)).otherwise(0.0).alias("max_disp_px"),
        F.when(enough, F.round(F.col("rms") * F.col("height"), 2)).otherwise(0.0).alias("fit_rms_px"), (method == "classical").alias("applied"), F.when(method == "classical", F.col("coefficients")).alias("coefficients"),
    )


def laid_out(pages: DataFrame, dets: DataFrame, bands: DataFrame, page: list[str]) -> DataFrame:
    """Blocks in reading order of all pages: merged figures split, doubles suppressed, ranked; an empty page is one block.

    ``pages`` is (page, page_w, page_h), ``dets`` (page, det, label, bbox, conf), ``bands`` (page, det, y, h)."""
    cut = layout.split_figures(dets, bands, page)
    # the parts of a figure are detections of their own
    part = F.row_number().over(Window.partitionBy(*page).orderBy("det", F.col("bbox.y"))) - 1
    numbered = cut.withColumn("det", part.cast("bigint")).join(pages, page)
    return layout.whole_page(pages, layout.blocks_of(numbered, page), page)


def read_pages(words: DataFrame, blocks: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """The words with their blocks, real and made, and (page, total_words, orphan_words, n_blocks).

    ``words`` is (page, pos, block_num, par_num, line_num, box, conf, ...), ``blocks`` (page, block, bbox)."""
    routed = spatial.route(words, blocks, page)
    lost = words.join(routed.filter("block is null").select(*page, "pos"), [*page, "pos"])
    orphans = spatial.orphan_blocks(lost.select(*page, "pos", "block_num", "par_num", "box.*"), page, ["block_num", "par_num"])
    found = attach_words(words, blocks, routed, orphans, page)
    counts = routed.groupBy(*page).agg(F.count("*").alias("total_words"), (F.count("*") - F.count("block")).alias("orphan_words"))
    made = blocks.groupBy(*page).agg(F.count("*").alias("real")).join(orphans.groupBy(*page).agg(F.count("*").alias("made")), page, "full")
    return found, counts.join(made, page, "left").select(*page, "total_words", "orphan_words", (F.coalesce("real", F.lit(0)) + F.coalesce("made", F.lit(0))).alias("n_blocks"))


def arms(texts: DataFrame, truth: DataFrame, names: list[str]) -> DataFrame:
    """(image_id, <arm>_wer, <arm>_cer, ...): each way of reading an image against its text.

    ``texts`` is (image_id, arm, part, text): an arm's parts are joined in order by line ends. Images without text are left out."""
    read = texts.groupBy("image_id", "arm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda s: s.text), "\n").alias("read"))
    both = read.join(truth.withColumnRenamed("text", "gt"), "image_id").withColumn("key", F.concat_ws("\x1f", "image_id", "arm"))
    errors = metrics.token_errors(both.select("key", tokenize(F.col("gt")).alias("truth"), tokenize(F.col("read")).alias("read")), "key", "truth", "read").select("key", "wer")
    chars = both.select("key", "image_id", "arm", metrics.character_error(normalize_text(F.col("gt")), normalize_text(F.col("read"))).alias("cer"))
    scored = chars.join(errors, "key")
    found = [F.max(F.when(F.col("arm") == n, F.col(m))).alias(f"{n}_{m}") for n in names for m in ("wer", "cer")]
    return scored.groupBy("image_id").agg(*found)


def mean_arms(scores: DataFrame) -> DataFrame:
    """One row: the means of all arms over images."""
    return scores.agg(F.count("*").alias("images"), *[F.avg(c).alias(c) for c in scores.columns if c != "image_id"])
