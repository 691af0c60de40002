"""Spatial joins by tiles: boxes and points meet in an equi-join on page and tile, then the exact test decides.

A nested loop over a page's words and blocks grows with their product; on tiles each word meets only the
blocks near it. Results do not depend on the tile size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, centre_x, centre_y, edge_gap, holds_centre, iou, overlap, united, x2, y2

TILE = 256


def _tiles(low: Column, high: Column, tile: int) -> Column:
    return F.sequence(F.floor(low / tile), F.floor(high / tile))


def covering(boxes: DataFrame, column: str, tile: int = TILE) -> DataFrame:
    """A row for each tile that a box covers, with tx and ty."""
    b = F.col(column)
    return boxes.withColumn("tx", F.explode(_tiles(b["x"], x2(b), tile))).withColumn("ty", F.explode(_tiles(b["y"], y2(b), tile)))


def at_centre(boxes: DataFrame, column: str, tile: int = TILE) -> DataFrame:
    """Each box with the tile of its centre."""
    b = F.col(column)
    return boxes.withColumn("tx", F.floor(centre_x(b) / tile)).withColumn("ty", F.floor(centre_y(b) / tile))


def route(words: DataFrame, blocks: DataFrame, page: list[str], tile: int = TILE) -> DataFrame:
    """(page, pos, block): the smallest block that holds a word's centre, the first of equal ones; null if none does.

    ``words`` has pos and box, ``blocks`` has block (its place in order) and bbox."""
    inside = at_centre(words.select(*page, "pos", "box"), "box", tile).join(covering(blocks.select(*page, "block", "bbox"), "bbox", tile), [*page, "tx", "ty"])
    inside = inside.filter(holds_centre(F.col("bbox"), F.col("box")))
    best = inside.groupBy(*page, "pos").agg(F.min_by("block", F.struct(area(F.col("bbox")), "block")).alias("block"))
    return words.select(*page, "pos").join(best, [*page, "pos"], "left")


def orphan_blocks(words: DataFrame, page: list[str], group: list[str]) -> DataFrame:
    """One block around each group of words that no block took, in order of first appearance.

    Groups without a row in ``words`` do not exist; rank counts from 0 on each page."""
    found = words.groupBy(*page, *group).agg(F.min("pos").alias("first"), F.count("*").alias("n_words"), united().alias("bbox"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy("first")) - 1)


def pairs_by_overlap(boxes: DataFrame, page: list[str], tile: int = TILE) -> DataFrame:
    """(page, i, j, iou, ...): pairs i < j of a page's boxes (i, bbox) that share area, each once."""
    one = covering(boxes.select(*page, "i", F.col("bbox").alias("a")), "a", tile)
    two = covering(boxes.select(*page, F.col("i").alias("j"), F.col("bbox").alias("b")), "b", tile)
    met = one.join(two, [*page, "tx", "ty"]).filter("i < j")
    a, b = F.col("a"), F.col("b")
    # two boxes meet in every tile that both cover; the one of their common corner counts
    first = (F.col("tx") == F.floor(F.greatest(a["x"], b["x"]) / tile)) & (F.col("ty") == F.floor(F.greatest(a["y"], b["y"]) / tile))
    return met.filter(first & (overlap(a, b) > 0)).select(*page, "i", "j", overlap(a, b).alias("shared"), area(a).alias("area_i"), area(b).alias("area_j"), iou(a, b).alias("iou"))


def nearest(froms: DataFrame, tos: DataFrame, page: list[str], rings: tuple[int, ...] = (TILE, 8 * TILE)) -> DataFrame:
    """(page, i, j, gap): for each box (i, a) the box (j, b) of its page at the least edge distance, the first of equal ones.

    Boxes look for others within a ring first, then a wider one; what lies that near shares a tile with the
    ring, and a gap within it cannot be beaten from outside. Only boxes with nothing near meet their whole page."""
    rest, found = froms.select(*page, "i", "a"), None
    best = F.min(F.struct("gap", "j")).alias("m")
    gap = edge_gap(F.col("a"), F.col("b"))
    for r in rings:
        a = F.col("a")
        ring = rest.withColumn("ring", F.struct((a["x"] - r).alias("x"), (a["y"] - r).alias("y"), (a["w"] + 2 * r).alias("w"), (a["h"] + 2 * r).alias("h")))
        met = covering(ring, "ring", r).join(covering(tos.select(*page, "j", "b"), "b", r), [*page, "tx", "ty"]).withColumn("gap", gap).filter(F.col("gap") <= r)
        near = met.groupBy(*page, "i").agg(best)
        found = near if found is None else found.union(near)
        rest = rest.join(near.select(*page, "i"), [*page, "i"], "left_anti")
    far = rest.join(tos.select(*page, "j", "b"), page).withColumn("gap", gap).groupBy(*page, "i").agg(best)
    return found.union(far).select(*page, "i", F.col("m.j").alias("j"), F.col("m.gap").alias("gap"))


def assign_regions(words: DataFrame, regions: DataFrame, page: list[str], tile: int = TILE) -> DataFrame:
    """(page, pos, region): the region with most overlap that holds a word's centre; of equal ones the smaller, then the first.

    A region without overlap takes no word. ``regions`` has region and rbox."""
    met = at_centre(words.select(*page, "pos", "box"), "box", tile).join(covering(regions.select(*page, "region", "rbox"), "rbox", tile), [*page, "tx", "ty"])
    b, r = F.col("box"), F.col("rbox")
    met = met.filter(holds_centre(r, b) & (overlap(b, r) > 0))
    return met.groupBy(*page, "pos").agg(F.min_by("region", F.struct(-overlap(b, r), area(r), "region")).alias("region"))
