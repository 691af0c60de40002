"""Orders: gaps and islands, recursive cuts into reading order, rows of boxes, suppression, running text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import runs_of

#: Share of the page's height or width that a gap must have to cut.
GAP = 0.012
NMS_IOU, NMS_CONTAINED = 0.45, 0.80


def separators(rows: DataFrame, by: list[str], start: str, end: str, tie: str, gap: Column) -> DataFrame:
    """rows with ``group``: intervals in order of start, a new group where one starts ``gap`` or more after all before it end."""
    order = Window.partitionBy(*by).orderBy(start, tie)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) - reach >= gap), 1).otherwise(0)
    return rows.withColumn("_opens", opens).withColumn("group", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_opens")


def runs(rows: DataFrame, by: list[str], pos: str, true: Column) -> DataFrame:
    """(by, start, end): runs of consecutive positions where ``true`` holds, the end beyond the last."""
    island = F.col(pos) - F.row_number().over(Window.partitionBy(*by).orderBy(pos))
    return rows.filter(true).withColumn("_island", island).groupBy(*by, "_island").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("_island")


def runs_of_rows(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """(by, start, end): the runs of each row's array of rising positions; nothing is shuffled."""
    runs_ = F.transform(runs_of(F.col(at), lambda a, b: b == a + 1), lambda r: F.struct(F.get(r, F.lit(0)).alias("start"), (F.element_at(r, -1) + 1).alias("end")))
    return rows.select(*by, F.inline(runs_))


def split_by_gaps(rows: DataFrame, by: list[str], pos: str, value: str, floor: Column, least_gap: int) -> DataFrame:
    """(by, start, end): runs above the floor, joined where fewer than ``least_gap`` positions part them."""
    order = Window.partitionBy(*by).orderBy(pos)
    last = F.lag(pos).over(order)
    opens = F.when(last.isNull() | ((F.col(pos) - last - 1 >= least_gap) & (F.col(pos) - last > 1)), 1).otherwise(0)
    above = rows.filter(F.col(value) > floor).withColumn("_opens", opens)
    return above.withColumn("_g", F.sum("_opens").over(order)).groupBy(*by, "_g").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("_g")


def moving_average(by: list[str], pos: str, value: str, width: int) -> Column:
    """Centred mean of ``width`` values, those beyond the ends counting as 0."""
    before, after = width - 1 - (width - 1) // 2, (width - 1) // 2
    return F.sum(value).over(Window.partitionBy(*by).orderBy(pos).rowsBetween(-before, after)) / width


def upper_median(values: Column) -> Column:
    """The upper median of an array, null if empty."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def running_text(words: DataFrame, by: list[str], line: list[str], order: str = "pos", token: str = "token") -> DataFrame:
    """(by, text): words in order, parted by a space within a line and by a newline where the line changes."""
    at = Window.partitionBy(*by).orderBy(order)
    same = F.lit(True)
    for c in line:
        same = same & F.lag(c).over(at).eqNullSafe(F.col(c))
    first = F.row_number().over(at) == 1
    sep = F.when(first, "").when(same, " ").otherwise("\n")
    rows = words.withColumn("_part", F.concat(sep, F.col(token)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_part").alias("p")))), lambda s: s.p), "").alias("text"))


def _islands(order: list[int], low: list[float], high: list[float], gap: float) -> list[list[int]]:
    groups: list[list[int]] = []
    reach = 0.0
    for i in sorted(order, key=lambda i: (low[i], i)):
        if not groups or low[i] - reach >= gap:
            groups.append([i])
            reach = high[i]
        else:
            groups[-1].append(i)
            reach = max(reach, high[i])
    return groups


class Boxes:
    """The boxes of a page for the sequential orders; they are numbered as given."""

    def __init__(self, boxes: list[tuple[float, float, float, float]]):
        self.x, self.y = [b[0] for b in boxes], [b[1] for b in boxes]
        self.x2, self.y2 = [b[0] + b[2] for b in boxes], [b[1] + b[3] for b in boxes]

    def rows(self, which: list[int]) -> list[int]:
        """Greedy rows by vertical overlap of more than half the smaller height, each row from left to right."""
        made: list[list] = []  # top, bottom, members
        live: list[list] = []  # rows that a box further down may still join; boxes come by their tops
        proper = all(self.y2[i] >= self.y[i] for i in which)
        for i in sorted(which, key=lambda i: self.y[i]):
            top, bottom = self.y[i], self.y2[i]
            if proper:
                live = [row for row in live if row[1] > top]
            for row in live:
                if min(bottom, row[1]) - max(top, row[0]) > 0.5 * min(bottom - top, row[1] - row[0]):
                    row[0], row[1] = min(row[0], top), max(row[1], bottom)
                    row[2].append(i)
                    break
            else:
                made.append([top, bottom, [i]])
                live.append(made[-1])
        found: list[int] = []
        for _, _, members in sorted(made, key=lambda r: r[0]):
            columns = _islands(members, self.x, self.x2, 1.0) if len(members) > 1 else [members]
            if len(columns) > 1:
                for c in columns:
                    found += self.rows(c) if len(c) > 1 else c
            else:
                found += sorted(members, key=lambda i: self.x[i])
        return found

    def cut(self, which: list[int], gap_x: float, gap_y: float) -> list[int]:
        """Cut across where a gap goes through, else down, else take rows; again in every part."""
        if len(which) < 2:
            return list(which)
        for low, high, gap in ((self.y, self.y2, gap_y), (self.x, self.x2, gap_x)):
            parts = _islands(which, low, high, gap)
            if len(parts) > 1:
                return [i for part in parts for i in self.cut(part, gap_x, gap_y)]
        return self.rows(which)


def xy_cut(blocks: DataFrame, page: list[str], gap: float = GAP) -> DataFrame:
    """(page, block, rank): reading order of each page's blocks (block, bbox, page_w, page_h) by recursive cuts.

    Gaps are shares of the page, at any depth. One page is one group; pages are small."""
    keys = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in page)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        b = Boxes([(r["x"], r["y"], r["w"], r["h"]) for r in t["bbox"].to_pylist()])
        order = b.cut(list(range(t.num_rows)), gap * t["page_w"][0].as_py(), gap * t["page_h"][0].as_py())
        rank = [0] * len(order)
        for k, i in enumerate(order):
            rank[i] = k
        return t.select([*page, "block"]).append_column("rank", pa.array(rank, pa.int32()))

    kind = blocks.schema["block"].dataType.simpleString()
    return blocks.select(*page, "block", "bbox", "page_w", "page_h").groupBy(*page).applyInArrow(run, f"{keys}, block {kind}, rank int")


def reading_rows(blocks: DataFrame, page: list[str]) -> DataFrame:
    """(page, block, rank): rows of boxes from top to bottom, each from left to right."""
    keys = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in page)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        order = Boxes([(r["x"], r["y"], r["w"], r["h"]) for r in t["bbox"].to_pylist()]).rows(list(range(t.num_rows)))
        rank = [0] * len(order)
        for k, i in enumerate(order):
            rank[i] = k
        return t.select([*page, "block"]).append_column("rank", pa.array(rank, pa.int32()))

    kind = blocks.schema["block"].dataType.simpleString()
    return blocks.select(*page, "block", "bbox").groupBy(*page).applyInArrow(run, f"{keys}, block {kind}, rank int")


def xy_cut_levels(blocks: DataFrame, page: list[str], levels: int = 2, gap: float = GAP) -> DataFrame:
    """(page, block, path): the same cuts as windows alone, ``levels`` times across and down.

    path orders the blocks; blocks that share it are not parted by gaps in so many levels."""
    now = blocks.select(*page, "block", "bbox.x", "bbox.y", (F.col("bbox.x") + F.col("bbox.w")).alias("x2"), (F.col("bbox.y") + F.col("bbox.h")).alias("y2"), "page_w", "page_h").withColumn("path", F.array().cast("array<bigint>"))
    for _ in range(levels):
        for start, end, size in (("y", "y2", "page_h"), ("x", "x2", "page_w")):
            now = separators(now, [*page, "path"], start, end, "block", F.col(size) * gap)
            now = now.withColumn("path", F.concat("path", F.array("group"))).drop("group")
    return now.select(*page, "block", "path")


def suppress(dets: DataFrame, page: list[str], iou_most: float = NMS_IOU, contained_most: float = NMS_CONTAINED) -> DataFrame:
    """The detections (det, bbox, conf) that stay, by confidence, first come on ties.

    One goes if a kept one overlaps it by ``iou_most`` or covers ``contained_most`` of it. The fold runs over
    a page's sorted array inside the JVM."""
    one = F.struct((-F.col("conf")).alias("rank"), "det", "conf", "bbox")
    sorted_ = dets.groupBy(*page).agg(F.array_sort(F.collect_list(one)).alias("dets"))

    def goes(kept, d):
        def over(k):
            a, b = k["bbox"], d["bbox"]
            shared = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])) * F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
            own = b["w"] * b["h"]
            return (shared > 0) & ((shared >= iou_most * (a["w"] * a["h"] + own - shared)) | (shared >= contained_most * own))

        return F.exists(kept, over)

    kind = sorted_.schema["dets"].dataType.simpleString()
    kept = F.aggregate("dets", F.array().cast(kind), lambda acc, d: F.when(goes(acc, d), acc).otherwise(F.concat(acc, F.array(d))))
    return sorted_.select(*page, F.explode(kept).alias("k")).select(*page, "k.det", "k.conf", "k.bbox")
