"""Matching: pairs by printed number, ground-truth blocks, grouping of captions, a second reader's vouchers."""

from __future__ import annotations

import bisect
import collections
import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capitalized, normalize_token
from .spatial import assign_regions

ANCHOR_LEAST, FIGURE_LEAST = 0.5, 0.2
REGION_LEAST, VOUCHER_LEAST = 0.30, 2


def pair_by_number(captions: DataFrame, figures: DataFrame, page: list[str]) -> DataFrame:
    """(page, caption, figure): a caption pairs with the figure of its number if just one figure has it.

    Two captions may share a figure; null numbers pair with nothing."""
    alone = figures.filter("number is not null").groupBy(*page, "number").agg(F.count("*").alias("n"), F.min("figure").alias("figure")).filter("n = 1").drop("n")
    return captions.join(alone, [*page, "number"]).select(*page, "caption", "figure")


def anchor_score(anchor: Column, text: Column) -> Column:
    """Share of the anchor's different tokens that the text has; 0 for an empty anchor."""
    n = F.size(F.array_distinct(anchor))
    return F.when(n > 0, F.size(F.array_intersect(anchor, text)) / n).otherwise(0.0)


def _greedy(pairs, least: float, used_left: dict, used_right: set) -> None:
    for score, left, right in pairs:
        if score >= least and left not in used_left and right not in used_right:
            used_left[left] = right
            used_right.add(right)


def _share(a, b) -> float:
    w = max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    h = max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    return w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h) if w * h else 0.0


def match_page(gts: list[dict], dets: list[dict]) -> dict:
    """{gt: block} of one page. Boxes meet the boxes at their height, anchors the blocks that have one of their tokens."""
    gts, dets = sorted(gts, key=lambda g: g["ord"]), sorted(dets, key=lambda x: x["block"])
    hit: dict = {}
    used: set = set()
    figures = [x for x in dets if x["type"] == "figure"]
    by_y = sorted(range(len(figures)), key=lambda i: figures[i]["bbox"]["y"])
    tops, tallest = [figures[i]["bbox"]["y"] for i in by_y], max((x["bbox"]["h"] for x in figures), default=0)
    overlaps = []
    for g in gts:
        if g["type"] == "figure" and g["bbox"]:
            box = g["bbox"]
            near = by_y[bisect.bisect_left(tops, box["y"] - tallest) : bisect.bisect_right(tops, box["y"] + box["h"])]
            met = ((_share(box, figures[i]["bbox"]), g["gt"], figures[i]["block"]) for i in sorted(near))
            overlaps += [p for p in met if p[0] >= FIGURE_LEAST]
    _greedy(sorted(overlaps, key=lambda p: -p[0]), FIGURE_LEAST, hit, used)
    left = sorted((x for x in figures if x["block"] not in used), key=lambda x: x["rank"])
    for g, x in zip((g for g in gts if g["type"] == "figure" and not g["bbox"]), left):
        hit[g["gt"]] = x["block"]
        used.add(x["block"])
    having: dict = {}
    for x in dets:
        if x["block"] not in used:
            for t in set(x["tokens"] or ()):
                having.setdefault(t, []).append(x["block"])
    scores = []
    for g in gts:
        anchor = set(g["anchor"] or ())
        if g["type"] != "figure" and anchor:
            met = collections.Counter(k for t in anchor for k in having.get(t, ()))
            scores += [(n / len(anchor), g["gt"], k) for k, n in met.items() if n / len(anchor) >= ANCHOR_LEAST]
    _greedy(sorted(scores, reverse=True), ANCHOR_LEAST, hit, used)
    return hit


def match_blocks(truth: DataFrame, found: DataFrame, page: list[str]) -> DataFrame:
    """(page, gt, block): one-to-one matches of ground-truth blocks; a miss has a null block.

    Figures with a box go by overlap, best first and first come on ties; figures without one by order among the
    detected figures left; texts by anchor score, ties to the larger (gt, block). ``truth`` has gt, type,
    ord, bbox (may be null) and anchor (tokens); ``found`` block, type, rank, bbox and tokens. Pages are small:
    one page is one group."""

    def run(key, t: pa.Table, d: pa.Table) -> pa.Table:
        gts = t.to_pylist()
        hit = match_page(gts, d.to_pylist())
        rows = [[k.as_py() for k in key] + [g["gt"], hit.get(g["gt"])] for g in gts]
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    kinds = [(c, truth.schema[c].dataType.simpleString()) for c in [*page, "gt"]] + [("block", found.schema["block"].dataType.simpleString())]
    ddl = ", ".join(f"{c} {k}" for c, k in kinds)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c, arrow[k]) for c, k in kinds])
    return truth.groupBy(*page).cogroup(found.groupBy(*page)).applyInArrow(run, ddl)


def grouping(pairs: DataFrame, near: DataFrame, types: DataFrame, page: list[str]) -> DataFrame:
    """(page, caption, typed_ok, nearest_ok, reason) for ground-truth pairs (caption, figure).

    ``near`` has the nearest figure of each caption, ``types`` the type of each matched block."""
    found = pairs.join(near.withColumnRenamed("figure", "got"), [*page, "caption"], "left").join(types.select(*page, F.col("block").alias("caption"), "type"), [*page, "caption"], "left")
    reason = F.when(F.col("type").isNull(), "caption_missed").when(F.col("got").isNull(), "no_figures").when(F.col("got") == F.col("figure"), "ok").otherwise("wrong_figure")
    return found.select(*page, "caption", F.coalesce(F.col("type") == "caption", F.lit(False)).alias("typed_ok"), F.coalesce(F.col("got") == F.col("figure"), F.lit(False)).alias("nearest_ok"), reason.alias("reason"))


def promote_captions(kind: Column, is_caption: Column) -> Column:
    """A paragraph, list or other block with a caption's header becomes a caption; nothing else changes."""
    return F.when(kind.isin("paragraph", "other", "list") & is_caption, "caption").otherwise(kind)


def replaced(own: list[str], other: list[str]) -> list[tuple[int, str]]:
    """Places of own tokens that stand against just one other token, with that token."""
    ops = difflib.SequenceMatcher(a=own, b=other, autojunk=False).get_opcodes()
    return [(a, other[c]) for tag, a, b, c, d in ops if tag == "replace" and b - a == 1 == d - c]


def vouched(words: DataFrame, regions: DataFrame, page: list[str], lexicon: DataFrame | None) -> DataFrame:
    """(page, pos) of words that a second reader's region contradicts with a word of the lexicon, itself not being one.

    ``words`` has region, pos, x and token in lexicon form; ``regions`` region and tokens; ``lexicon`` token. A
    null lexicon finds nothing; a capitalised entry knows the word in lower case. A region's words are its
    group; the lexicon's two look-ups are joins."""
    own = words.filter("token <> ''").groupBy(*page, "region").agg(F.array_sort(F.collect_list(F.struct("x", "pos", "token"))).alias("own"))
    both = own.join(regions, [*page, "region"])

    def run(batches):
        for b in batches:
            rows = []
            for key in b.to_pylist():
                ws = key["own"]
                rows += [(*(key[c] for c in page), ws[i]["pos"], ws[i]["token"], e) for i, e in replaced([w["token"] for w in ws], [t for t in key["tokens"] if t])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    fields = [(c, words.schema[c].dataType.simpleString()) for c in [*page, "pos"]] + [("token", "string"), ("voucher", "string")]
    names, kinds = [c for c, _ in fields], [arrow[k] for _, k in fields]
    found = both.select(*page, "own", "tokens").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in fields))
    return vouchers_known(found.filter(F.length("voucher") >= VOUCHER_LEAST), lexicon).select(*page, "pos")


def vouchers_known(pairs: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """The pairs (token, voucher, ...) whose voucher alone the lexicon knows; none without a lexicon."""
    if lexicon is None:
        return pairs.filter("false")
    # each look-up is a join that adds no row, so that the pairs are found once
    words = lexicon.select(F.col("token").alias("_w")).distinct()

    def look(rows, column):
        for k, form in enumerate((F.col(column), capitalized(F.col(column)))):
            rows = rows.withColumn("_w", F.nullif(form, F.lit(""))).join(words.withColumn(f"_{k}", F.lit(True)), "_w", "left").drop("_w")
        return rows.withColumn("_known", F.coalesce("_0", "_1", F.lit(False))).drop("_0", "_1")

    unknown = look(pairs, "token").filter("not _known").drop("_known")
    return look(unknown, "voucher").filter("_known").drop("_known")


def disagreements(words: DataFrame, regions: DataFrame, page: list[str], lexicon: DataFrame | None, least: float = REGION_LEAST) -> DataFrame:
    """(page, pos) of words that a second reader disagrees with, from words (pos, box, token) and regions (region, rbox, text, conf).

    Regions read with less than ``least`` confidence neither take words nor vouch. Each word belongs to the
    one region that ``assign_regions`` gives it."""
    sure = regions.filter(F.col("conf") >= least)
    own = words.join(assign_regions(words, sure, page), [*page, "pos"]).select(*page, "region", "pos", F.col("box.x").alias("x"), normalize_token(F.col("token")).alias("token"))
    read = sure.select(*page, "region", F.transform(F.split("text", r"(?U)\s+"), normalize_token).alias("tokens"))
    return vouched(own, read, page, lexicon)


def gutter_hits(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(image, hit): a single page wants no gutter, a spread one within its tolerance."""
    ok = F.when(F.coalesce("single", F.lit(False)), F.col("x").isNull()).otherwise(F.coalesce(F.abs(F.col("x") - F.col("gutter_x")) <= F.col("tol"), F.lit(False)))
    return truth.join(found, "image", "left").select("image", ok.alias("hit"))


def cluster_labels(candidates: DataFrame, by: list[str]) -> DataFrame:
    """(by, cluster, n, weight, x, y): runs of shapes along a line that may be a printed number, 1 to 3 members each.

    By x, a shape joins the one before if their centres differ by less than .6 of the median height, the
    gap is under .9 of it, and the heights' ratio lies between .55 and 1.8."""
    order = Window.partitionBy(*by).orderBy("x", "i")
    height = F.median("h").over(Window.partitionBy(*by))
    last = F.lag(F.struct("x", "y", "w", "h")).over(order)
    ratio = F.col("h") / last["h"]
    level = F.abs((F.col("y") + F.col("h") / 2) - (last["y"] + last["h"] / 2)) < 0.6 * height
    joins = level & (F.col("x") - (last["x"] + last["w"]) < 0.9 * height) & (ratio > 0.55) & (ratio < 1.8)
    opened = candidates.withColumn("_o", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    found = opened.withColumn("cluster", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy(*by, "cluster").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.max(F.col("x") + F.col("w")).alias("x"), F.max(F.col("y") + F.col("h")).alias("y")).filter("n <= 3")
