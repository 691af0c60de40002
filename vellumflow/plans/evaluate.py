"""Evaluations: images against their text, two arms of one page, block order graded by subpage."""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..functions.captions import figure_number, parse_caption
from ..functions.text import anchor_tokens, normalize_text, tokenize
from ..operators import matching, metrics, ordering, paged, spatial


def evaluate_images(words: DataFrame, truth: DataFrame, manifest: DataFrame) -> DataFrame:
    """A row for each image: errors and accuracy against its text, separation, flagged recall; nulls where it has no text.

    ``words`` is (image_id, pos, block_num, par_num, line_num, text, conf), ``truth`` (image_id, text)."""
    read = ordering.running_text(words, ["image_id"], ["block_num", "par_num", "line_num"], "pos", "text").withColumnRenamed("text", "read")
    both = truth.withColumnRenamed("text", "gt").join(read, "image_id", "left").withColumn("read", F.coalesce("read", F.lit("")))
    tokens = both.select("image_id", tokenize(F.col("gt")).alias("truth"), tokenize(F.col("read")).alias("read"))
    errors = metrics.token_errors(tokens, "image_id", "truth", "read")
    chars = both.select("image_id", metrics.character_error(normalize_text(F.col("gt")), normalize_text(F.col("read"))).alias("cer"))
    # labels belong to the words whose tokens they are; a word is one token
    labels = errors.select("image_id", F.posexplode("labels").alias("i", "ok"))
    numbered = words.withColumn("i", F.row_number().over(Window.partitionBy("image_id").orderBy("pos")) - 1)
    scored = numbered.join(labels, ["image_id", "i"]).select("image_id", "pos", "conf", (~F.col("ok")).alias("wrong"))
    separation = metrics.auroc(scored, ["image_id"], "conf", "wrong").select("image_id", "auroc")
    recall = metrics.flag_rates(scored, ["image_id"], "conf", "wrong", "pos", (0.10,)).select("image_id", F.col("recall").alias("recall_10"))
    found = manifest.join(errors.select("image_id", "wer", "accuracy"), "image_id", "left").join(chars, "image_id", "left")
    found = found.join(separation, "image_id", "left").join(recall, "image_id", "left")
    return found.withColumn("has_gt", F.col("wer").isNotNull())


def summarized(results: DataFrame, key: str) -> DataFrame:
    """Means over images with text by a key, in order."""
    return metrics.report(results, key, ["wer", "cer", "auroc", "recall_10"], F.col("has_gt"))


def two_labels(words: DataFrame, truth: DataFrame) -> DataFrame:
    """(image_id, accuracy_seq, auroc_seq, accuracy_bag, auroc_bag): labels by alignment against labels by multiplicity."""
    tokens = truth.select("image_id", tokenize(F.col("text")).alias("truth"))
    read = words.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s.text).alias("read"))
    seq = metrics.token_errors(tokens.join(read, "image_id"), "image_id", "truth", "read").select("image_id", F.posexplode("labels").alias("i", "ok"))
    rows = words.withColumn("i", F.row_number().over(Window.partitionBy("image_id").orderBy("pos")) - 1)
    bag = metrics.bag_labels(words.select("image_id", "pos", F.col("text").alias("token")), tokens.select("image_id", F.explode("truth").alias("token")), ["image_id"])
    found = None
    for name, labels in (("seq", rows.join(seq, ["image_id", "i"])), ("bag", words.join(bag.select("image_id", "pos", "ok"), ["image_id", "pos"]))):
        marked = labels.select("image_id", "conf", (~F.col("ok")).alias("wrong"))
        one = metrics.auroc(marked, ["image_id"], "conf", "wrong").select("image_id", (1 - F.col("n_wrong") / F.col("n")).alias(f"accuracy_{name}"), F.col("auroc").alias(f"auroc_{name}"))
        found = one if found is None else found.join(one, "image_id")
    return found


def layout_text(words: DataFrame, blocks: DataFrame, page: list[str]) -> DataFrame:
    """(page, text, n_orphans): words in the order of their blocks' rank; each word without a block is a block of its own.

    ``words`` has pos, line, token and box, ``blocks`` block, bbox, page_w and page_h."""
    routed = spatial.route(words, blocks, page)
    lost = words.join(routed.filter("block is null").select(*page, "pos"), [*page, "pos"])
    size = blocks.groupBy(*page).agg(F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"), (F.max("block") + 1).alias("_n"))
    own = lost.join(size, page).select(*page, (F.col("_n") + F.col("pos")).alias("block"), F.col("box").alias("bbox"), "page_w", "page_h", "pos")
    cells = blocks.select(*page, F.col("block").cast("bigint").alias("block"), "bbox", "page_w", "page_h").unionByName(own.drop("pos").withColumn("block", F.col("block").cast("bigint")))
    rank = ordering.xy_cut(cells, page)
    at = routed.filter("block is not null").select(*page, "pos", F.col("block").cast("bigint").alias("block")).unionByName(own.select(*page, "pos", F.col("block").cast("bigint").alias("block")))
    rows = words.join(at, [*page, "pos"]).join(rank, [*page, "block"]).withColumn("_o", F.struct("rank", "pos"))
    found = ordering.running_text(rows, page, ["rank", "line"], "_o")
    return found.join(lost.groupBy(*page).agg(F.count("*").alias("n_orphans")), page, "left").withColumn("n_orphans", F.coalesce("n_orphans", F.lit(0)))


def grade(truth: DataFrame, found: DataFrame, page: list[str], lang: Column | None = None) -> DataFrame:
    """A row for each page: matched share, type accuracy, rank correlation of text blocks in the given and the native order,
    captions found by their header, captions paired by number.

    ``truth`` has gt, type, ord, anchor, bbox (struct); ``found`` block, type, rank, bbox, text, native_ranks."""
    lang = F.lit("ita") if lang is None else lang
    typed = found.withColumn("_c", parse_caption(F.col("text"), lang))
    typed = typed.withColumn("type", matching.promote_captions(F.col("type"), F.col("_c").isNotNull()))
    hits = matching.match_blocks(truth.withColumn("anchor", anchor_tokens(F.col("anchor"))), typed.withColumn("tokens", anchor_tokens(F.col("text"))), page)
    rows = truth.select(*page, "gt", "ord", F.col("type").alias("gt_type")).join(hits, [*page, "gt"]).join(typed.select(*page, "block", "type", "rank", ordering.upper_median(F.col("native_ranks")).alias("native")), [*page, "block"], "left")
    shares = rows.groupBy(*page).agg(metrics.ratio(F.count("block"), F.count("*")).alias("seg_recall"), F.coalesce(F.avg(F.when(F.col("block").isNotNull(), (F.col("type") == F.col("gt_type")).cast("int"))), F.lit(0.0)).alias("type_acc"))
    text = rows.filter("block is not null and gt_type <> 'figure'")
    taus = shares
    for name, key, only in (("tau", "rank", text), ("tau_native", "native", text.filter("native is not null"))):
        taus = taus.join(metrics.kendall_tau(only, page, "ord", key).select(*page, F.col("tau").alias(name)), page, "left")
    captions = typed.filter("type = 'caption'").select(*page, F.col("block").alias("caption"), F.col("_c.number").alias("number"))
    figures = typed.filter("type = 'figure'").select(*page, F.col("block").alias("figure"), figure_number(F.col("text")).alias("number"))
    pairs = matching.pair_by_number(captions, figures, page).groupBy(*page).agg(F.count("*").alias("n_pairs"))
    return taus.join(captions.groupBy(*page).agg(F.count("*").alias("n_captions")), page, "left").join(pairs, page, "left").fillna(0, ["n_captions", "n_pairs"])


def grade_rows(rows: DataFrame, page: list[str], lang: Column | None = None) -> DataFrame:
    """What ``grade`` finds of rows that hold a page's truth (gt, type, ord, anchor, bbox) and found (block, type, rank, bbox, text, native_ranks) in arrays."""
    lang = F.lit("ita") if lang is None else lang

    def typed(x):
        def of(c):
            kind = matching.promote_captions(x["type"], c.isNotNull())
            return F.struct(
                x["block"].alias("block"), kind.alias("type"), x["rank"].alias("rank"), x["bbox"].alias("bbox"), anchor_tokens(x["text"]).alias("tokens"), ordering.upper_median(x["native_ranks"]).alias("native"),
                c["number"].alias("number"), F.when(x["type"] == "figure", figure_number(x["text"])).alias("figure"),
            )

        return once(parse_caption(x["text"], lang), of)

    def tau(pairs):
        pairs = [p for p in pairs if None not in p]
        together, against = metrics.pair_counts(*np.array(pairs, float).reshape(-1, 2).T)
        return (together - against) / (together + against) if together + against else None

    def of_page(gts, dets):
        hit, by = matching.match_page(gts, dets), {x["block"]: x for x in dets}
        met = [(g, by[hit[g["gt"]]]) for g in gts if g["gt"] in hit]
        same = [g["type"] == x["type"] for g, x in met if g["type"] and x["type"]]
        text = [(g["ord"], x["rank"], x["native"]) for g, x in met if g["type"] and g["type"] != "figure"]
        captions = [x["number"] for x in dets if x["type"] == "caption"]
        figures = collections.Counter(x["figure"] for x in dets if x["type"] == "figure" and x["figure"] is not None)
        return (
            len(met) / len(gts), sum(same) / len(same) if same else 0.0, tau([(o, r) for o, r, _ in text]), tau([(o, n) for o, _, n in text]),
            len(captions), sum(figures[n] == 1 for n in captions if n is not None),
        )

    def run(b):
        both = zip(paged.Items(b.column("truth")).lists(), paged.Items(b.column("found")).lists())
        found = [(k, of_page(g, d)) for k, (g, d) in enumerate(both) if g]
        kinds = [pa.float64()] * 4 + [pa.int64()] * 2
        return np.array([k for k, _ in found], np.int64), [pa.array([v[i] for _, v in found], t) for i, t in enumerate(kinds)]

    made = "seg_recall double; type_acc double; tau double; tau_native double; n_captions bigint; n_pairs bigint"
    anchored = F.transform("truth", lambda g: g.withField("anchor", anchor_tokens(g["anchor"])))
    return paged.mapped(rows.select(*page, anchored.alias("truth"), F.transform("found", typed).alias("found")), page, made, ["truth", "found"], run)
