"""Word decisions: adaptive thresholds per document, keep / flag / patch, counts and roll-ups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..functions.geometry import box, clamped
from ..functions.scalars import CEILING, FLAG_RATE, FLOOR
from ..functions.text import is_blank

#: Scored words from which a threshold is taken; fewer leave the floor.
LEAST_WORDS = 20


def is_scored(text: Column, conf: Column) -> Column:
    return ~is_blank(text) & (conf > 0)


def is_uncertain(conf: Column, threshold: Column, disagree: Column) -> Column:
    return (conf < threshold) | F.coalesce(disagree, F.lit(False))


def decide(text: Column, uncertain: Column, mode: Column) -> Column:
    return F.when(is_blank(text) | ~uncertain | (mode == "best_guess"), "keep").when(mode == "patch", "patch").otherwise("flag")


def flag_visible(decision: Column, edited: Column, text: Column, text_ocr: Column) -> Column:
    """Whether a word still shows its mark: flagged or patched, and neither edited nor changed from what was read."""
    changed = F.coalesce(text_ocr.isNotNull() & (text != text_ocr), F.lit(False))
    return F.coalesce(decision.isin("flag", "patch"), F.lit(False)) & ~(F.coalesce(edited, F.lit(False)) | changed)


def order_review_visible(order_mode: Column, confirmed: Column, order: Column, order_auto: Column) -> Column:
    """Whether a block's order still asks for review; an unknown automatic order does."""
    moved = F.coalesce(order_auto.isNotNull() & (order != order_auto), F.lit(False))
    return (order_mode == "review") & ~F.coalesce(confirmed, F.lit(False)) & ~moved


def thresholds(words: DataFrame, by: list[str], rate: float = FLAG_RATE, floor: float = FLOOR, ceiling: float = CEILING, override: float | None = None) -> DataFrame:
    """(by, scored, raw, threshold): the percentile of scored confidences between the rails.

    Fewer than LEAST_WORDS scored words give the floor and raw -1; an override goes before all. The
    percentile is rounded to 6 places, as is the comparison with it."""
    scored = is_scored(F.col("token"), F.col("conf"))
    low, high = min(floor, ceiling), max(floor, ceiling)
    found = words.groupBy(*by).agg(F.count_if(scored).alias("scored"), F.round(F.percentile(F.when(scored, F.col("conf")), F.lit(rate)), 6).alias("p"))
    if override is not None:
        return found.select(*by, "scored", F.lit(-1.0).alias("raw"), F.lit(float(override)).alias("threshold"))
    few = F.col("scored") < LEAST_WORDS
    return found.select(*by, "scored", F.when(few, -1.0).otherwise(F.col("p")).alias("raw"), F.when(few, low).otherwise(F.least(F.greatest("p", F.lit(low)), F.lit(high))).alias("threshold"))


def decided(words: DataFrame, limits: DataFrame, by: list[str], mode: str = "flag") -> DataFrame:
    """Words with uncertain and decision. Both sides are keyed by ``by``, so one partitioning serves."""
    found = words.join(limits, by).withColumn("uncertain", is_uncertain(F.col("conf"), F.col("threshold"), F.col("disagree")))
    return found.withColumn("decision", decide(F.col("token"), F.col("uncertain"), F.lit(mode)))


def decision_counts() -> list[Column]:
    """Aggregates over decided words. Uncertain and scored-and-flagged words count in any mode."""
    text, decision, uncertain = F.col("token"), F.col("decision"), F.col("uncertain")
    return [
        F.count("*").alias("n_words"),
        *[F.count_if(decision == d).alias(f"n_{d}") for d in ("keep", "flag", "patch")],
        F.count_if(uncertain & ~is_blank(text)).alias("n_uncertain"),
        F.count_if(uncertain & is_scored(text, F.col("conf"))).alias("n_scored_flagged"),
        F.count_if(is_scored(text, F.col("conf"))).alias("n_scored"),
    ]


def effective_rate(flagged: Column, scored: Column) -> Column:
    return F.when(scored > 0, flagged / scored).otherwise(0.0)


def by_document(words: DataFrame, mode: str = "flag", rate: float = FLAG_RATE, floor: float = FLOOR, ceiling: float = CEILING) -> DataFrame:
    """One row per document: threshold, counts and the effective rate.

    Of a word its confidence alone is shuffled, once: words that stand together are packed into arrays before, as
    they need be neither sorted nor whole for that."""

    def run(batches):
        for b in batches:
            doc, conf = b.column(0), b.column(1)
            code = pc.dictionary_encode(doc, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            blank, odd = (b.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (2, 3))
            n = int(code.max(initial=-1)) + 1

            def packed(which):
                at = np.flatnonzero(which)
                at = at[np.argsort(code[at], kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(code[at], minlength=n))])
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), conf.take(pa.array(at)))

            first = np.full(n, -1)
            first[code[::-1]] = np.arange(len(code))[::-1]
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(first)), pa.array(np.bincount(code, minlength=n), pa.int64()), packed(~blank & ~odd), packed(~blank & odd)], ["doc_id", "n_words", "sure", "odd"])

    kind = words.schema["doc_id"].dataType.simpleString()
    facts = words.select("doc_id", F.col("conf").cast("double").alias("conf"), is_blank(F.col("token")).alias("blank"), F.coalesce("disagree", F.lit(False)).alias("odd"))
    parts = facts.mapInArrow(run, f"doc_id {kind}, n_words bigint, sure array<double>, odd array<double>")
    whole = parts.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("sure", "odd")])
    return _counted(whole, ["doc_id"], mode, rate, floor, ceiling)


def percentile_of(ordered: Column, share: float) -> Column:
    """The linear percentile of a sorted array, rounded to 6 places; null if it is empty."""
    at = (F.size(ordered) - 1) * F.lit(share)
    low = F.floor(at)
    a, b = F.get(ordered, low.cast("int")), F.get(ordered, F.least(low + 1, F.size(ordered) - 1).cast("int"))
    return F.when(F.size(ordered) > 0, F.round(a * (low + 1 - at) + b * (at - low), 6))


def _limits(confs: Column, rate: float, floor: float, ceiling: float) -> tuple[Column, Column]:
    """raw and threshold of the sorted confidences of a document's scored words."""
    low, high = min(floor, ceiling), max(floor, ceiling)
    few, p = F.size(confs) < LEAST_WORDS, percentile_of(confs, rate)
    return F.when(few, -1.0).otherwise(p), F.when(few, low).otherwise(F.least(F.greatest(p, F.lit(low)), F.lit(high)))


def with_limits(documents: DataFrame, words: str = "words", rate: float = FLAG_RATE, floor: float = FLOOR, ceiling: float = CEILING) -> DataFrame:
    """Documents that hold their words (token, conf, ...) with raw and threshold, as ``thresholds`` has them."""
    scored = F.filter(words, lambda x: is_scored(x["token"], x["conf"]))
    rows = documents.withColumn("_confs", F.array_sort(F.transform(scored, lambda x: x["conf"])))
    raw, threshold = _limits(F.col("_confs"), rate, floor, ceiling)
    return rows.withColumns({"raw": raw, "threshold": threshold}).drop("_confs")


def unsure(words: Column, threshold: Column) -> Column:
    """The uncertain ones of an array of words (conf, disagree)."""
    return once(threshold, lambda t: F.filter(words, lambda x: is_uncertain(x["conf"], t, x["disagree"])))


def by_row(documents: DataFrame, words: str = "words", mode: str = "flag", rate: float = FLAG_RATE, floor: float = FLOOR, ceiling: float = CEILING, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What ``by_document`` finds, for documents that hold their words as an array of (token, conf, disagree).

    A document is one row, so nothing is shuffled: sorting and counting stay inside the row."""
    # blank words are kept and never scored, so they are set aside once
    rows = documents.select(*keep, F.size(words).cast("bigint").alias("n_words"), F.filter(words, lambda x: ~is_blank(x["token"])).alias("w"))

    def confs(odd):
        return F.transform(F.filter("w", lambda x: F.coalesce(x["disagree"], F.lit(False)) == F.lit(odd)), lambda x: x["conf"])

    return _counted(rows.select(*keep, "n_words", confs(False).alias("sure"), confs(True).alias("odd")), [*keep], mode, rate, floor, ceiling)


def _counted(rows: DataFrame, keep: list[str], mode: str, rate: float, floor: float, ceiling: float) -> DataFrame:
    """A row of counts for each document, of how many words it has and the confidences of those not blank: ``sure``, and ``odd`` where a second reader disagrees."""
    rows = rows.select("*", F.array_sort(F.filter(F.concat("sure", "odd"), lambda c: c > 0)).alias("confs"))
    raw, threshold = _limits(F.col("confs"), rate, floor, ceiling)
    rows = rows.select(*keep, "n_words", "sure", "odd", F.size("confs").cast("bigint").alias("n_scored"), raw.alias("raw"), threshold.alias("threshold"))
    low = once(F.col("threshold"), lambda t: F.filter("sure", lambda c: c < t))
    rows = rows.select(*keep, "raw", "threshold", "n_words", "n_scored", F.concat(low, "odd").alias("unsure"))
    n, none = F.size("unsure").cast("bigint"), F.lit(0).cast("bigint")
    marked = {d: n if mode == d else none for d in ("flag", "patch")}
    found = rows.select(
        *keep, "raw", "threshold", "n_words", (F.col("n_words") - marked["flag"] - marked["patch"]).alias("n_keep"), *[c.alias(f"n_{d}") for d, c in marked.items()],
        n.alias("n_uncertain"), F.size(F.filter("unsure", lambda c: c > 0)).cast("bigint").alias("n_scored_flagged"), "n_scored",
    )
    return found.withColumn("effective", effective_rate(F.col("n_scored_flagged"), F.col("n_scored")))


def patch_name(page: Column, block: Column, word: Column) -> Column:
    return F.format_string("patches/%s_b%d_w%02d.png", page, block, word)


def patch_manifest(words: DataFrame, page_w: Column, page_h: Column) -> DataFrame:
    """(doc_id, block, word, asset, x, y, w, h): the crop of each patched word, cut to the page."""
    crop = clamped(box(F.col("x"), F.col("y"), F.col("w"), F.col("h")), page_w, page_h)
    found = words.filter("decision = 'patch'").withColumn("crop", crop).filter("crop is not null")
    return found.select("doc_id", "block", "word", patch_name(F.col("page"), F.col("block"), F.col("word")).alias("asset"), "crop.x", "crop.y", "crop.w", "crop.h")
