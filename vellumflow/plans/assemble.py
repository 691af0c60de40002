"""Assembling: flat words and blocks of pages, with decisions and patches, into one nested document a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MODES
from ..operators.document import enriched, gathered, with_patches
from .schemas import BLOCK, BOX, DOCUMENT_VERSION, WORD


def attach_words(words: DataFrame, blocks: DataFrame, routed: DataFrame, orphans: DataFrame, page: list[str]) -> DataFrame:
    """words with block and the gapless rank of the block among real and made ones, real ones first.

    Confidence is cut to 0..100, and line is the place of first appearance of (block_num, par_num, line_num)."""
    n = blocks.groupBy(*page).agg((F.max("block") + 1).alias("_n"))
    lines = words.groupBy(*page, "block_num", "par_num", "line_num").agg(F.min("pos").alias("_first"))
    lines = lines.withColumn("line", F.row_number().over(Window.partitionBy(*page).orderBy("_first")) - 1)
    made = orphans.join(n, page, "left").select(*page, "block_num", "par_num", (F.coalesce("_n", F.lit(0)) + F.col("rank")).alias("_made"))
    found = words.drop("line").join(routed, [*page, "pos"]).join(made, [*page, "block_num", "par_num"], "left")
    found = found.join(lines.drop("_first"), [*page, "block_num", "par_num", "line_num"])
    return found.withColumns({"block": F.coalesce("block", "_made"), "conf": F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("conf")))}).drop("_made")


def documents(pages: DataFrame, blocks: DataFrame, words: DataFrame, patches: DataFrame, settings: DataFrame) -> DataFrame:
    """One nested row for each document, of the form that ``tables.documents`` reads, and its warnings.

    ``pages`` (doc_id, spread, subpage, width, height, language, mode, image_asset), ``blocks`` (doc_id, spread,
    subpage, block, type, bbox, reading_order), ``words`` (doc_id, spread, subpage, block, word, text, bbox, conf,
    decision, line, disagree), ``patches`` (doc_id, spread, subpage, block, word, asset), ``settings`` (doc_id,
    target_language, order_mode, strip_running_headers, strip_page_numbers, fonts; nulls stand for the defaults).
    Pages stand by spread and then subpage. Each level is folded into the one above by its own key, so no row is
    larger than its page until the last step."""
    key = ["doc_id", "spread", "subpage"]
    w = with_patches(words, patches, key)
    nested = w.groupBy(*key, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", _word(F.col).alias("w")))), lambda x: x["w"]).alias("words"))
    b = enriched(blocks).join(nested, [*key, "block"], "left")
    p = pages.join(b.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "block", _block(F.col, F.col("words")).alias("b")))), lambda x: x["b"]).alias("blocks")), key, "left")
    whole = p.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("spread", "subpage", _page(F.col, F.col("blocks")).alias("p")))), lambda x: x["p"]).alias("pages"))
    return _document(whole.join(gathered(pages), "doc_id").join(settings, "doc_id", "left"))


def documents_of_rows(rows: DataFrame) -> DataFrame:
    """What ``documents`` makes, of documents that hold their pages, blocks and words in arrays; nothing is shuffled.

    ``rows`` is (doc_id, the settings, pages), a page an element with the columns of ``pages`` and ``blocks``, a block
    one with those of ``blocks`` and ``words``, a word one with those of ``words`` and the asset of its patch, if any."""

    def at(x):
        return lambda c: x[c]

    def in_order(items, keys, made):
        return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(*[x[k].alias(k) for k in keys], made(x).alias("v")))), lambda x: x["v"])

    def of_word(b):
        own = {"text_ocr": "text", "patch_asset": "asset"}

        def get(x):
            return lambda c: F.lit(False) if c == "edited" else b["block"] if c == "block" else x[own.get(c, c)]

        return lambda x: _word(get(x))

    def of_block(b):
        own = {"type_auto": b["type"], "order_auto": b["reading_order"], "structure_edited": F.lit(False), "order_confirmed": F.lit(False), "text": F.lit(None).cast("string")}
        return _block(lambda c: own[c] if c in own else b[c], in_order(b["words"], ["word"], of_word(b)))

    def of_page(p):
        return _page(at(p), in_order(p["blocks"], ["reading_order", "block"], of_block))

    def all_of(c):
        return F.array_sort(F.array_distinct(F.array_compact(F.transform("pages", lambda p: p[c]))))

    facts = {f"{c}s": all_of(c) for c in ("language", "mode")}
    found = rows.withColumns(facts).withColumns({c: F.get(f"{c}s", F.lit(0)) for c in ("language", "mode")})
    return _document(found.withColumn("pages", in_order(F.col("pages"), ["spread", "subpage"], of_page)))


def _word(c) -> Column:
    return F.struct(
        c("text").alias("text"), c("bbox").cast(BOX).alias("bbox"), c("conf").cast("double").alias("conf"), F.lit("tesseract").alias("engine"), c("line").cast("int").alias("line_id"),
        c("block").cast("int").alias("block_id"), c("decision").alias("decision"), F.coalesce(c("disagree"), F.lit(False)).alias("engine_disagree"), c("text_ocr").alias("text_ocr"), c("edited").alias("edited"), c("patch_asset").alias("patch_asset"),
    )


def _block(c, words: Column) -> Column:
    return F.struct(
        c("block").cast("int").alias("id"), c("type").alias("type"), c("bbox").cast(BOX).alias("bbox"), c("reading_order").cast("int").alias("reading_order"), F.coalesce(words, F.array().cast(f"array<{WORD}>")).alias("words"), c("type_auto").alias("type_auto"),
        c("order_auto").cast("int").alias("order_auto"), c("structure_edited").alias("structure_edited"), c("order_confirmed").alias("order_confirmed"), c("text").alias("text"),
    )


def _page(c, blocks: Column) -> Column:
    return F.struct(
        F.concat_ws("__", c("spread"), c("subpage")).alias("page_id"), c("spread").alias("source_spread"), c("subpage").alias("subpage"), c("width").cast("int").alias("width"),
        c("height").cast("int").alias("height"), c("image_asset").alias("image_asset"), F.coalesce(blocks, F.array().cast(f"array<{BLOCK}>")).alias("blocks"),
    )


def _document(found: DataFrame) -> DataFrame:
    """Documents of their pages, the sets of these pages' modes and languages, and the settings."""
    of_settings = F.struct(
        F.coalesce("language", F.lit("eng")).alias("source_language"), "target_language", F.coalesce("mode", F.lit("flag")).alias("uncertainty_mode"), F.coalesce("order_mode", F.lit("auto")).alias("order_mode"),
        F.coalesce("strip_running_headers", F.lit(True)).alias("strip_running_headers"), F.coalesce("strip_page_numbers", F.lit(True)).alias("strip_page_numbers"),
        F.coalesce("fonts", F.array().cast("array<string>")).alias("fonts"),
    )
    mixed = F.array_compact(F.array(F.when(F.size("modes") > 1, F.concat(F.lit("pages were resolved under different modes: "), F.array_join("modes", ", "))), F.when(F.size("languages") > 1, F.concat(F.lit("pages were read in different languages: "), F.array_join("languages", ", ")))))
    return found.select(F.lit(DOCUMENT_VERSION).alias("schema_version"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("job_id"), of_settings.alias("settings"), "pages", mixed.alias("warnings"))


def guard(assembled: DataFrame, edited: DataFrame, force: bool = False) -> DataFrame:
    """Documents that may be written: those without edits, or all if forced. ``edited`` is (document_id, has_edits)."""
    if force:
        return assembled
    return assembled.join(edited.filter("has_edits").select("document_id"), "document_id", "left_anti")


def job_rows(jobs: DataFrame) -> DataFrame:
    """Jobs by id, their modes checked."""
    checked = F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise(F.raise_error(F.concat(F.lit("no such mode: "), F.coalesce("mode", F.lit("null")))))
    return jobs.select("job_id", checked.alias("mode")).orderBy("job_id")
