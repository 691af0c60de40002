"""Queries whose words stay in their document's row: how often rows are shuffled, and what the row forms find."""

import re

import pytest
from pyspark.sql import functions as F

from vellumflow.functions import captions
from vellumflow.functions.arrays import runs_of
from vellumflow.functions.text import capitalized
from vellumflow.plans import queries

#: How many exchanges a plan may have besides the one that deals documents out.
EXCHANGES = {"document_round_trip": 0, "document_words": 0, "layout_texts": 0, "second_opinion_diff": 12, "graded_pages": 0, "greedy_match": 0, "read_pages": 0, "label_tokens": 0, "wer_tokens": 0, "hyphen_merge": 4, "runs_true": 0, "page_html": 0, "orphan_blocks": 4, "patch_manifest": 0, "word_conservation": 0, "uncertainty_rollup": 0, "uncertainty_by_word_table": 4, "route_words": 0, "layout_pages": 0, "word_edits": 0, "reading_rows": 0, "xy_cut_exact": 0, "auroc_words": 0}


@pytest.mark.parametrize("name", sorted(EXCHANGES))
def test_words_are_not_shuffled(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    met = len(re.findall(r"SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|FlatMapCoGroups|FlatMapGroups|Window|ObjectHashAggregate|SortAggregate", plan))
    assert met <= EXCHANGES[name]


def test_runs_of(spark):
    rows = spark.createDataFrame([([1, 1, 2, 1],), ([],), (None,)], "a array<int>")
    assert [r.b for r in rows.select(runs_of(F.col("a"), lambda x, y: x == y).alias("b")).collect()] == [[[1, 1], [2], [1]], None, None]


@pytest.mark.parametrize("word, large", [("ß", "ẞ"), ("ab-cd", "Ab-cd"), ("ŉa", "ŉa"), ("àB", "Àb"), ("", "")])
def test_capitalized_letter_by_letter(spark, word, large):
    assert spark.createDataFrame([(word,)], "w string").select(capitalized(F.col("w")).alias("c")).first().c == large


def test_captions_of_rows_are_those_of_columns(spark):
    texts = ["Figura 12 | casa", "Sopra: Fig. 3", "Abb. 1234 x", "Tav. 7:  mare ", "nulla", "", None, "A b :  figura9-x"]
    rows = spark.createDataFrame([(i, t, k) for i, t in enumerate(texts) for k in ("ita", "deu", "eng")], "i int, text string, key string")
    got = captions.parsed_captions(rows, "text", "key").select("i", "key", "c").collect()
    want = rows.select("i", "key", captions.parse_caption(F.col("text"), F.col("key")).alias("c")).filter("c is not null").collect()
    assert sorted(got) == sorted(want) and want
