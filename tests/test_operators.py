import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumflow.operators import decisions, document, layout, matching, metrics, ordering, pixels, spatial

BOX = "struct<x:int,y:int,w:int,h:int>"


def words(spark, confs, token="a"):
    return spark.createDataFrame([(1, i, token, float(c), False) for i, c in enumerate(confs)], "doc_id int, pos int, token string, conf double, disagree boolean")


@pytest.mark.parametrize("confs, rate, raw, threshold", [([95] * 96 + [30] * 4, 0.1, 95, 75), ([15] * 60 + [90] * 40, 0.1, None, 45), (list(range(1, 101)), 0.6, None, None), ([50] * 19, 0.1, -1, 45)])
def test_thresholds(spark, confs, rate, raw, threshold):
    r = decisions.thresholds(words(spark, confs), ["doc_id"], rate).first()
    assert raw is None or r.raw == raw
    assert r.threshold == (threshold if threshold is not None else r.raw)


def test_threshold_override(spark):
    r = decisions.thresholds(words(spark, [50] * 3), ["doc_id"], override=60).first()
    assert (r.raw, r.threshold) == (-1.0, 60.0)


def test_decide(spark):
    rows = spark.createDataFrame([("x", m, 50.0) for m in ("flag", "patch", "best_guess")] + [(" ", "flag", 5.0)], "t string, m string, c double")
    got = rows.select(decisions.decide(F.col("t"), F.col("c") < 70, F.col("m")).alias("d")).collect()
    assert [x.d for x in got] == ["flag", "patch", "keep", "keep"]


def test_visibility(spark):
    rows = spark.createDataFrame([("flag", False, "a", None), ("flag", False, "a", "b"), ("flag", True, "a", "a"), ("keep", False, "a", "a"), (None, None, "a", None), ("patch", None, "a", "a")], "d string, e boolean, t string, o string")
    assert [x.v for x in rows.select(decisions.flag_visible(F.col("d"), F.col("e"), F.col("t"), F.col("o")).alias("v")).collect()] == [True, False, False, False, False, True]


def scored(spark, confs, wrong):
    return spark.createDataFrame([(1, i, float(c), w) for i, (c, w) in enumerate(zip(confs, wrong))], "k int, pos int, conf double, bad boolean")


@pytest.mark.parametrize("confs, wrong, want", [([95, 92, 88, 30, 20, 10], [False] * 3 + [True] * 3, 1.0), ([95, 92, 88, 30, 20, 10], [True] * 3 + [False] * 3, 0.0), ([5, 6], [True, True], None), ([5, 5, 5], [True, False, False], 0.5)])
def test_auroc(spark, confs, wrong, want):
    assert metrics.auroc(scored(spark, confs, wrong), ["k"], "conf", "bad").first().auroc == want


def test_auroc_brute_force(spark):
    rng = random.Random(3)
    confs, wrong = [rng.randint(0, 9) for _ in range(60)], [rng.random() < 0.4 for _ in range(60)]
    pairs = [(a, b) for a, w in zip(confs, wrong) if w for b, v in zip(confs, wrong) if not v]
    want = sum((b > a) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert metrics.auroc(scored(spark, confs, wrong), ["k"], "conf", "bad").first().auroc == pytest.approx(want)


def test_flag_rates(spark):
    rows = scored(spark, [1, 2, 50, 60, 70, 80, 90, 91, 92, 93], [True, True] + [False] * 8)
    r = metrics.flag_rates(rows.withColumnRenamed("k", "doc"), ["doc"], "conf", "bad", "pos", (0.2, 0.01)).orderBy("rate").collect()
    assert (r[1].k, r[1].recall, r[1].precision, r[1].threshold) == (2, 1.0, 1.0, 2.0)
    assert (r[0].k, r[0].recall, r[0].threshold) == (0, 0.0, float("-inf"))


def test_bag_labels(spark):
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate("a b a a".split())], "k int, pos int, token string")
    g = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c")], "k int, token string")
    assert [x.ok for x in metrics.bag_labels(t, g, ["k"]).orderBy("pos").collect()] == [True, False, True, False]


def test_kendall_tau(spark):
    cases = {"a": [(0, 286), (1, 43), (2, 128), (3, 337)], "b": [(0, 3), (1, 2), (2, 1)], "c": [(0, 1)]}
    rows = spark.createDataFrame([(k, *p) for k, ps in cases.items() for p in ps], "k string, a int, b int")
    got = {x.k: x.tau for x in metrics.kendall_tau(rows, ["k"], "a", "b").collect()}
    assert got["a"] == pytest.approx(1 / 3) and got["b"] == -1 and got["c"] is None


def test_discordant_by_brute_force():
    rng = random.Random(2)
    for n in (0, 1, 2, 17, 200):
        v = [rng.randint(0, 30) for _ in range(n)]
        assert metrics.discordant(np.array(v, np.int64)) == sum(v[i] > v[j] for i in range(n) for j in range(i + 1, n))


def test_kendall_tau_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 12), rng.choice([rng.random() < 0.5, True]) * rng.randint(0, 9) / 4) for g in range(5) for _ in range(g * 15)] + [(9, None, 1.0), (9, 1, None)]
    got = {r.g: (r.concordant, r.discordant) for r in metrics.kendall_tau(spark.createDataFrame(rows, "g int, a int, b double"), ["g"], "a", "b").collect()}
    for g in range(1, 5):
        own = [(a, b) for k, a, b in rows if k == g]
        turn = [(x[0] - y[0]) * (x[1] - y[1]) for i, x in enumerate(own) for y in own[:i]]
        assert got[g] == (sum(t > 0 for t in turn), sum(t < 0 for t in turn))
    assert got[9] == (0, 0)


def test_errors(spark):
    rows = spark.createDataFrame([("w", ["a", "b", "c", "d"], ["a", "x", "c", "d"]), ("l", ["the", "cat", "sat"], ["the", "cot", "sat", "here"]), ("e", [], []), ("n", None, ["x"])], "k string, t array<string>, r array<string>")
    got = {x.k: x for x in metrics.token_errors(rows, "k", "t", "r").collect()}
    assert (got["w"].wer, got["w"].accuracy) == (0.25, 0.75)
    assert got["l"].labels == [True, False, True, False]
    assert got["e"].wer == 0.0 and got["n"].wer == 1.0
    assert spark.range(1).select(metrics.character_error(F.lit("hello world"), F.lit("hallo world")).alias("c")).first().c == pytest.approx(1 / 11)


def test_alignment_is_shortest():
    rng = random.Random(5)
    for _ in range(200):
        a, b = [rng.choice("abc") for _ in range(rng.randint(0, 6))], [rng.choice("abc") for _ in range(rng.randint(0, 6))]
        d, ok = metrics.align(a, b)
        table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i, j] = min(table[i - 1, j - 1] + (a[i - 1] != b[j - 1]), table[i - 1, j] + 1, table[i, j - 1] + 1)
        assert d == table[len(a), len(b)] and len(ok) == len(b) and sum(ok) <= min(len(a), len(b))


@pytest.mark.parametrize("rows, want", [([("eng", 0.01, 0.9), ("bul", 0.02, 0.5)], "PASS"), ([("eng", 0.01, 0.9), ("bul", 0.2, 0.5)], "MIXED"), ([("eng", 0.5, 0.7)], "FAIL"), ([("bul", 0.0, 0.9)], "INCONCLUSIVE"), ([("eng", 0.01, 0.8)], "PASS")])
def test_verdict(spark, rows, want):
    assert metrics.verdict(spark.createDataFrame(rows, "lang string, wer double, auroc double")).first().verdict == want


def pages(spark, boxes, w=1000, h=1200):
    return spark.createDataFrame([(1, i, b, w, h) for i, b in enumerate(boxes)], f"page int, block int, bbox {BOX}, page_w int, page_h int")


CUTS = [
    ([(520, 120, 430, 980), (50, 20, 900, 50), (50, 120, 430, 980)], 1000, 1200, [1, 2, 0]),
    ([(100, 100, 60, 21), (165, 102, 120, 29), (288, 109, 70, 16), (360, 105, 110, 26)], 800, 1000, [0, 1, 2, 3]),
    ([(118, 1211, 1417, 285), (106, 1501, 1431, 200), (99, 1704, 1443, 319), (1574, 1246, 262, 956), (28, 148, 1801, 1029)], 2057, 3000, [4, 0, 1, 2, 3]),
]


@pytest.mark.parametrize("boxes, w, h, want", CUTS)
def test_xy_cut(spark, boxes, w, h, want):
    got = ordering.xy_cut(pages(spark, boxes, w, h), ["page"]).orderBy("rank").collect()
    assert [x.block for x in got] == want


@pytest.mark.parametrize("boxes, want", [([(600, 0, 300, 300), (0, 320, 300, 300)], [0, 1]), ([(400, 50, 100, 40), (100, 52, 100, 40)], [1, 0])])
def test_reading_rows(spark, boxes, want):
    assert [x.block for x in ordering.reading_rows(pages(spark, boxes), ["page"]).orderBy("rank").collect()] == want


def test_levels_agree_with_recursion(spark):
    rng = random.Random(2)
    grid = [(100 * c + 5, 100 * r + 5, 60, 60) for r in range(4) for c in range(4)]
    rng.shuffle(grid)
    p = pages(spark, grid, 400, 400)
    exact = [x.block for x in ordering.xy_cut(p, ["page"]).orderBy("rank").collect()]
    assert [x.block for x in ordering.xy_cut_levels(p, ["page"], 1).orderBy("path").collect()] == exact


def test_separators_and_runs(spark):
    rows = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([(0, 10), (12, 20), (5, 30), (31, 40), (33, 35)])], "k int, i int, a int, b int")
    assert [x.group for x in ordering.separators(rows, ["k"], "a", "b", "i", F.lit(1)).orderBy("i").collect()] == [0, 0, 0, 1, 1]
    mask = spark.createDataFrame([(1, i, c == "1") for i, c in enumerate("0110111")], "k int, i int, t boolean")
    assert sorted((x.start, x.end) for x in ordering.runs(mask, ["k"], "i", F.col("t")).collect()) == [(1, 3), (4, 7)]
    level = mask.withColumn("v", F.col("t").cast("int"))
    assert [(x.start, x.end) for x in ordering.split_by_gaps(level, ["k"], "i", "v", F.lit(0), 2).collect()] == [(1, 7)]


def test_suppress(spark):
    d = spark.createDataFrame([(1, 0, (500, 100, 300, 200), 0.9), (1, 1, (520, 120, 60, 40), 0.5), (1, 2, (100, 100, 200, 50), 0.61), (1, 3, (100, 100, 200, 50), 0.33)], f"page int, det int, bbox {BOX}, conf double")
    assert sorted(x.det for x in ordering.suppress(d, ["page"]).collect()) == [0, 2]


def test_moving_average(spark):
    import numpy as np

    v = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "k int, i int, v double")
    for width in (4, 5):
        got = [x.m for x in rows.select("i", ordering.moving_average(["k"], "i", "v", width).alias("m")).orderBy("i").collect()]
        assert got == pytest.approx(np.convolve(v, np.ones(width) / width, mode="same").tolist())


def test_running_text(spark):
    rows = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (1, 2, None, "c"), (1, 3, None, "d")], "k int, pos int, line int, token string")
    assert ordering.running_text(rows, ["k"], ["line"]).first().text == "a b\nc d"


def boxed(spark, boxes):
    return spark.createDataFrame([(1, i, b) for i, b in enumerate(boxes)], f"page int, pos int, box {BOX}")


def test_route(spark):
    b = pages(spark, [(0, 0, 1000, 1000), (100, 100, 200, 100), (100, 100, 200, 100)]).select("page", "block", "bbox")
    w = boxed(spark, [(160, 130, 20, 10), (600, 600, 10, 10), (2000, 5, 10, 10), (990, 990, 20, 20)])
    got = {x.pos: x.block for x in spatial.route(w, b, ["page"], 64).collect()}
    assert got == {0: 1, 1: 0, 2: None, 3: 0}


def test_route_does_not_depend_on_tiles(spark):
    rng = random.Random(4)
    b = pages(spark, [(rng.randint(-50, 500), rng.randint(-50, 500), rng.randint(1, 300), rng.randint(1, 300)) for _ in range(30)]).select("page", "block", "bbox")
    w = boxed(spark, [(rng.randint(-60, 600), rng.randint(-60, 600), 20, 10) for _ in range(80)])
    a, c = ({x.pos: x.block for x in spatial.route(w, b, ["page"], t).collect()} for t in (17, 5000))
    assert a == c and len(a) == 80
    p, q = (sorted(map(tuple, spatial.pairs_by_overlap(b.withColumnRenamed("block", "i"), ["page"], t).collect())) for t in (23, 5000))
    assert p == q


def test_orphans(spark):
    w = spark.createDataFrame([(1, 0, 5, 1, 800, 10, 20, 10), (1, 1, 5, 1, 830, 12, 20, 10), (1, 2, 4, 1, 0, 0, 0, 0)], "page int, pos int, b int, p int, x int, y int, w int, h int")
    got = spatial.orphan_blocks(w, ["page"], ["b", "p"]).orderBy("rank").collect()
    assert [(x.b, x.n_words, tuple(x.bbox), x["rank"]) for x in got] == [(5, 2, (800, 10, 50, 12), 0), (4, 1, (0, 0, 1, 1), 1)]


def test_nearest_by_brute_force(spark):
    """Near and far boxes, whatever the rings."""
    rng = random.Random(7)

    def boxes(n, spread):
        return [(p, k, (rng.randint(0, spread), rng.randint(-spread, spread), rng.randint(0, 30), rng.randint(1, 30))) for p in (1, 2, 3) for k in range(n * (p - 1))]

    one, two = boxes(12, 3000), boxes(9, 3000)
    f, t = spark.createDataFrame(one, f"page int, i int, a {BOX}"), spark.createDataFrame(two, f"page int, j int, b {BOX}")

    def gap(a, b):
        return np.hypot(max(0, a[0] - b[0] - b[2], b[0] - a[0] - a[2]), max(0, a[1] - b[1] - b[3], b[1] - a[1] - a[3]))

    want = {(p, i): min((gap(a, b), j) for q, j, b in two if q == p) for p, i, a in one if p > 1}
    for rings in ((256, 2048), (1,), (300,)):
        got = {(r.page, r.i): (r.gap, r.j) for r in spatial.nearest(f, t, ["page"], rings).collect()}
        assert {k: j for k, (_, j) in got.items()} == {k: j for k, (_, j) in want.items()} and all(g == pytest.approx(want[k][0]) for k, (g, _) in got.items())


def test_regions(spark):
    r = spark.createDataFrame([(1, 0, (0, 0, 100, 20)), (1, 1, (0, 0, 200, 20)), (1, 2, (0, 0, 100, 20))], f"page int, region int, rbox {BOX}")
    got = {x.pos: x.region for x in spatial.assign_regions(boxed(spark, [(10, 5, 20, 10), (150, 5, 20, 10), (500, 5, 9, 9)]), r, ["page"]).collect()}
    assert got == {0: 0, 1: 1}


def test_pair_by_number(spark):
    def table(name, rows):
        return spark.createDataFrame([(1, f"{name}{i}", n) for i, n in enumerate(rows)], f"page int, {name} string, number int")

    got = matching.pair_by_number(table("caption", [25, 26, 25, None, 5]), table("figure", [25, 26, None, 5, 5]), ["page"]).collect()
    assert sorted((x.caption, x.figure) for x in got) == [("caption0", "figure0"), ("caption1", "figure1"), ("caption2", "figure0")]


def test_match_blocks(spark):
    t = spark.createDataFrame([(1, "F1", "figure", 0, (0, 0, 100, 100), None), (1, "F2", "figure", 1, None, None), (1, "P1", "paragraph", 2, None, ["a", "b"]), (1, "P2", "paragraph", 3, None, ["z"])], f"page int, gt string, type string, ord int, bbox {BOX}, anchor array<string>")
    f = spark.createDataFrame([(1, 0, "figure", 5, (500, 500, 10, 10), None), (1, 1, "figure", 1, (10, 0, 100, 100), None), (1, 2, "paragraph", 2, (0, 0, 1, 1), ["b", "x", "a"])], f"page int, block int, type string, rank int, bbox {BOX}, tokens array<string>")
    assert {x.gt: x.block for x in matching.match_blocks(t, f, ["page"]).collect()} == {"F1": 1, "F2": 0, "P1": 2, "P2": None}


def second(spark, own, other, lexicon):
    w = spark.createDataFrame([(1, 0, i, i, t) for i, t in enumerate(own)], "page int, region int, pos int, x int, token string")
    r = spark.createDataFrame([(1, 0, other)], "page int, region int, tokens array<string>")
    lex = None if lexicon is None else spark.createDataFrame([(t,) for t in lexicon], "token string")
    return sorted(x.pos for x in matching.vouched(w, r, ["page"], lex).collect())


def test_second_opinion(spark):
    assert second(spark, ["chapmarked"], ["chopmarked"], ["chopmarked"]) == [0]
    assert second(spark, ["chapmarked"], ["chopmarked"], None) == []
    assert second(spark, ["valid"], ["other"], ["valid", "other"]) == []
    assert second(spark, ["xx", "yy"], ["ab", "cd"], ["ab", "cd"]) == []
    assert second(spark, ["q"], ["k"], ["k"]) == []
    assert second(spark, ["a", "zz", "c"], ["a", "c"], ["a", "c"]) == []
    assert second(spark, ["a", "bb"], ["bb", "a"], ["a", "bb"]) == []


def test_disagreements(spark):
    """Unsure regions neither take words nor vouch; a capitalised entry knows the word; only one against one counts."""
    box = "struct<x:int,y:int,w:int,h:int>"
    words = spark.createDataFrame([(1, k, (k * 10, 0, 8, 8), t) for k, t in enumerate(["das", "Hsus", "ist", "gorß,", "x"])], f"page int, pos int, box {box}, token string")
    lexicon = spark.createDataFrame([("das",), ("Haus",), ("ist",), ("gro",)], "token string")

    def found(text, conf, other=()):
        regions = spark.createDataFrame([(1, 0, (0, 0, 100, 8), text, conf), *other], f"page int, region int, rbox {box}, text string, conf double")
        return sorted(r.pos for r in matching.disagreements(words, regions, ["page"], lexicon).collect())

    assert found("das Haus ist gro x", 0.9) == [1, 3]
    assert found("das Haus ist gro x", 0.2) == []
    assert found("das Haus ist gro x", 0.9, [(1, 1, (0, 0, 100, 8), "nothing here", 0.1)]) == [1, 3]
    assert found("das Haus Haus ist gor x", 0.9) == []


def test_hyphen_merge(spark):
    rows = [(1, 0, "compara-", 0, False), (1, 1, "tive", 1, False), (1, 2, "An-", 1, False), (1, 3, "Other", 2, False), (1, 4, "a-", 2, False), (1, 5, "b-", 3, False), (1, 6, "c", 4, False)]
    w = spark.createDataFrame(rows, "doc int, pos int, token string, line int, flagged boolean")
    lex = spark.createDataFrame([("comparative",), ("another",), ("ab-",), ("bc",)], "token string")
    got = document.merge_hyphens(w, ["doc"], lex).orderBy("pos").collect()
    assert [(x.pos, x.merged) for x in got] == [(0, "comparative"), (2, None), (3, None), (4, "ab-"), (6, None)]
    assert all(x.merged is None for x in document.merge_hyphens(w, ["doc"], None).collect())


def test_edits(spark):
    w = spark.createDataFrame([(1, "a", "a", False), (2, "b", "b", False), (3, "c", "c", False)], "k int, text string, text_ocr string, edited boolean")
    e = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (2, 2, None)], "k int, at int, text string")
    assert [(x.text, x.edited) for x in document.merge_edits(w, e, ["k"], ["at"]).orderBy("k").collect()] == [("y", True), ("b", False), ("c", False)]
    b = spark.createDataFrame([("p", "p", 1, 1, False), ("h", "p", 1, 1, False), ("p", "p", 2, None, True), ("p", "p", 2, None, None)], "type string, type_auto string, reading_order int, order_auto int, structure_edited boolean")
    assert [x.structure_edited for x in document.normalized_edits(b).collect()] == [False, True, True, False]


def test_page_html(spark):
    rows = [(0, "header", "run"), (1, "figure", ""), (2, "caption", "Cap"), (3, "caption", "Lone"), (4, "paragraph", " "), (5, "paragraph", "Text"), (6, "page_number", "7")]
    b = spark.createDataFrame([("p<1", o, o, t, x, None) for o, t, x in rows], "page string, reading_order int, pos int, type string, body string, crop_uri string")
    html = document.page_html(b, ["page"], "page").first().html
    assert html.split("\n") == [
        '<section class="page" data-page="p&lt;1">', '<figure class="figure-block"><div class="figure-missing">[figure]</div><figcaption class="caption">Cap</figcaption></figure>',
        '<figcaption class="caption">Lone</figcaption>', '<p class="paragraph">Text</p>', "</section>",
    ]
    assert "run" in document.page_html(b, ["page"], "page", False, False).first().html


def test_status(spark):
    e = spark.createDataFrame([("j", "page_001", "ocr", True), ("j", "page_001", "split", False)], "job_id string, page string, stage string, ok boolean").withColumn("status", document.stage_status(F.col("ok")))
    r = document.page_status(e, ["job_id", "page"]).first()
    assert (r.ocr, r.split, r.ingest) == ("ok", "unreadable", None)
    assert document.next_page(e).first().next_page == "page_002"


def test_frames(spark):
    f = spark.createDataFrame([(1, 0, 100, 5.0), (1, 1, 80, 9.0), (1, 2, 75, 9.0), (1, 3, 10, 99.0)], "k int, idx int, area int, sharpness double")
    assert [x.role for x in layout.partition_frames(f, ["k"]).orderBy("idx").collect()] == ["full", "base", "full", "closeup"]


def test_gutter_and_cut(spark):
    rows = [(i, 0 if 48 <= i <= 52 else 50, 100, 10, 100) for i in range(100)]
    p = spark.createDataFrame([("a", *r) for r in rows] + [("b", i, 50, 60 if i == 45 else 100, 10, 100) for i in range(100)] + [("c", i, 50, 100, 10, 100) for i in range(100)], "k string, x int, ink int, extent int, light int, width int")
    got = {x.k: (x.x, x.method) for x in layout.detect_gutter(p, ["k"]).collect()}
    assert got == {"a": (48, "ink"), "b": (45, "pinch"), "c": (None, "none")}
    i = spark.createDataFrame([("a", 100, 50, 48, 2), ("c", 100, 50, None, 1)], "k string, width int, height int, gutter int, margin int")
    assert [(x.k, x.subpage, tuple(x.box)) for x in layout.cut_pages(i).orderBy("k", "subpage").collect()] == [("a", "left", (0, 0, 50, 50)), ("a", "right", (46, 0, 54, 50)), ("c", "single", (0, 0, 100, 50))]


def test_figure_bands(spark):
    rows = [(1, 0, y, 1.0 if 45 <= y < 55 or y < 3 else 0.1, 100) for y in range(100)] + [(1, 1, y, 0.1, 100) for y in range(100)]
    r = spark.createDataFrame(rows, "page int, det int, y int, background double, height int")
    assert sorted((x.det, x.y, x.h) for x in layout.figure_bands(r, ["page", "det"]).collect()) == [(0, 3, 42), (0, 55, 45)]


def test_whole_page(spark):
    p = spark.createDataFrame([(1, 100, 200), (2, 100, 200)], "page int, page_w int, page_h int")
    b = spark.createDataFrame([(1, 0, "text", (1, 2, 3, 4), 0)], f"page int, block int, label string, bbox {BOX}, rank int")
    assert [(x.page, x.label, tuple(x.bbox)) for x in layout.whole_page(p, b, ["page"]).orderBy("page").collect()] == [(1, "text", (1, 2, 3, 4)), (2, "other", (0, 0, 100, 200))]


def test_pixels(spark):
    import numpy as np

    assert pixels.laplacian_variance(np.ones((5, 5))) == 0 and pixels.laplacian_variance(np.ones((2, 9))) == 0
    g = np.arange(6.0).reshape(2, 3)
    assert pixels.rotate(g, 90).tolist() == [[3, 0], [4, 1], [5, 2]] and pixels.crop(g, 9, 9, 2, 2).tolist() == [[0]]
    assert [len(t) for t in pixels.link_peaks([[10, 50], [11, 90], [12]], 3)] == [3, 1, 1]
    page = np.full((40, 60), 230.0)
    page[10:30, 20:22] = 20
    r = pixels.facts(spark.createDataFrame([(1, 40, 60, page.ravel().tolist())], "k int, height int, width int, pixels array<double>"), "k").first()
    assert r.sharpness > 0 and r.ink[20] == 20 and r.ink[5] == 0 and len(r.extent) == 60


def test_baselines_and_fit(spark):
    import numpy as np

    page = np.full((200, 360), 240.0)
    for top in (40, 90, 140):
        for x in range(360):
            y = top + round(6 * x / 360)
            page[y : y + 4, x] = 20
    lines = pixels.baselines(page)
    assert len(lines) == 3 and all(len(t) == 36 for t in lines)
    points = spark.createDataFrame([("p", k, x / 360, y / 200) for k, t in enumerate(lines) for x, y in t], "page string, line int, x double, y double")
    r = layout.fit_displacement(layout.displacement_terms(points, ["page"]), ["page"]).first()
    at = lambda x, y: sum(c * b for c, b in zip(r.coefficients, (1, x, x * x, x**3, y, y * x, y * x * x, y * y)))
    assert r.lines == 3 and (at(0.05, 0.5) - at(0.95, 0.5)) * 200 == pytest.approx(5.4, abs=1)
