from pyspark.sql import functions as F

from vellumflow.functions import captions, geometry, scalars, text


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def boxes(spark, rows):
    return spark.createDataFrame([(i, dict(zip("xywh", b))) for i, b in enumerate(rows)], "i int, b struct<x:int,y:int,w:int,h:int>")


def test_hyphens(spark):
    r = one(spark, text.join_hyphenated(F.lit("encyclo-\npedia")), text.join_hyphenated(F.lit("anti-\ndis-\nestablishment")), text.join_hyphenated(F.lit("a-\nb-\nc")), text.join_hyphenated(F.lit("те-\nкст")))
    assert tuple(r) == ("encyclopedia", "antidisestablishment", "abc", "текст")


def test_tokenize(spark):
    r = one(spark, text.tokenize(F.lit("")), text.tokenize(F.lit("  \n ")), text.tokenize(F.lit(" a  b-\nc ")))
    assert tuple(r) == ([], [], ["a", "bc"])


def test_token_forms(spark):
    r = one(spark, text.normalize_token(F.lit("Più, 3Ёж!")), text.anchor_tokens(F.lit("clinostra- tificazioni")), text.anchor_tokens(F.lit("A lato: Figura 20!")), text.has_cyrillic(F.lit("abж")), text.has_cyrillic(F.lit("abc")))
    assert tuple(r) == ("pi3ёж", ["clinostratificazioni"], ["a", "lato", "figura", "20"], True, False)


def test_escape_and_uri(spark):
    r = one(spark, text.escape_html(F.lit("<a href=\"x\">&'")), text.data_uri(F.lit(b"\x00" * 100)))
    assert r[0] == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert "\n" not in r[1] and r[1].startswith("data:image/png;base64,AAAA")


def test_formats(spark):
    none = F.lit(None).cast("double")
    r = one(spark, text.percent(F.lit(0.256)), text.percent(none), text.three_places(F.lit(0.5)), text.signed_tau(F.lit(0.5)), text.signed_tau(none))
    assert tuple(r) == ("25.6%", "—", "0.500", "+0.50", "n/a")


def test_iou(spark):
    b = boxes(spark, [(0, 0, 100, 50), (0, 0, 100, 100), (300, 300, 10, 10)])
    r = {(x.i, x.j): (x.iou, x.c, x.g) for x in b.alias("a").crossJoin(b.alias("o")).select(F.col("a.i"), F.col("o.i").alias("j"), geometry.iou(F.col("a.b"), F.col("o.b")).alias("iou"), geometry.contained(F.col("a.b"), F.col("o.b")).alias("c"), geometry.edge_gap(F.col("a.b"), F.col("o.b")).alias("g")).collect()}
    assert r[0, 1] == (0.5, 1.0, 0.0)
    assert r[0, 2][0] == 0.0 and abs(r[0, 2][2] - (200**2 + 250**2) ** 0.5) < 1e-9


def test_word_box(spark):
    r = one(spark, geometry.scaled_back(F.lit(200), F.lit(400), F.lit(60), F.lit(40), F.lit(2)), geometry.scaled_back(F.lit(5), F.lit(5), F.lit(0), F.lit(0), F.lit(1)))
    assert tuple(r[0]) == (100, 200, 30, 20) and tuple(r[1]) == (5, 5, 1, 1)


def test_running_matter_and_clamp(spark):
    rows = boxes(spark, [(0, 10, 10, 10), (0, 2900, 10, 10), (0, 1500, 10, 10)]).select(geometry.running_matter(F.col("b"), F.lit(3000)).alias("k"), geometry.clamped(F.col("b"), F.lit(100), F.lit(3000)).alias("c")).collect()
    assert [x.k for x in rows] == ["header", "page_number", "other"]
    assert tuple(rows[0].c) == (0, 7, 13, 16)


def test_polygon(spark):
    r = one(spark, geometry.of_polygon(F.expr("array(named_struct('x', 3.0D, 'y', 1.0D), named_struct('x', 1.0D, 'y', 5.0D))")))
    assert tuple(r[0]) == (1.0, 1.0, 3.0, 5.0)


def caption(spark, value, lang="ita"):
    return one(spark, captions.parse_caption(F.lit(value), F.lit(lang)))[0]


def test_captions(spark):
    c = caption(spark, "In questa pagina: Figura 25 | La Maiolica…")
    assert (c.number, c.prefix, c.residual, c.keyword) == (25, "In questa pagina", "La Maiolica…", "figura")
    for value in ("come si vede (fig. 28) nel testo", "1) primo", "figurano tre cose", "figurative 3 cose", "", "Figura 1234"):
        assert caption(spark, value) is None
    assert caption(spark, "Fig. 12 x", "eng").number == 12
    assert caption(spark, "Abb. 7 x", "german").number == 7
    assert caption(spark, "Фиг. 9 x", "bg").number == 9
    assert caption(spark, "figura 5", "eng") is None
    assert caption(spark, "Figura 5", "xx+ita").number == 5


def test_figure_numbers(spark):
    r = one(spark, *[captions.figure_number(F.lit(x)) for x in ("26", " 25 ", "Fig. 27", "si vede 26 qui", "")])
    assert tuple(r) == (26, 25, 27, None, None)


def test_votes(spark):
    cases = [("25,2,25,2", 25), ("25", None), ("25,27,25,2", None), ("3,3,3,3", 3), ("3,3,5,5", None), ("26,26,2,6", 26), ("0,0,0,0", None), ("100,100,100,100", None)]
    r = one(spark, *[captions.vote_label(F.split(F.lit(x), ",")) for x, _ in cases])
    assert list(r) == [y for _, y in cases]


def test_languages(spark):
    r = one(spark, captions.lang_code(F.lit(" English ")), captions.lang_code(F.lit("Klingon")), captions.resolve_language(F.lit("german+en"), "ita"), captions.resolve_language(F.lit(None).cast("string"), "ita"))
    assert tuple(r) == ("eng", "klingon", "deu+eng", "ita")


def test_retry_and_sizes(spark):
    r = one(spark, *[scalars.retry_delay(F.lit(k)) for k in (1, 2, 5, 6, 60)], scalars.closeup_side(F.lit(100), F.lit(0.5)), scalars.closeup_side(F.lit(1), F.lit(0.01)))
    assert tuple(r) == (500, 1000, 8000, 8000, 8000, 71, 1)


def test_names(spark):
    r = one(spark, scalars.valid_job_id(F.lit("a-B_1")), scalars.valid_job_id(F.lit("a\n")), scalars.valid_job_id(F.lit("../x")), scalars.page_number(F.lit("page_012")), scalars.page_name(F.lit(1000)), scalars.frame_name(F.lit(3), F.lit(".jpg")))
    assert tuple(r) == (True, False, False, 12, "page_1000", "frame_03.jpg")


def test_parameters(spark):
    null = F.lit(None)
    r = one(spark, scalars.rails(null.cast("double"), F.lit(80.0), F.lit(40.0)), scalars.resolve_mode(null.cast("string"), F.lit("patch")), scalars.job_mode(F.lit('{"mode":"patch"}')), scalars.job_mode(F.lit('{"mode":"x"}')))
    assert tuple(r[0]) == (0.1, 40.0, 80.0) and tuple(r)[1:] == ("patch", "patch", "flag")


def test_orientation(spark):
    i, d = F.lit(None).cast("int"), F.lit(None).cast("double")
    r = one(
        spark, scalars.orientation(F.lit(-90), i, d, i, d, F.lit(1), F.lit(2)), scalars.orientation(i, F.lit(180), F.lit(1.0), i, d, F.lit(1), F.lit(2)),
        scalars.orientation(i, i, d, F.lit(90), F.lit(1.9), F.lit(3), F.lit(2)), scalars.orientation(i, i, d, i, d, F.lit(1), F.lit(2)),
    )
    assert [(x.method, x.rotate, x.warnings) for x in r] == [("hint", 270, []), ("baseline", 180, []), ("none", 0, ["osd_low_conf", "landscape"]), ("none", 0, ["osd_unavailable"])]
