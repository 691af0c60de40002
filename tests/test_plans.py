import pytest
from pyspark.sql import functions as F

from vellumflow.operators import spatial
from vellumflow.plans import assemble, evaluate, queries, schemas

BOX = "struct<x:int,y:int,w:int,h:int>"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_and_oracle(spark, sf, name):
    import duckdb

    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    assert rows or name == "nms"
    if name in queries.ORACLES:
        c = duckdb.connect()
        for t in ("documents", "benchmark", "conversations", "pages", "events", "embeddings", "labels", "part", "region", "nation"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        want = c.sql(queries.ORACLES[name]).select(*[f'"{x}"' for x in columns]).fetchall()

        def norm(r):
            return tuple(round(x, 9) if isinstance(x, float) else int(x) if isinstance(x, bool) else x for x in (float(v) if type(v).__name__ == "Decimal" else v for v in r))

        assert sorted(map(norm, rows), key=str) == sorted(map(norm, want), key=str)


def test_nms_and_orders_by_brute_force(spark, sf):
    """Every block of a page has one rank, without gaps."""
    for q in (queries.xy_cut_exact, queries.reading_rows):
        bad = q(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).filter("n <> d or m <> n - 1")
        assert bad.count() == 0


def test_evaluate(spark):
    w = spark.createDataFrame([("i", k, 1, 1, 1, t, c) for k, (t, c) in enumerate([("the", 95.0), ("cot", 20.0), ("sat", 90.0)])], "image_id string, pos int, block_num int, par_num int, line_num int, text string, conf double")
    t = spark.createDataFrame([("i", "the cat sat")], "image_id string, text string")
    m = spark.createDataFrame([("i", "eng"), ("j", "eng")], "image_id string, lang string")
    r = {x.image_id: x for x in evaluate.evaluate_images(w, t, m).collect()}
    assert r["i"].wer == pytest.approx(1 / 3) and r["i"].auroc == 1.0 and r["j"].wer is None and not r["j"].has_gt
    s = evaluate.summarized(evaluate.evaluate_images(w, t, m), "lang").first()
    assert s.images == 2 and s.wer == pytest.approx(1 / 3)
    p = evaluate.two_labels(w, t).first()
    assert p.auroc_seq == p.auroc_bag == 1.0 and p.accuracy_seq == pytest.approx(2 / 3)


def test_layout_text(spark):
    b = spark.createDataFrame([(1, 0, (500, 0, 400, 900), 1000, 1000), (1, 1, (0, 0, 400, 900), 1000, 1000)], f"page int, block int, bbox {BOX}, page_w int, page_h int")
    w = spark.createDataFrame([(1, 0, 0, "right", (510, 10, 50, 10)), (1, 1, 1, "left", (10, 10, 50, 10)), (1, 2, 2, "below", (10, 950, 50, 10))], f"page int, pos int, line int, token string, box {BOX}")
    r = evaluate.layout_text(w, b, ["page"]).first()
    assert (r.text, r.n_orphans) == ("left\nright\nbelow", 1)


def test_grade(spark):
    t = spark.createDataFrame([(1, "P1", "paragraph", 0, "uno due", None), (1, "C1", "caption", 1, "Figura 5 mare", None), (1, "F1", "figure", 2, None, (0, 0, 100, 100))], f"page int, gt string, type string, ord int, anchor string, bbox {BOX}")
    f = spark.createDataFrame([(1, 0, "paragraph", 0, (0, 200, 9, 9), "uno due tre", [1, 2]), (1, 1, "paragraph", 1, (0, 300, 9, 9), "Figura 5 mare blu", [3]), (1, 2, "figure", 2, (0, 0, 90, 100), "5", [])], f"page int, block int, type string, rank int, bbox {BOX}, text string, native_ranks array<int>")
    r = evaluate.grade(t, f, ["page"]).first()
    assert (r.seg_recall, r.type_acc, r.tau, r.tau_native, r.n_captions, r.n_pairs) == (1.0, 1.0, 1.0, 1.0, 1, 1)


def test_attach_and_assemble(spark):
    w = spark.createDataFrame([(1, 0, 1, 1, 1, (110, 110, 10, 10), 120.0), (1, 1, 2, 1, 1, (800, 800, 10, 10), 50.0)], f"page int, pos int, block_num int, par_num int, line_num int, box {BOX}, conf double")
    b = spark.createDataFrame([(1, 0, (0, 0, 400, 400))], f"page int, block int, bbox {BOX}")
    routed = spatial.route(w, b, ["page"])
    lost = w.join(routed.filter("block is null").select("page", "pos"), ["page", "pos"]).select("page", "pos", "block_num", "par_num", "box.*")
    orphans = spatial.orphan_blocks(lost, ["page"], ["block_num", "par_num"])
    got = assemble.attach_words(w, b, routed, orphans, ["page"]).orderBy("pos").collect()
    assert [(x.block, x.conf, x.line) for x in got] == [(0, 100.0, 0), (1, 50.0, 1)]

    key = "doc_id string, spread string, subpage string"
    pages = spark.createDataFrame([("d", "p1", "left", 10, 20, "eng", "flag", "a/p1.png"), ("d", "p2", "single", 10, 20, "bul", "patch", None)], f"{key}, width int, height int, language string, mode string, image_asset string")
    blocks = spark.createDataFrame([("d", "p1", "left", 1, "paragraph", (0, 0, 1, 1), 1), ("d", "p1", "left", 0, "title", (0, 0, 1, 1), 0)], f"{key}, block int, type string, bbox {BOX}, reading_order int")
    words = spark.createDataFrame([("d", "p1", "left", 1, 1, "b", (0, 0, 1, 1), 9.0, "patch", 0, True), ("d", "p1", "left", 1, 0, "a", (0, 0, 1, 1), 9.0, "keep", 0, None)], f"{key}, block int, word int, text string, bbox {BOX}, conf double, decision string, line int, disagree boolean")
    patches = spark.createDataFrame([("d", "p1", "left", 1, 1, "x.png")], f"{key}, block int, word int, asset string")
    settings = spark.createDataFrame([("d", None, None, False, None, ["A"])], "doc_id string, target_language string, order_mode string, strip_running_headers boolean, strip_page_numbers boolean, fonts array<string>")
    whole = assemble.documents(pages, blocks, words, patches, settings)
    d = whole.first()
    assert [x.page_id for x in d.pages] == ["p1__left", "p2__single"] and [x.type for x in d.pages[0].blocks] == ["title", "paragraph"]
    assert [(x.text, x.patch_asset, x.text_ocr, x.engine_disagree) for x in d.pages[0].blocks[1].words] == [("a", None, "a", False), ("b", "x.png", "b", True)]
    assert d.settings.source_language == "bul" and len(d.warnings) == 2 and d.pages[0].blocks[0].words == [] and d.pages[1].blocks == []
    assert (d.schema_version, d.settings.order_mode, d.settings.strip_running_headers, d.settings.strip_page_numbers, d.settings.fonts) == ("1.0", "auto", False, True, ["A"])
    edited = spark.createDataFrame([("d", True)], "document_id string, has_edits boolean")
    assert assemble.guard(whole, edited).count() == 0 and assemble.guard(whole, edited, True).count() == 1
    # what is assembled is what is read: one shape
    again = whole.select(F.to_json(F.struct(*[c for c in whole.columns if c != "warnings"])).alias("j")).select(F.from_json("j", schemas.DOCUMENT).alias("d")).select("d.*")
    assert again.first() == whole.drop("warnings").first() and [(f.name, f.dataType) for f in again.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], schemas.DOCUMENT).schema]


def test_jobs(spark):
    j = spark.createDataFrame([("b", "flag"), ("a", "patch")], "job_id string, mode string")
    assert [x.job_id for x in assemble.job_rows(j).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="no such mode"):
        assemble.job_rows(spark.createDataFrame([("b", "zap")], "job_id string, mode string")).collect()
