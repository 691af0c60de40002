import json
import os

import pytest
from pyspark.sql import functions as F

from vellumflow.plans import chain, schemas
from vellumflow.sources import sinks, tables
from vellumflow.streaming import gate, queue

FRAME = "device string, sharpness double, stability double, timestamp_ms bigint"


def frames(times, good=True):
    return [("d", 50.0 if good else 1.0, 1.0, t) for t in times]


@pytest.mark.parametrize("settings, times, want", [({"needed": 3, "interval_ms": 400}, [0, 1000, 2000], ["none", "none", "capture"]), ({"needed": 1, "interval_ms": 100}, [0, 50, 120], ["capture", "none", "capture"]), ({"needed": 1, "interval_ms": 100, "burst": 3}, [0, 100, 200, 300], ["capture"] * 3 + ["finalize"])])
def test_gate(spark, settings, times, want):
    got = gate.gate_batch(spark.createDataFrame(frames(times), FRAME), **settings).orderBy("timestamp_ms").collect()
    assert [x.action for x in got] == want


def test_gate_fails_and_closes():
    g = gate.Gate(needed=1)
    assert [g.on_frame(50, 1, 0), g.on_frame(1, 1, 10), g.on_frame(1, 1, 20)] == ["capture", "finalize", "none"]
    assert g.on_frame(float("nan"), 1, 30) == "none"


def test_gate_stream_is_the_batch(spark, tmp_path):
    rows = [("d", 50.0, 1.0, t * 200) for t in range(8)] + [("d", 1.0, 1.0, 1700)] + [("e", 50.0, 1.0, t * 90) for t in range(9)]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):  # later files hold later frames
        part = sorted(rows, key=lambda r: r[3])[k * 6 : (k + 1) * 6]
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("device", "sharpness", "stability", "timestamp_ms"), r))) for r in part))
        os.utime(source / f"{k}.json", (k + 1e9, k + 1e9))  # files are taken up by age
    settings = {"needed": 2, "interval_ms": 300, "burst": 2}
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).json(str(source))
    q = gate.gate_stream(stream, **settings).writeStream.format("memory").queryName("gate_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("gate_out").collect()))
    assert got == sorted(map(tuple, gate.gate_batch(spark.createDataFrame(rows, FRAME), **settings).collect()))


def test_scores(spark):
    rows = spark.createDataFrame([("d", [1, 2, 3], 0), ("d", [2, 2, 5], 1), ("d", [1], 2)], "device string, luma array<int>, timestamp_ms bigint")
    got = [x.stability for x in gate.score_frames(rows).orderBy("timestamp_ms").collect()]
    assert got == [1.7976931348623157e308, 1.0, 1.7976931348623157e308]


def test_queue(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, (event, page) in enumerate([("e1", "page_001"), ("e2", "bad"), ("e1", "page_001")]):
        (source / f"{k}.json").write_text(json.dumps({"event_id": event, "job_id": "j", "page": page, "ts": "2024-01-01T00:00:00"}))

    def run(batch):
        checked = F.when(F.col("page") == "bad", F.raise_error(F.lit("cannot read"))).otherwise(True)
        return batch.select("job_id", "page", checked.alias("ok"))

    for _ in range(2):  # a restart repeats nothing
        queue.run_pages(queue.page_events(spark, str(source)), run, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.schema("job_id string, page string, ok boolean, error string").json(str(tmp_path / "out")).collect()
    assert sorted((x.page, x.ok) for x in got) == [("bad", False), ("page_001", True)]


def test_tsv(spark):
    rows = ["level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext", "1\t1\t0\t0\t0\t0\t0\t0\t10\t10\t-1\t", "5\t1\t1\t1\t1\t1\t5\t6\t40\t9\t96.5\t Hi ", "5\t1\t1\t1\t1\t2\t5\t6\t7\t9\t91\t\"q", "5\t1\t1\t1\t1\t3\t5\t6\t7\t9\t90\t ", "5\t1\t1\t1\t1\t4\t5\t6\t7\t9\t-1\tx"]
    lines = spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "file string, line int, value string")
    got = tables.parse_tsv(lines, ["file"], "line", "value").orderBy("pos").collect()
    assert [(x.text, x.conf, x.width) for x in got] == [("Hi", 96.5, 40), ('"q', 91.0, 7)]


def test_tsv_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("5\t1\t1\t1\t1\t1\t5\t6\t40\t9\t96.5\tHi\r\n5\t1\t1\t1\t1\t2\t5\t6\t40\t9\t90\tyou\n")
    assert [x.text for x in tables.words_tsv(spark, str(tmp_path)).orderBy("pos").collect()] == ["Hi", "you"]


def test_osd(spark):
    r = spark.range(1).select(tables.parse_osd(F.lit("Rotate: 90\nOrientation confidence: 3.5\nRotate: 180\n")).alias("a"), tables.parse_osd(F.lit("Rotate: x")).alias("b")).first()
    assert tuple(r.a) == (180, 3.5) and tuple(r.b) == (None, None)


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text('image_id,file,language,gt_file,category,notes\na,a.jpg,english,,"x,y","say ""hi"""\n')
    r = tables.manifest(spark, str(tmp_path / "m.csv")).first()
    assert (r.category, r.notes, r.gt_file) == ("x,y", 'say "hi"', None)
    (tmp_path / "g.json").write_text('{"_doc": "x", "spreads": {"a": {"gutter_x": 5, "tol": 2}}}')
    assert tuple(tables.gutter_truth(spark, str(tmp_path / "g.json")).first()) == ("a", 5, 2, False)
    (tmp_path / "w.txt").write_text("Uno due, uno\n")
    assert sorted(x.token for x in tables.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["due", "uno"]
    (tmp_path / "geo.txt").write_text("1\tСофия\tSofia\tSofija,Средец град\n2\tX\n")
    assert [x.token for x in tables.gazetteer(spark, str(tmp_path / "geo.txt")).collect()] == sorted(["София", "Средец", "град"])
    b = {"image_id": "i", "subpages": {"left": {"page_number": 1, "reading_order": [{"order": 0, "id": "P1", "type": "paragraph", "anchor": "x", "bbox": [1, 2, 3, 4]}]}}}
    (tmp_path / "b.json").write_text(json.dumps(b))
    assert tables.block_truth(spark, str(tmp_path / "b.json")).first().gt == "P1"


def test_captures(spark, tmp_path):
    for n in ("b.JPG", "a.dng", "c.txt", "d.png"):
        (tmp_path / n).write_bytes(b"x")
    got = tables.captures(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(x.path.rsplit("/", 1)[1], x.frame, x.skipped) for x in got] == [("a.dng", 0, True), ("b.JPG", 1, False), ("d.png", 2, False)]


def test_lexicon(spark):
    lex = spark.createDataFrame([("word",), ("Paris",)], "token string")
    got = {x.token: x.known for x in tables.in_lexicon(spark.createDataFrame([("word",), ("paris",), ("",), ("zzz",)], "token string"), lex).collect()}
    assert got == {"word": True, "paris": True, "": False, "zzz": False}
    c = spark.createDataFrame([(0, "a", False), (1, "b", True), (2, "c", True)], "ord int, path string, usable boolean")
    assert tables.first_usable(c).first().path == "b" and tables.first_usable(c.filter("ord = 0")).count() == 0


def test_documents_round_trip(spark, tmp_path):
    doc = {"schema_version": "1.0", "document_id": "d", "job_id": "d", "pages": [{"page_id": "p", "blocks": [{"id": 0, "type": "paragraph", "words": [{"text": "a", "conf": 90.0}]}]}]}
    path = str(tmp_path / "docs")
    d = spark.createDataFrame([json.dumps(doc)], "string").select(F.from_json("value", schemas.DOCUMENT).alias("d")).select("d.*")
    sinks.save_documents(d, path)
    sinks.save_documents(d.withColumn("schema_version", F.lit("1.1")), path)
    assert tables.documents(spark, path, True).first().schema_version == "1.1" and tables.documents(spark, f"{path}.bak", True).first().schema_version == "1.0"
    got = tables.documents(spark, path, True).first()
    assert got.settings.asDict() == {"source_language": "eng", "target_language": None, "uncertainty_mode": "flag", "order_mode": "auto", "strip_running_headers": True, "strip_page_numbers": True, "fonts": []}
    assert got.pages[0].blocks[0].words[0].engine == "tesseract" and got.pages[0].blocks[0].order_confirmed is False
    assert schemas.words_of(tables.documents(spark, path, True)).first().text == "a" and schemas.blocks_of(tables.documents(spark, path, True)).first().type == "paragraph"


def test_a_save_that_died(spark, tmp_path):
    """Whatever a dead run left, the next one finds a whole document."""
    path = str(tmp_path / "docs")
    one, two = (spark.createDataFrame([(v, "d")], "schema_version string, document_id string") for v in ("1", "2"))
    sinks.save_documents(one, path)
    two.write.json(f"{path}.new")
    (tmp_path / "docs").rename(tmp_path / "docs.bak")  # died between the renames
    sinks.recover(spark, path)
    assert tables.documents(spark, path, True).first().schema_version == "2"
    (tmp_path / "docs").rename(tmp_path / "docs.bak2")
    (tmp_path / "docs.new").mkdir()  # died while writing: no mark of success
    sinks.recover(spark, path)
    assert tables.documents(spark, path, True).first().schema_version == "1"


def test_affix_rules(spark, tmp_path):
    (tmp_path / "a.aff").write_text("FLAG long\nPFX Aa Y 1\nPFX Aa 0 re .\nSFX Bb Y 2\nSFX Bb y ied [^aeiou]y\nSFX Bb 0 ed/Cc [^y]\nSFX Xx N 1\nSFX Xx 0 er .\n")
    (tmp_path / "a.dic").write_text("4\nwork/AaBb\ntry/Bb\nplay/XxAa\nplain\n")
    forms = tables.hunspell(spark, str(tmp_path / "a.dic"), str(tmp_path / "a.aff"))
    assert sorted(r.token for r in forms.collect()) == sorted(["work", "rework", "worked", "reworked", "try", "tried", "play", "player", "replay", "plain"])
    assert tables.lexicon_works(forms, "tried").first().ok and not tables.lexicon_works(forms, "replayer").first().ok and tables.lexicon_works(forms, "").first().ok


def test_stage_results(spark, tmp_path):
    doc = {"source": "s", "mode": "flag", "threshold": 50.0, "counts": {"keep": 1}, "pages": [{"name": "left.png", "width": 5, "blocks": [{"id": 0, "type": "title", "words": []}], "patches": [{"file": "p", "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}}]}]}
    (tmp_path / "resolved.json").write_text(json.dumps(doc))
    r = tables.stage_results(spark, str(tmp_path / "resolved.json"), "resolved").first()
    assert (r.mode, r.counts, r.pages[0].blocks[0].type, r.pages[0].patches[0].bbox.h) == ("flag", {"keep": 1}, "title", 4)
    for ddl in (v for k, v in vars(schemas).items() if k.isupper() and isinstance(v, str) and " " in v):
        assert spark.createDataFrame([], ddl).columns


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("eng", 1, None)], "lang string, n int, wer double")
    for _ in range(2):
        sinks.append_report(sinks.report_lines(rows, "T", ["lang", "n", "wer"]), str(tmp_path / "r"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "r")).collect()]
    assert len(lines) == 8 and lines[3] == "| eng | 1 | — |"
    assert sinks.as_json(rows).first().json == '{"lang":"eng","n":1}'


def test_chain(spark, tmp_path):
    def bad():
        raise ValueError("no")

    out = chain.run_stages(spark, "p", [("a", lambda: ["w"]), ("b", bad), ("c", lambda: None)])
    r = chain.summary(out).first()
    assert (r.ok, r.failed_stage, r.n_stages, r.n_warnings) == (False, "b", 2, 1)
    assert chain.resolve_params({"a": 1, "b": 2}, {"s": {"b": 3, "zz": 1}}, "s") == {"a": 1, "b": 3}
    assert chain.load_config(tmp_path / "none.json") == {}


def test_stage_json(spark):
    r = spark.range(1).select(tables.warnings_of(F.lit('{"warnings":["x"]}')).alias("a"), tables.warnings_of(F.lit("broken")).alias("b"), tables.ocr_language(F.lit('{"params":{"language":"bul"}}')).alias("c"), tables.ocr_language(F.lit("{}")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (["x"], [], "bul", "eng")
