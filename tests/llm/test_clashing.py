"""Columns beside the ones that an operator reads, named as its own inner ones are, change nothing."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vellumflow.llm import embeddings, lattice, mixing, packing, quality, sharding, simhash, toxicity, urls, warc
from vellumflow.llm.common import crc_mod, written

INNER = (
    "id doc text_key label name token n pos size hash known class held_out row word block start length ids sequence_id offset doc_tokens fingerprint component kept score toxic side gram copies "
    "target threshold host path rule verdict check key weight node v g crc shard slot bucket lot rows own k rank part fine candidates hits bloom tail sums n_words whole rest a b"
).split()
WORDS = public_tokenizers.path("word_bpe_49k.json")


def clashing(df):
    """The table with all these columns, text and binary by turns."""
    return df.withColumns({c: F.lit("x") if i % 2 else F.lit(b"y") for i, c in enumerate(INNER) if c not in df.columns})


def same(make, df, *columns):
    def rows(d):
        return sorted((str(tuple(r)) for r in make(d).select(*columns).collect()))

    want = rows(df)
    assert want and rows(clashing(df)) == want


@pytest.fixture(scope="module")
def small(spark):
    texts = [None, "", "one", *[" ".join(f"w{(i * k) % 17}" for k in range(5 + i * 4)) for i in range(24)]]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts + texts[5:8])]
    return spark.createDataFrame(rows + rows[:2] + [(None, "no id", None, None, 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(26)], "doc_id bigint, quality int, toxic int")


def test_documents(small, marks):
    same(simhash.near_duplicates, small, "id", "fingerprint", "component")
    same(simhash.near_copies, small, "doc_id", "text", "source")
    same(lambda d: lattice.score(d, public_tokenizers.path("piece_bpe_32k.model"), crc_mod("doc_id", 5) == 1), small, "id", "held_out", "n_tokens", "n_known", F.round("score", 6).alias("score"))
    same(sharding.shard, small, "id", "size", "text_crc32", "shard")
    same(lambda d: toxicity.score(d, marks), small, "doc.doc_id", F.round("score", 9).alias("score"))
    same(lambda d: quality.judge(d, marks), small, "doc.doc_id", "n_words", "kept", F.round("score", 9).alias("score"))
    same(mixing.mix, small, "doc.doc_id", "size", "target", "copies")
    same(lambda d: packing.pack(packing.cut(d, WORDS)), small, "id", "start", "length", "ids")


def test_vectors_and_pages(spark):
    rows = [(i, [float(i % 4), 1.0, float(i % 3)], i % 2) for i in range(40)] + [(41, None, 1), (42, [1.0], None)]
    same(embeddings.links, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), "id", "n_links", "component")
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.net/p{i}", f"<p>{i % 5}") for i in range(20)] + [(None, None, None)], "page_id bigint, url string, html string")
    listed = spark.createDataFrame([("net", "/p1", "block")], "host string, path string, verdict string")
    same(lambda d: urls.judge(d, listed), pages, "id", "host", "path", "rule", "verdict")
    same(lambda d: warc.pages_of(warc.read(d.sparkSession, warc.write(d))), pages, "id", "payload_digest", "record_type", "refers_to")


def test_stages(spark, small, marks, tmp_path):
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing(small)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, str(tmp_path)), name)
        assert after.columns == docs.columns
    assert stage(spark, docs, str(tmp_path)).count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
