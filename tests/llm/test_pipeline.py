import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from vellumflow.llm import mixing, packing, quality, queries, simhash, toxicity
from vellumflow.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, sf):
    found, docs = [queries.table(spark, sf, "documents")], None
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, found[-1], sf), name)
        found.append(docs)
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf, stages):
    docs, clean, good, single, mixed, packed = stages
    labels = queries.table(spark, sf, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "mixing", "packing"]
    assert all(x.columns == docs.columns for x in stages[:-1])
    assert ids(clean) == ids(toxicity.score(docs, labels).filter("predicted = 0").select("doc.*"))
    assert ids(good) == ids(quality.judge(clean, labels).filter("kept").select("doc.*"))
    assert ids(single) == ids(simhash.near_copies(good))
    copies = {r.doc.doc_id: r.copies for r in mixing.mix(single).collect()}
    assert ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    tokens = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    once = {r.id: r.n for r in packing.cut(single, queries.public_tokenizers.path("word_bpe_49k.json")).groupBy("id").agg(F.sum("length").alias("n")).collect()}
    assert tokens == {i: once[i] * n for i, n in copies.items() if n}


def test_run_is_the_stages(spark, sf, stages):
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    a, b = (sorted(map(tuple, x.select(cols).collect())) for x in (corpus_pipeline.run(spark, sf), stages[-1]))
    assert a == b and a


def test_stages_take_odd_documents(spark, sf, docs, empty):
    for start in (docs, empty):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, sf), name)
        assert now.count() >= 0
