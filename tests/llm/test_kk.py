import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumflow.llm import common, packing, sharding
from vellumflow.llm.differencing import difference, items

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_differencing_textbook():
    # two-way differencing of 8 7 6 5 4 leaves a difference of 2
    put = items(np.array([8, 7, 6, 5, 4]), 2)
    sums = np.bincount(put, [8, 7, 6, 5, 4])
    assert abs(sums[0] - sums[1]) == 2


def test_differencing_is_a_partition():
    rng = np.random.default_rng(1)
    for n, k in ((1, 3), (2, 3), (50, 8), (200, 7)):
        parts = rng.integers(0, 100, (n, k))
        slots = difference(parts)
        assert all(sorted(s) == list(range(k)) for s in slots.tolist())
    assert items(np.empty(0, np.int64), 4).size == 0
    sizes = rng.integers(1, 1000, 500)
    sums = np.bincount(items(sizes, 8), sizes)
    assert sums.max() - sums.min() <= 5


def plain_differencing(sizes, k):
    """Slot sums of Karmarkar-Karp differencing, by lists and a full search for the two largest spreads."""
    parts = [sorted([(s, [i])] + [(0, [])] * (k - 1), key=lambda p: -p[0]) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1][0] - p[0][0])
        a, b, *rest = parts
        parts = [*rest, sorted([(x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b))], key=lambda p: -p[0])]
    return parts[0]


def test_differencing_against_brute_force():
    rng = random.Random(3)
    for n, k in ((1, 2), (7, 2), (9, 4), (25, 3), (40, 8)):
        sizes = rng.sample(range(1, 10**9), n)  # no ties, so there is one right answer
        want, put = plain_differencing(sizes, k), items(np.array(sizes), k)
        got = sorted((sum(sizes[i] for i in range(n) if put[i] == s), sorted(i for i in range(n) if put[i] == s)) for s in range(k))
        assert got == sorted((total, sorted(members)) for total, members in want)


def test_windows_against_brute_force():
    """As many windows as the tokens need, and one more until none overflows."""
    rng = random.Random(4)
    for window in (100, 1000):
        lengths = rng.sample(range(1, window), 60) + [window] * 3
        rest, n = lengths[:60], -(-sum(lengths[:60]) // window)
        while max(total for total, _ in plain_differencing(rest, n)) > window:
            n += 1
        put = packing.windows(np.array(lengths), window)
        loads = sorted(np.bincount(put, lengths).astype(int).tolist())
        assert loads == sorted([total for total, _ in plain_differencing(rest, n)] + [window] * 3)


def test_rows_that_repeat_are_spread(spark):
    """One document in most rows: its pieces fill many blocks, its rows many buckets."""
    rows = [(7, 0, 5)] * 9000 + [(None, 0, 3)] * 3000
    got = packing.pack(spark.createDataFrame(rows, "id bigint, start bigint, length bigint")).select("id", "length", "offset", F.expr("sequence_id div 4294967296").alias("block")).collect()
    assert sorted(((r.id, r.length) for r in got), key=str) == sorted(((i, n) for i, _, n in rows), key=str)
    sizes = [sum(r.block == b for r in got) for b in {r.block for r in got}]
    assert len(sizes) == 6 and max(sizes) < 2 * min(sizes)
    docs = spark.createDataFrame([(7, "same")] * 3000, "doc_id bigint, text string")
    shards = sharding.shard(docs, 4).collect()
    assert len({r.shard for r in shards}) == 1 and sorted(r.slot for r in shards) == list(range(3000))


@pytest.mark.parametrize("block", [4096, 7])
def test_shard(docs, corpus, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK", block)
    rows = sharding.shard(docs, 8).collect()
    want = sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus if r[0] is not None)
    assert sorted((r.id, r.size, r.text_crc32) for r in rows if r.id is not None) == want and len(rows) == len(corpus)
    by_text: dict = {}
    for r in rows:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for k in range(8):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))


def test_shard_balance(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 400))) for _ in range(600)]
    rows = [(i, rng.choice(texts)) for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy("shard").sum("size").collect()
    sums = [r[1] for r in got]
    assert len(sums) == 8 and max(sums) - min(sums) <= 0.001 * sum(sums)


def test_shard_empty(empty):
    assert sharding.shard(empty).count() == 0


def test_word_ids_are_the_tokenizers():
    rng, t, w = random.Random(9), Tokenizer.from_file(PATH), packing.WordIds(PATH)
    letters = [*"abzIİıKéÉßΣσς'sdtll.,;:!?\u0301\u0307 \n\t\x1c\x85\xa0\u2003\u200d漢字😀1234\x01<|>&%…", "<|endoftext|>", "<|STARTOFTEXT|>", "don't", "I'M", "word,", "x" * 70]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", None]
    got = [x for k in range(0, len(texts), 50) for x in w.encode(pa.array(texts[k : k + 50]))]
    assert got == [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_cuts():
    assert packing.cuts(1, False) == [1] and packing.cuts(8192, True) == [4096, 4096] and packing.cuts(4100, False) == [4096, 4]
    for n in range(1, 9000, 97):
        assert sum(packing.cuts(n, True)) == n and all(packing.cuts(n, True))


@pytest.mark.parametrize("block", [2048, 9])
def test_pack_round_trip(docs, corpus, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    pieces = packing.cut(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), PATH)
    rows = packing.pack(pieces).collect()
    t = Tokenizer.from_file(PATH)
    for i, text, *_ in corpus:
        if i is None:
            continue
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4").tobytes()
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == ids
        assert all(r.doc_tokens == len(ids) // 4 for r in own) and [r.start for r in own] == np.cumsum([0, *[r.length for r in own][:-1]]).tolist()
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s][:-1]]).tolist() and sum(n for _, n in s) <= packing.WINDOW


@pytest.mark.parametrize("law, most", [("documents", 0.01), ("even", 0.05)])
def test_pack_padding(spark, law, most):
    """Lengths like those of documents leave little padding; lengths spread evenly up to a window are the hard case."""
    rng = random.Random(5)
    lengths = [min(20_000, 1 + int(rng.lognormvariate(6.4, 1.0))) if law == "documents" else rng.randint(1, 4095) for _ in range(3000)]
    rows = [(i, k, n) for i, tokens in enumerate(lengths) for k, n in enumerate(packing.cuts(tokens, i % packing.FINE == 0))]
    got = packing.pack(spark.createDataFrame(rows, "id bigint, start bigint, length bigint")).groupBy("sequence_id").sum("length").collect()
    assert 1 - sum(r[1] for r in got) / (4096 * len(got)) < most


def test_whole_windows_bypass_blocks(spark):
    """Windows of one long document, all of one block, are sequences of their own; their ids come along."""
    rows = [(1, 4 * k, 4, bytes([k]) * 16) for k in range(50)] * 2 + [(1, 200, 3, b"x" * 12), (2, 0, 1, b"y" * 4)]
    got = packing.pack(spark.createDataFrame(rows, "id bigint, start bigint, length bigint, ids binary"), 4).collect()
    assert sorted((r.id, r.start, r.length, bytes(r.ids)) for r in got) == sorted(rows)
    whole = [r for r in got if r.length == 4]
    assert len({r.sequence_id for r in whole}) == 100 and all(r.sequence_id < 0 and r.offset == 0 for r in whole)
    assert len({r.sequence_id for r in got if r.length < 4}) == 1 and {r.sequence_id for r in got if r.length < 4}.isdisjoint(r.sequence_id for r in whole)


def test_pack_odd_rows(docs, empty, corpus):
    assert packing.pack(packing.cut(empty, PATH)).count() == 0
    assert packing.pack(packing.cut(docs, PATH)).filter("start = 0").count() == len(corpus)


def held():
    """MB that this process has of its own."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read as Linux tells it")
def test_workers_that_pack_give_up_what_they_cut_with(spark, monkeypatch):
    rng = random.Random(21)
    texts = pa.array([" ".join(f"{rng.getrandbits(60):x}" for _ in range(1000)) for _ in range(150)])
    packing.word_ids(PATH).encode(texts)
    common.release_state()
    empty = held()
    packing.word_ids(PATH).encode(texts)
    assert held() > empty + 30
    # the very function that Spark would run on a block
    run = []
    monkeypatch.setattr(type(spark.range(1).groupBy()), "applyInArrow", lambda self, f, schema: run.append(f) or spark.createDataFrame([], schema))
    packing.pack(spark.createDataFrame([(1, 0, 5)], "id bigint, start bigint, length bigint"))
    t = run[0](pa.table({"id": [1, 2], "start": [0, 0], "length": [5, 4], "block": [0, 0]}))
    assert t["offset"].to_pylist() in ([0, 5], [4, 0]) and not common._STATE
    assert held() < empty + 20


def test_cutting_gives_back_memory_with_each_slice(spark, docs, monkeypatch):
    run, made = [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f) or self)
    packing.cut(docs, PATH)
    monkeypatch.setattr(pa, "default_memory_pool", lambda real=pa.default_memory_pool: made.append(1) or real())
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["a b", None, "c " * packing.TEXTS]), pa.array([False, True, False])], ["id", "text", "fine"])
    got = list(run[0]([batch]))
    assert len(got) == len(made) == 2 and sum(b.num_rows for b in got) > 3
