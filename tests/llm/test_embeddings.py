from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrame

from vellumflow.llm import embeddings
from vellumflow.llm.common import roots

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ok = [i for i, (_, v, l) in enumerate(rows) if l is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    pairs = []
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    pairs.append((a, b))
    i, j = (np.array(x, int) for x in zip(*pairs)) if pairs else (np.empty(0, int),) * 2
    label, n = roots(len(rows), i, j), np.bincount(i, minlength=len(rows))
    out = []
    for k, r in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[k] and rows[m][0] is not None]
        out.append((r[0], int(n[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (base * rng.uniform(0.1, 5) + rng.normal(size=16) * 0.12).tolist(), int(k % 3)))
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], None), (902, None, 1), (903, [0.0] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [float("nan")] + [1.0] * 15, 1), (906, [float("inf")] + [1.0] * 15, 1), (907, [], 1), (908, [1.0, 2.0], 1), (909, [2.0, 4.0], 1), (910, [3e38] * 16, 2), (911, [1e-40] * 16, 2), (None, rows[4][1], rows[4][2])]
    return rows + [rows[5], rows[5]]


@pytest.mark.parametrize("cell, block", [(4096, 2048), (5, 4)])
def test_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors()
    got = sorted(((r.id, r.n_links, r.component) for r in embeddings.links(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_nothing_to_compare(spark):
    assert embeddings.links(spark.createDataFrame([], VECTORS)).count() == 0
    assert [tuple(r) for r in embeddings.links(spark.createDataFrame([(1, None, 1)], VECTORS)).collect()] == [(1, 0, 1)]


def test_every_near_vector_visits(spark):
    """The border rule: whatever the centres, a vector visits the home of all vectors within the threshold."""
    rng = np.random.default_rng(8)
    x = embeddings.unit(rng.normal(size=(300, 6)).tolist())
    y = embeddings.unit((x + rng.normal(size=x.shape) * 0.05).tolist())
    home, _ = embeddings.visits(x, c := embeddings.unit(rng.normal(size=(20, 6)).tolist()), np.sqrt(1 - 0.98**2))
    _, there = embeddings.visits(y, c, np.sqrt(1 - 0.98**2))
    near = (x * y).sum(1) >= 0.98
    assert near.sum() > 100 and there[np.arange(300), home][near].all()


def test_visitors_do_not_meet(spark, monkeypatch):
    """A visitor goes to the blocks of those at home in a cell, not to those of other visitors, however many there are."""
    monkeypatch.setattr(embeddings, "CELL", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=24).tolist(), 1) for k in range(600)]
    rows += [(600 + k, [c * 2 + 0.01 for c in rows[k][1]], 1) for k in range(50)]
    plans, written = {}, embeddings.written

    def counted(df, name):
        if name == "products":  # what the products' groups are handed
            plans["rows"] = df._jdf.queryExecution().analyzed().children().apply(0)
        return written(df, name)

    monkeypatch.setattr(embeddings, "written", counted)
    got = sorted(((r.id, r.n_links, r.component) for r in embeddings.links(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    assert got == brute(rows)
    handed = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plans["rows"]), spark).select("cell", "node", "at_home").collect()
    homes, visits = {}, Counter((r.cell, r.node) for r in handed if not r.at_home)
    for r in handed:
        if r.at_home:
            homes.setdefault(r.cell, set()).add(r.node)
    assert visits and all(n <= -(-len(homes[cell]) // 40) for (cell, _), n in visits.items())
