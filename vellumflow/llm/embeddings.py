"""Operator 2, embedding near-duplicates by spherical k-means cells and blocked cosine products.

Exact copies are collapsed first. Only vectors of one label and dimension are compared; where these are
many, they have centres of their own, fitted on a bounded sample. Every vector has a home in the cell of its
nearest centre and visits each cell that a vector within the threshold of it could have for home. That is
decided by the plane between the two centres: a vector whose sine to the plane exceeds that of the
threshold's angle cannot have a near vector beyond it. So each link is met in the home cells of both ends,
no link is lost to a cell's border, and a vector counts its links in its home cell alone.

Cells are cut into blocks, those at home apart from the visitors, as two visitors have nothing to tell. A task holds
one block of those at home, or that and another block, in double precision: where visitors are many and those at home
are few, a vector travels once for each cell that it belongs to. Counts are summed, and of the links a spanning forest goes on to the components; pairs are not written anywhere."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import roots, written
from .components import components

#: Vectors of a cell that are aimed at, and the most centres of all labels together.
CELL, MOST_CENTRES = 8192, 16_384
#: Vectors that the centres are fitted on, at most: those with the smallest hashes.
SAMPLE = 4 * MOST_CENTRES
#: Vectors of a block; a product is of one block with another, a slice of SLICE rows at a time.
BLOCK, SLICE = 8192, 512
#: Cosines of vectors to centres that are held at once.
HELD = 1 << 21
#: Slack on the cells' borders for rounding.
SLACK = 1e-6


def unit(rows: list) -> np.ndarray:
    """Vectors at length 1, in double precision; scaled by the largest component first, as squares may overflow."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k unit centres of unit vectors; a cell that runs empty keeps its centre."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def visits(x: np.ndarray, centres: np.ndarray, sine: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each vector, and of each vector and centre whether the vector belongs to the cell or visits it."""
    near = x @ centres.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres[home] @ centres.T)))
    there = near[np.arange(len(x)), home][:, None] - near <= sine * apart + SLACK
    there[np.arange(len(x)), home] = True
    return home, there


def links(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component): for each row the rows linked with it directly, and the smallest id reachable.

    Rows link where labels are equal and not null, dimensions are equal and the cosine is at least
    ``threshold`` (0 or more). Null, empty and zero vectors, and those that hold a null or non-finite component, link
    with nothing: n_links 0, their own id as component. Rows that repeat link with one another. A null id
    keeps its row, counts as a partner, and has the smallest id of its component, or null. An empty table
    gives an empty table; other columns are not read."""
    spark = vectors.sparkSession
    v = F.col("v")
    fine = v.isNotNull() & (F.size("v") > 0) & F.col("label").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    # exact copies share a node, known by two hashes of label and vector; from then on by a number of its own
    rows = rows.select("id", "label", "v", F.coalesce(fine, F.lit(False)).alias("fine"))
    keys = F.xxhash64("label", "v").alias("key"), F.xxhash64(F.lit(1), "v", "label").alias("check")
    nodes = rows.filter("fine").select("id", "label", "v", *keys).groupBy("key", "check").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = written(nodes.withColumns({"size": F.size("v"), "node": F.monotonically_increasing_id()}), "nodes")
    alone = rows.filter("not fine").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))

    counts, forest = _compare(nodes, threshold)
    named = nodes.select("node", "key", "check", "weight", "least").join(counts, "node", "left").join(components(forest).withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    named = written(named.select("key", "check", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("group")), "labels")
    smallest = named.groupBy("group").agg(F.min("least").alias("component"))
    place = named.join(smallest, "group").select("key", "check", "n_links", "component")
    return rows.filter("fine").select("id", *keys).join(place, ["key", "check"]).select("id", "n_links", "component").union(alone)


def _centres(nodes: DataFrame) -> dict[tuple, np.ndarray]:
    """Centres by (label, size), of those alone that have more vectors than a cell: MOST_CENTRES at most, or one each."""
    large = written(nodes.groupBy("label", "size").agg(F.count("*").alias("n")).filter(F.col("n") > CELL), "large")
    n, k = large.agg(F.sum("n"), F.sum(F.ceil(F.col("n") / CELL))).first()
    if not n:
        return {}
    wanted = F.greatest(F.lit(1), F.floor(F.col("n") / CELL * min(1.0, MOST_CENTRES / k))).cast("int")
    mark = F.shiftrightunsigned(F.xxhash64("key", "check"), 1)
    # about twice the sample passes, however many vectors there are, so the sort stays small
    near = nodes.filter(mark <= F.lit(min(2**63 - 1, 2**63 * 2 * SAMPLE // n))).join(large.select("label", "size", wanted.alias("k")), ["label", "size"])
    sample = near.orderBy(mark, "key").limit(SAMPLE).select("label", "size", "k", "v")

    def fit(t: pa.Table) -> pa.Table:
        x = unit(t["v"].to_pylist())
        found = spherical_k_means(x, min(t["k"][0].as_py(), len(x)))
        first = t.select(["label", "size"]).take(pa.array(np.zeros(len(found), np.int64)))
        return first.append_column("centre", pa.array(found.tolist(), pa.list_(pa.float64())))

    kind = nodes.schema["label"].dataType.simpleString()
    got = sample.groupBy("label", "size").applyInArrow(fit, f"label {kind}, size int, centre array<double>").toArrow()  # SAMPLE / 4 rows at most
    centres: dict[tuple, list] = {}
    for label, size, centre in zip(*(got[c].to_pylist() for c in ("label", "size", "centre"))):
        centres.setdefault((label, size), []).append(centre)
    return {key: np.array(c) for key, c in centres.items()}


def _compare(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) of nodes with links to other nodes, and links (a, b) that connect the components."""
    held = nodes.sparkSession.sparkContext.broadcast(_centres(nodes))
    sine = math.sqrt(max(0.0, 1 - threshold * threshold))

    def place(batches):
        centres = held.value
        for b in batches:
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                groups.setdefault(key if key in centres else None, []).append(i)
            for key, rows in groups.items():
                step = max(1, HELD // len(centres[key])) if key else len(rows)
                for at in range(0, len(rows), step):
                    part = pa.array(rows[at : at + step])
                    if key:
                        home, there = visits(unit(b.column(3).take(part).to_pylist()), centres[key], sine)
                        i, c = np.nonzero(there)
                    else:  # few vectors of this label and dimension: one cell
                        i, c, home = np.arange(len(part)), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                    here = part.take(pa.array(i))
                    yield pa.record_batch([*(b.column(k).take(here) for k in range(3)), pa.array(c.astype(np.int32)), pa.array(home[i] == c)], ["node", "label", "size", "cell", "at_home"])

    kind = nodes.schema["label"].dataType.simpleString()
    cells = written(nodes.select("node", "label", "size", "v").mapInArrow(place, f"node bigint, label {kind}, size int, cell int, at_home boolean"), "cells")
    sizes = cells.groupBy("label", "size", "cell").agg(F.count_if("at_home").alias("homes"), F.count("*").alias("all")).filter("homes > 0")
    blocks = sizes.select("label", "size", "cell", F.ceil(F.col("homes") / BLOCK).cast("int").alias("hb"), F.when(F.col("all") <= BLOCK, 0).otherwise(F.ceil((F.col("all") - F.col("homes")) / BLOCK)).cast("int").alias("vb"))
    # blocks of those at home come first and meet all; blocks of visitors meet these alone; a small cell is one block
    lot, among = F.xxhash64("node", "cell"), F.col("at_home") | (F.col("vb") == 0)
    own = F.when(among, F.pmod(lot, "hb")).otherwise(F.col("hb") + F.pmod(lot, F.greatest("vb", F.lit(1)))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(among, F.col("hb") + F.col("vb")).otherwise(F.col("hb")) - 1))
    dealt = cells.join(blocks, ["label", "size", "cell"]).withColumn("own", own).withColumn("other", other)
    both = dealt.select("label", "size", "cell", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("c"), "own", "at_home", "node").join(nodes.select("node", "weight", "v"), "node")

    def product(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        own, r, c = t["own"].to_numpy(), t["r"][0].as_py(), t["c"][0].as_py()
        node, weight, home = (t[k].to_numpy() for k in ("node", "weight", "at_home"))
        x = unit(t["v"].to_pylist())
        a, b = np.nonzero(own == r)[0], np.nonzero(own == c)[0]
        found, ends = np.zeros(len(node), np.int64), []
        for k in range(0, len(a), SLICE):
            here = a[k : k + SLICE]
            near = x[here] @ x[b].T >= threshold
            near &= here[:, None] != b[None, :]
            found[here] += near @ weight[b]
            if r != c:
                found[b] += weight[here] @ near
            i, j = np.nonzero(near)
            label = roots(len(node), here[i], b[j])  # a forest of this slice
            m = np.nonzero(label != np.arange(len(node)))[0]
            ends.append((node[m], node[label[m]]))
        ends = [np.concatenate(e) for e in zip(*ends)] if ends else [np.empty(0, np.int64)] * 2
        some = np.nonzero(np.where(home, found, 0))[0]
        none = np.zeros(len(ends[0]), np.int64)
        return pa.table({"a": np.concatenate((node[some], ends[0])), "b": np.concatenate((node[some], ends[1])), "links": np.concatenate((found[some], none))})

    got = written(both.groupBy("label", "size", "cell", "r", "c").applyInArrow(product, "a bigint, b bigint, links bigint"), "products")
    return got.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), got.filter("links = 0").select("a", "b")
