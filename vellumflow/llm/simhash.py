"""Operator 1, SimHash near-duplicates by pivot distance tables.

A chain of 65 reference fingerprints R_0 ... R_64, each differing from the one before in one bit, serves
as pivots. The distances of a fingerprint to the pivots of a stretch of the chain, less its distance to
the stretch's first pivot, tell the fingerprint's bits in that stretch and change with no others: two
fingerprints with equal relative distances there agree in those bits. (fingerprint AND the stretch's bits)
is that profile in its short form, and is what the search groups by.

Links within 2 bits: of 4 stretches of 16 bits, 2 at least hold none of the differing bits, so the
6 pairs of stretches find every such link. A group that is too large is cut further by the same rule over
the bits left, down to 8 free bits (256 fingerprints), so no group is unbounded and no pair is lost.
Wider radii have no such cover of useful size, so near copies by Jaccard similarity are first searched by
fingerprints like any others, and those that are further apart by their rarest shingles, as said at ``near_links``.

Inside a group, pairs are discarded by the largest difference of their distances to the pivots (the
triangle inequality bounds it by the distance), survivors are verified by their exact distance, and a
spanning forest of the links is passed on instead of the pairs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Buckets, Table, lower_words, release_state, roots, shuffle_partitions, tidy, written
from .components import components, nearby

SEED = 42
#: Rows of a group that are compared in one go; larger groups are cut by more of the chain.
GROUP_ROWS = 4096
#: Order of the bits along the chain of pivots, and the first pivot.
CHAIN = np.random.default_rng(20).permutation(64)
FIRST = np.uint64(0x9E3779B97F4A7C15)
#: Of the 65 pivots, those whose distances the filter compares.
PIVOTS = np.arange(4, 65, 4)


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of a text, in blocks, so that long texts need little memory."""
    if not words:
        return
    joined, f = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        yield np.array([f(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    for k in range(0, len(starts), 1 << 16):
        yield np.array([f(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist())], np.uint64)


def fingerprint(words: list[bytes], size: int) -> int:
    """The 64-bit SimHash as a signed integer; a text without words has 0."""
    return majority(shingle_hashes(words, size))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that more than half of all hashes have, as a signed integer; 0 of none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint): the signed 64-bit SimHash of every whole text's lower-cased word shingles.

    Null and wordless texts have fingerprint 0; fewer words than a shingle count as one shingle. Other
    columns are not read, ids may repeat or be null."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fingerprint(lower_words(x), shingle) for x in b.column(1).to_pylist()], pa.int64())], ["id", "fingerprint"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint bigint")


def bits_mask(positions) -> int:
    """The signed 64-bit mask of the bits at these places of the chain."""
    m = np.zeros(64, np.uint8)
    m[CHAIN[list(positions)]] = 1
    return int(np.packbits(m, bitorder="little").view(np.int64)[0])


def cover(fixed: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
    """Sets of places of the chain: the fixed ones and 2 of 4 stretches of the rest, in all 6 ways.

    Two fingerprints that agree at the fixed places and differ in 2 bits at most agree on one set."""
    left = [p for p in range(64) if p not in set(fixed)]
    parts = [left[k * len(left) // 4 : (k + 1) * len(left) // 4] for k in range(4)]
    return [tuple(sorted((*fixed, *a, *b))) for a, b in itertools.combinations(parts, 2)]


def pivot_distances(fp: np.ndarray) -> np.ndarray:
    """Hamming distances to the pivots of PIVOTS, a row for each fingerprint."""
    differs = np.unpackbits((fp.view(np.uint64) ^ FIRST).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, CHAIN]
    total = differs.sum(1, dtype=np.int16)
    # pivot k has the first k bits of the chain flipped, so there agreement counts as difference
    return (total[:, None] + np.cumsum(1 - 2 * differs.astype(np.int16), axis=1)[:, PIVOTS - 1]).astype(np.int16)


def close_pairs(group: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i < j of one group at most radius bits apart, with that distance. Rows are sorted by group."""
    table = pivot_distances(fp)
    i = np.arange(len(group))
    for step in itertools.count(1):
        i = i[i + step < len(group)]
        i = i[group[i] == group[i + step]]
        if not i.size:
            return
        keep = i
        for column in range(table.shape[1]):
            keep = keep[np.abs(table[keep, column] - table[keep + step, column]) <= radius]
            if not keep.size:
                break
        d = np.bitwise_count(fp[keep].view(np.uint64) ^ fp[keep + step].view(np.uint64))
        found = keep[d <= radius]
        if found.size:
            yield found, found + step, d[d <= radius]


def forest(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what the close pairs of each group connect: no more than rows."""
    label, held_i, held_j, held = np.arange(len(fp)), [], [], 0
    for i, j, _ in close_pairs(group, fp, radius):
        open_ = label[i] != label[j]
        held_i.append(i[open_])
        held_j.append(j[open_])
        held += int(open_.sum())
        if held > len(fp):
            i, j = np.concatenate(held_i), np.concatenate(held_j)
            label, held_i, held_j, held = roots(len(fp), np.concatenate((i, np.arange(len(fp)))), np.concatenate((j, label))), [], [], 0
    if held:
        label = roots(len(fp), np.concatenate((*held_i, np.arange(len(fp)))), np.concatenate((*held_j, label)))
    i = np.nonzero(label != np.arange(len(fp)))[0]
    return i, label[i]


def grouped(batches, link):
    """Feed runs of whole groups (mask, key, fp, name) to ``link``; a group may begin in one batch and end in another."""
    rest = None
    for b in itertools.chain(batches, [None]):
        now = np.empty((0, 4), np.int64) if b is None else np.stack([b.column(k).to_numpy() for k in range(4)], axis=1)
        if rest is not None:
            now = np.concatenate((rest, now))
        if not len(now):
            continue
        changed = np.nonzero((now[1:, 0] != now[:-1, 0]) | (now[1:, 1] != now[:-1, 1]))[0] + 1
        cut = len(now) if b is None else int(changed[-1]) if changed.size else 0
        rest = now[cut:]
        group = np.zeros(cut, np.int64)
        group[changed[changed < cut]] = 1
        group = np.cumsum(group)
        pairs = np.bincount(group, minlength=1)[group] > 1 if cut else np.empty(0, bool)
        rows = now[:cut][pairs]
        if len(rows):
            i, j = link(group[pairs], np.ascontiguousarray(rows[:, 2]))
            if len(i):
                yield pa.record_batch([pa.array(rows[i, 3]), pa.array(rows[j, 3])], ["a", "b"])


def search(fps: DataFrame, sets: list[tuple[int, ...]], finer, depth: int, link, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between names that ``link`` finds within the groups that agree on one of the sets of places.

    ``fps`` has fp and name, distinct names. Groups of more than ``group_rows`` rows are cut by the sets that
    ``finer`` makes of theirs, ``depth`` times at most."""
    spark, ready = fps.sparkSession, []
    mask = F.explode(F.array([F.lit(bits_mask(s)) for s in sets]).cast("array<bigint>"))
    rows = fps.select(mask.alias("mask"), "fp", "name").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp", "name")
    for level in range(depth + 1):
        if level == depth:
            ready.append(rows)
            break
        large = written(rows.groupBy("mask", "key").count().filter(F.col("count") > group_rows).select("mask", "key"), "large")
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, ["mask", "key"], "left_anti"))
        more = {s: finer(s) for s in sets}
        names = spark.createDataFrame([(bits_mask(s), [bits_mask(t) for t in ts]) for s, ts in more.items()], "mask bigint, finer array<bigint>")
        rows = rows.join(large, ["mask", "key"], "left_semi").join(names, "mask").select(F.explode("finer").alias("mask"), "fp", "name")
        rows = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp", "name").distinct()
        sets = [t for ts in more.values() for t in ts]
    found = None
    for r in ready:
        part = r.repartition(shuffle_partitions(spark), "mask", "key").sortWithinPartitions("mask", "key", "fp", "name").mapInArrow(lambda it: grouped(it, link), "a bigint, b bigint")
        found = part if found is None else found.union(part)
    return found


def exact_links(fps: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that connect what pairs of distinct fingerprints within 2 bits connect.

    ``fps`` has one column fp, without repeats. After two cuts 8 bits are free: 256 rows at most."""
    return search(fps.select("fp", F.col("fp").alias("name")), cover(), cover, 2, lambda g, fp: forest(g, fp, 2), group_rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component): documents whose fingerprints link at 2 or fewer differing bits.

    component is the smallest id reachable by links, a document's own included. One row is returned for
    each input row, repeated rows too. A null id keeps its row and takes the component of its fingerprint's
    group (null if no member has an id). An empty table gives an empty table; other columns are ignored,
    whatever their names."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = written(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("least")), "distinct")
    linked = components(exact_links(least.select("fp")))
    named = least.join(linked, least.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    named = written(named, "labels")
    smallest = named.groupBy("label").agg(F.min("least").alias("component"))
    place = named.join(smallest, "label").select("fp", "component")
    return rows.join(place, rows.fingerprint == place.fp).select("id", "fingerprint", "component")


#: Buckets by which it is told how frequent a shingle is, and how many of them one written row holds.
BUCKETS, PART = 1 << 18, 1 << 10
#: Shingles of buckets from this frequency on, and from so many times the mean, are spread before they are grouped.
HOT, HOT_TIMES, SPREAD = 4096, 8, 1024
#: Texts are held each against one other in rounds, as long as this share of them prove near.
FRUITFUL = 0.1
#: Texts of a shingle that are compared by steps, and the most that one task compares at once.
STEPS, CELL = 512, 4096
#: Bits of the parities that all texts have alike.
SIGN = 1024
#: Pairs of one text that are verified together.
CHUNK = 1024
#: Bytes of a hash that travel, its highest: 40 bits tell the shingles of two texts apart.
KEPT = 5
#: Room for rounding where a bound is reckoned in floating point.
ROUND = 1e-6


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    blocks = list(shingle_hashes(lower_words(text), size))
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)


def parity(hashes: np.ndarray) -> bytes:
    """Whether an odd number of a set's hashes falls on each of SIGN bits, or on at least twice as many as there are hashes."""
    bits = max(SIGN, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else SIGN
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """A parity over fewer bits, ``size`` bytes: halves fall on one another."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def apart(x: bytes, y: bytes) -> int:
    """The least number of elements that two sets with these parities do not share: each odd bit of the two together is one."""
    a, b, size = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), min(len(x), len(y))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def survey(texts: DataFrame, shingle: int) -> Table:
    """One table of two kinds of rows: (part, counts), how often the shingles of a part of the buckets stand in a task's
    texts, and (text_key, n, parity, sign, fp), the size, parity and fingerprint of each text's shingle set, the parity over
    SIGN bits too."""

    def run(batches):
        release_state()
        found = np.zeros(BUCKETS, np.int64)
        for b in batches:
            sizes, odd, signs, fps = [], [], [], []
            for x in b.column(1):
                s = shingle_set(x.as_py(), shingle)
                np.add.at(found, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                sizes.append(len(s))
                odd.append(parity(s))
                signs.append(folded(np.frombuffer(odd[-1], np.uint8), SIGN // 8).tobytes())
                fps.append(majority(s[k : k + (1 << 16)] for k in range(0, len(s), 1 << 16)))
            m = len(sizes)
            yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), b.column(0), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary()), pa.array(signs, pa.binary()), pa.array(fps, pa.int64())], names)
        parts = found.reshape(-1, PART)
        at = np.nonzero(parts.any(1))[0]
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array([parts[k].tobytes() for k in at], pa.binary()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()), *[pa.nulls(len(at), pa.binary())] * 2, pa.nulls(len(at), pa.int64())], names)

    names = ["part", "counts", "text_key", "n", "parity", "sign", "fp"]
    return Table(texts.select("text_key", "text").mapInArrow(run, "part bigint, counts binary, text_key bigint, n int, parity binary, sign binary, fp bigint"), "survey")


def close_texts(fps: DataFrame) -> Table:
    """(a, b): pairs of texts (text_key, fp) that connect all whose fingerprints link within 2 bits, as in ``exact_links``."""
    least = Table(fps.groupBy("fp").agg(F.min("text_key").alias("least")), "distinct")
    links = exact_links(least.df.select("fp")).distinct()
    for end in "ab":
        links = links.join(least.df.select(F.col("fp").alias(end), F.col("least").alias(f"least_{end}")).hint("merge"), end)
    alike = fps.join(least.df.hint("merge"), "fp").filter("text_key > least").select(F.col("text_key").alias("a"), F.col("least").alias("b"))
    found = Table(links.select(F.greatest("least_a", "least_b").alias("a"), F.least("least_a", "least_b").alias("b")).union(alike), "close")
    least.drop()
    return found


def frequencies(surveyed: DataFrame) -> np.ndarray:
    """In how many texts the shingles of each bucket of hashes stand."""

    def add(batches):
        sums = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    found = np.zeros((BUCKETS // PART, PART), np.int64)
    for r in surveyed.filter("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part bigint, counts binary").collect():  # BUCKETS counts
        found[r.part] = np.frombuffer(r.counts, np.int64)
    return found.ravel()


def prefixes(texts: DataFrame, often: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """(token, hot, name, n, pos): the rarest of each text's n different shingles, so many that near texts share one.

    All texts order their shingles alike, by their bucket's frequency and then by hash; pos is the place
    there. Two sets of that similarity have their first common shingle among these of both. The order
    decides how many pairs are met in vain, never which are found. hot tells tokens of very frequent buckets."""
    held = texts.sparkSession.sparkContext.broadcast(often)
    warm = max(HOT, HOT_TIMES * float(often.mean()))

    def run(batches):
        release_state()
        often = held.value
        for b in batches:
            rows, size = [], 0
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingle_set(text.as_py(), shingle)
                n = len(s)
                count = often[s & np.uint64(BUCKETS - 1)]
                order = np.lexsort((s, count))[: n - math.ceil(similarity * n - ROUND) + 1]
                token, hot = (s[order].view(np.int64), count[order] >= warm) if n else (np.zeros(1, np.int64), np.ones(1, bool))  # texts without words meet under 0
                m = len(token)
                rows.append((token, hot, np.full(m, name), np.full(m, n), np.arange(m)))
                size += m
                if size > 1 << 17:
                    yield pa.record_batch([pa.array(np.concatenate(c), t) for c, t in zip(zip(*rows), types)], names)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(np.concatenate(c), t) for c, t in zip(zip(*rows), types)], names)

    types, names = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()), ["token", "hot", "name", "n", "pos"]
    return texts.select("text_key", "text").mapInArrow(run, "token bigint, hot boolean, name bigint, n int, pos int")


def of_token(rows: DataFrame, any_hot: bool = True, **found) -> DataFrame:
    """rows with aggregates over their token's rows; those of hot tokens, if any, are combined before a join brings them back."""
    group = Window.partitionBy("token")
    plain = rows.filter("not hot").select("*", *[c.over(group).alias(k) for k, c in found.items()])
    if not any_hot:
        return plain
    hot = rows.filter("hot")
    return plain.unionByName(hot.join(hot.groupBy("token").agg(*[c.alias(k) for k, c in found.items()]).hint("merge"), "token"))


def may_link(n_a, pos_a, n_b, pos_b, similarity: float, least=np.minimum, most=np.maximum):
    """Whether sets that first meet at these places can be near: by their sizes, and by what is left to share."""
    fit = least(n_a, n_b) >= similarity * most(n_a, n_b) - ROUND
    return fit & (least(n_a - pos_a, n_b - pos_b) >= similarity / (1 + similarity) * (n_a + n_b) - ROUND)


def crossing(rows: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of all pairs that may link and do not carry one label, of whole cells (cell, role, label, name, n, pos, sign), sorted.

    Rows of role 0 are paired with one another, those of role 2 with those of role 1 of their cell."""
    (cell, role, label, name, n, pos), sign = rows.T[:6], rows[:, 6:].view(np.uint64)  # bits are counted of unsigned numbers alone

    def pairs(i, j):
        ok = (label[i] != label[j]) & may_link(n[i], pos[i], n[j], pos[j], similarity)
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(sign[i] ^ sign[j]).sum(1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + ROUND
        return name[i[ok]], name[j[ok]]

    group = np.cumsum(np.concatenate(([0], cell[1:] != cell[:-1])))
    size, alone = np.bincount(group), role == 0
    i = np.nonzero(alone & (size[group] <= STEPS))[0]
    for step in range(1, STEPS):
        i = i[i + step < len(rows)]
        i = i[(group[i] == group[i + step]) & alone[i + step]]
        if not i.size:
            break
        yield pairs(i, i + step)
    starts = np.cumsum(size) - size
    for g in np.nonzero((size > STEPS) | (np.bincount(group, ~alone) > 0))[0]:
        at = np.arange(starts[g], starts[g] + size[g])
        own, base, probes = (at[role[at] == k] for k in range(3))
        for k in range(len(own) if size[g] > STEPS else 0):
            yield pairs(np.full(len(own) - k - 1, own[k]), own[k + 1 :])
        for p in probes:
            yield pairs(np.full(len(base), p), base)


def crossings(batches, similarity: float):
    """Run ``crossing`` over batches sorted by cell; a cell may begin in one batch and end in another."""

    def of(rows):
        held, size = [], 0
        for a, b in crossing(rows, similarity):
            held.append((a, b))
            size += len(a)
            if size > 1 << 17:
                yield batch(held)
                held, size = [], 0
        if size:
            yield batch(held)

    def batch(held):
        a, b = (np.concatenate(c) for c in zip(*held))
        return pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    rest = []
    for b in batches:
        if not b.num_rows:
            continue
        signs = np.frombuffer(b"".join(b.column(6).to_pylist()), np.int64).reshape(b.num_rows, -1)
        now = np.concatenate((np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(6)], axis=1), signs), axis=1)
        changed = np.nonzero(now[1:, 0] != now[:-1, 0])[0] + 1
        if rest and rest[-1][-1, 0] != now[0, 0]:
            changed = np.concatenate(([0], changed))
        if changed.size:
            yield from of(np.concatenate((*rest, now[: changed[-1]])))
            rest, now = [], now[changed[-1] :]
        rest.append(now)
    if rest:
        yield from of(np.concatenate(rest))


def cells(rows: DataFrame, cell: int = CELL, any_hot: bool = True) -> DataFrame:
    """(cell, role, label, name, n, pos, sign): the rows (token, hot, label, name, n, pos, sign) dealt out for ``crossing``.

    The rows of a token are one cell, if they are ``cell`` at most. More are dealt into blocks; all that carry
    another label than most do are probes, dealt into blocks too, and each block of probes meets each of
    rows. Pairs within the commonest label need no test, and no cell holds much more than twice ``cell``."""
    sized = of_token(rows, any_hot, size=F.count("*"))
    columns = ["label", "name", "n", "pos", "sign"]
    small = sized.filter(F.col("size") <= cell).select(F.col("token").alias("cell"), F.lit(0).alias("role"), *columns)
    large = sized.filter(F.col("size") > cell)
    labels = large.groupBy("token", "label").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.sum("k").alias("k"), F.max("k").alias("most"))
    blocks = labels.select("token", "major", F.ceil(F.col("k") / cell).alias("nb"), F.greatest(F.lit(1), F.ceil((F.col("k") - F.col("most")) / cell)).alias("np"))
    met = large.join(blocks.hint("merge"), "token")
    lot = F.xxhash64("name", F.lit(-1))

    def dealt(role, own, others, own_first):
        here, there = F.pmod(lot, F.col(own)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(others) - 1))
        pair = ["own", "other"] if own_first else ["other", "own"]
        return lambda d: d.select("token", here.alias("own"), there.alias("other"), *columns).select(F.xxhash64("token", *pair).alias("cell"), F.lit(role).alias("role"), *columns)

    return small.union(dealt(1, "nb", "np", True)(met)).union(dealt(2, "np", "nb", False)(met.filter("label <> major")))


def near_links(texts: Buckets, shingle: int, similarity: float, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect what all pairs of texts (text_key, text) of that similarity connect.

    Texts whose fingerprints link within 2 bits are held against one another first, so that most copies fall together
    at once. Fingerprints of near texts may be further apart, so an exact search follows for what is not connected
    by then: texts that share none of their prefixes' shingles are not near. In rounds each text is held against one
    text of another component, that with which most of its shingles bring it together and which it was not held
    against before, so that copies fall together without pairing them all. When few texts find a near one in
    that way, every pair is tested that shares such a shingle and is not yet connected. No group is cut. The
    parities of two sets bound from below how far they are apart, which discards most pairs that are not near
    where they meet; what is left is verified by the whole sets."""
    surveyed = survey(texts.df, shingle)
    found = prefixes(texts.df, frequencies(surveyed.df), shingle, similarity)
    # hot tokens are spread, so that none is sorted in one task; that they are shared is taken for granted
    group = Window.partitionBy("token", F.when(F.col("hot"), F.pmod(F.xxhash64("name"), F.lit(SPREAD))))
    found = found.select("*", F.min("name").over(group).alias("lo"), F.max("name").over(group).alias("hi"))
    found = found.filter("hot or lo < hi").drop("lo", "hi")
    signs = surveyed.df.filter("part is null").select("text_key", "n", "parity", "sign", "fp")

    def near(batches):
        for b in batches:
            ok = [apart(x, y) <= (1 - similarity) / (1 + similarity) * (n + m) + ROUND for n, x, m, y in zip(*(b.column(k).to_pylist() for k in range(2, 6)))]
            yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def as_sets(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                sets = [shingle_set(x.as_py(), shingle).view(np.uint8).reshape(-1, 8)[:, 8 - KEPT :].tobytes() for x in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(sets, pa.binary())], ["b", "chunk", "hashes"])

    def verify(batches):
        last, own = None, np.empty(0, np.uint64)
        for b in batches:
            ok = []
            for a, text, other in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if a != last:
                    last, own = a, shingle_set(text.as_py(), shingle) >> np.uint64(64 - 8 * KEPT)
                ok.append(jaccard(own, unpacked(other.as_py())) >= similarity)
            yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verify_into(links: Table | None, met: Table) -> Table:
        pairs = met.df
        for end in "ab":
            one = signs.select(F.col("text_key").alias(end), F.col("n").alias(f"n_{end}"), F.col("parity").alias(f"p_{end}"))
            pairs = pairs.join(one.hint("merge"), end)
        left = Table(pairs.select("a", "b", "n_a", "p_a", "n_b", "p_b").mapInArrow(near, "a bigint, b bigint"), "survivors")
        # a text that many are held against goes out in chunks, to where the others are
        chunks = left.df.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        dealt = left.df.join(chunks.hint("merge"), "b").select("a", "b", F.pmod(F.xxhash64("a"), "chunks").alias("chunk"))
        wanted = chunks.join(texts.df.hint("merge"), F.col("b") == F.col("text_key")).select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "text")
        sent = dealt.join(wanted.mapInArrow(as_sets, "b bigint, chunk bigint, hashes binary").hint("merge"), ["b", "chunk"])
        both = sent.join(texts.df.hint("merge"), F.col("a") == F.col("text_key")).select("a", "b", "text", "hashes").mapInArrow(verify, "a bigint, b bigint")
        if links is None:
            links = Table(both, "links")
        else:
            links.append(both)
        left.drop()
        return links

    def labelled(rows: DataFrame, links: Table) -> Table:
        """Labels need not tell all that is connected, but whatever shares one is."""
        place = nearby(links.df)
        again = rows.join(place.df.withColumnRenamed("node", "name").hint("merge"), "name", "left").withColumn("label", F.coalesce("component", "name")).drop("component")
        again = Table(again, "open")
        place.drop()
        return again

    tried = close_texts(signs.select("text_key", "fp"))
    links = verify_into(None, tried)
    open_ = labelled(found, links)
    any_hot = not open_.df.filter("hot").isEmpty()
    tidy(texts.spark)
    rounds, near_before = 0, links.df.count()
    while True:
        own = F.struct("label", F.xxhash64("name", F.lit(rounds)).alias("lot"), "name", "n", "pos")
        ends = of_token(open_.df, any_hot, lo=F.min(own), hi=F.max(own)).filter("lo.label < hi.label")
        to = F.when(F.col("lo.label") != F.col("label"), F.col("lo")).otherwise(F.col("hi"))
        pairs = ends.withColumn("to", to).filter(may_link(F.col("n"), F.col("pos"), F.col("to.n"), F.col("to.pos"), similarity, F.least, F.greatest))
        pairs = pairs.groupBy(F.col("name").alias("a"), F.col("to.name").alias("b")).agg(F.count("*").alias("shared"))
        pairs = pairs.join(tried.df.union(tried.df.select("b", "a")).hint("merge"), ["a", "b"], "left_anti")
        met = Table(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", F.xxhash64("b", F.lit(rounds)))).alias("b")), "candidates")
        links = verify_into(links, met)
        again = labelled(open_.df.drop("label"), links)
        open_.drop()
        one, none = F.lit(1), F.lit(0)
        asked, found = met.df.select(one.alias("asked"), none.alias("found")).union(links.df.select(none, one)).agg(F.sum("asked"), F.sum("found")).first()
        open_, rounds = again, rounds + 1
        if (found or 0) - near_before <= FRUITFUL * (asked or 0):
            break
        near_before = found
        tried.append(met.df)
        met.drop()
        tidy(texts.spark)
    # now all that is connected is told, and tokens whose texts are have nothing more to tell
    place = components(links.df).select(F.col("node").alias("name"), "component")
    told = open_.df.drop("label").join(place.hint("merge"), "name", "left").withColumn("label", F.coalesce("component", "name")).drop("component")
    again = Table(of_token(told, any_hot, lo=F.min("label"), hi=F.max("label")).filter("lo < hi").drop("lo", "hi"), "open")
    open_.drop()
    open_ = again
    tidy(texts.spark)
    rows = open_.df.join(signs.select(F.col("text_key").alias("name"), "sign").hint("merge"), "name")
    last = cells(rows, cell, any_hot).repartition(shuffle_partitions(texts.spark), "cell").sortWithinPartitions("cell").mapInArrow(lambda it: crossings(it, similarity), "a bigint, b bigint")
    last = Table(last.distinct(), "candidates")
    links = verify_into(links, last)
    for t in (open_, surveyed, met, last, tried):
        t.drop()
    return links.df


def unpacked(packed: bytes) -> np.ndarray:
    """Hashes from their KEPT highest bytes."""
    x = np.zeros((len(packed) // KEPT, 8), np.uint8)
    x[:, :KEPT] = np.frombuffer(packed, np.uint8).reshape(-1, KEPT)
    return x.view(np.uint64).ravel()


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted shingle sets; two empty ones are alike."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) + len(y) else 1.0


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, cell: int = CELL) -> DataFrame:
    """One document of each group of near copies, with all its columns.

    Texts are near copies if the Jaccard similarity of their sets of lower-cased word shingles is
    ``similarity`` or more; groups are what such links connect. Fingerprints and their pivot distances find most, an
    exact search by the shingles themselves the rest (see ``near_links``). Of a group the smallest id stays (a null id
    only if there is no other), and of rows that repeat it, one. Null texts count as empty, and texts without
    words are copies of one another. Different texts whose 64-bit hashes clash are told apart by a second one, and
    each stays, compared with equal texts alone. An empty table gives an empty table; other columns stay as
    they are, whatever their names."""
    tidy(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, check = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    texts = docs.select(key.alias("text_key"), check.alias("check"), text.alias("text")).groupBy("text_key")
    texts = Buckets(texts.agg(F.first("text").alias("text"), F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo = hi").select("text_key", "text"), "texts", "text_key")
    # joins are by sorting whatever the sizes, so the plan, and what it needs, is the same at any scale
    groups = Table(components(near_links(texts, shingle, similarity, cell)), "groups")
    texts.drop()
    tidy(docs.sparkSession)
    # a group keeps its smallest (id, text); ids that are null come last
    counts = docs.select(F.col(id_col).alias("id"), key.alias("text_key"), check.alias("check")).groupBy("text_key", "check", "id").agg(F.count("*").alias("rows"))
    best = counts.groupBy("text_key", "check").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "check", "rows")).alias("best"))
    best = best.join(groups.df, F.col("text_key") == F.col("node"), "left").select(F.coalesce("component", "text_key").alias("label"), F.when(F.col("component").isNull(), F.col("check")).alias("own"), "best")
    kept = written(best.groupBy("label", "own").agg(F.min("best").alias("k")).select(F.col("k.id").alias("kept_id"), F.col("k.text_key").alias("kept_key"), F.col("k.check").alias("kept_check"), F.col("k.rows").alias("rows")), "kept")
    groups.drop()
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), key.alias("text_key"), check.alias("check"))
    rows = rows.join(kept.hint("merge"), (F.col("text_key") == F.col("kept_key")) & (F.col("check") == F.col("kept_check")) & F.col("id").eqNullSafe(F.col("kept_id")))
    if kept.filter("rows > 1").isEmpty():
        return rows.select("doc.*")
    # rows that repeat the kept id and text: any one of them; only these are brought together
    return rows.filter("rows = 1").select("doc.*").union(rows.filter("rows > 1").dropDuplicates(["text_key", "check"]).select("doc.*"))
