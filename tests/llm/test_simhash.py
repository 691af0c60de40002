import random

import numpy as np
import pytest
import xxhash

from vellumflow.llm import queries, simhash
from vellumflow.llm.common import lower_words, roots
from vellumflow.llm.components import components, nearby


def brute_fingerprint(text, size):
    ws = lower_words(text)
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    n, f = len(fps), np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
    return roots(n, i, j)


def test_near_duplicates_against_brute_force(docs, corpus):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    fps = [brute_fingerprint(r[1], 3) for r in corpus]
    label = brute_components(fps, 2)
    want = {}
    for (i, *_), fp, c in zip(corpus, fps, label):
        ids = [corpus[k][0] for k in range(len(corpus)) if label[k] == c and corpus[k][0] is not None]
        want[i] = (fp, min(ids) if ids else None)
    assert all((r.fingerprint & (1 << 64) - 1, r.component) == want[r.id] for r in got)


def test_empty_and_clashing(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c d", 5, "x", 7)], "doc_id bigint, text string, fp bigint, id string, component int")
    assert simhash.near_duplicates(odd).first().component == 1
    assert simhash.near_copies(odd).columns == odd.columns
    assert simhash.near_copies(empty).count() == 0


@pytest.mark.parametrize("group_rows", [4096, 3])
def test_links_are_complete(spark, group_rows):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for base in list(fps)[:20]:
        for _ in range(10):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.exact_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), group_rows)
    at = {x: i for i, x in enumerate(signed)}
    pairs = [(at[r.a], at[r.b]) for r in links.collect()]
    got = roots(len(fps), *(np.array(x, int) for x in zip(*pairs)))
    assert (got == brute_components(fps, 2)).all()


def test_cover_and_pivots():
    rng = np.random.default_rng(0)
    assert all(any(not set(s) & {int(a), int(b)} for s in simhash.cover()) for a, b in (rng.choice(64, 2, replace=False) for _ in range(200)))
    fp = rng.integers(-(2**63), 2**63 - 1, 50)
    d = simhash.pivot_distances(fp)
    pivots = []
    p = int(simhash.FIRST)
    for k in range(1, 65):
        p ^= 1 << int(simhash.CHAIN[k - 1])
        pivots.append(p)
    want = [[((int(x) & (1 << 64) - 1) ^ pivots[k - 1]).bit_count() for k in simhash.PIVOTS] for x in fp]
    assert (d == np.array(want)).all()


def shingles(text, n=5):
    ws = lower_words(text)
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if len(ws) >= n else {tuple(ws)}


def test_near_copies_against_brute_force(docs, corpus):
    sets = [shingles(r[1]) for r in corpus]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = roots(len(corpus), *(np.array(x) for x in zip(*pairs)))
    want = []
    for c in set(label.tolist()):
        ids = [corpus[k][0] for k in range(len(corpus)) if label[k] == c]
        want.append(min((x for x in ids if x is not None), default=None))
    got = [r.doc_id for r in simhash.near_copies(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def same_groups(spark, texts, **settings):
    sets = [shingles(t) for t in texts]
    at, jac = {}, np.zeros((len(texts), len(texts)), int)
    for i, x in enumerate(sets):
        for g in x:
            at.setdefault(g, []).append(i)
    for rows in at.values():
        jac[np.ix_(rows, rows)] += 1
    n = jac.diagonal()
    label = roots(len(texts), *np.nonzero(jac >= 0.8 * (n[:, None] + n[None, :] - jac)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(r.doc_id for r in simhash.near_copies(docs, **settings).collect())
    assert got == sorted({int(x) for x in label})
    return len(got)


def family(rng, base, rows, own):
    """Texts that share ``base`` but for a run of ``own`` words of their own, at a place that all have in common."""
    return [" ".join(base[:50] + [f"w{rng.getrandbits(40)}" for _ in range(own)] + base[50 + own :]) for _ in range(rows)]


def test_parity_bounds_from_below():
    rng = np.random.default_rng(8)
    for n in (0, 1, 3, 40, 700, 5000):
        for m in (1, 30, 900):
            both = np.unique(rng.integers(0, 2**63, n + 2 * m).astype(np.uint64))
            x, y = both[: n + m], np.concatenate((both[:n], both[n + m :]))
            least = simhash.apart(simhash.parity(x), simhash.parity(y))
            assert least <= len(np.setxor1d(x, y)) and least == simhash.apart(simhash.parity(y), simhash.parity(x))
    assert simhash.apart(simhash.parity(both), simhash.parity(both)) == 0
    # sets far apart are told so
    x, y = (np.unique(rng.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(2))
    assert simhash.apart(simhash.parity(x), simhash.parity(y)) > 0.2 / 1.8 * 1000


def test_packed_hashes():
    x = np.unique(np.random.default_rng(9).integers(0, 2**63, 100).astype(np.uint64)) | np.uint64(1 << 63)
    packed = x.view(np.uint8).reshape(-1, 8)[:, 8 - simhash.KEPT :].tobytes()
    assert (simhash.unpacked(packed) == x >> np.uint64(24)).all() and len(simhash.unpacked(b"")) == 0


@pytest.mark.parametrize("cell", [4096, 16])
def test_cells_lose_no_pair(spark, cell):
    """Tokens with more rows than a cell: every pair of different labels that may link is met, none is missed."""
    rng, draw = random.Random(12), np.random.default_rng(12)
    bases = [draw.integers(0, 2**63, 130).astype(np.uint64) for _ in range(4)]
    rows, sets = [], {}
    for t, m in ((1, 300), (2, 90), (3, 5), (4, 1)):
        for k in range(m):
            own = np.unique(np.concatenate((bases[k % 4][: 100 + rng.randint(0, 30)], draw.integers(0, 2**63, rng.randint(0, 12)).astype(np.uint64))))
            name = 1000 * t + k
            sets[name] = own
            sign = simhash.folded(np.frombuffer(simhash.parity(own), np.uint8), simhash.SIGN // 8).tobytes()
            rows.append((t, t == 1, rng.choice([0, 0, 0, 0, t, k]), name, len(own), rng.randint(0, 20), sign))
    df = spark.createDataFrame(rows, "token bigint, hot boolean, label bigint, name bigint, n int, pos int, sign binary")
    dealt = simhash.cells(df, cell)
    assert cell == 4096 or dealt.groupBy("cell").count().agg({"count": "max"}).first()[0] < 6 * cell
    met = dealt.repartition(3, "cell").sortWithinPartitions("cell").mapInArrow(lambda it: simhash.crossings(it, 0.8), "a bigint, b bigint")
    got = {(r.a, r.b) for r in met.collect()}
    meet = {(max(x[3], y[3]), min(x[3], y[3])) for x in rows for y in rows if x[0] == y[0] and x[2] != y[2] and simhash.may_link(x[4], x[5], y[4], y[5], 0.8)}
    assert got <= meet and all(simhash.jaccard(sets[a], sets[b]) < 0.8 for a, b in meet - got)
    assert len(got) < 0.5 * len(meet)


def test_template_does_not_hide_near_copies(spark):
    """Texts of one template that are no copies crowd around pairs that are."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(300)]
    texts = family(rng, base, 400, 40)
    for t in texts[:60]:
        ws = t.split()
        ws[200:205] = [f"v{rng.getrandbits(40)}" for _ in range(5)]
        ws[250:255] = [f"v{rng.getrandbits(40)}" for _ in range(5)]
        texts.append(" ".join(ws))
    rng.shuffle(texts)
    assert same_groups(spark, texts) == 400 == same_groups(spark, texts, cell=32)


def test_large_family(spark):
    """A family above 4096 different texts, with pairs apart from it that share most of its text."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for k in range(4200):
        ws = list(base)
        ws[rng.randrange(200)] = f"w{k}"
        texts.append(" ".join(ws))
    for k in range(80):
        ws = [f"x{k}.{i}" for i in range(60)] + base[60:]
        texts += [" ".join(ws), " ".join([*ws[:-1], f"y{k}"])]
    # two of the family share 186 of 206 shingles at least, one of it and one apart about half
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.near_copies(docs).collect()) == [0, *range(4200, 4360, 2)]


def test_long_texts_at_the_limit(spark):
    """Pairs of texts of 2000 words just above and just below the similarity."""
    rng, texts = random.Random(5), []
    for k in range(40):
        ws = [f"t{k}.{i}" for i in range(2004)]
        texts.append(" ".join(ws))
        # of 2000 shingles so many at the end are new: 1778 of 2222 are common, or 1777 of 2223
        new = 222 if k % 2 else 223
        texts.append(" ".join(ws[: 2004 - new] + [f"u{k}.{rng.getrandbits(40)}.{i}" for i in range(new)]))
    assert same_groups(spark, texts) == 60


def test_all_pairs_at_the_limit_are_met(spark):
    """Pairs of two with similarities from 0.8 to 0.9, whose fingerprints may be far apart."""
    texts = []
    for k in range(600):
        ws = [f"t{k}.{i}" for i in range(104)]
        new = 6 + k % 6
        texts += [" ".join(ws), " ".join(ws[: 104 - new] + [f"u{k}.{i}" for i in range(new)])]
    assert same_groups(spark, texts) == 600


def test_text_hashes_that_clash(spark, monkeypatch):
    """Texts of one 64-bit hash are no copies: each stays, its exact copies go."""
    real = simhash.F.xxhash64
    monkeypatch.setattr(simhash.F, "xxhash64", lambda *c: simhash.F.lit(7).cast("bigint") if len(c) == 1 and not isinstance(c[0], str) else real(*c))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z"), (3, "a b c d e f"), (4, None)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.near_copies(docs).collect()) == [1, 2, 4]


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    links += links[:5] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    ends = [(a, b) for a, b in links if a is not None and a != b]
    label = roots(301, *(np.array(x) for x in zip(*ends)))
    assert got == {n: label[n] for n in {x for e in ends for x in e}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    near = {r.node: r.component for r in nearby(spark.createDataFrame(links, "a bigint, b bigint")).df.collect()}
    assert all(label[c] == label[n] and c < n for n, c in near.items())


def test_query(spark, sf):
    r = queries.op1_simhash_near_dedup(spark, sf).collect()
    docs = {x.doc_id: x.text for x in queries.table(spark, sf, "documents").collect()}
    assert len(r) == len(docs) and all(x.fingerprint == f"{brute_fingerprint(docs[x.doc_id], 3):016x}" for x in r)


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """The stage's first candidates are by fingerprints, through the pivot distances, and connect all within 2 bits."""
    rng = np.random.default_rng(4)
    fps = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = np.concatenate([fps, fps[:20] ^ 1, fps[:10] ^ np.int64(6), fps[:5], fps[5:8] ^ 7]).tolist()
    found = simhash.close_texts(spark.createDataFrame(list(enumerate(fps)), "text_key bigint, fp bigint")).df.collect()
    i, j = (np.array(x, int) for x in zip(*((r.a, r.b) for r in found)))
    assert roots(len(fps), i, j).tolist() == brute_components([f & (1 << 64) - 1 for f in fps], 2).tolist()

    asked, search = [], simhash.exact_links
    monkeypatch.setattr(simhash, "exact_links", lambda fps, *args: asked.append(fps.count()) or search(fps, *args))
    words = [f"w{k}" for k in rng.integers(0, 999, 400)]
    rows = [(k, " ".join(words[:-1] + [f"end{k}"])) for k in range(4)] + [(9, "quite another text of some words")]
    assert sorted(r.doc_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == [0, 9]
    assert len(asked) == 1 and 2 <= asked[0] <= len(rows)
