import functools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumflow.llm import mixing, quality, queries, toxicity, urls
from vellumflow.llm.common import crc_mod

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 if i % 5 == 0 else 0) for i in range(60)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], LABELS)


class Plain:
    """Kneser-Ney over shorter contexts, by dictionaries, from the distinct grams of both classes."""

    def __init__(self, seen):
        self.levels = []
        while len(next(iter(seen))) > 1:
            counts = {}
            for g in seen:
                counts[g[1:]] = counts.get(g[1:], 0) + 1
            values = list(counts.values())
            one, two = values.count(1), values.count(2)
            self.levels.append((counts, one / (one + 2 * two) if one and two else 0.5))
            seen = set(counts)
        self.floor = 1 / (len(seen) + 1)

    def probability(self, gram):
        p = self.floor
        for length, (counts, d) in enumerate(reversed(self.levels), 1):
            g = gram[-length:]
            own = {x: n for x, n in counts.items() if x[:-1] == g[:-1]}
            if own:
                p = (max(own.get(g, 0) - d, 0) + d * len(own) * p) / sum(own.values())
        return p


def kn_brute(counts, plain, gram):
    """Interpolated Kneser-Ney of one class, straight from the definition."""
    values = list(counts.values())
    one, two = values.count(1), values.count(2)
    d = one / (one + 2 * two) if one and two else 0.5
    h = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
    p = plain.probability(gram)
    return (max(counts.get(gram, 0) - d, 0) + d * len(h) * p) / sum(h.values()) if h else p


def learnt(toxic, ordinary):
    every = sorted(set(toxic) | set(ordinary))
    codes = toxicity.code_points("".join(every)).reshape(-1, toxicity.ORDER)
    return every, toxicity.ratios(codes, *(np.array([float(c.get(g, 0)) for g in every]) for c in (toxic, ordinary)))


def test_ratios_are_kneser_ney():
    toxic = dict(toxicity.gram_counts({"bad": 3, "bag": 1, "cab": 2, "\x00é": 1}))
    ordinary = dict(toxicity.gram_counts({"dab": 5, "bad": 1, "cab": 2, "😀": 2}))
    plain = Plain(set(toxic) | set(ordinary))
    seen = {g[:-1] for g in (*toxic, *ordinary)}
    words = ["bad", "bag", "dab", "zzz", "bax", "\x00é", "😀", "", "b"]
    got = toxicity.Model(learnt(toxic, ordinary)[1]).words(words)
    for w, r in zip(words, got):
        want = sum(np.log(kn_brute(toxic, plain, g) / kn_brute(ordinary, plain, g)) for g in toxicity.grams(w) if g[:-1] in seen)
        assert r == pytest.approx(want)


def test_shared_model_sums_to_one():
    every = sorted(toxicity.gram_counts({w: 1 for w in ("bad", "bag", "cab", "dab", "dad")}))
    p, plain = toxicity.shared(toxicity.code_points("".join(every)).reshape(-1, toxicity.ORDER)), Plain(set(every))
    assert p == pytest.approx([plain.probability(g) for g in every])
    total = sum(plain.probability("\x02\x02ba"[-3:] + c) for c in "abcdg" + toxicity.START + toxicity.STOP)
    assert total <= 1 + 1e-9 and total > 0.8


def test_toxicity_on_held_out(spark, sf):
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in queries.op5_kneser_ney_toxicity(spark, sf).filter("held_out").collect() if r.doc_id in labels]
    yes, no = [s for s, t in rows if t], [s for s, t in rows if not t]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no]) > 0.8


def test_toxicity_learns_whole_words(spark):
    """What tells the classes apart stands only beyond the first 256 characters of one long word."""
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(600)) for _ in range(40)]
    rows = [(i, t[:300] + ("zqzqxzqx" if i % 2 else "") + t[300:]) for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    found, *_ = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    at = np.searchsorted(found.grams, toxicity.hashed(toxicity.code_points("qzqxz")[None, :])[0])
    assert found.grams[at] == toxicity.hashed(toxicity.code_points("qzqxz")[None, :])[0] and found.ratio[at] > 0
    assert toxicity.gram_counts({"a" * 1000: 2})["aaaaa"] == 2 * 996


def test_toxicity_score_against_brute_force(spark):
    """The score of every text, from counts and features made anew."""
    rng = random.Random(14)
    ordinary, bad = ["table", "river", "house", "green", "walks", "slowly", "bread"], ["scum", "vermin", "trash"]
    rows = []
    for i in range(60):
        ws = [rng.choice(ordinary) for _ in range(rng.randint(3, 40))]
        for _ in range(rng.randint(1, 4) if i % 3 == 0 else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        rows.append((i, " ".join(ws) + "." * (i % 2), int(i % 3 == 0)))
    rows += [(60, "", 0), (61, "... ,", 0), (62, "Scum scum, SCUM! " + "x" * 700, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    *_, weights, intercept = toxicity.fit(docs, labels)

    def bare(text):
        return [x for w in text.lower().split() if (x := w.strip(toxicity.PUNCTUATION.decode()))]

    counts = {0: {}, 1: {}}
    for _, text, t in rows:
        for w in dict.fromkeys(bare(text)):
            s = "\x02" * 4 + w + "\x03"
            for k in range(len(s) - 4):
                counts[t][s[k : k + 5]] = counts[t].get(s[k : k + 5], 0) + 1
    shared = Plain(set(counts[0]) | set(counts[1]))

    @functools.cache
    def ratio(w):
        def of(part):
            s = "\x02" * 4 + part + "\x03"
            gs = [s[k : k + 5] for k in range(len(s) - 4)]
            # contexts that no class has seen tell nothing
            return sum(np.log(kn_brute(counts[1], shared, g) / kn_brute(counts[0], shared, g)) for g in gs if any(x[:-1] == g[:-1] for c in counts.values() for x in c))

        return of(w) if len(w) <= 256 else max(of(w[k : k + 256]) for k in range(0, len(w), 128))

    got = {r.doc.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert weights[0] > 0
    for i, text, _ in rows:
        words = bare(text)
        x = [ratio(w) for w in dict.fromkeys(words)]
        whole = sum(ratio(w) for w in words) / len(words) if words else 0.0
        span = max(sum(x[k : k + 8]) / 8 for k in range(max(1, len(x) - 7))) if x else 0.0
        top = sum(sorted(x)[-4:]) / 4
        excess = sum(max(v - 1.0, 0) for v in x) / len(x) if x else 0.0
        want = 1 / (1 + np.exp(-np.clip(np.dot(weights, [whole, span, top, excess]) + intercept, -30, 30)))
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert got[0] > got[1] and got[62] > 0.5


def test_logistic_keeps_the_whole_text():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.3).astype(float)
    x = np.column_stack((-y + rng.normal(size=400), y + rng.normal(size=400), -y + rng.normal(size=400)))
    weights, _ = toxicity.logistic(x, y)
    assert weights[0] == pytest.approx(toxicity.LEAST / (x[:, 0].std() + 1e-9)) and weights[1] > 0 and weights[2] == 0
    assert toxicity.logistic(x, np.zeros(400)) == ([0.0] * 3, 0.0)


def test_toxicity_odd_rows(docs, empty, labels, corpus):
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(corpus) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.doc.text: r.score for r in got}[""] == {r.doc.text: r.score for r in got}[None]
    assert toxicity.score(empty, labels).count() == 0
    assert all(r.score < 0.01 for r in toxicity.score(docs, labels.filter("toxic = 1")).collect())
    assert all(r.score < 0.01 for r in toxicity.score(docs, labels.filter("false")).collect())


def test_label_folds(spark, docs):
    """Labels of held-out rows change nothing."""
    one = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], LABELS)
    other = spark.createDataFrame([(i, 1, i % 2 if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - i % 2) for i in range(60)], LABELS)
    a, b = (sorted((str(r.doc.doc_id), r.score) for r in toxicity.score(docs, x, learn=toxicity.not_held_out()).collect()) for x in (one, other))
    assert a == b


def brute_facts(text):
    text = text or ""
    space = " \t\n\x0b\x0c\r"
    ws, w = [], ""
    for c in text + " ":
        if c in space:
            ws, w = ws + [w] if w else ws, ""
        else:
            w += c
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if any(c not in space for c in x) and x in lines[:i])
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "a b c", "a b c a b c", "a b c d a b c", "x\nx\n \n \nx y", "# * <é>|\x1c\xa0 b", "a a a a a", "1 2 3 1 2 4 1 2 3 4\n" * 3])
def test_facts(text):
    assert quality.facts(text) == brute_facts(text)


def test_quality(docs, labels, empty, corpus):
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(corpus)
    for r in got:
        if len(r.doc.text or "") < 20_000:
            assert tuple(r)[1:6] == brute_facts(r.doc.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judge(empty, labels).count() == 0
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in quality.judge(docs, labels.filter("false")).collect())


def test_quality_against_brute_force(docs, labels, corpus):
    """Scores are the mean log ratio of add-half multinomials over hashed words and pairs."""
    trusted = {r.doc_id for r in labels.filter("quality = 1 and doc_id is not null").collect()}
    raw, target = np.full(quality.BUCKETS, 0.5), np.full(quality.BUCKETS, 0.5)
    hashed = {}
    for i, t, *_ in corpus:
        ws = (t or "").encode().split()
        hashed[i, t] = h = quality.ngram_buckets(ws) if ws else np.empty(0, int)
        np.add.at(raw, h, 1)
        if i in trusted:
            np.add.at(target, h, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for r in quality.judge(docs, labels).collect():
        h = hashed[r.doc.doc_id, r.doc.text]
        assert r.score == pytest.approx(ratio[h].mean() if len(h) else 0.0)


def test_quality_keeps_trusted(spark, sf):
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    rows = [r for r in queries.op8_quality_rules(spark, sf).filter("not base_failed").collect() if r.doc_id in labels]
    good, bad = [r.kept for r in rows if labels[r.doc_id]], [r.kept for r in rows if not labels[r.doc_id]]
    assert np.mean(good) > 0.97 and (not bad or np.mean(bad) < 0.5)  # few labels are to be had at this size


@pytest.mark.parametrize("broadcast", [1 << 20, 10])
def test_quality_counts_all_trusted(spark, monkeypatch, broadcast):
    """Every trusted document is in the target counts, however many there are and however they are joined."""
    monkeypatch.setattr(quality, "BROADCAST", broadcast, raising=False)
    rng, n = random.Random(5), 20_500
    rows = [(i, " ".join(rng.choice("abcdefghij") + str(i % 50) for _ in range(3))) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 100 < 99), 0) for i in range(n)], LABELS)
    raw, target = np.full(quality.BUCKETS, 0.5), np.full(quality.BUCKETS, 0.5)
    for i, t in rows:
        h = quality.ngram_buckets(t.encode().split())
        np.add.at(raw, h, 1)
        if i % 100 < 99:
            np.add.at(target, h, 1)
    found, threshold = quality.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    assert threshold == quality.THRESHOLD
    assert found == pytest.approx(np.log(target / target.sum()) - np.log(raw / raw.sum()), abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 499, 501, 502, 5000])
def test_threshold_is_the_quantile_of_all(spark, n):
    scores = np.random.default_rng(n).normal(size=n).round(2)
    got = quality.lowest(spark.createDataFrame([(float(x),) for x in scores], "score double"), -0.1)
    assert got == min(-0.1, np.quantile(scores, quality.LOST, method="lower"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("deep.example.org", "", "block")]
URLS = [None, "", "no scheme", "http://A.Example.NET/en/1", "http://example.net/EN/1", "http://net", "http://net/", "http://x.net?y", "https://www.example.com/de/", "https://badexample.com/de/x", "x://a.org/fr/y#z", "http://deep.example.org", "http://a.deep.example.org/fr/x", "http://org/fr/://net/", "http:///path", "://net/x", "http://a.net/\n#", "http://é.net/ü"]


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"


@pytest.mark.parametrize("bits", [16, 1])
def test_urls(spark, monkeypatch, bits):
    monkeypatch.setattr(urls, "BITS_PER_KEY", bits)
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[3:5])], "page_id bigint, url string, rule string")
    listed = spark.createDataFrame(RULES + [(None, "/", "block")], "host string, path string, verdict string")
    got = {r.id: tuple(r)[1:] for r in urls.judge(pages, listed).collect()}
    assert got == {i: brute_judge(u) for i, u in enumerate(URLS + URLS[3:5])}
    assert urls.judge(pages.filter("false"), listed).count() == 0
    assert {r.verdict for r in urls.judge(pages, listed.filter("false")).collect()} == {"allow"}


def test_urls_hot_key(spark):
    """One URL in most rows, listed or not."""
    pages = spark.createDataFrame([(i, "http://a.net/x" if i % 3 else "http://b.com/x", 1) for i in range(4000)], "page_id bigint, url string, hits int")
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.judge(pages, listed).groupBy("host", "rule", "verdict").count().collect()
    assert sorted(map(tuple, got), key=str) == [("a.net", "net/", "block", 2666), ("b.com", None, "allow", 1334)]


def test_url_oracle(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = sorted(duckdb.sql(queries.OP6_SQL).select("page_id", "host", "path", "rule", "verdict").fetchall())
    got = queries.op6_bloom_url_filter(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == want


def brute_targets(sizes, budget, most, weights=(5, 2, 1)):
    """Fill sources by weight in small steps of the level, found by bisection."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(weight[s] * level, most * n) for s, n in sizes.items()) < budget * sum(sizes.values()):
            low = level
        else:
            high = level
    return {s: min(weight[s] * low, most * n) for s, n in sizes.items()}


@pytest.mark.parametrize("sizes, budget", [
    ({"a": 100, "b": 100, "c": 100, None: 100}, 1.5), ({"a": 10}, 1.5), ({"b": 1, "a": 1000, "\U0001f600": 5, "Z": 0, "\uffff": 7}, 1.5), ({"a": 0, None: 0}, 1.5), ({"a": 3, "b": 4}, 2.5),
])
def test_targets(spark, sizes, budget):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size bigint")
    got = mixing.targets(rows.select(mixing._known(rows.source).alias("known"), "source_size"), budget, 2.0).collect()
    want = brute_targets(sizes, budget, 2.0)
    assert {r.known: r.target for r in got} == pytest.approx({"1" if s is None else "0" + s: t for s, t in want.items()})


def brute_taken(rows, goal):
    """Whole copies of all, and of the rest those of the smallest hashes, equal hashes together, until the target is nearest."""
    total = sum(n for n, _ in rows)
    whole, rest = (int(goal // total), goal % total) if total else (0, 0)
    taken, best = 0, 0
    for h in sorted({h for _, h in rows}):
        more = taken + sum(n for n, x in rows if x == h)
        if more > rest:
            best = more if more - rest < rest - taken else taken
            break
        best = taken = more
    return whole * total + best


@pytest.mark.parametrize("few", [50_000, 0])
def test_mix(docs, empty, corpus, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST", few)
    rows = mixing.mix(docs).withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc.doc_id", "doc.text"), 4)).collect()
    assert len(rows) == len(corpus) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc.doc_id", "doc.text"), 4)).collect()))
    sizes: dict = {}
    for r in rows:
        assert r.size == len((r.doc.text or "").encode().split())
        sizes.setdefault(r.doc.source, []).append(r)
    goal = brute_targets({s: sum(r.size for r in rs) for s, rs in sizes.items()}, 1.5, 2.0)
    for s, rs in sizes.items():
        total = sum(r.size for r in rs)
        assert all(r.source_size == total and r.target == pytest.approx(goal[s]) and 0 <= r.copies <= 2 for r in rs)
        assert sum(r.size * r.copies for r in rs) == brute_taken([(r.size, r.hash) for r in rs], rs[0].target)
    assert mixing.mix(empty).count() == 0


def test_mix_clashing_names_and_many_sources(spark):
    rows = [(i, "w " * (i % 4), f"s{i % 400}", "x", "y", 1.0, 2) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, known string, doc string, target double, rank int")
    got = mixing.mix(docs)
    assert got.select("doc.*").columns == docs.columns and got.count() == 1200
    by = got.groupBy("doc.source").agg(F.max("target").alias("t"), F.max("source_size").alias("n")).collect()
    assert {r.source: r.t for r in by} == pytest.approx(brute_targets({r.source: r.n for r in by}, 1.5, 2.0))


def test_mix_hot_key(spark):
    """Rows that repeat one id and text share a fate, and count each."""
    docs = spark.createDataFrame([(1, "a b c", "hot")] * 3000 + [(i, "a b", "cold") for i in range(30)], "doc_id bigint, text string, source string")
    got = mixing.mix(docs).groupBy("doc.source").agg(F.countDistinct("copies").alias("k"), F.sum("size").alias("n"), F.max("source_size").alias("m")).collect()
    assert {r.source: (r.n, r.m) for r in got} == {"hot": (9000, 9000), "cold": (60, 60)} and all(r.k == 1 for r in got if r.source == "hot")


def test_mix_is_near_and_nested(spark):
    rows = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(3000)], "doc_id bigint, text string, source string")
    one, two = ({r.doc.doc_id: r.copies for r in mixing.mix(rows, budget=b).collect()} for b in (0.5, 0.7))
    assert all(two[i] >= n for i, n in one.items())
    got = mixing.mix(rows).selectExpr("doc.source", "target", "size * copies as taken").groupBy("source", "target").sum("taken").collect()
    assert all(abs(r[2] - r.target) <= 9 for r in got)


def test_crc_mod(spark):
    got = spark.createDataFrame([(5,), (None,)], "doc_id bigint").select(crc_mod("doc_id", 5)).collect()
    assert [r[0] for r in got] == [zlib.crc32(b"5") % 5, zlib.crc32(b"") % 5]
