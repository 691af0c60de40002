import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vellumflow.llm import lattice
from vellumflow.llm.common import crc_mod, lower_words

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    w = b" " + word
    found = []
    for cuts in itertools.product((0, 1), repeat=len(w) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(w)]
        parts = [w[a:b] for a, b in zip([0, *ends], ends)]
        if all(p in pieces for p in parts):
            found.append(parts)
    return found


@pytest.mark.parametrize("long", [48, 1])
def test_marginal_and_expectations(monkeypatch, long):
    monkeypatch.setattr(lattice, "LONG", long)
    rng = np.random.default_rng(2)
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba", b" ab"]
    scores = np.log(rng.dirichlet(np.ones(len(pieces)), size=2))
    m, words = lattice.Lattice(pieces, scores), [b"abab", b"b", b"", b"aabba"]
    got = m.log_probabilities(words)
    seen = np.array([[1, 1], [1, 0], [0, 1], [1, 1]], bool)
    want = np.zeros(scores.shape)
    for k, w in enumerate(words):
        for c in (0, 1):
            all_ = [(s, math.exp(sum(scores[c][pieces.index(p)] for p in s))) for s in segmentations(w, pieces)]
            total = sum(p for _, p in all_)
            assert got[k][c] == pytest.approx(math.log(total))
            for s, p in all_ if seen[k][c] else []:
                for piece in s:
                    want[c][pieces.index(piece)] += p / total
    assert m.expect(words, seen) == pytest.approx(want)


def test_every_word_has_a_segmentation():
    v = lattice.vocabulary(VOCABULARY)
    assert sum(v.values()) == pytest.approx(1) and all(bytes([b]) in v for b in range(256))
    m = lattice.Lattice(list(v), np.log(np.array([list(v.values())])))
    words = [b"\xff\x00", "漢字".encode(), b"x" * 3000, b""]
    assert np.isfinite(m.log_probabilities(words)).all()


def base(corpus, held):
    c, ends = Counter(), 0
    for i, t, *_ in corpus:
        if not held(i):
            c.update(lower_words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    f = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    for i, t, *_ in corpus:
        ws = lower_words(t)
        yield i, held(i), len(ws) + 1, sum(1 for w in ws if c[w]) + 1, n, sum(f(c[w]) for w in ws) + f(ends)


@pytest.mark.parametrize("head", [1 << 17, 20])
def test_score(docs, corpus, monkeypatch, head):
    monkeypatch.setattr(lattice, "HEAD", head)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    got = sorted((tuple(r) for r in lattice.score(docs, VOCABULARY, crc_mod("doc_id", 5) == 1).collect()), key=str)
    want = sorted(base(corpus, held), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])
    assert all(r[6] < 0 for r in got)


def marginal(word, scores):
    """Natural logarithm of a word's probability by the plain recursion over its prefixes."""
    w = b" " + word
    f = [0.0] + [-math.inf] * len(w)
    for j in range(1, len(w) + 1):
        f[j] = np.logaddexp.reduce([f[i] + scores[w[i:j]] for i in range(j) if w[i:j] in scores])
    return f[-1]


def test_score_against_brute_force(spark):
    """The mixture of the classes, from counts made anew and the pieces' estimated scores."""
    rng = random.Random(4)
    stock = {c: ["".join(rng.choice(s) for _ in range(rng.randint(1, 5))) for _ in range(60)] for c, s in (("x", "abc"), ("y", "bcd"))}
    rows = [(i, " ".join(rng.choice(stock[c][: 5 + i]) for _ in range(rng.randint(0, 30))), c, i % 4 == 0) for i, c in enumerate(["x", "x", "y"] * 20)]
    rows += [(90, "abc New abc words", "x", True), (91, None, "y", True), (92, "", "z", True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, held boolean")
    got = {r.id: r.score for r in lattice.score(docs, VOCABULARY, F.col("held")).collect()}

    train = {c: [lower_words(t) for _, t, own, h in rows if own == c and not h] for c in "xy"}
    counts = [Counter(w for t in train[c] for w in t) for c in "xy"]
    df = spark.createDataFrame([(bytearray(w), counts[0][w], counts[1][w]) for w in counts[0] | counts[1]], "word binary, c0 bigint, c1 bigint")
    pieces, scores = lattice.estimate(df, 2, VOCABULARY)
    by_class = [dict(zip(pieces, s.tolist())) for s in scores]
    docs_of = [len(train[c]) for c in "xy"]

    def word(c, w):
        n, total = counts[c], sum(counts[c].values())
        m = [sum(1 for v in n.values() if v == k) for k in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1])
        d = [min(max(k - (k + 1) * y * m[k] / m[k - 1], 0.1), k - 0.1) if m[k - 1] else y for k in (1, 2, 3)]
        free = sum(d[min(v, 3) - 1] for v in n.values()) / total
        seen = (n[w] - d[min(n[w], 3) - 1]) / total if n[w] else 0.0
        return math.log(seen + free * math.exp(marginal(w, by_class[c]))) + math.log((total + 0.5) / (total + docs_of[c] + 1))

    for i, text, *_ in rows:
        ws = lower_words(text)
        both = []
        for c in (0, 1):
            total = sum(counts[c].values())
            end = math.log((docs_of[c] + 0.5) / (docs_of[c] + total + 1))
            both.append(sum(word(c, w) for w in ws) + end + math.log((docs_of[c] + 0.5) / (sum(docs_of) + 1)))
        assert got[i] == pytest.approx(np.logaddexp(*both) / math.log(10), abs=1e-6)


def test_discounts():
    assert lattice.discounts([0, 5, 5, 5]) == [0.5] * 3 == lattice.discounts([5, 0, 5, 5])
    y = 100 / 160
    assert lattice.discounts([100, 30, 15, 8]) == pytest.approx([1 - 2 * y * 0.3, 2 - 3 * y * 0.5, 3 - 4 * y * 8 / 15])
    assert lattice.discounts([10, 1000, 1, 0])[0] == 0.1


def test_learnt_beats_base_on_held_out(spark, sf):
    from vellumflow.llm import queries

    r = queries.op3_subword_lattice(spark, sf).filter("held_out and n_known = n_tokens").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_empty(empty, docs):
    assert lattice.score(empty, VOCABULARY, F.lit(False)).count() == 0
    assert lattice.score(docs, VOCABULARY, F.lit(True)).filter("n_known = 0 and train_tokens = 0 and score < 0").count() == docs.count()
