"""Operator 5, toxicity by class-conditional Kneser-Ney models.

Both models run over the characters of words, five at a time. A class keeps discounted counts of its own
for the longest context only; what it discounts goes to Kneser-Ney models of shorter contexts whose
continuation counts come from both classes together, so an expression that is rare in one class is
smoothed by what is known of it anywhere, and contexts that no class has seen tell nothing. The score rests on
the log-likelihood of the whole text under the toxic model less that under the ordinary one, both divided by
its number of words. Beside this mean stand three of the same ratios over the different words in order of
appearance, as a few toxic words are lost in the mean of a long text: the highest of SPAN neighbours, that of
the TOP highest words, and that of all words' excess over MILD. A logistic curve fitted on labelled documents
that the models have not seen turns them into 0 to 1.

Everything learnt is learnt from SAMPLE labelled documents of each class at most, those whose ids have
the smallest hashes. For the curve, models of one half score the other half."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, carried, crc_mod, worker_state

ORDER = 5
#: Labelled documents of each class that are learnt from, at most.
SAMPLE = 8000
#: Neighbouring different words whose mean counts, and characters of a word that are scored one by one.
SPAN, PIECE = 8, 256
#: Words whose highest ratios are averaged, and the ratio from which a word speaks for toxicity.
TOP, MILD = 4, 1.0
#: Words whose ratios a worker keeps.
MET = 200_000
#: Least weight of the whole text's ratio, in its standard deviations.
LEAST = 0.1
#: Score from which a document is predicted toxic.
CUT = 0.7
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
START, STOP = "\x02", "\x03"
#: Odd factors of the hash, one for each place of a gram.
FACTORS = np.random.default_rng(5).integers(0, 2**63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def expressions(text: str | None) -> dict[str, int]:
    """How often the different words of a text stand in it, in order, A-Z lower-cased, without ASCII punctuation around them."""
    found: dict[bytes, int] = {}
    for w, n in Counter(text.encode().translate(LOWER).split() if text else ()).items():
        if x := w.strip(PUNCTUATION):
            found[x] = found.get(x, 0) + n
    return {x.decode(errors="replace"): n for x, n in found.items()}


def grams(word: str) -> Iterator[str]:
    """The grams of a whole word, however long, with marks of its beginning and end."""
    s = START * (ORDER - 1) + word + STOP
    return (s[i : i + ORDER] for i in range(len(s) - ORDER + 1))


def gram_counts(words: dict[str, int]) -> Counter:
    """How often the grams of these words stand in them, each word counted whole, however long."""
    found = Counter()
    for w, n in words.items():
        for g in grams(w):
            found[g] += n
    return found


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _numbered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a table of code points, and the number of each row among them."""
    if not rows.shape[1]:
        return rows[:1], np.zeros(len(rows), np.int64)
    flat = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 4))).ravel()
    _, first, number = np.unique(flat, return_index=True, return_inverse=True)
    return rows[first], number.ravel()


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


def _interpolated(counts: np.ndarray, context: np.ndarray, backoff: np.ndarray, d: float) -> np.ndarray:
    """Kneser-Ney probabilities of rows with these counts and numbers of contexts; contexts without counts back off whole."""
    total = np.bincount(context, counts)[context]
    kinds = np.bincount(context, counts > 0)[context]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, (np.maximum(counts - d, 0) * (counts > 0) + d * kinds * backoff) / total, backoff)


def shared(codes: np.ndarray) -> np.ndarray:
    """The probability of each distinct gram's last character, by the model of its shorter contexts.

    An interpolated Kneser-Ney model of what continues a context, from the distinct grams of both classes."""
    suffix, number = _numbered(codes[:, 1:])
    counts = np.bincount(number).astype(np.float64)
    below = np.full(len(suffix), 1 / (len(suffix) + 1)) if suffix.shape[1] == 1 else shared(suffix)
    return _interpolated(counts, _numbered(suffix[:, :-1])[1], below, _discount(counts))[number]


def hashed(codes: np.ndarray) -> np.ndarray:
    """64-bit numbers of grams and contexts, rows of code points: among the millions of a model none is met twice."""
    sums = (codes.astype(np.uint64) * FACTORS[: codes.shape[1]]).sum(1, dtype=np.uint64)
    return (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Ratios(NamedTuple):
    """Log ratios of seen grams, and of seen contexts for all that never followed them, by ``hashed``, in order."""

    grams: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def ratios(codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Ratios:
    """The class-conditional models of distinct grams with their counts, as one toxic against ordinary."""
    context, number = _numbered(codes[:, :-1])
    p = shared(codes)
    ratio, weight = np.zeros(len(codes)), np.zeros(len(context))
    for counts, sign in ((toxic, 1), (ordinary, -1)):
        d = _discount(counts)
        ratio += sign * np.log(_interpolated(counts, number, p, d))
        total, kinds = np.bincount(number, counts), np.bincount(number, counts > 0)
        known = total > 0
        weight[known] += sign * np.log(d * kinds[known] / total[known])
    keys, above = hashed(codes), hashed(context)
    i, j = np.argsort(keys), np.argsort(above)
    return Ratios(keys[i], ratio[i], above[j], weight[j])


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, otherwise) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], otherwise)


class Model:
    """Scores texts; one in each worker process, with the ratios of words that it has met."""

    def __init__(self, ratios: Ratios):
        self.ratios, self.met = ratios, {}

    def words(self, words: list[str]) -> np.ndarray:
        """The log ratio of each word; of a long one that of its most toxic piece."""
        step = PIECE // 2
        parts = [[w] if len(w) <= PIECE else [w[k : k + PIECE] for k in range(0, len(w), step)] for w in words]
        flat = [x for p in parts for x in p]
        if not flat:
            return np.zeros(0)
        if not len(self.ratios.grams):
            return np.zeros(len(words))
        codes = code_points("".join(f"{START * (ORDER - 1)}{x}{STOP}" for x in flat))
        size = np.fromiter(map(len, flat), np.int64, len(flat)) + 1  # grams of each part
        starts = np.cumsum(size + ORDER - 1) - (size + ORDER - 1)
        at = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
        windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[at]
        r = self.ratios
        got = _looked_up(r.grams, r.ratio, hashed(windows), _looked_up(r.contexts, r.weight, hashed(windows[:, :-1]), 0.0))
        sums = np.add.reduceat(got, np.cumsum(size) - size)
        many = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.maximum.reduceat(sums, np.cumsum(many) - many)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the mean ratio of all its words, and the three means of different words.

        Texts of fewer words are filled up with ratios of 0 in the latter, and an empty one has 0 for all."""
        if len(self.met) > MET:
            self.met.clear()
        met, counts = self.met, [expressions(t) for t in texts]
        new = list(dict.fromkeys(w for c in counts for w in c if w not in met))
        now = dict(zip(new, self.words(new).tolist()))
        found = np.zeros((len(texts), 4))
        for row, c in zip(found, counts):
            if c:
                x, n = np.array([met[w] if w in met else now[w] for w in c]), np.fromiter(c.values(), np.float64, len(c))
                sums, m = np.concatenate(([0.0], np.cumsum(x))), min(SPAN, len(x))
                top = np.partition(x, len(x) - TOP)[-TOP:] if len(x) > TOP else x
                row[:] = x @ n / n.sum(), (sums[m:] - sums[:-m]).max() / SPAN, top.sum() / TOP, np.maximum(x - MILD, 0).mean()
        met.update((w, r) for w, r in now.items() if len(w) <= 64)
        return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.002) -> tuple[list[float], float]:
    """Weights and intercept of a ridge-penalised logistic curve, classes weighing alike; the penalty is on standardised features.

    A higher ratio never speaks against toxicity. The first feature has the standardised weight LEAST at least;
    others whose weight turns out negative are left out, one by one."""
    if not (y == 1).any() or not (y == 0).any():
        return [0.0] * x.shape[1], 0.0
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, use, fixed = (x - mean) / scale, list(range(x.shape[1])), 0.0
    while True:
        weights, intercept = _fitted(z[:, use], y, ridge, fixed * z[:, 0])
        by = dict(zip(use, weights))
        if by.get(0, LEAST) < LEAST:
            fixed = LEAST
            use.remove(0)
        elif min((w for i, w in by.items() if i), default=0.0) < 0:
            use.remove(min((w, i) for i, w in by.items() if i)[1])
        else:
            break
    found = np.array([by.get(i, 0.0) + (fixed if i == 0 else 0.0) for i in range(x.shape[1])]) / scale
    return found.tolist(), float(intercept - found @ mean)


def _fitted(z: np.ndarray, y: np.ndarray, ridge: float, offset: np.ndarray) -> tuple[list[float], float]:
    """Newton's method on standardised features, ``offset`` added to what they make."""
    design, w = np.column_stack((z, np.ones(len(z)))), np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    beta, penalty = np.zeros(design.shape[1]), ridge * len(z)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta + offset, -30, 30)))
        step = np.linalg.solve((design * (w * (p * (1 - p) + 1e-9))[:, None]).T @ design + penalty * np.eye(len(beta)), design.T @ (w * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta[:-1].tolist(), float(beta[-1])


def _together(texts: list[str | None], most: int = 1 << 18) -> Iterator[list[str | None]]:
    """Runs of texts of about ``most`` characters, a text at least."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn=None) -> tuple[Ratios, list[float], float]:
    """(ratios, weights, intercept), learnt from the labels that ``learn`` admits (a condition on their doc_id)."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null")
    known = (known.filter(learn) if learn is not None else known).groupBy(F.col("doc_id").alias("known_id")).agg(F.max("toxic").alias("toxic"))
    sample = None
    for kind in (0, 1):
        part = known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("known_id"), "known_id").limit(SAMPLE)
        sample = part if sample is None else sample.union(part)
    sample = F.broadcast(sample)  # 2 * SAMPLE rows at most
    # equal texts fall on the same side, or the curve would be fitted on texts that the models know
    side = F.pmod(F.xxhash64("text"), F.lit(2))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, F.col("id") == F.col("known_id")).select("text", "toxic", side.alias("side"))

    def count(batches):
        counts = {(s, toxic): Counter() for s in (0, 1) for toxic in (0, 1)}
        for b in batches:
            for text, toxic, s in zip(*(c.to_pylist() for c in b.columns)):
                counts[s, toxic].update(expressions(text).keys())
        for (s, toxic), ws in counts.items():
            found = gram_counts(ws)
            m = len(found)
            yield pa.record_batch([pa.array(list(found), pa.string()), pa.array([s] * m, pa.int64()), pa.array([toxic] * m, pa.int32()), pa.array(list(found.values()), pa.int64())], ["gram", "side", "toxic", "n"])

    n = [F.sum(F.when((F.col("side") == s) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{s}{t}") for s in (0, 1) for t in (0, 1)]
    found = rows.mapInArrow(count, "gram string, side bigint, toxic int, n bigint").groupBy("gram").agg(*n).toArrow()  # bounded by the sample
    counts = {(s, t): found[f"n{s}{t}"].to_numpy().astype(np.float64) for s in (0, 1) for t in (0, 1)}
    codes = code_points("".join(found["gram"].to_pylist())).reshape(-1, ORDER)
    del found
    both = [counts[0, t] + counts[1, t] for t in (0, 1)]
    none = np.zeros(0)
    if not both[0].sum() or not both[1].sum():
        return Ratios(none.astype(np.uint64), none, none.astype(np.uint64), none), [0.0] * 4, -30.0
    whole, halves = ratios(codes, both[1], both[0]), []
    for s in (0, 1):
        seen = counts[s, 0] + counts[s, 1] > 0
        # a half without one of the classes makes no models; the whole's stand in
        halves.append(ratios(codes[seen], counts[s, 1][seen], counts[s, 0][seen]) if counts[s, 0].sum() and counts[s, 1].sum() else whole)
    held = docs.sparkSession.sparkContext.broadcast([tuple(h) for h in halves])

    def features(batches):
        models = [Model(Ratios(*x)) for x in held.value]
        for b in batches:
            texts, sides = b.column(0).to_pylist(), b.column(2).to_numpy()
            x = np.zeros((len(texts), 4))
            for s in (0, 1):
                at = np.nonzero(sides == s)[0].tolist()
                if at:
                    x[at] = np.concatenate([models[1 - s].features(some) for some in _together([texts[i] for i in at])])
            yield pa.record_batch([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    unseen = rows.mapInArrow(features, "x array<double>, y int").toPandas()  # bounded by the sample
    return whole, *logistic(np.array(unseen.x.tolist(), float).reshape(-1, 4), unseen.y.to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn=None, keep: list[str] | None = None) -> DataFrame:
    """(doc, score, predicted): doc is a struct of all columns of the row (or those of ``keep``), whatever their names.

    Only the text enters the score. Null and empty texts get the curve's value at 0, like texts whose
    words tell nothing. Rows that repeat score alike; labels that are null or not 0 or 1 are left out, and
    without labels of both classes every score is near 0. An empty table gives an empty table."""
    learnt, weights, intercept = fit(docs, labels, id_col, text_col, learn)
    plain, texts = carried(docs, text_col, keep)
    held = docs.sparkSession.sparkContext.broadcast(tuple(learnt))
    number = uuid.uuid4().hex

    def run(batches):
        model = worker_state(f"toxicity {number}", lambda: Model(Ratios(*held.value)))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.concatenate([model.features(some) for some in _together(texts(b))])
            s = 1 / (1 + np.exp(-np.clip(x @ np.array(weights) + intercept, -30, 30)))
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc", "score", "predicted"])

    return plain.mapInArrow(run, f"doc {plain.schema['doc'].dataType.simpleString()}, score double, predicted int")


def not_held_out(column: str = "doc_id", folds: int = 3, held: int = 1):
    return crc_mod(column, folds) != held
