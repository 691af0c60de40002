"""Operator 3, language-model scoring by subword lattice likelihood.

The vocabulary is that of a public tokenizer, in the order of its ranks, with the words of the training
texts as further, long pieces. Piece scores weight every segmentation of a word into pieces, and a
forward recursion in log space sums them to the word's marginal probability. Scores start from the ranks
(Zipf's law) and are re-estimated by expected counts over the lattices of all distinct training words.
A word that was seen keeps its discounted relative frequency; what the discount frees goes to the
segmentations into subwords, so any text has a probability.

There is a set of scores for each class of documents (here: their language). A text's probability is that
of the mixture of the classes, so at scoring nothing but the text is used.

Counts of words follow the corpus and stay in tables. Tasks hold the piece scores (bounded by the
vocabulary) and the HEAD most frequent words; the rest of a document's words meet their counts in a join."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_words, shuffle_partitions, written

#: Classes of documents with scores of their own, at most; the rest share the last one.
CLASSES = 6
#: Words that every task looks up itself, and the longest of them in bytes.
HEAD, HEAD_BYTES = 1 << 18, 64
#: Rounds of re-estimation, and the weight of the ranks' scores in it, in pieces of text.
ROUNDS, PRIOR = 4, 200.0
#: Distinct words a task counts before it passes them on.
FLUSH = 400_000
#: Bytes of words that are reckoned many at a time.
LONG = 48
LOG10 = math.log(10)


def vocabulary(path: str) -> dict[bytes, float]:
    """Pieces of a sentencepiece model as bytes, a space for the mark of a word's beginning, with their rank weights.

    All 256 bytes and the space are pieces, so every word has a segmentation."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n, ranks = model.get_piece_size(), {}
    for i in range(n):
        if model.is_byte(i):
            ranks.setdefault(bytes([int(model.id_to_piece(i)[3:5], 16)]), n)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ranks[model.id_to_piece(i).replace("▁", " ").encode()] = -model.get_score(i)
    for b in range(256):
        ranks.setdefault(bytes([b]), n)
    weight = {p: 1 / (r + 10) for p, r in ranks.items()}
    total = sum(weight.values())
    return {p: w / total for p, w in weight.items()}


class Lattice:
    """Segmentations of words into the pieces of one vocabulary, under several sets of scores."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.scores = scores
        # a trie of the pieces: node 0 is the root, a child is found by its parent's number and its byte
        child: dict[int, int] = {}
        piece = [-1]
        for number, p in enumerate(pieces):
            node = 0
            for byte in p:
                key = node << 8 | byte
                if (node := child.get(key, 0)) == 0:
                    node = child[key] = len(piece)
                    piece.append(-1)
            piece[node] = number
        self.keys = np.array(sorted(child), np.int64)
        self.nodes, self.piece = np.array([child[k] for k in self.keys.tolist()], np.int64), np.array(piece)

    def edges(self, words: list[bytes]) -> np.ndarray:
        """(word, start, end, piece) of every piece that fits a word after the mark of its beginning, in no order."""
        data = np.frombuffer(b" " + b" ".join(words), np.uint8)
        size = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(size)
        at, word = np.arange(len(data)), np.repeat(np.arange(len(words)), size)
        start, node, found, depth = at, np.zeros(len(data), np.int64), [], 0
        while at.size:
            key = node << 8 | data[at]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[k] == key
            at, word, start, node, depth = at[on] + 1, word[on], start[on], self.nodes[k[on]], depth + 1
            piece = self.piece[node]
            fits = piece >= 0
            i = start[fits] - (ends - size)[word[fits]]
            found.append(np.stack((word[fits], i, i + depth, piece[fits]), axis=1))
            on = at < ends[word]
            at, word, start, node = at[on], word[on], start[on], node[on]
        return np.concatenate(found) if found else np.empty((0, 4), np.int64)

    def _steps(self, edges: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces) of edges, by start; in each no word comes twice."""
        key = edges[:, 1] * 65536 + edges[:, 2]
        order = np.argsort(key, kind="stable")
        cuts = np.nonzero(np.diff(key[order]))[0] + 1
        return [(int(edges[x[0], 1]), int(edges[x[0], 2]), edges[x, 0], edges[x, 3]) for x in np.split(order, cuts)]

    def forward(self, words: list[bytes], steps) -> np.ndarray:
        """Log probability of each prefix of each word, for each set of scores."""
        f = np.full((len(self.scores), len(words), max(map(len, words)) + 2), -np.inf)
        f[:, :, 0] = 0.0
        for i, j, at, p in steps:
            f[:, at, j] = np.logaddexp(f[:, at, j], f[:, at, i] + self.scores[:, p])
        return f

    def _batches(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """Numbers of words of like length, few if they are long."""
        size = np.array([len(w) for w in words])
        order, k = np.argsort(size, kind="stable"), 0
        while k < len(order):
            n = max(1, min(2048, 65536 // (int(size[order[min(k + 2047, len(order) - 1)]]) + 2)))
            yield order[k : k + n]
            k += n

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's marginal probability (rows) under each set of scores (columns)."""
        found = np.empty((len(words), len(self.scores)))
        for some in self._batches(words):
            ws = [words[i] for i in some]
            if len(ws[-1]) > LONG:
                found[some] = [self._long(w) for w in ws]
                continue
            f = self.forward(ws, self._steps(self.edges(ws)))
            found[some] = f[:, np.arange(len(ws)), [len(w) + 1 for w in ws]].T
        return found

    def _long(self, word: bytes) -> list[float]:
        """The same recursion over a window of positions, for words of any length."""
        out = np.full((len(self.scores), len(word) + 2), -np.inf)
        out[:, 0] = 0.0
        edges = self.edges([word])
        for _, i, j, p in edges[np.lexsort((edges[:, 2], edges[:, 1]))].tolist():
            out[:, j] = np.logaddexp(out[:, j], out[:, i] + self.scores[:, p])
        return out[:, -1].tolist()

    def expect(self, words: list[bytes], seen: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (columns) for each set of scores (rows), over the words that ``seen`` gives it.

        A row of the recursion is a word under one set of scores; most words were seen by one alone."""
        total, pieces = np.zeros(self.scores.size), self.scores.shape[1]
        word, own = np.nonzero(seen)
        weight, flat = seen[word, own].astype(np.float64), self.scores.ravel()
        words = [words[i] for i in word]
        for some in self._batches(words) if words else ():
            ws, here, first = [words[i] for i in some], weight[some], own[some] * pieces
            edges = self.edges(ws)
            if len(ws[-1]) <= LONG:
                steps = self._steps(edges)
            else:
                steps = [(i, j, np.array([at]), np.array([p])) for at, i, j, p in edges[np.lexsort((edges[:, 2], edges[:, 1]))].tolist()]
            f = np.full((max(map(len, ws)) + 2, len(ws)), -np.inf)
            f[0] = 0.0
            for i, j, at, p in steps:
                f[j, at] = np.logaddexp(f[j, at], f[i, at] + flat[first[at] + p])
            ends, row = np.array([len(w) + 1 for w in ws]), np.arange(len(ws))
            back, whole = np.full(f.shape, -np.inf), f[ends, row]
            back[ends, row] = 0.0
            used, parts = [], []
            for i, j, at, p in reversed(steps):
                k = first[at] + p
                x = flat[k] + back[j, at]
                back[i, at] = np.logaddexp(back[i, at], x)
                used.append(k)
                parts.append(np.exp(f[i, at] + x - whole[at]) * here[at])
            np.add.at(total, np.concatenate(used), np.concatenate(parts))
        return total.reshape(self.scores.shape)


def count_words(docs: DataFrame, classes: list[str | None]) -> DataFrame:
    """(word, c0, c1, ...): how often training documents of each class hold each word of any document."""
    k = len(classes)
    cs = [f"c{c}" for c in range(k)]

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(k + 1)]  # the last one of documents that are not learnt from

        def flush():
            for c, found in enumerate(counts):
                ws, n = list(found), np.fromiter(found.values(), np.int64, len(found))
                found.clear()
                for at in range(0, len(ws), 50_000):
                    some = pa.array(ws[at : at + 50_000], pa.binary())
                    none = pa.array(np.zeros(len(some), np.int64))
                    yield pa.record_batch([some, *(pa.array(n[at : at + 50_000]) if x == c else none for x in range(k))], ["word", *cs])

        for b in batches:
            for text, c, held in zip(*(x.to_pylist() for x in b.columns)):
                counts[k if held else c].update(lower_words(text))
            if sum(map(len, counts)) > FLUSH:
                yield from flush()
        yield from flush()

    rows = docs.select("text", "class", "held_out").mapInArrow(run, "word binary, " + ", ".join(f"{c} bigint" for c in cs))
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in cs])


def discounts(n: list[int]) -> list[float]:
    """What is taken off words seen once, twice, and more often, from how many words were seen 1, 2, 3 and 4 times.

    The estimates of modified Kneser-Ney smoothing, each at least a tenth and less than the count; without
    words seen 1 and 2 times, half a word."""
    if not n[0] or not n[1]:
        return [0.5] * 3
    y = n[0] / (n[0] + 2 * n[1])
    found = [m - (m + 1) * y * n[m] / n[m - 1] if n[m - 1] else y for m in (1, 2, 3)]
    return [min(max(d, 0.1), m - 0.1) for m, d in enumerate(found, 1)]


def estimate(counts: DataFrame, k: int, vocabulary_path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces and their log scores for each class, by expected counts over the distinct training words."""
    sc = counts.sparkSession.sparkContext
    rank = vocabulary(vocabulary_path)
    pieces, prior = list(rank), np.array(list(rank.values()))
    scores = np.log(np.tile(prior, (k, 1)))
    words = counts.filter(" + ".join(f"c{c}" for c in range(k)) + " > 0")
    for _ in range(ROUNDS):
        held = sc.broadcast((pieces, scores))

        def run(batches, held=held):
            lattice = Lattice(*held.value)
            got = np.zeros(lattice.scores.shape)
            for b in batches:
                got += lattice.expect(b.column(0).to_pylist(), np.stack([c.to_numpy() > 0 for c in b.columns[1:]], axis=1))
            c, p = np.nonzero(got)
            yield pa.record_batch([pa.array(c.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(got[c, p])], ["class", "piece", "n"])

        # as many rows as classes and pieces, at most
        sums = words.mapInArrow(run, "class int, piece int, n double").groupBy("class", "piece").agg(F.sum("n").alias("n")).toPandas()
        expected = np.tile(PRIOR * prior, (k, 1))
        np.add.at(expected, (sums["class"].to_numpy(), sums["piece"].to_numpy()), sums["n"].to_numpy())
        scores = np.log(expected / expected.sum(1, keepdims=True))
    return pieces, scores


def score(docs: DataFrame, vocabulary_path: str, held_out, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Learns from the rows where ``held_out`` (a condition) is false or null. Tokens are the text's words,
    A-Z lower-cased, and one end. score is log10 of the text's probability, base_score that of the add-half
    unigram model over the same tokens. A null text counts as empty: it has the end alone. Rows that repeat
    are counted and scored each; null ids are scored like others; null classes are a class. Without
    training rows the ranks alone weight the pieces. An empty table gives an empty table."""
    label = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label.alias("label"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    groups = rows.filter("not held_out").groupBy("label").count().orderBy(F.desc("count"), "label").limit(CLASSES - 1).collect()
    names = [g.label for g in groups] or [""]
    total_docs = rows.filter("not held_out").count()
    sizes = [g["count"] for g in groups] or [0]
    if total_docs > sum(sizes):  # the classes beyond the most common share one set of scores
        names, sizes = [*names, None], [*sizes, total_docs - sum(sizes)]
    k = len(names)
    number = F.lit(k - 1)
    for c, name in enumerate(names):
        if name is not None:
            number = F.when(F.col("label") == name, c).otherwise(number)
    rows = rows.select("id", "text", "held_out", number.cast("int").alias("class"))

    # a word costs far more time than bytes, so the table is cut finer than by bytes
    counts = written(count_words(rows, names).repartition(shuffle_partitions(docs.sparkSession), "word"), "counts")
    cs = [f"c{c}" for c in range(k)]
    sums = counts.agg(*[F.sum(c).alias(c) for c in cs], *[F.count_if(F.expr(f"{c} > 0")).alias(f"v_{c}") for c in cs], *[F.count_if(F.expr(f"{c} = {m}")).alias(f"n{m}_{c}") for c in cs for m in (1, 2, 3, 4)], F.count_if(F.expr(" + ".join(cs) + " > 0")).alias("v")).first()
    tokens = [(sums[c] or 0) for c in cs]  # words of each class
    train = sum(tokens) + total_docs
    distinct = sums["v"] + (1 if total_docs else 0)
    divisor = math.log10(train + 0.5 * (distinct + 1))
    taken = np.array([discounts([sums[f"n{m}_{c}"] or 0 for m in (1, 2, 3, 4)]) for c in cs])
    # the share of a class's words that goes to segmentations into subwords
    off = [d[0] * sums[f"n1_{c}"] + d[1] * sums[f"n2_{c}"] + d[2] * (sums[f"v_{c}"] - sums[f"n1_{c}"] - sums[f"n2_{c}"]) for c, d in zip(cs, taken)]
    free = [x / n if n else 1.0 for x, n in zip(off, tokens)]
    # words and ends of a class are drawn from one unigram distribution
    ends = [math.log((n + 0.5) / (n + t + 1)) for n, t in zip(sizes, tokens)]
    goes_on = [math.log((t + 0.5) / (n + t + 1)) for n, t in zip(sizes, tokens)]
    priors = [math.log((n + 0.5) / (total_docs + 0.5 * k)) for n in sizes]
    pieces, scores = estimate(counts, k, vocabulary_path)
    model = docs.sparkSession.sparkContext.broadcast((pieces, scores))

    def weigh(batches):
        lattice = Lattice(*model.value)
        for b in batches:
            seen = np.stack([c.to_numpy() for c in b.columns[1:]], axis=1)
            subword = lattice.log_probabilities(b.column(0).to_pylist()) + np.log(free)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(seen - np.where(seen > 0, taken[np.arange(k), np.clip(seen, 1, 3) - 1], 0), 0) / np.maximum(tokens, 1))
            lp = np.logaddexp(subword, whole) + np.array(goes_on)
            yield pa.record_batch([b.column(0), pa.array(seen.sum(1)), pa.array(lp.tolist(), pa.list_(pa.float64()))], ["word", "n_train", "lp"])

    known = written(counts.mapInArrow(weigh, "word binary, n_train bigint, lp array<double>"), "words")
    # the head is all words from a count on: a histogram of counts finds it without sorting words anywhere
    level = F.floor(F.log2(F.col("n_train") + 1) * 16)
    short = known.filter(F.length("word") <= HEAD_BYTES).withColumn("level", level)
    least, held = None, 0
    for r in sorted(short.groupBy("level").count().collect(), key=lambda r: -r.level):  # about a thousand rows at most
        held += r["count"]
        if held > HEAD:
            break
        least = r.level
    head = (short.filter(F.col("level") >= least) if least is not None else short.filter("false")).select("word", "n_train", "lp").toArrow()  # HEAD rows at most
    head_n = np.array(head["n_train"].to_pylist(), np.float64)
    head_lp = np.array(head["lp"].to_pylist(), np.float64).reshape(-1, k)
    table = np.concatenate((np.log10(head_n + 0.5)[:, None] - divisor, (head_n > 0)[:, None], head_lp), axis=1)
    common = docs.sparkSession.sparkContext.broadcast((head["word"].to_pylist(), table))

    def request(batches):
        ws, table = common.value
        index = {w: i for i, w in enumerate(ws)}
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                found = Counter(lower_words(text))
                at, n, tail = [], [], []
                for w, m in found.items():
                    i = index.get(w)
                    if i is None:
                        tail.append((w, m))
                    else:
                        at.append(i)
                        n.append(m)
                sums = np.array(n, np.float64) @ table[at] if at else np.zeros(k + 2)
                out.append((sum(found.values()) + 1, sums.tolist(), tail))
            kinds = pa.int64(), pa.list_(pa.float64()), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([r[c] for r in out], t) for c, t in enumerate(kinds))], ["id", "held_out", "n_tokens", "sums", "tail"])

    kind = rows.schema["id"].dataType.simpleString()
    asked = rows.select("id", "text", "held_out").mapInArrow(request, f"id {kind}, held_out boolean, n_tokens bigint, sums array<double>, tail array<struct<word:binary,n:bigint>>")
    asked = written(asked.withColumn("row", F.monotonically_increasing_id()), "requests")
    tail = asked.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n").join(known, "word")
    each = [(F.log10(F.col("n_train") + 0.5) - divisor), (F.col("n_train") > 0).cast("double"), *[F.col("lp")[c] for c in range(k)]]
    tail = tail.groupBy("row").agg(*[F.sum(F.col("n") * e).alias(f"t{c}") for c, e in enumerate(each)])
    all_sums = [F.col("sums")[c] + F.coalesce(F.col(f"t{c}"), F.lit(0.0)) for c in range(k + 2)]
    end_base = math.log10(total_docs + 0.5) - divisor
    by_class = F.array(*[all_sums[2 + c] + (ends[c] + priors[c]) for c in range(k)])
    top = F.array_max("by_class")
    mixed = (top + F.log(F.aggregate("by_class", F.lit(0.0), lambda s, x: s + F.exp(x - top)))) / LOG10
    return asked.join(tail, "row", "left").select(
        "id", "held_out", "n_tokens",
        (F.round(all_sums[1]).cast("bigint") + (1 if total_docs else 0)).alias("n_known"),
        F.lit(train).cast("bigint").alias("train_tokens"),
        (all_sums[0] + end_base).alias("base_score"),
        by_class.alias("by_class"),
    ).select("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", mixed.alias("score"))
