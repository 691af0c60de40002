"""Operator 8, quality rules: hashed n-gram log-likelihood ratio of trusted target to raw corpus.

Single words and word pairs are hashed into BUCKETS. One multinomial is counted over all documents, one
over the trusted ones; a document's score is the mean log ratio of its n-grams, and one threshold decides
for every document. Trusted documents, scored with their own counts taken out, lower it where few of them
leave much to chance. Only sums by bucket leave the tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, carried, release_state, words

BUCKETS = 1 << 16
#: Trusted ids that are broadcast, at most; more are joined by shuffling, with the same result.
BROADCAST = 200_000
#: Mean log ratio under which a document goes, unless more than this share of the trusted would go too.
THRESHOLD, LOST = -0.1, 0.002
#: N-grams that are added up at once.
FLUSH = 1 << 20
#: Pseudo-count of a bucket.
PRIOR = 0.5
#: Rules that go before the score: fewest words, and the greatest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

def ngram_buckets(ws: list[bytes]) -> np.ndarray:
    """The bucket of each word and of each pair of neighbours, repeats included."""
    h = np.array(list(map(zlib.crc32, ws)), np.uint64)
    pairs = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
    return np.concatenate((h & np.uint64(BUCKETS - 1), pairs)).astype(np.int64)


def repeated_words(ws: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in some window of ``window`` words found twice or more in the text, the first one included."""
    if len(ws) <= window:
        return 0
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
    at = ids[: len(ids) - window + 1]
    for k in range(1, window):  # numbering windows anew each time keeps the product small
        pair = at * len(number) + ids[k : len(ids) - window + 1 + k]
        at = np.unique(pair, return_inverse=True)[1]
    twice = np.bincount(at)[at] > 1
    marks = np.zeros(len(ids), bool)
    for k in range(window):
        marks[k : k + len(twice)] |= twice
    return int(marks.sum())


def facts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text; a null text has none of any."""
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(ws), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ws)


def _counts(batches) -> Iterator[pa.RecordBatch]:
    release_state()
    sums = np.zeros((2, BUCKETS), np.int64)
    held: tuple[list, list] = [], []

    def add():
        for total, parts in zip(sums, held):
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
                parts.clear()

    for b in batches:
        size = 0
        for text, trusted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ws := words(text):
                at = ngram_buckets(ws)
                held[0].append(at)
                if trusted:
                    held[1].append(at)
                size += len(at)
                if size > FLUSH:
                    add()
                    size = 0
        add()
    at = np.nonzero(sums[0])[0]
    yield pa.record_batch([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the threshold: raw counts are of all documents, target counts and threshold of all trusted ones."""
    trusted = Table(labels.filter("quality = 1").select(F.col("doc_id").alias("trusted_id")).distinct(), "trusted")
    held = F.broadcast(trusted.df) if trusted.df.count() <= BROADCAST else trusted.df.hint("merge")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    flagged = plain.join(held, F.col("id") == F.col("trusted_id"), "left").select("text", F.col("trusted_id").isNotNull().alias("trusted"))
    found = flagged.mapInArrow(_counts, "bucket bigint, raw bigint, target bigint")
    sums = found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # BUCKETS rows at most
    raw, target = np.full(BUCKETS, PRIOR), np.full(BUCKETS, PRIOR)
    raw[sums.bucket] += sums.raw
    target[sums.bucket] += sums.target
    if not sums.target.sum():  # nothing to compare with: no document is told from another
        trusted.drop()
        return np.zeros(BUCKETS), threshold
    log_raw = np.log(raw / raw.sum())
    sent = docs.sparkSession.sparkContext.broadcast((target, log_raw))

    def without(batches):
        target, log_raw = sent.value
        total = target.sum()
        for b in batches:
            got = []
            for text in b.column(0).to_pylist():
                if len(ws := words(text)) >= LEAST_WORDS:
                    at, n = np.unique(ngram_buckets(ws), return_counts=True)
                    got.append(float((n * (np.log((target[at] - n) / (total - n.sum())) - log_raw[at])).sum() / n.sum()))
            yield pa.record_batch([pa.array(got, pa.float64())], ["score"])

    own = Table(plain.join(held, F.col("id") == F.col("trusted_id")).select("text").mapInArrow(without, "score double"), "trusted_scores")
    low = lowest(own.df, threshold)
    for t in (own, trusted):
        t.drop()
    return np.log(target / target.sum()) - log_raw, low


def lowest(scores: DataFrame, threshold: float) -> float:
    """The threshold, or the LOST quantile of all scores (the lower of two that it lies between) where that is less.

    Only scores that lie under both are ranked; the driver gets counts and one score."""
    n, under = scores.agg(F.count("*"), F.count_if(F.col("score") < threshold)).first()
    place = int(np.floor(LOST * (n - 1))) if n else 0
    if not n or under <= place:
        return threshold
    return scores.orderBy("score").limit(place + 1).agg(F.max("score")).first()[0]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """(doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept).

    doc is a struct of all columns of the row (or those of ``keep``), whatever their names. base_failed holds for fewer than 50
    words or more than half of them in repeated 3-word windows; kept for those that pass and score at or
    above the threshold. A null text counts as empty: score 0, base_failed. Rows that repeat are judged
    alike; a null id is never trusted. Without trusted labels every score is 0. Empty tables give empty ones."""
    found, threshold = fit(docs, labels, id_col, text_col, threshold)
    ratios = docs.sparkSession.sparkContext.broadcast(found)  # BUCKETS numbers

    plain, texts = carried(docs, text_col, keep)

    def run(batches):
        table = ratios.value
        for b in batches:
            rows = []
            for text in texts(b):
                n, chars, symbols, dup, repeat = facts(text)
                failed = n < LEAST_WORDS or 100 * repeat > MOST_REPEATED * n
                score = float(table[ngram_buckets(words(text))].mean()) if n else 0.0
                rows.append((n, chars, symbols, dup, repeat, failed, score, not failed and score >= threshold))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds))], ["doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return plain.mapInArrow(run, f"doc {plain.schema['doc'].dataType.simpleString()}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean")
