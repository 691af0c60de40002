"""Recognition metrics: separation, error rates, order correlation, grouped reports and the verdict."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATES = (0.05, 0.10, 0.20)


def auroc(rows: DataFrame, by: list[str], score: str, wrong: str) -> DataFrame:
    """(by, n, n_wrong, auroc): the chance that a wrong row scores below a right one, ties counting half.

    Rows are first summed by distinct score, so the running counts pass over distinct scores alone, not
    over rows. Null if either class is empty."""
    sums = rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.count_if(wrong).alias("bad"))
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2.0
    found = sums.withColumn("rank", rank).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("n_wrong"), F.sum(F.col("rank") * (F.col("n") - F.col("bad"))).alias("right_ranks"))
    right = F.col("n") - F.col("n_wrong")
    u = F.col("right_ranks") - right * (right + 1) / 2.0
    return found.select(*by, "n", "n_wrong", F.when((F.col("n_wrong") > 0) & (right > 0), u / (F.col("n_wrong") * right)).alias("auroc"))


def flag_rates(rows: DataFrame, by: list[str], score: str, wrong: str, tie: str, rates=RATES) -> DataFrame:
    """(by, rate, k, hits, recall, precision, threshold): flagging exactly the k lowest scores, k = rate * n half-even.

    Ties keep the order of ``tie``. With k = 0 the threshold is -Infinity."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(score, tie))
    ranked = rows.select(*by, F.col(score).alias("s"), F.col(wrong).alias("bad"), place.alias("place"))
    ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy(*by))).withColumn("rate", F.explode(F.array(*[F.lit(r) for r in rates])))
    inside = F.col("place") <= F.bround(F.col("rate") * F.col("n"))
    found = ranked.groupBy(*by, "rate").agg(
        F.first("n").alias("n"), F.count_if("bad").alias("n_wrong"), F.count_if(inside).alias("k"),
        F.count_if(inside & F.col("bad")).alias("hits"), F.max(F.when(inside, F.col("s"))).alias("top"),
    )
    return found.select(
        *by, "rate", "k", "hits",
        F.when(F.col("n_wrong") > 0, F.col("hits") / F.col("n_wrong")).otherwise(0.0).alias("recall"),
        F.when(F.col("k") > 0, F.col("hits") / F.col("k")).otherwise(0.0).alias("precision"),
        F.coalesce("top", F.lit(float("-inf"))).alias("threshold"),
    )


def histogram(rows: DataFrame, score: str, wrong: str, bins: int = 20, top: float = 100.0) -> DataFrame:
    """(bin, n_right, n_wrong) over [0, top], the last bin closed."""
    at = F.least(F.call_function("width_bucket", F.col(score).cast("double"), F.lit(0.0), F.lit(top), F.lit(bins)), F.lit(bins))
    return rows.groupBy(at.cast("int").alias("bin")).agg(F.count_if(~F.col(wrong)).alias("n_right"), F.count_if(wrong).alias("n_wrong"))


def bag_labels(tokens: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """tokens (by, token, pos) with ok: the i-th occurrence of a token is right if the truth has i or more of it."""
    nth = F.row_number().over(Window.partitionBy(*by, "token").orderBy("pos"))
    have = truth.groupBy(*by, "token").agg(F.count("*").alias("have"))
    return tokens.withColumn("nth", nth).join(have, [*by, "token"], "left").withColumn("ok", F.coalesce(F.col("nth") <= F.col("have"), F.lit(False))).drop("nth", "have")


def discordant(values: np.ndarray) -> int:
    """How many pairs of an array stand in falling order, by the bits of the values' ranks from the highest down."""
    rank, found = np.unique(values, return_inverse=True)[1], 0
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        # values alike above this bit stand together, in their first order
        rank = rank[np.argsort(rank >> (bit + 1), kind="stable")]
        one = (rank >> bit) & 1
        ones = np.cumsum(one)
        start = np.searchsorted(rank >> (bit + 1), rank >> (bit + 1))
        found += int((ones - (ones - one)[start])[one == 0].sum())
    return found


def pair_counts(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How many pairs stand in the same and in the opposite order in both arrays; ties count in neither."""

    def tied(*columns: np.ndarray) -> int:
        n = np.unique(np.stack([np.unique(c, return_inverse=True)[1] for c in columns]), axis=1, return_counts=True)[1].astype(np.int64)
        return int((n * (n - 1) // 2).sum())

    n = len(x)
    if n < 50:  # few pairs are sooner formed than counted
        order = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
        return int((order > 0).sum()) // 2, int((order < 0).sum()) // 2
    against = discordant(y[np.lexsort((y, x))])
    return n * (n - 1) // 2 - tied(x) - tied(y) + tied(x, y) - against, against


def kendall_tau(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, concordant, discordant, tau) over all pairs of a group; ties drop out, no untied pair gives null.

    A group is sorted in one task and its pairs are counted without being formed, in n log n steps. Nulls pair with nothing."""

    def run(key, t):
        t = t.drop_null().combine_chunks()
        together, against = pair_counts(*(t[c].to_numpy(zero_copy_only=False) for c in ("_a", "_b")))
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], pa.array([together], pa.int64()), pa.array([against], pa.int64())], names=[*by, "concordant", "discordant"])

    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    pairs = rows.select(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).groupBy(*by).applyInArrow(run, f"{keys}, concordant bigint, discordant bigint")
    n = F.col("concordant") + F.col("discordant")
    return pairs.withColumn("tau", F.when(n > 0, (F.col("concordant") - F.col("discordant")) / n))


def character_error(truth: Column, read: Column) -> Column:
    """Edit distance over the truth's length; an empty truth gives 0 or 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(read) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(truth, read) / F.length(truth))


def report(rows: DataFrame, key: str, measures: list[str], scored: Column) -> DataFrame:
    """Per key, in order: how many, and the means of the measures over scored rows, nulls left out."""
    return rows.groupBy(key).agg(F.count("*").alias("images"), *[F.avg(F.when(scored, F.col(m))).alias(m) for m in measures]).orderBy(key)


def verdict(by_lang: DataFrame) -> DataFrame:
    """One row: PASS, MIXED, FAIL or INCONCLUSIVE, from (lang, wer, auroc)."""
    eng = F.col("lang") == "eng"
    found = by_lang.agg(F.max(F.when(eng, F.col("wer"))).alias("wer"), F.max(F.when(eng, F.col("auroc"))).alias("auroc"), F.bool_and(F.when(~eng & F.col("wer").isNotNull(), 1 - F.col("wer") >= 0.95)).alias("others"))
    usable = F.col("auroc") >= 0.80
    clean = (1 - F.col("wer") >= 0.98) & F.coalesce("others", F.lit(True))
    return found.select(F.when(F.col("wer").isNull() | F.col("auroc").isNull(), "INCONCLUSIVE").when(clean & usable, "PASS").when(usable, "MIXED").otherwise("FAIL").alias("verdict"))


def median_height() -> Column:
    """Aggregate: exact median of positive heights, 0 for none."""
    return F.coalesce(F.median(F.when(F.col("h") > 0, F.col("h"))), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def align(truth: list[str], read: list[str]) -> tuple[int, list[bool]]:
    """Edit distance of two token lists, and which of the read ones are right in one best alignment.

    Of equal alignments that is taken which, from the end, prefers a match or a replacement, then a
    missing token, then an extra one. Common ends are matched first."""
    head = 0
    while head < min(len(truth), len(read)) and truth[head] == read[head]:
        head += 1
    tail = 0
    while tail < min(len(truth), len(read)) - head and truth[-1 - tail] == read[-1 - tail]:
        tail += 1
    a, b = truth[head : len(truth) - tail], read[head : len(read) - tail]
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        last, now = rows[-1], [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j - 1] + (x != y), last[j] + 1, now[j - 1] + 1))
        rows.append(now)
    ok, i, j = [False] * len(b), len(a), len(b)
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            ok[j] = a[i] == b[j]
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return rows[-1][-1], [True] * head + ok + [True] * tail


def token_errors(rows: DataFrame, key: str, truth: str, read: str) -> DataFrame:
    """(key, distance, wer, accuracy, labels) of two columns of token arrays; null arrays count as empty."""

    def run(batches):
        for b in batches:
            both = [(t or [], r or []) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            found = [align(t, r) for t, r in both]
            sizes = [pa.array([len(x[k]) for x in both], pa.int32()) for k in (0, 1)]
            yield pa.record_batch([b.column(0), pa.array([d for d, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.bool_())), *sizes], [key, "distance", "labels", "n", "m"])

    kind = rows.schema[key].dataType.simpleString()
    errors = rows.select(key, truth, read).mapInArrow(run, f"{key} {kind}, distance int, labels array<boolean>, n int, m int")
    wer = F.when(F.col("n") == 0, F.when(F.col("m") == 0, 0.0).otherwise(1.0)).otherwise(F.col("distance") / F.col("n"))
    return errors.select(key, "distance", wer.alias("wer"), F.greatest(F.lit(0.0), 1 - wer).alias("accuracy"), "labels")
