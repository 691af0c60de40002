"""Operator 9, mixing sources to target weights by hash-threshold histograms.

Each source takes a whole number of copies of all its documents and one more of those whose hash is under
a threshold. The thresholds come from histograms of tokens by source and hash bucket: the bucket in which
a source's budget runs out is found from running sums and is alone refined, by the next bits of the hash,
until it holds one hash. Nothing is sorted, a larger budget keeps every document that a smaller one took,
and a hot source is summed up before any shuffle like all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Table, shuffle_partitions, written

#: Weights of the sources in order of their names' code points, null last, repeated as needed.
WEIGHTS = (5.0, 2.0, 1.0)
#: Bits of the hash, and those of them that one histogram resolves.
HASH_BITS, STEP_BITS = 60, 10
#: Sources up to which their table is broadcast; the tables of more are joined by shuffling.
BROADCAST = 50_000


def _known(source: Column) -> Column:
    """A source's name in joins, which a null has too; it sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, their place by name: counted by ranges of names, so no task sorts all of them."""
    spread = written(sources.repartitionByRange(shuffle_partitions(sources.sparkSession), "known").withColumn("part", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    first = spread.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("known")) - 1
    return spread.withColumn("place", place).join(F.broadcast(first), "part").withColumn("rank", F.col("first") + F.col("place")).drop("part", "first", "place")


def targets(sources: DataFrame, budget: float, most: float, weights=WEIGHTS) -> DataFrame:
    """sources (known, source_size) with target: ``budget`` times all sizes, shared by weight.

    A source gets ``most`` times its size at most and leaves the rest to the others, by weight again. Each
    round is one sum over the sources; those that are full stay so."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    found = written(ranked(sources).withColumns({"weight": weight, "full": F.lit(most) * F.col("source_size")}).drop("rank"), "sources")
    total = found.agg(F.sum("source_size")).first()[0] or 0
    per, past = 0.0, -1.0
    while per > past:
        past = per
        left = F.col("weight") * past <= F.col("full") if past else F.lit(True)
        got = found.agg(F.sum(F.when(left, F.col("weight"))).alias("w"), F.sum(F.when(~left, F.col("full"))).alias("full")).first()
        if not got.w:  # all are full
            break
        per = (budget * total - (got.full or 0.0)) / got.w
    share = F.col("weight") * F.lit(per)
    return found.withColumn("target", F.least(share, F.col("full"))).drop("weight", "full")


def _thresholds(rows: DataFrame, plan: DataFrame, held) -> DataFrame:
    """(known, threshold): the hash under which a source's documents hold its ``rest`` of tokens, as near as whole documents come.

    ``plan`` is (known, rest). The state of the search is a table with a row for each source; ``held`` says how it is joined."""
    none = F.lit(None).cast("bigint")
    state = Table(plan.select("known", F.lit(0).cast("bigint").alias("prefix"), "rest", F.when(F.col("rest") <= 0, F.lit(0).cast("bigint")).otherwise(none).alias("threshold")), "state")
    for level in range(1, HASH_BITS // STEP_BITS + 1):
        open_ = state.df.filter("threshold is null").select("known", "prefix", "rest")
        if open_.isEmpty():
            break
        shift = HASH_BITS - STEP_BITS * level
        here = rows.withColumn("prefix", F.shiftright("hash", shift + STEP_BITS)).join(held(open_), ["known", "prefix"])
        bins = here.groupBy("known", F.shiftright("hash", shift).alias("bin"), "rest").agg(F.sum("size").alias("tokens"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        upto = F.sum("tokens").over(Window.partitionBy("known").orderBy("bin"))
        crossed = bins.withColumn("upto", upto).filter("upto > rest").groupBy("known").agg(F.min(F.struct("bin", "upto", "tokens", "low", "high")).alias("x"))
        now, x = state.df.join(crossed, "known", "left"), F.col("x")
        below = x["upto"] - x["tokens"]
        one = F.when(x["upto"] - F.col("rest") < F.col("rest") - below, x["low"] + 1).otherwise(x["low"])  # one hash: all of it or none, whichever is nearer
        # rounding alone can leave a budget that no bucket exceeds
        threshold = F.when(F.col("threshold").isNotNull(), F.col("threshold")).when(x.isNull(), F.lit(1 << HASH_BITS)).when(x["low"] == x["high"], one)
        after = Table(now.select("known", F.coalesce(x["bin"], "prefix").alias("prefix"), F.when(x.isNull(), F.col("rest")).otherwise(F.col("rest") - below).alias("rest"), threshold.alias("threshold")), "state")
        state.drop()
        state = after
    return state.df.select("known", "threshold")


def mix(docs: DataFrame, budget: float = 1.5, most: float = 2.0, weights=WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc, size, source_size, target, copies): how often the mix takes each row.

    doc is a struct of all columns of the row, whatever their names. size counts words (null text: 0),
    source_size and target are of the row's source; a null source is a source of its own, the last.
    copies is floor(target / source_size), and one more under the source's threshold. Rows of the same
    id and text share a hash and so a fate; a null id hashes as such. Sources without words have target 0
    and copies 0. An empty table gives an empty table. There may be any number of sources: their tables are
    joined, and broadcast only if they have BROADCAST rows at most."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    mark = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 64 - HASH_BITS)
    plain = docs.select(F.struct("*").alias("doc"), _known(F.col(source_col).cast("string")).alias("known"), size.alias("size"), mark.alias("hash"))
    rows = written(plain.select("known", "size", "hash"), "sizes")
    sources = targets(rows.groupBy("known").agg(F.sum("size").alias("source_size")), budget, most, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = written(sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "plan")
    few = plan.count() <= BROADCAST
    held = F.broadcast if few else (lambda df: df.hint("merge"))
    cut = written(plan.join(_thresholds(rows, plan, held), "known").select("known", "source_size", "target", "whole", "threshold"), "thresholds")
    copies = F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return plain.join(held(cut), "known").select("doc", "size", "source_size", "target", copies.cast("int").alias("copies"))
