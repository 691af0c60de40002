"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round reads a written table and writes the next one, so lineage stays short and a lost executor
costs one round at most. Minima are combined before the shuffle, and a node with many links spreads over
the join's partitions, which adaptive execution splits. Nothing is gathered on the driver but two numbers
a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, shuffle_partitions, tidy

#: Links of a round's table that go to one file.
LINKS = 20_000


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest of that node's neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all point to the smallest of these."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def turned(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller end, each once; rows with a null end or equal ends are left out."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def nearby(links: DataFrame, rounds: int = 2) -> Table:
    """(node, component): a smaller node that each node is connected with, after so many rounds.

    Nodes of one component need not have the same one yet, but nodes of different ones never do."""
    now = Table(turned(links), "links")
    for _ in range(rounds):
        after = Table(_small_star(_large_star(now.df)).distinct(), "links")
        now.drop()
        now = after
    found = Table(now.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "near")
    now.drop()
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that a link (a, b) names; component is the smallest node reachable.

    Links may repeat, point either way or join a node with itself; rows with a null end are ignored.
    No links give an empty table."""
    most = shuffle_partitions(links.sparkSession)
    now, seen = Table(turned(links), "links"), None
    while True:
        size = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == seen or size[0] == 0:
            break
        seen = size
        # few links need few files; a round leaves about as many as it found
        after = Table(_small_star(_large_star(now.df)).distinct().coalesce(min(most, 1 + size[0] // LINKS)), "links")
        now.drop()
        now = after
        tidy(links.sparkSession)
    # in a star forest no centre points anywhere, so each node has one row
    centres = now.df.select(F.col("b").alias("node")).distinct()
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres.select("node", F.col("node").alias("component")))
