"""Operator 4, sharding by Karmarkar-Karp differencing: near-equal bytes with equal texts kept together.

Groups of equal texts are the indivisible items. They are dealt by hash into blocks of bounded size, each
block is differenced into a partial partition, and blocks of partial partitions are differenced again,
level by level, until one is left. A level's table is smaller than the one below by the block size, and no
task sees more than a block, so the number of groups has no bound."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .differencing import difference, items

#: Groups, or partial partitions, that one task differences.
BLOCK = 4096
#: Rows of a shard that one task numbers.
NUMBERED = 50_000


def _dealt(groups: DataFrame, shards: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bytes", "descending"), ("g", "ascending"), ("crc", "ascending"), ("size", "ascending")])
        return t.append_column("slot", pa.array(items(t["bytes"].to_numpy(), shards), pa.int64()))

    return groups.groupBy("block").applyInArrow(run, "g bigint, size bigint, crc bigint, bytes bigint, block bigint, slot bigint")


def _joined(parts: DataFrame, shards: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        block, at = np.unique(t["block"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(block), shards), np.int64)
        sums[at, t["slot"].to_numpy()] = t["bytes"].to_numpy()
        return t.append_column("up_slot", pa.array(difference(sums)[at, t["slot"].to_numpy()], pa.int64()))

    return parts.withColumn("up", F.expr(f"block div {BLOCK}")).groupBy("up").applyInArrow(run, "block bigint, slot bigint, bytes bigint, up bigint, up_slot bigint")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row's shard and its gapless place there.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty and shares a group with empty
    texts. Rows of equal text share a shard, unless ids say otherwise never apart. Repeated rows keep a
    place each; null ids are placed like others. An empty table gives an empty table. Columns besides
    the two named are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a group is known by 128 bits of hash and its length, so texts are not shuffled; a clash would only merge two groups
    rows = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("g"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc")), "sizes")
    groups = rows.groupBy("g", "size", "crc").agg(F.sum("size").alias("bytes"))
    n = max(1, math.ceil(groups.count() / BLOCK))
    dealt = written(_dealt(groups.withColumn("block", F.pmod(F.xxhash64("crc", "g", "size"), F.lit(n))), shards), "dealt")
    place = dealt.groupBy("block", "slot").agg(F.sum("bytes").alias("bytes")).select("block", "slot", F.col("block").alias("top"), F.col("slot").alias("shard"), "bytes")
    while n > 1:
        n = math.ceil(n / BLOCK)
        parts = place.groupBy(F.col("top").alias("block"), F.col("shard").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        level = _joined(parts, shards).select(F.col("block").alias("top"), F.col("slot").alias("shard"), "up", "up_slot")
        place = written(place.join(level, ["top", "shard"]).select("block", "slot", F.col("up").alias("top"), F.col("up_slot").alias("shard"), "bytes"), "level")
    put = dealt.join(place.select("block", "slot", "shard"), ["block", "slot"]).select("g", "size", "crc", "shard")
    found = written(rows.join(put, ["g", "size", "crc"]).select("id", "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.xxhash64("id", "g", F.monotonically_increasing_id()).alias("lot")), "shards")
    buckets = max(shuffle_partitions(docs.sparkSession), math.ceil(found.count() / (shards * NUMBERED)))
    # rows that repeat an id and a text are spread as well
    found = found.withColumn("bucket", F.pmod("lot", F.lit(buckets))).drop("lot")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = found.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32"))
    return found.withColumn("number", number).join(first, ["shard", "bucket"]).select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("number") - 1).cast("bigint").alias("slot"))
