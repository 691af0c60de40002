"""Operator 6, URL filters: a blocked Bloom filter of listed URLs, then an exact hash join.

The list holds canonical URLs: a lower-case host and the beginning of a path. A URL can hit a listed entry
only by a suffix of its host at a dot and a prefix of its path as long as some listed path. These
candidates are tested in the filter, where all bits of a key lie in one 64-bit block; rows with possible
hits go to a join with the list, which removes the false positives, and no other row is shuffled. The filter
is built by OR-ing bits per block, its size is bounded, and a list beyond that bound only passes more
candidates on to the join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed key; 64-bit blocks at most (32 MB).
BITS_PER_KEY, MAX_BLOCKS = 16, 1 << 22
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def _bits(key: Column) -> Column:
    """Four of the 64 bits of a block, by a second hash of the key."""
    h, one = F.xxhash64(key, F.lit(1)), F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def judge(pages: DataFrame, listed: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict): the longest listed entry that fits each row's URL, else ``otherwise``.

    ``listed`` has host, path (empty or beginning with /) and verdict. An entry fits its host and all
    subdomains where the path begins with the entry's. The longest is that with most characters of host
    and path together, of these that with the longer host; of repeated entries the largest verdict holds.
    Null URLs and those without :// have empty host and path. Every row is returned, repeated rows too;
    an empty list judges all rows ``otherwise``; other columns are not read."""
    entries = listed.filter("host is not null and path is not null").groupBy(F.concat("host", "path").alias("key"), F.col("host").alias("at"), F.col("path").alias("under")).agg(F.max("verdict").alias("verdict"))
    facts = entries.agg(F.count("*").alias("n"), F.max(F.size(F.split("at", r"\."))).alias("labels"), F.collect_set(F.length("under")).alias("lengths")).first()
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not facts.n:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    blocks = min(MAX_BLOCKS, max(1, -(-facts.n * BITS_PER_KEY // 64)))
    words = entries.groupBy(_block(F.col("key"), F.lit(blocks)).alias("block")).agg(F.bit_or(_bits(F.col("key"))).alias("bits")).toArrow()  # MAX_BLOCKS rows at most
    bloom = np.zeros(blocks, np.int64)
    bloom[words["block"].to_numpy()] = words["bits"].to_numpy()
    held = pages.sparkSession.sparkContext.broadcast(bloom)  # 32 MB at most

    labels = F.split("host", r"\.")
    deep = F.least(F.size(labels), F.lit(facts.labels))
    suffixes = F.transform(F.sequence(F.lit(1), deep), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    prefixes = F.transform(F.filter(F.lit(sorted(facts.lengths)), lambda n: n <= F.length("path")), lambda n: F.struct(n.alias("n"), F.substring("path", F.lit(1), n).alias("p")))
    candidates = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p.p).alias("key"), s.alias("at")))))
    hashed = F.transform(candidates, lambda c: F.struct(c["key"].alias("key"), c["at"].alias("at"), _block(c["key"], F.lit(blocks)).alias("block"), _bits(c["key"]).alias("bits")))

    def test(batches):
        table = held.value
        for b in batches:
            c = b.column(3)
            flat, ends = c.flatten(), np.cumsum(np.concatenate(([0], pc.list_value_length(c).to_numpy())))
            bits = flat.field("bits").to_numpy()
            ok = (table[flat.field("block").to_numpy()] & bits) == bits
            hits = np.concatenate(([0], np.cumsum(ok)))[ends]
            kept = pa.StructArray.from_arrays([flat.field(k).filter(pa.array(ok)) for k in ("key", "at")], ["key", "at"])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.ListArray.from_arrays(pa.array(hits, pa.int32()), kept)], ["id", "host", "path", "hits"])

    kind = urls.schema["id"].dataType.simpleString()
    tested = urls.withColumn("candidates", hashed).mapInArrow(test, f"id {kind}, host string, path string, hits array<struct<key:string,at:string>>")
    # rows that the filter passes go on to the join, all others are judged where they lie
    clear = tested.filter(F.size("hits") == 0).select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    passed = tested.filter(F.size("hits") > 0)
    hits = passed.groupBy("host", "path").agg(F.first("hits").alias("hits")).select("host", "path", F.explode("hits").alias("c"))
    exact = hits.join(entries, (F.col("c.key") == entries.key) & (F.col("c.at") == entries["at"]))
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.length("at").alias("m"), "key", "verdict")).alias("best"))
    judged = passed.join(best, ["host", "path"], "left").select("id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
    return clear.union(judged)
