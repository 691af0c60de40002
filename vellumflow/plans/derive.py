"""Word, box and frame tables derived from the plain tables by integer arithmetic alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(rows: DataFrame, key: str, text: str = "text", *keep: str) -> DataFrame:
    """(key, pos, token) of whole texts, cut at blanks, tabs and line ends."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+$", ""), r"[ \t\n\r]+")
    return rows.select(key, *keep, F.posexplode(cut).alias("pos", "token")).filter("token <> ''")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with confidence, a second reader's disagreement, truth, and a place on the page."""
    w = tokens(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    w = w.withColumn("h", F.expr("(doc_id * 7919 + pos * 104729) % 1000"))
    w = w.withColumn("conf", F.expr("greatest(0, 10000 - (h * h * (10 + doc_id % 100)) div 10000) / 100.0D"))
    line = "cast(pos div 10 as int)"
    return w.selectExpr(
        "doc_id", "lang", "source", "pos", "token", "conf",
        "(doc_id + pos * 31) % 97 = 0 as disagree", "(doc_id * 13 + pos * 17) % 10 = 0 as is_wrong",
        f"{line} as line", f"cast({line} div 5 as int) as block", "cast(pos % 50 as int) as word",
        "cast((pos % 10) * 60 + if(pos % 11 = 0, 700, 0) as int) as x", f"cast({line} * 24 as int) as y", "50 as w", "18 as h",
    )


#: What a word has beside its place and token, of its document's number and its place.
OF_WORD = {
    "conf": "greatest(0, 10000 - (((doc_id * 7919 + pos * 104729) % 1000) * ((doc_id * 7919 + pos * 104729) % 1000) * (10 + doc_id % 100)) div 10000) / 100.0D",
    "disagree": "(doc_id + pos * 31) % 97 = 0", "is_wrong": "(doc_id * 13 + pos * 17) % 10 = 0",
    "line": "cast(pos div 10 as int)", "block": "cast(pos div 50 as int)", "word": "cast(pos % 50 as int)",
    "x": "cast((pos % 10) * 60 + if(pos % 11 = 0, 700, 0) as int)", "y": "cast(pos div 10 * 24 as int)", "w": "50", "h": "18",
}


def cut_rows(spark: SparkSession, sf_dir: str, blank: bool = False) -> DataFrame:
    """(doc_id, lang, source, cut): documents with the array of their tokens; those without any are left out, or have a null.

    Documents are dealt out anew where their files make fewer tasks than there are cores."""
    d, n = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), spark.sparkContext.defaultParallelism
    d = d if d.rdd.getNumPartitions() >= n else d.repartition(n, "doc_id")
    trimmed = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    d = d.select("doc_id", "lang", "source", F.nullif(trimmed, F.lit("")).alias("text"))
    return (d if blank else d.filter("text is not null")).select("doc_id", "lang", "source", F.split("text", r"[ \t\n\r]+").alias("cut"))


def word_rows(spark: SparkSession, sf_dir: str, *fields: str, **made: str) -> DataFrame:
    """(doc_id, lang, source, words): the words of ``words`` inside their document's row, in order, with pos and what is asked for.

    ``fields`` are columns of ``words``, ``made`` further ones as SQL over doc_id, pos and token."""
    return cut_rows(spark, sf_dir).select("doc_id", "lang", "source", word_array(*fields, **made).alias("words"))


def word_array(*fields: str, **made: str) -> Column:
    """The words of ``cut`` with pos and what is asked for, as ``word_rows`` has it."""
    of = {f: "token" if f == "token" else OF_WORD[f] for f in fields} | made
    one = ", ".join(["'pos', pos", *[f"'{c}', {e}" for c, e in of.items()]])
    return F.expr(f"transform(cut, (token, pos) -> named_struct({one}))")


#: The blocks of ``blocks`` (block, x, y, w, h) of a document's ``cut``, the wide ones alone, and its lines (line).
WIDE = "named_struct('block', cast(b * 2 as int), 'x', 0, 'y', cast(b * 120 as int), 'w', 600, 'h', 114)"
BLOCK_ARRAY = f"""flatten(transform(sequence(0, cast((size(cut) - 1) div 50 as int)), b -> if(b % 3 = 0, array({WIDE},
  named_struct('block', cast(b * 2 + 1 as int), 'x', 120, 'y', cast(b * 120 as int), 'w', 240, 'h', 60)), array({WIDE}))))"""
LINES = "sequence(0, cast((size(cut) - 1) div 10 as int))"


def word_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, words): the same words as an array of what decisions need."""
    return word_rows(spark, sf_dir, "token", "conf", "disagree")


WORDS_SQL = """
cut AS (
  SELECT doc_id, lang, source, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+')) AS token,
    generate_subscripts(string_split_regex(regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+'), 1) - 1 AS pos
  FROM documents
), cut_h AS (SELECT *, (doc_id * 7919 + pos * 104729) % 1000 AS hh FROM cut WHERE token <> ''),
w AS (
  SELECT doc_id, lang, source, pos, token, greatest(0, 10000 - (hh * hh * (10 + doc_id % 100)) // 10000) / 100.0 AS conf,
    (doc_id + pos * 31) % 97 = 0 AS disagree, (doc_id * 13 + pos * 17) % 10 = 0 AS is_wrong,
    pos // 10 AS line, pos // 50 AS block, pos % 50 AS word,
    (pos % 10) * 60 + CASE WHEN pos % 11 = 0 THEN 700 ELSE 0 END AS x, (pos // 10) * 24 AS y, 50 AS w, 18 AS h
  FROM cut_h
)
"""


def blocks(w: DataFrame) -> DataFrame:
    """(doc_id, block, bbox): a page-wide block for every 50 words, and a narrow one inside every third."""
    whole = w.select("doc_id", F.col("block").alias("b")).distinct()
    wide = whole.selectExpr("doc_id", "b * 2 as block", "named_struct('x', 0, 'y', b * 120, 'w', 600, 'h', 114) as bbox")
    narrow = whole.filter("b % 3 = 0").selectExpr("doc_id", "b * 2 + 1 as block", "named_struct('x', 120, 'y', b * 120, 'w', 240, 'h', 60) as bbox")
    return wide.union(narrow)


BLOCKS_SQL = """
bs AS (SELECT DISTINCT doc_id, block AS b FROM w),
bl AS (
  SELECT doc_id, b * 2 AS block, 0 AS x0, b * 120 AS y0, 600 AS bw, 114 AS bh FROM bs
  UNION ALL SELECT doc_id, b * 2 + 1, 120, b * 120, 240, 60 FROM bs WHERE b % 3 = 0
)
"""


def boxed(w: DataFrame) -> DataFrame:
    return w.withColumn("box", F.struct("x", "y", "w", "h"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a device: sharpness from the value, stability and area from the number."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as device", "event_id as frame", "value as sharpness", "cast((event_id * 37) % 11 as double) as stability",
        "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000 as timestamp_ms", "(event_id * 53) % 97 + 1 as area",
    )


FRAMES_SQL = """
f AS (
  SELECT user_id AS device, event_id AS frame, value AS sharpness, CAST((event_id * 37) % 11 AS DOUBLE) AS stability,
    epoch_us(ts) // 1000 AS timestamp_ms, (event_id * 53) % 97 + 1 AS area FROM events
)
"""
