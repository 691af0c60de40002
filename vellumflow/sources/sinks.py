"""Sinks: documents with a backup, appended reports, grades as JSON."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, gone when the driver ends.

    That is spark.checkpoint.dir; only where it is unset, and on a local master, a temporary folder stands in."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="vellumflow-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    path = f"{root.rstrip('/')}/vellumflow/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            store, of = _store(spark, path)
            store.delete(of(path), True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(remove)
    return path


def save_documents(documents: DataFrame, path: str) -> None:
    """Replace a folder of documents whole, one in each line of its files; the former one is kept as ``path``.bak.

    The new one is written aside and normalised marks of edits are the caller's. A run that dies between the
    two renames leaves the former as ``path``.bak and the new one as ``path``.new: the next call, or
    ``recover``, finishes it."""
    spark = documents.sparkSession
    recover(spark, path)
    store, of = _store(spark, path)
    documents.write.mode("overwrite").json(f"{path}.new")
    if store.exists(of(path)):
        store.delete(of(f"{path}.bak"), True)
        _renamed(store, of, path, f"{path}.bak")
    _renamed(store, of, f"{path}.new", path)


def _renamed(store, of, old: str, new: str) -> None:
    if not store.rename(of(old), of(new)):
        raise OSError(f"{old} could not be renamed to {new}")


def recover(spark: SparkSession, path: str) -> None:
    """Finish a save that died: with no current folder, the complete new one takes its place, else the former."""
    store, of = _store(spark, path)
    if store.exists(of(path)):
        return
    for aside in (f"{path}.new", f"{path}.bak"):
        if store.exists(of(f"{aside}/_SUCCESS")):
            _renamed(store, of, aside, path)
            return


def append_report(lines: DataFrame, path: str) -> None:
    """Add the lines (ord, line) to a report folder, in order; what is there stays."""
    lines.orderBy("ord").select("line").coalesce(1).write.mode("append").text(path)


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("—")) for c in cells]), F.lit(" |"))


def report_lines(rows: DataFrame, title: str, columns: list[str]) -> DataFrame:
    """(ord, line): a title, a table's head and a line for each row of an already small, grouped result."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, f"## {title}"), (1, "| " + " | ".join(columns) + " |"), (2, "|" + "---|" * len(columns))], "ord int, line string")
    body = rows.select(F.lit(3).alias("ord"), markdown_row(*[F.col(c) for c in columns]).alias("line"))
    return head.union(body)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))
