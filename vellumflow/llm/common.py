"""Words, shared storage and small numeric helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a text with A-Z lower-cased and nothing else changed.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A word for the JVM's regular expressions; the same set as ``bytes.split()`` cuts by.
WORD = r"[^\x20\x09-\x0D]+"


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, A-Z lower-cased; a null text has none."""
    return text.encode().translate(LOWER).split() if text else []


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, as they stand; a null text has none."""
    return text.encode().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset, and only on a local master, a temporary folder takes its place."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if own := sc._jsc.sc().getCheckpointDir():
        if own.isDefined():
            return own.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vellumflow-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vellumflow/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, so any store will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def delete_at_exit(spark: SparkSession, path: str) -> Callable[[], None]:
    """Have a folder removed when the driver ends, whose results are read until then; the function that does so."""

    def remove() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(remove)
    return remove


class Table:
    """A result written to the shared folder: its lineage ends there, and losing executors loses nothing."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        self._at_exit = delete_at_exit(self.spark, self.path)

    def append(self, df: DataFrame) -> None:
        """Add rows; plans over the table stay as they are, however often it grows."""
        df.write.option("compression", "zstd").mode("append").parquet(self.path)
        self.df = self.spark.read.schema(self.df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)
        atexit.unregister(self._at_exit)


class Buckets(Table):
    """A result written in as many buckets of a column as there are shuffle partitions: joins on it move the other side alone.

    The catalog holds its name, the shared folder its files."""

    def __init__(self, df: DataFrame, name: str, key: str):
        self.spark, self.path, self.name = df.sparkSession, new_path(df.sparkSession, name), f"vellumflow_{name}_{uuid.uuid4().hex}"
        n = shuffle_partitions(self.spark)
        df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", self.path).saveAsTable(self.name)
        self.df = self.spark.table(self.name)
        self._at_exit = delete_at_exit(self.spark, self.path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        super().drop()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of a table in the shared folder."""
    return Table(df, name).df


def tidy(spark: SparkSession) -> None:
    """Have the driver let go of plans that are done with, so that Spark's cleaner removes their shuffle files.

    The cleaner waits for the driver's garbage collector, which a driver with room to spare seldom runs. What the
    collectors free goes back to the system, so that a driver of many small plans stays small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    try:
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(commands, "systemTrimNativeHeap", None, None)
    except Py4JError:  # a JVM that has no such command keeps its native memory
        pass


def give_back() -> None:
    """Return to the system what this process has freed; Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # a C library that has no such function keeps its memory
        pass


_STATE: dict[str, object] = {}


def worker_state(key: str, make):
    """make(), kept in this worker process under ``key`` until another operator keeps something of its own.

    A worker serves many tasks of many operators, so that it holds what one of them needs, not what all did."""
    if key not in _STATE:
        release_state()
        _STATE[key] = make()
    return _STATE[key]


def release_state() -> None:
    """Give up what another operator keeps in this worker process."""
    if _STATE:
        _STATE.clear()
        give_back()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (i, j) connect it with."""
    label = np.arange(n)
    while i.size:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def carried(docs: DataFrame, text_col: str, keep: list[str] | None = None):
    """(df, texts): ``df`` has doc, a struct of the columns to keep (all, if None), and ``texts`` reads a batch's texts.

    The text crosses to Python once, whether it is kept or not."""
    columns = docs.columns if keep is None else keep
    held = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in columns]).alias("doc")
    if text_col in columns:
        at = columns.index(text_col)
        return docs.select(held), lambda b: pc.struct_field(b.column(0), [at]).to_pylist()
    return docs.select(held, F.col(text_col).alias("text")), lambda b: b.column(1).to_pylist()
