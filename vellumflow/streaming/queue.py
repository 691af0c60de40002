"""The page queue: pages land as files, a stream takes them up in micro-batches, and each is run on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PAGE = "event_id string, job_id string, page string, ts timestamp"


def page_events(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """Uploaded pages as a stream of JSON lines, each event once though an upload may be retried."""
    events = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_a_batch).json(folder)
    return events.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])


def run_pages(events: DataFrame, run: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Run each micro-batch of pages and append its outcomes; a failing batch is written as such and does not stop the stream.

    Progress is in the checkpoint, so a restart neither loses nor repeats pages. Without ``seconds`` the
    stream takes up what is there and ends."""

    def one(batch: DataFrame, number: int) -> None:
        try:
            outcome = run(batch).withColumn("error", F.lit(None).cast("string"))
            outcome.write.mode("overwrite").json(f"{results}/batch={number}")
        except Exception as e:  # noqa: BLE001  isolation is the point
            failed = batch.select("job_id", "page").withColumns({"ok": F.lit(False), "error": F.lit(str(e)[:500])})
            failed.write.mode("overwrite").json(f"{results}/batch={number}")

    writer = events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()
