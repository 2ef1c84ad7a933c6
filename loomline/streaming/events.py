"""The event log as a stream: idempotent appends, per-run sequences, progress, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import sequence_in
from ..registry import query
from ..sources.shared import shared_folder


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Event files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique_events(stream: DataFrame, key: str = "event_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it is sent; state older than the watermark goes."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, key: str = "event_type", time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; what is later than the watermark is left out."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), key, "n")
    )


def append_batch(path: str):
    """For foreachBatch: a batch's rows under its own number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_to_end(stream: DataFrame, folder: str, mode: str = "append", reader: SparkSession | None = None) -> DataFrame:
    """Run a stream over all there is, and read what it wrote, in the session `reader`. `folder` is one that all executors share; run again with
    it, the stream goes on from its checkpoint."""
    spark = reader or stream.sparkSession
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
    writer.foreachBatch(append_batch(f"{folder}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


@query("t5_t9_event_tail", "SELECT event_id, user_id, event_type FROM events")
def event_tail(t):
    """All events through a stream that reads each file once; `unique_events` is for senders that repeat themselves."""
    static = t.events
    stream = event_stream(t.spark, f"{t.folder}/events.parquet*", static.schema)
    return run_to_end(stream.select("event_id", "user_id", "event_type"), shared_folder(t.spark))


@query("t6_windowed_progress", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def windowed(t):
    """Hourly counts in update mode, the last of each window, summed; the stream is one run, so nothing is late."""
    stream = event_stream(t.spark, f"{t.folder}/events.parquet*", t.events.schema)
    hours = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    done = run_to_end(hours.select(F.col("w.start").alias("start"), "event_type", "n"), shared_folder(t.spark), "update")
    return done.groupBy("start", "event_type").agg(F.max("n").alias("n")).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("k8_append_once", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events")
def k8(t):
    """Events sent twice are appended once, with a gap-free sequence per run."""
    sent = t.events.select("event_id", "user_id")
    once = sent.union(sent.where("event_id % 3 = 0")).dropDuplicates(["event_id"])
    return sequence_in(once, "seq", ["user_id"], F.col("event_id")).select("event_id", "seq")
