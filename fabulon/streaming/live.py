"""Structured Streaming forms of replay and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """A stream of event files, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def live_counts(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by type in time windows; the watermark closes windows so that state stays bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n_events"))


def live_state(events: DataFrame) -> DataFrame:
    """The latest value of each target and key: an aggregate whose state is one row for each."""
    return events.groupBy("target_id", "key").agg(F.max_by("value", F.struct("learned", "seq")).alias("value"), F.count("*").alias("n_facts"))


def upsert_state(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Runs live_state over all there is and writes each batch's changed rows to a folder of its own number, so a retried batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return live_state(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def read_upserts(spark: SparkSession, out: str) -> DataFrame:
    """The state as of the last batch."""
    rows = spark.read.parquet(out)
    return rows.groupBy("target_id", "key").agg(F.max_by("value", "batch").alias("value"), F.max_by("n_facts", "batch").alias("n_facts"))
