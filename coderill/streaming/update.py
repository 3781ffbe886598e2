"""Incremental update of the index by Structured Streaming.

Deliveries of files arrive as a stream; every micro-batch replaces what was derived from the files it brings, so that the tables after the
last batch equal those of a batch build over all deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key does not come again, and all of ``rows``."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def latest_file_versions(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, target: str) -> None:
    """Stream the deliveries in ``source`` (Parquet files of ``schema``) into ``target``, one folder a batch, each with the newest
    version of every file in the batch; :func:`current` reads the state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        row = F.struct("repo_id", "file_path", "file_lines", "ingested_at")
        one = batch.groupBy("file_id").agg(F.max_by(row, "ingested_at").alias("r")).select("file_id", "r.*")
        one.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of every file over all batches."""
    rows = spark.read.parquet(target)
    return rows.groupBy("file_id").agg(F.max_by(F.struct("repo_id", "file_path", "file_lines", "ingested_at"), "ingested_at").alias("r")).select("file_id", "r.*")


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events and their values per type and window of event time; works on streams and tables alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", f"{minutes} minutes")
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total_value")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total_value")
