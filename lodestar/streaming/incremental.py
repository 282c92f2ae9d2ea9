"""The streaming twin: changed files arrive, are extracted, merged and appended as a new snapshot of facts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.lineage import shared_folder


def incremental(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> None:
    """Each micro-batch of files(path, text) replaces its paths' facts. Facts are appended under their batch id and
    the newest batch of a path counts, so a batch that is run again after a failure overwrites its own folder only."""
    def take(batch: DataFrame, batch_id: int) -> None:
        seen = batch.select("path").distinct().withColumn("batch", F.lit(batch_id))
        found = extract(batch)
        seen.join(found, "path", "left").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def current(spark: SparkSession, store: str) -> DataFrame:
    """The facts of each path as of the last batch that had it."""
    rows = spark.read.parquet(store)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"])


def windows(events: DataFrame, length: str, slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums of events by event-time window and type, tumbling or sliding."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str = "10 minutes") -> DataFrame:
    """Extension: sessions of a user, apart by at least ``gap``."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def drained(result: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Runs a streaming result over what is there now and returns its rows."""
    base = f"{shared_folder(spark)}/stream-{os.urandom(8).hex()}"
    q = result.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out")
