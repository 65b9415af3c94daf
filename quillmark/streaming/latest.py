"""Structured Streaming: append-only events, deduplicated, into a keyed latest view."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmark-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def stream_latest(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, event_type, n, last_event): the state after all available events.

    The stream aggregates by key with map-side combining and writes each batch's upserts; the view
    takes the last upsert of a key.  Progress and output are in the shared folder, so a restart goes on.
    """
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path)
    source = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)
    out = _shared(spark)
    state = source.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).alias("last"))

    def upsert(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/view/batch={number}")

    running = state.writeStream.outputMode("update").option("checkpointLocation", f"{out}/progress").foreachBatch(upsert).trigger(availableNow=True).start()
    running.awaitTermination()
    upserts = spark.read.parquet(f"{out}/view")
    rows = upserts.groupBy("user_id", "event_type").agg(F.max_by(F.struct("n", "last"), "batch").alias("r"))
    return rows.select("user_id", "event_type", "r.n", F.col("r.last.event_id").alias("last_event"))


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and type, with a watermark; for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
