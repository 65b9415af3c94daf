"""The operation log as a stateful stream: idempotent ids, ordered transitions, a state that stays small.

Events of an operation may come late, out of order, or again.  Those that the watermark has not passed
wait in the operation's state under their own id, so that a repeated one changes nothing; a timer folds
them into one row once the watermark has passed them.  Every batch emits the operations that it touched,
as folded from all that is known.  After a restart the checkpoint goes on where it stood.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.session import shared_root

# What an operation's status may change to; the same status again changes nothing.
TRANSITIONS = frozenset(
    {("planned", "running"), ("planned", "superseded"), ("running", "completed"), ("running", "failed"), ("failed", "running"), ("failed", "superseded"), ("completed", "superseded")}
)
#: Fixed value: part of every id.
VERSION = "maintenance.operation_log.v0.4"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "n long, status string, event_id long, illegal long, micros long, ids array<long>, times array<long>, said array<string>"
OUT = "operation_id string, n_events long, status string, event_id long, illegal long, waiting long"


def operation_id(workspace: Column, kind: Column, key: Column, version: str) -> Column:
    """An id that the same workspace, type and idempotency key always get."""
    text = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
    fields = (("idempotency_key", key), ("operation_type", kind), ("schema_version", F.lit(version)), ("workspace_id", workspace))
    spelled = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), text(v.cast("string"))) for k, v in fields]), F.lit("}"))
    return F.concat(F.lit("op_"), F.substring(F.sha2(F.encode(spelled, "UTF-8"), 256), 1, 16))


def fold(state: tuple, events: Iterable[tuple]) -> tuple:
    """(n, status, event_id, illegal, micros) after more events (micros, event_id, status), which come in their order."""
    n, status, last, illegal, at = state
    for micros, event, new in events:
        illegal += int(status is not None and new != status and (status, new) not in TRANSITIONS)
        n, status, last, at = n + 1, new, event, micros
    return n, status, last, illegal, at


def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One operation's batch: what is settled, and the events that wait by their id, are one row of state, read and written once."""
    settled, waiting = (0, None, None, 0, None), {}
    if state.exists:
        *settled, ids, times, said = state.get
        waiting = dict(zip(ids, zip(times, said, strict=True), strict=True))
    if not state.hasTimedOut:
        for frame in frames:
            waiting.update(zip(frame["event_id"].tolist(), zip(frame["micros"].tolist(), frame["status"].tolist(), strict=True), strict=True))
    events = sorted(((micros, event, status) for event, (micros, status) in waiting.items()), key=lambda e: e[:2])
    passed = state.getCurrentWatermarkMs() * 1000  # no such event is let in after this batch
    over = [e for e in events if e[0] <= passed]
    left = events[len(over) :]
    settled = fold(tuple(settled), over)
    state.update((*settled, [e[1] for e in left], [e[0] for e in left], [e[2] for e in left]))
    if left:
        state.setTimeoutTimestamp(left[0][0] // 1000 + 1)
    if not state.hasTimedOut:
        n, status, event, illegal, _ = fold(settled, left)
        yield pd.DataFrame({"operation_id": [key[0]], "n_events": [n], "status": [status], "event_id": [event], "illegal": [illegal], "waiting": [len(left)]})


def operation_states(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream of touched operations from a stream of (operation_id, event_id, ts, status).

    Events that come later than ``delay`` behind the newest are dropped.  Null ids and times are left out.
    """
    rows = events.where("operation_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL")
    rows = rows.select("operation_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "status").withColumn("micros", F.unix_micros("ts"))
    keyed = rows.withWatermark("ts", delay).groupBy("operation_id")
    return keyed.applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_operations(spark: SparkSession, source: DataFrame, out: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Process all that is there, from where ``out`` stands, and return the view: the last state of every operation."""
    out = out or f"{shared_root(spark)}/quillmark/operations-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def upsert(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/view/batch={number}")

    try:
        stream = operation_states(source, delay).writeStream.outputMode("update").option("checkpointLocation", f"{out}/progress")
        stream.foreachBatch(upsert).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    fields = ("n_events", "status", "event_id", "illegal")
    last = spark.read.parquet(f"{out}/view").groupBy("operation_id").agg(F.max_by(F.struct(*fields), "batch").alias("r"))
    return last.select("operation_id", "r.*")


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream."""
    folder, name = os.path.split(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)
