"""The operation log as a stream against a plain fold, with repeats, disorder, several batches and a restart."""

import datetime
import hashlib
import json
import random

import pandas as pd
from pyspark.sql import functions as F

from quillmark.streaming import operations

BEGIN = datetime.datetime(2024, 1, 1)
LOG = "operation_id string, event_id long, ts timestamp, status string"


def plain(rows):
    out = {}
    for key in {r[0] for r in rows}:
        events = sorted({(r[2], r[1], r[3]) for r in rows if r[0] == key})
        illegal = sum(a != b and (a, b) not in operations.TRANSITIONS for (*_, a), (*_, b) in zip(events, events[1:], strict=False))
        out[key] = (len(events), events[-1][2], events[-1][1], illegal)
    return out


def events(n, seed):
    r = random.Random(seed)
    names = ["planned", "running", "completed", "failed", "superseded"]
    return [(f"op{r.randrange(6)}", k, BEGIN + datetime.timedelta(minutes=k, microseconds=r.randrange(10)), r.choice(names)) for k in range(n)]


def test_replays_disorder_and_restart(spark, tmp_path):
    rows = events(160, 1)
    r, folder, out = random.Random(2), f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    parts = [rows[:60], rows[50:110] + rows[100:120], rows[:30] + rows[110:]]  # overlapping, repeated
    def write(part):
        part = part + r.sample(part, 10)
        r.shuffle(part)
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(folder)
    def run():
        source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
        return {x.operation_id: tuple(x)[1:] for x in operations.run_operations(spark, source, out, delay="10 hours").collect()}
    write(parts[0])
    assert run() == plain(rows[:60])
    write(parts[1])
    write(parts[2])
    assert run() == plain(rows)
    assert run() == plain(rows)  # nothing new: nothing repeated


def test_settled_events_leave_the_state(spark, tmp_path):
    rows, folder, out = events(300, 3), f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    for k in range(0, 300, 60):
        spark.createDataFrame(rows[k : k + 60], LOG).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(LOG).parquet(folder)
        got = {x.operation_id: tuple(x)[1:] for x in operations.run_operations(spark, source, out, delay="20 minutes").collect()}
    assert got == plain(rows)
    last = spark.read.parquet(f"{out}/view").groupBy("operation_id").agg(F.max_by("waiting", "batch").alias("w"), F.max_by("n_events", "batch").alias("n"))
    assert all(x.w < x.n for x in last.collect())


def test_ids(spark):
    df = spark.createDataFrame([('k"é', 7)], "kind string, key long")
    got = df.select(operations.operation_id(F.lit("w"), F.col("kind"), F.col("key"), "v")).first()[0]
    want = json.dumps({"schema_version": "v", "workspace_id": "w", "operation_type": 'k"é', "idempotency_key": "7"}, ensure_ascii=False, sort_keys=True)
    assert got == "op_" + hashlib.sha256(want.encode()).hexdigest()[:16]


class State:
    """One operation's state, which counts its writes."""

    exists, hasTimedOut, watermark, writes, timeout = False, False, 0, 0, None

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.watermark

    def update(self, value):
        self.get, self.exists, self.writes = value, True, self.writes + 1

    def setTimeoutTimestamp(self, at):  # noqa: N802
        assert at > self.watermark
        self.timeout = at


def test_a_batch_writes_the_state_once():
    frame = lambda *rows: pd.DataFrame(rows, columns=["event_id", "micros", "status"])
    state = State()
    (out,) = operations.step(("op",), iter([frame((1, 5000, "planned"), (3, 9000, "completed")), frame((3, 9000, "completed"))]), state)
    assert out.values.tolist() == [["op", 2, "completed", 3, 1, 2]] and state.writes == 1 and state.timeout == 6
    state.watermark = 6
    (out,) = operations.step(("op",), iter([frame((2, 8000, "running"))]), state)
    assert out.values.tolist() == [["op", 3, "completed", 3, 0, 2]] and state.writes == 2 and state.timeout == 9
    state.watermark, state.hasTimedOut = 20, True
    assert not list(operations.step(("op",), iter(()), state))
    assert state.get == (3, "completed", 3, 0, 9000, [], [], []) and state.writes == 3
