"""Cohort retention by secondary sort.

Clicks are shuffled once, by client, and sorted by time inside each task; a scan over Arrow batches
then meets a client's clicks in order.  The first purchase it meets is the client's start, equal rows
follow each other, and a change of the period emits the client once for the period, so that distinct
users are counted by adding ones.  A task holds one batch and the periods of one client.

A client with more than 1/4096 of all rows (so at most 4096 of them, whatever the size of the input)
is dealt to several pieces by the row's hash.  What the scan cannot know of such a client from one
piece, its starts, comes from an aggregate and is broadcast; its periods are added up over the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A client with more than this share of all rows is dealt to pieces; hence at most so many clients are.
HOT_CLIENTS = 4096
#: Stored bytes of the clicks that a task sorts.
TASK_BYTES = 64 << 20
COHORT_DAYS = PERIOD_DAYS = 3
DAY = 86_400_000_000
KNOWN_BEFORE = "2024-03-01 00:00:00"
NEVER = np.iinfo(np.int64).max

RUNS = "client_id long, state int, cohort long, period long, moved boolean, cents long, piece int"


def _columns(clicks: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in clicks.columns]


def known_clicks(clicks: DataFrame, start_kind: str = "purchase") -> DataFrame:
    """The scan's columns of every click with a time and a client; nothing else is shuffled.

    ``id1`` and ``id2`` are 128 bits over all columns and over which of them are null: they stand for
    the whole row when equal rows are counted once.  A null ``arrived_at`` is not known in state 0,
    a null ``click_id`` is never late, a null or undefined value is 0 cents.
    """
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("string") for c in clicks.columns])
    late = F.crc32(F.col("click_id").cast("string"))
    days = F.when(late % 3 == 0, (late % 100).cast("int")).otherwise(0)
    arrives = F.col("arrived_at").cast("timestamp_ntz") + F.make_dt_interval(days)
    known = F.coalesce(arrives < F.lit(KNOWN_BEFORE).cast("timestamp_ntz"), F.lit(False))
    cents = F.floor(100 * F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)) + 0.5)
    begins = F.coalesce(F.col("kind") == start_kind, F.lit(False))
    rows = clicks.where(F.col("ts").isNotNull() & F.col("client_id").isNotNull())
    return rows.select(
        F.col("client_id").cast("long").alias("client_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(begins & known, 0).when(begins, 1).when(known, 2).otherwise(3).alias("rank"),
        cents.cast("long").alias("cents"),
        F.xxhash64(nulls, *_columns(clicks)).alias("id1"),
        F.xxhash64(F.lit("second"), nulls, *_columns(clicks)).alias("id2"),
    )


def hot_clients(known: DataFrame, tasks: int) -> DataFrame:
    """Clients with more than 1/HOT_CLIENTS of the rows, with both starts and the number of pieces (a written table)."""
    counts = known.groupBy("client_id").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("rank") == 0, F.col("ts"))).alias("start0"), F.min(F.when(F.col("rank") <= 1, F.col("ts"))).alias("start1")
    )
    counts = common.written(counts, "client-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    pieces = F.ceil(F.col("n") * (4.0 * tasks / max(total, 1))).cast("int")
    return counts.where(F.col("n") * HOT_CLIENTS > total).select("client_id", "start0", "start1", pieces.alias("pieces"))


@dataclass
class _Open:
    """The client that the last batch ended with: its starts and its periods so far, by state."""

    client: int | None = None
    piece: int = -1
    start: list[int] = field(default_factory=lambda: [NEVER, NEVER])
    periods: list[dict[int, int]] = field(default_factory=lambda: [{}, {}])
    last_key: tuple | None = None


def _starts(ts: np.ndarray, begins: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The first time of each client that is marked as a beginning."""
    return np.minimum.reduceat(np.where(begins, ts, NEVER), heads)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a client's period, from clicks sorted by client, piece, time, rank and id.

    Of equal times the beginnings come first (rank), so a start is never met after clicks of its time.
    """
    open_ = _Open()
    for batch in batches:
        if batch.num_rows:
            done = _scan_batch(batch, open_)
            if done:
                yield _runs(done)
    if open_.client is not None and (done := _close(open_)):
        yield _runs(done)


def _close(o: _Open) -> list[tuple]:
    cohort = [None if s == NEVER else s // DAY // COHORT_DAYS for s in o.start]
    moved = None not in cohort and cohort[0] != cohort[1]
    piece = None if o.piece < 0 else o.piece
    return [(o.client, state, cohort[state], period, moved, cents, piece) for state in (0, 1) for period, cents in o.periods[state].items()]


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32())
    names = [x.split()[0] for x in RUNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _micros(col: pa.Array) -> np.ndarray:
    return col.cast(pa.timestamp("us")).view(pa.int64()).fill_null(NEVER).to_numpy(zero_copy_only=False)


def _scan_batch(batch: pa.RecordBatch, o: _Open) -> list[tuple]:
    """Take one batch up; returns the runs of the clients that ended in it."""
    col = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    client, piece, rank, cents = col("client_id"), col("piece"), col("rank"), col("cents")
    ts, id1, id2 = _micros(batch.column("ts")), col("id1"), col("id2")
    given = [_micros(batch.column("start0")), _micros(batch.column("start1"))]

    same = np.empty(len(client), bool)  # client and piece as in the row before
    same[1:] = (client[1:] == client[:-1]) & (piece[1:] == piece[:-1])
    same[0] = o.client == client[0] and o.piece == piece[0]
    twice = np.empty(len(client), bool)
    twice[1:] = same[1:] & (ts[1:] == ts[:-1]) & (id1[1:] == id1[:-1]) & (id2[1:] == id2[:-1])
    twice[0] = o.last_key == (client[0], piece[0], ts[0], id1[0], id2[0])
    o.last_key = (client[-1], piece[-1], ts[-1], id1[-1], id2[-1])

    done: list[tuple] = []
    if not same[0] and o.client is not None:
        done += _close(o)
        o.client = None
    heads = np.flatnonzero(~same)
    heads = heads if len(heads) and heads[0] == 0 else np.concatenate([[0], heads])
    group = np.cumsum(~same) - (0 if same[0] else 1)
    start = []
    for state in (0, 1):
        met = _starts(ts, rank <= state, heads)
        met = np.where(piece[heads] >= 0, given[state][heads], met)
        if same[0]:
            met[0] = min(met[0], o.start[state])
        start.append(met)

    cohorts = [np.where(s == NEVER, 0, s // DAY // COHORT_DAYS) for s in start]
    moved = (start[0] != NEVER) & (start[1] != NEVER) & (cohorts[0] != cohorts[1])
    last = len(heads) - 1
    if not same[0] or last > 0:
        fresh = _Open(int(client[-1]), int(piece[-1]))
    else:
        fresh = o
    for state in (0, 1):
        at = start[state][group]
        keep = ~twice & (ts >= at) & (at != NEVER)
        if state == 0:
            keep &= (rank == 0) | (rank == 2)
        g, when, amount = group[keep], ts[keep] - at[keep], cents[keep]
        if not len(g):
            continue
        period = when // (PERIOD_DAYS * DAY)
        change = np.empty(len(g), bool)
        change[0] = True
        change[1:] = (g[1:] != g[:-1]) | (period[1:] != period[:-1])
        first = np.flatnonzero(change)
        sums = np.add.reduceat(amount, first)
        for k, p, s in zip(g[first].tolist(), period[first].tolist(), sums.tolist(), strict=True):
            if k == 0 and same[0]:
                o.periods[state][p] = o.periods[state].get(p, 0) + s
            elif k == last:
                fresh.periods[state][p] = s
            else:
                h = heads[k]
                done.append((int(client[h]), state, int(cohorts[state][k]), p, bool(moved[k]), s, None if piece[h] < 0 else int(piece[h])))
    if same[0]:
        o.start = [int(start[0][0]), int(start[1][0])]
        if last > 0:
            done += _close(o)
    if fresh is not o:
        fresh.start = [int(start[0][last]), int(start[1][last])]
        o.client, o.piece, o.start, o.periods = fresh.client, fresh.piece, fresh.start, fresh.periods
    return done


def client_periods(clicks: DataFrame, start_kind: str = "purchase", task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per state, client and period with clicks: cohort, moved, cents, and the piece (null: the client was whole)."""
    spark = clicks.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(shuffle, common.parallel(spark, common.stored_bytes(clicks), task_bytes))
    known = known_clicks(clicks, start_kind)
    hot = F.broadcast(hot_clients(known, tasks))
    dealt = known.join(hot, "client_id", "left").withColumn("piece", F.coalesce(F.pmod("id1", "pieces"), F.lit(-1)).cast("int")).drop("pieces")
    ordered = dealt.repartition(tasks, "client_id", "piece").sortWithinPartitions("client_id", "piece", "ts", "rank", "id1", "id2")
    return ordered.mapInArrow(scan, RUNS)


def retention(clicks: DataFrame, clients: DataFrame, *, start_kind: str = "purchase", segment_col: str = "city") -> DataFrame:
    """The retention matrix in two states of knowledge, by segment, cohort and period.

    Nulls, repeats: see ``known_clicks``; equal clicks count once.  A client that is missing in
    ``clients`` or has no segment falls into segment ''; of several rows of a client the smallest
    segment counts.  Equal times: all clicks of the start's time belong to period 0.  Other columns
    of ``clicks`` only tell rows apart.  Empty tables give no rows.  Times are without a zone.
    """
    with common.scratch(clicks.sparkSession) as kept:
        runs = common.written(client_periods(clicks, start_kind), "client-periods")
        key = ["client_id", "state", "cohort", "period", "moved"]
        split = runs.where(F.col("piece").isNotNull()).groupBy(*key).agg(F.sum("cents").alias("cents"))
        users = runs.where(F.col("piece").isNull()).select(*key, "cents").unionByName(split)
        segments = clients.groupBy(F.col("client_id").cast("long").alias("client_id")).agg(F.min(segment_col).cast("string").alias("segment"))
        placed = users.join(segments, "client_id", "left").withColumn("segment", F.coalesce("segment", F.lit("")))
        cells = placed.groupBy("state", "segment", "cohort", "period").agg(
            F.count("*").alias("users"),
            F.sum(F.crc32(F.col("client_id").cast("string"))).alias("users_crc32"),
            F.sum(F.col("moved").cast("long")).alias("moved"),
            F.sum("cents").alias("cents"),
        )
        kept.append(common.written(cells, "retention"))
    return kept[0]
