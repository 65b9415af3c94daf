"""Cost-balanced packing of token sequences.

Every sequence holds at most ``capacity`` tokens.  A document is tokenized, gets its end id and is
cut into full-capacity pieces and one rest.  Rests of a window are taken longest first; each goes
to the sequence of lowest estimated cost (``linear * n + quadratic * n**2`` summed over its pieces,
the attention cost of a block-diagonal mask) that still has room.  A rest that fits nowhere whole
is cut to fill the cheapest open sequence.  Whatever does not fit the window's sequences moves on
to the next window, so the padding of a whole task is less than one sequence.

Packing happens where the text is read: no shuffle, and no task holds more than a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordids import word_ids

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Sequences of a window, and stored bytes that one task packs (fewer, larger tasks leave fewer padded ends).
WINDOW, TASK_BYTES = 512, 24 << 20


class Packer:
    """Windows of one task.  ``sequence_id`` is the task number above 32 bits of counter."""

    def __init__(self, task: int, capacity: int, window: int, linear: float, quadratic: float):
        self.next_id, self.capacity, self.window = task << 32, capacity, window
        self.linear, self.quadratic = linear, quadratic
        self.rests: list[tuple] = []
        self.held = 0
        self.out: list[tuple] = []

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, cap = len(ids) // 4, self.capacity
        full = n - n % cap
        for start in range(0, full, cap):
            self.out.append((doc_id, start, cap, n, self.next_id, 0, ids[4 * start : 4 * (start + cap)]))
            self.next_id += 1
        if n > full:
            self.rests.append((n - full, full, doc_id, n, ids[4 * full :]))
            self.held += n - full
        if self.held >= self.window * cap:
            self.close(self.held // cap)

    def close(self, bins: int) -> None:
        """Fill that many sequences; pieces beyond their room stay for the next window."""
        cap = self.capacity
        room, cost = np.full(bins, cap), np.zeros(bins)
        todo = sorted(self.rests, key=lambda r: -r[0])  # stable: ties keep reading order
        self.rests, k = [], 0
        while k < len(todo):
            n, start, doc_id, doc_n, ids = todo[k]
            k += 1
            while n:
                fits = np.where(room >= n, cost, np.inf)
                at = int(fits.argmin())
                take = n
                if room[at] < n:
                    open_ = np.where(room > 0, cost, np.inf)
                    at = int(open_.argmin())
                    take = int(room[at])
                    if not take:
                        self.rests.append((n, start, doc_id, doc_n, ids))
                        break
                self.out.append((doc_id, start, take, doc_n, self.next_id + at, cap - int(room[at]), ids[: 4 * take]))
                room[at] -= take
                cost[at] += self.cost(take)
                n, start, ids = n - take, start + take, ids[4 * take :]
        self.next_id += bins
        self.held = sum(r[0] for r in self.rests)

    def finish(self) -> None:
        while self.rests:
            self.close(-(-self.held // self.capacity))

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    capacity: int = 4096,
    window: int = WINDOW,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
) -> DataFrame:
    """Pieces of every document with their place in the packed sequences, and the ids themselves.

    Null or empty text: one piece with the end id alone.  Repeated rows are packed once each.
    Null ids are kept as null.  A text of any length spans as many sequences as it needs.  An empty
    table gives no rows.  Other columns of ``docs`` are ignored.  The result depends only on how the
    input is split into tasks, so a task that runs again gives the same pieces.
    """
    common.small_batches(docs.sparkSession)
    tasks = common.parallel(docs.sparkSession, common.stored_bytes(docs), TASK_BYTES)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).coalesce(tasks)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_ids(tokenizer).encode
        packer = Packer(TaskContext.get().partitionId(), capacity, window, linear, quadratic)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(i, encode(t.as_py()) + end)
                if len(packer.out) >= 2000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return texts.mapInArrow(run, SCHEMA)
