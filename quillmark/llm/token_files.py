"""Token files in the Arrow IPC file format: fixed-size-list batches of equal-length sequences and masks.

Ids of all documents, in ascending id order, run on without gaps over the sequences of a file; the
last sequence is padded and its mask says where.  Sequence ``k`` of a file is at a fixed place of a
fixed batch, so a reader that maps the file reaches it without copying.  A second small file holds
where each document starts.  A task writes files under a name of its own attempt, and only the names
in the written manifest count, so a task that runs again leaves no half file in the result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, files
from .wordids import word_ids

SEQ_LEN, BATCH_SEQS = 2048, 256
#: Stored bytes of a table that go to one file.
FILE_BYTES = 32 << 20
MANIFEST = "shard long, tokens_uri string, index_uri string, n_docs long, n_tokens long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, first_sequence long"


class SequenceWriter:
    """Streams ids into fixed-length sequences; holds one batch at a time."""

    def __init__(self, uri: str, kind: np.dtype, seq_len: int = SEQ_LEN, batch_seqs: int = BATCH_SEQS):
        fs, path = files.open_fs(uri)
        self.kind, self.seq_len, self.batch = np.dtype(kind), seq_len, seq_len * batch_seqs
        self.schema = pa.schema(
            [
                ("tokens", pa.list_(pa.from_numpy_dtype(self.kind), seq_len)),
                ("mask", pa.list_(pa.bool_(), seq_len)),
            ]
        )
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= self.batch:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        stop = len(flat) if last else len(flat) - len(flat) % self.batch
        for at in range(0, stop, self.batch):
            part = flat[at : min(at + self.batch, stop)]
            pad = -len(part) % self.seq_len
            mask = np.arange(len(part) + pad) < len(part)
            part = np.concatenate([part, np.zeros(pad, self.kind)])
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(part), self.seq_len),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len),
            ]
            self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.held = [] if last else [flat[stop:]]
        self.n_held = 0 if last else len(flat) - stop

    def close(self) -> None:
        self._flush(last=True)
        self.file.close()
        self.sink.close()


class SequenceReader:
    """Random access to sequences and to runs of ids, without copying a batch."""

    def __init__(self, uri: str):
        self.source = files.open_input(uri)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("tokens").type.list_size
        self.seqs = len(self.file.get_batch(0)) if self.file.num_record_batches else 0  # all but the last are alike

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        batch, at = self.file.get_batch(k // self.seqs), k % self.seqs
        cut = slice(at * self.seq_len, (at + 1) * self.seq_len)
        return self._tokens(batch)[cut], batch.column(1).flatten().to_numpy(zero_copy_only=False)[cut]

    @staticmethod
    def _tokens(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=True)

    def run(self, start: int, length: int) -> Iterator[np.ndarray]:
        """Views of the ids ``start .. start + length``, batch by batch."""
        step = self.seqs * self.seq_len
        while length:
            k, at = divmod(start, step)
            view = self._batch(k)[at : at + length]
            yield view
            start, length = start + len(view), length - len(view)

    def _batch(self, k: int) -> np.ndarray:
        if getattr(self, "_at", None) != k:
            self._at, self._view = k, self._tokens(self.file.get_batch(k))
        return self._view


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    seq_len: int = SEQ_LEN,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the files and return their manifest, in id order (a row a file).

    Null or empty text: the end id alone.  Null ids come first.  Repeated ids stand side by side,
    ordered by a hash of their text; repeated rows are written once each.  An empty table writes no
    file.  Other columns are ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = common.parallel(spark, common.stored_bytes(docs), file_bytes)
    files.make_dir(folder)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    order = [F.col("i").asc_nulls_first(), F.xxhash64("t")]
    texts = texts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = word_ids(tokenizer), TaskContext.get().partitionId()
        kind = np.uint16 if max(encoder.vocab_size, end_id + 1) <= 1 << 16 else np.uint32
        writer, rows = None, []
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer = writer or SequenceWriter(f"{name}.arrow", kind, seq_len)
                ids = np.frombuffer(encoder.encode(t.as_py()) + end, dtype="<u4")
                rows.append((i, writer.n_tokens, len(ids)))
                writer.add(ids)
        if not writer:
            return
        writer.close()
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        index = pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens"])
        fs, path = files.open_fs(f"{name}.index.arrow")
        with fs.open_output_stream(path) as sink, pa.ipc.new_file(sink, index.schema) as file:
            for at in range(0, len(index), 65536):
                file.write_batch(index.slice(at, 65536))
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "shard": shard,
                    "tokens_uri": f"{name}.arrow",
                    "index_uri": f"{name}.index.arrow",
                    "n_docs": len(rows),
                    "n_tokens": writer.n_tokens,
                }
            ]
        )

    return common.written(texts.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents as the files have them: place among all ids, count, and checksum of their ids.

    One row of the manifest is one task's work; the running start is a sum over the files' counts.
    """
    spark: SparkSession = manifest.sparkSession
    starts = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("before", starts)
    n_files = manifest.count()
    spread = placed.select("shard", "before", "tokens_uri", "index_uri").repartition(max(1, n_files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = SequenceReader(row["tokens_uri"])
                index = pa.ipc.open_file(files.open_input(row["index_uri"]))
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    crcs = []
                    for start, n in zip(part["start"].to_pylist(), part["n_tokens"].to_pylist(), strict=True):
                        crc = 0
                        for view in reader.run(start, n):
                            crc = zlib.crc32(view.astype("<u4"), crc)
                        crcs.append(crc)
                    start = part["start"].to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [
                            part["doc_id"],
                            pa.array(start + row["before"]),
                            part["n_tokens"],
                            pa.array(crcs, pa.int64()),
                            pa.array(np.full(len(part), row["shard"])),
                            pa.array(start // reader.seq_len),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "first_sequence"],
                    )

    return spread.mapInArrow(run, DOCS)
