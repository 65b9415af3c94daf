"""Vector index files: matrices as .npy beside their documents as JSON lines, read by ranges of rows.

A part is a matrix file and a documents file of as many lines.  The manifest names the parts that count,
so what a lost task has left does no harm.  A matrix whose shape does not fit its part is an error.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a part, and of a range that is read at once.
PART_ROWS, RANGE_ROWS = 8192, 2048
MANIFEST = "part string, n_rows long, dim long"


def write_vectors(df: DataFrame, id_col: str, vector_col: str, folder: str, *, part_rows: int = PART_ROWS) -> DataFrame:
    """Write (id, vector) as parts into a shared folder; returns the manifest, which is written there too.

    Null vectors are left out; vectors of different lengths are an error.  Ids may be null or repeated.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        ids: list = []
        rows: list = []

        def flush() -> pa.RecordBatch:
            name, dims = f"part-{uuid.uuid4().hex}", {len(v) for v in rows}
            if len(dims) != 1:
                raise ValueError(f"vectors of different lengths: {sorted(dims)[:5]}")
            held = io.BytesIO()
            np.save(held, np.array(rows, np.float32))
            with fs.open_output_stream(f"{root}/{name}.npy") as out:
                out.write(held.getvalue())
            with fs.open_output_stream(f"{root}/{name}.jsonl") as out:
                out.write("".join(json.dumps({"id": i}) + "\n" for i in ids).encode())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([dims.pop()], pa.int64())], names=["part", "n_rows", "dim"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                rows.append(v)
                if len(rows) == part_rows:
                    yield flush()
                    ids, rows = [], []
        if rows:
            yield flush()

    chosen = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<float>"))
    chosen.mapInArrow(parts, MANIFEST).write.mode("errorifexists").parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_vectors(spark: SparkSession, folder: str, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, vector) of all parts, a range of rows at a time; nothing but the range is read of a matrix."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_stream(f"{root}/{r['part']}.jsonl") as lines:
                    ids = [json.loads(x)["id"] for x in lines.read().decode().splitlines()]
                with fs.open_input_file(f"{root}/{r['part']}.npy") as file:
                    version = np.lib.format.read_magic(file)
                    head = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                    shape, by_column, dtype = head(file)
                    if shape != (r["n_rows"], r["dim"]) or len(ids) != r["n_rows"] or by_column:
                        raise ValueError(f"{r['part']}: a matrix of shape {shape} for {len(ids)} documents; expected {r['n_rows']} x {r['dim']}")
                    stop = min(r["start"] + range_rows, r["n_rows"])
                    file.seek(file.tell() + r["start"] * r["dim"] * dtype.itemsize)
                    matrix = np.frombuffer(file.read((stop - r["start"]) * r["dim"] * dtype.itemsize), dtype).reshape(-1, r["dim"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[r["start"] : stop], pa.int64()), pa.array(list(matrix.astype(np.float32)), pa.list_(pa.float32()))], names=["id", "vector"])

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where("n_rows > 0")
    starts = manifest.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(range_rows).cast("long"))))
    return starts.repartition("part", "start").mapInArrow(ranges, "id long, vector array<float>")
