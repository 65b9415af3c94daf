"""What the operators share: the cluster's shared folder, written tables, batch limits, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch handed to Python: texts may be long, so both are kept small.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

#: A side of a join is broadcast only up to this many rows and estimated bytes; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20

#: Short rows that one task takes where a table's size is known.
TASK_ROWS = 50_000

#: From here on the planner's size is no size: it stands for a table that it knows nothing of.
UNKNOWN_BYTES = 1 << 58

_own_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []
_state: dict[Hashable, Any] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only a local session without the setting, as in tests, gets a folder of its own; on a cluster
    each machine would have another one, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quillmark-")
            spark.sparkContext.setCheckpointDir(_own_dirs[app])
        base = _own_dirs[app]
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/quillmark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and lost executors lose nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_state(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: the state of the operator that runs, and no other.

    Workers are reused; what an earlier operator left there is given back to the system first.
    """
    if key not in _state:
        _state.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # not every C library can
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _state[key] = make()
    return _state[key]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those appended to the yielded list."""
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        files = {f.split("/quillmark/", 1)[-1].split("/", 1)[0] for df in kept for f in df.inputFiles()}
        for path in _scopes.pop():
            if path.rsplit("/", 1)[-1] not in files:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            elif _scopes:
                _scopes[-1].append(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def row_bytes(df: DataFrame) -> Column:
    """An estimate of what a row takes in a broadcast table."""

    def size(kind: T.DataType, col: Column) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(col), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            width = 8 * (1 + len(kind.elementType)) if isinstance(kind.elementType, T.StructType) else 8
            return F.greatest(F.size(col), F.lit(0)) * width + 24
        if isinstance(kind, T.StructType):
            return sum((size(f.dataType, col[f.name]) for f in kind), F.lit(16))
        return F.lit(8)

    return sum((size(f.dataType, F.col(f"`{f.name}`")) for f in df.schema), F.lit(48)).cast("long")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if it is proven to be small, in rows and bytes; else Spark shuffles it."""
    n, bytes_ = df.limit(rows + 1).agg(F.count("*"), F.sum(row_bytes(df))).first()
    return F.broadcast(df) if n <= rows and (bytes_ or 0) <= size else df


def few(df: DataFrame, rows: int) -> DataFrame:
    """At most a task for ``TASK_ROWS`` of ``rows``, so that small tables do not come in as many files as a shuffle has partitions."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_bytes(df: DataFrame) -> int:
    """The planner's size of a table (of files: their size), without reading it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parallel(spark: SparkSession, size: int, task_bytes: int) -> int:
    """Tasks for that many stored bytes, as many as there are cores at least.

    A table that is no file has no size that the planner knows; it gets as many tasks as a shuffle.
    """
    if size >= UNKNOWN_BYTES:
        return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(spark.sparkContext.defaultParallelism, min(-(-size // task_bytes), 1 << 20))
