"""Session settings that operators rely on: the shared folder, checkpoints, written intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


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
        base = _own_dirs[app]
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: end the lineage of an iteration in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    root = shared_root(df.sparkSession)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(root)
    return df.checkpoint()


def settled(df: DataFrame, folder: str | None = None) -> DataFrame:
    """A written table in the shared folder, read again: lineage and the plan's constraints end there.

    Long iterations want this rather than ``cut``, whose plans keep growing constraints.
    """
    spark = df.sparkSession
    path = f"{folder or shared_root(spark) + '/quillmark'}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Marked for broadcast if it has at most ``rows`` rows, which are counted; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``settled`` into a folder that is deleted at the end; what is returned must be settled elsewhere."""
    folder = f"{shared_root(spark)}/quillmark/{uuid.uuid4().hex}"
    try:
        yield lambda df: settled(df, folder)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
