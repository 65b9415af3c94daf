"""Sinks: guarded table writes, JSON lines, CSV, manifests, graph exports, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def write_table(df: DataFrame, path: str, *, duplicates: str = "fail", keep_old: str | None = None) -> None:
    """``fail`` refuses to touch a table; ``overwrite_generated`` copies it to ``keep_old`` first."""
    spark = df.sparkSession
    if exists(spark, path):
        if duplicates == "fail":
            raise FileExistsError(path)
        if keep_old:
            spark.read.parquet(path).write.mode("overwrite").parquet(keep_old)
    df.write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Keys in order, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns become JSON text."""
    nested = {n: F.to_json(n) for n, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    df.withColumns(nested).write.option("header", "true").csv(path)


def manifest(df: DataFrame, name: str) -> DataFrame:
    """One row: rows and an order-free content hash."""
    row = F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns])
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("content_hash"))


def cytoscape_edges(edges: DataFrame, most_refs: int = 20) -> DataFrame:
    """Parallel edges grouped by ends and relation, counts summed, references united up to a stated number."""
    return edges.groupBy("source", "target", "relation_type").agg(
        F.sum("evidence_count").alias("evidence_count"), F.slice(F.array_sort(F.collect_set("edge_id")), 1, most_refs).alias("edge_ids")
    )


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements of a GraphML document as text rows, nodes before edges."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(0).alias("part"), F.format_string('<node id="%s"><data key="label">%s</data></node>', safe("node_id"), safe("label")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.format_string('<edge source="%s" target="%s"><data key="type">%s</data></edge>', safe("source"), safe("target"), safe("relation_type")).alias("value"))
    return n.unionByName(e)


def publish(spark: SparkSession, new: DataFrame, current: str, history: str) -> None:
    """Write the new version beside the current one, archive that, then swap by rename."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(current).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged = f"{current}.next"
    new.write.mode("overwrite").parquet(staged)
    if fs.exists(path(current)):
        fs.mkdirs(path(history))
        version = len(fs.listStatus(path(history)))
        fs.rename(path(current), path(f"{history}/v{version:06d}"))
    fs.rename(path(staged), path(current))
