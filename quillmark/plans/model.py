"""The engine's layers as views over the given tables: evidence, memory, questions, property graph, operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that mark a derived row as a candidate, never as a fact.
BOUNDARY = {"graph_is_not_proof": True, "support_status": "not_checked", "write_permission": False}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in BOUNDARY.items()})


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as evidence rows; the user is the target subject."""
    target = F.col("role") == "user"
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.lit("evidence:conv"), "conv_id", "turn").alias("evidence_ref"),
        F.concat(F.lit("conv:"), F.col("conv_id")).alias("source_id"),
        "conv_id",
        "turn",
        F.col("role").alias("speaker"),
        F.when(target, "target").otherwise("other_participant").alias("subject_role"),
        F.when(target, "low").otherwise("medium").alias("contamination_risk"),
        F.when(target, F.lit("allowed")).otherwise("context_only").alias("s2_policy"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions; the id falls back to a running number."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, label, entity_type) of regions, nations, suppliers, customers and parts."""
    kinds = (
        ("region", "r_regionkey", "r_name", "place"),
        ("nation", "n_nationkey", "n_name", "place"),
        ("supplier", "s_suppkey", "s_name", "organization"),
        ("customer", "c_custkey", "c_name", "person"),
        ("part", "p_partkey", "p_name", "concept"),
    )
    out = None
    for name, key, label, kind in kinds:
        part = table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{name}:"), F.col(key)).alias("node_id"), F.col(label).alias("label"), F.lit(kind).alias("entity_type")
        )
        out = part if out is None else out.unionByName(part)
    return out


def sent_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, l_partkey, evidence_count): which parts a supplier sends, in how many lines."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("evidence_count"))


def graph_edges(spark: SparkSession, sf_dir: str, sent: DataFrame | None = None) -> DataFrame:
    """(edge_id, source, target, relation_type, evidence_count): part_of, located_in, supplies.

    ``sent``: ``sent_parts`` as written by a caller that reads the edges several times.
    """
    ref = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key))
    nation = table(spark, sf_dir, "nation").select(
        ref("nation", "n_nationkey").alias("source"), ref("region", "n_regionkey").alias("target"), F.lit("part_of").alias("relation_type"), F.lit(1).cast("long").alias("evidence_count")
    )
    homes = [
        table(spark, sf_dir, name).select(
            ref(name, key).alias("source"), ref("nation", home).alias("target"), F.lit("located_in").alias("relation_type"), F.lit(1).cast("long").alias("evidence_count")
        )
        for name, key, home in (("supplier", "s_suppkey", "s_nationkey"), ("customer", "c_custkey", "c_nationkey"))
    ]
    sent = sent_parts(spark, sf_dir) if sent is None else sent
    supplies = sent.select(ref("supplier", "l_suppkey").alias("source"), ref("part", "l_partkey").alias("target"), F.lit("supplies").alias("relation_type"), "evidence_count")
    both = nation.unionByName(homes[0]).unionByName(homes[1]).unionByName(supplies)
    return both.withColumn("edge_id", F.concat_ws("|", "source", "relation_type", "target"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append-only operation log: the same operation recurs as its status changes."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.concat_ws(":", F.lit("op"), "user_id", "event_type").alias("operation_id"),
        F.col("event_type").alias("operation_type"),
        F.concat(F.lit("conv:"), F.col("user_id")).alias("source_id"),
        F.element_at(F.array(*[F.lit(s) for s in ("planned", "running", "completed", "failed", "superseded")]), F.pmod(k, F.lit(5)) + 1).alias("status"),
        "value",
    )
