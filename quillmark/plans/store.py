"""The evidence store as views over conversations: sources, raw sources, evidence with aliases, memory units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import table

MEMORY_STATUSES = ("accepted_for_experiment", "accepted_by_user", "proposed", "archived")
INFERENCE = ("direct", "weak_signal", "strong_inference")


def _pick(values: tuple[str, ...], k) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Turns with their four names, owners and text; ``ordinal`` is the order of the table."""
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, d, "conversations").select(
        F.concat_ws(":", F.lit("evidence:conv"), c, t).alias("evidence_ref"),
        F.concat(F.lit("conv "), c, F.lit(" part "), F.floor(t / 3)).alias("display_ref"),
        F.concat(F.lit("D"), c, F.lit(":"), t).alias("source_specific_ref"),
        F.array(F.concat_ws("-", F.lit("turn"), c, t)).alias("ref_aliases"),
        F.concat(F.lit("source:conv:"), c).alias("source_id"),
        F.when(c % 7 != 0, F.concat(F.lit("raw:"), c % 50)).alias("raw_source_id"),
        F.col("role").alias("speaker"),
        F.array(F.col("role")).alias("subject_ids"),
        F.array(F.concat(F.lit("p"), c % 20), F.col("role")).alias("participant_ids"),
        (c * 1000 + t).alias("ordinal"),
        c.alias("conv_id"),
        t.alias("turn"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def sources(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conv_id")
    return (
        table(spark, d, "conversations")
        .select("conv_id")
        .distinct()
        .select(F.concat(F.lit("source:conv:"), c).alias("source_id"), F.when(c % 11 != 0, F.concat(F.lit("raw:"), c % 50)).alias("raw_source_id"), F.concat(F.lit("conversations/"), c).alias("path_or_uri"))
    )


def raw_sources(spark: SparkSession, d: str) -> DataFrame:
    """Raw sources whose manifest is there; one of fifty is missing."""
    k = F.col("conv_id") % 50
    return table(spark, d, "conversations").where(k != 49).select(F.concat(F.lit("raw:"), k).alias("raw_source_id")).distinct()


def memory_units(spark: SparkSession, d: str) -> DataFrame:
    """User turns as memory units of several statuses, some without a way back to their evidence."""
    c, t = F.col("conv_id"), F.col("turn")
    return evidence(spark, d).where("speaker = 'user'").select(
        F.concat_ws(":", F.lit("memory"), c, t).alias("memory_id"),
        F.col("text").alias("content"),
        _pick(MEMORY_STATUSES, c + t).alias("status"),
        _pick(INFERENCE, c).alias("inference_level"),
        F.when(t % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("evidence_ref")).alias("backpointer_refs"),
        F.array("evidence_ref").alias("evidence_refs"),
        F.array("source_id").alias("source_refs"),
        "conv_id",
        "turn",
    )


#: The same views for DuckDB.
SQL = """
ev AS (SELECT concat_ws(':', 'evidence:conv', conv_id, turn) AS evidence_ref, 'conv ' || conv_id || ' part ' || (turn // 3) AS display_ref,
  'D' || conv_id || ':' || turn AS source_specific_ref, 'turn-' || conv_id || '-' || turn AS alias, 'source:conv:' || conv_id AS source_id,
  CASE WHEN conv_id % 7 <> 0 THEN 'raw:' || (conv_id % 50) END AS raw_source_id, role AS speaker, conv_id * 1000 + turn AS ordinal,
  conv_id, turn, coalesce(text, '') AS text FROM conversations),
src AS (SELECT DISTINCT 'source:conv:' || conv_id AS source_id, CASE WHEN conv_id % 11 <> 0 THEN 'raw:' || (conv_id % 50) END AS raw_source_id,
  'conversations/' || conv_id AS path_or_uri FROM conversations),
raws AS (SELECT DISTINCT 'raw:' || (conv_id % 50) AS raw_source_id FROM conversations WHERE conv_id % 50 <> 49),
mem AS (SELECT concat_ws(':', 'memory', conv_id, turn) AS memory_id, text AS content,
  ['accepted_for_experiment', 'accepted_by_user', 'proposed', 'archived'][(conv_id + turn) % 4 + 1] AS status,
  ['direct', 'weak_signal', 'strong_inference'][conv_id % 3 + 1] AS inference_level, turn % 3 <> 0 AS has_back,
  evidence_ref, source_id, conv_id, turn FROM ev WHERE speaker = 'user')"""
