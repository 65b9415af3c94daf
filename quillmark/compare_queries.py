"""Queries of route comparison over whole tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compare, routing
from .oracles import ORACLES
from .plans import model
from .service_queries import oracle

_ROUTES = {"skip": "skip_or_background_only", "script": "script_only", "weak": "weak_llm_proposal", "strong": "strong_llm_proposal"}


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the calibrated router's route, a portrait route by speaker for four turns in five, and suggestions."""
    rows = routing.salience_axes(model.table(spark, d, "conversations")).withColumn("route", routing.salience_route())
    old = F.lit(None).cast("string")
    for name, long in _ROUTES.items():
        old = F.when(F.col("route") == name, long).otherwise(old)
    portrait = F.when(F.col("turn") % 5 == 4, None).when(F.col("role") == "user", "weak_llm_proposal").otherwise("skip_or_background_only")
    return compare.compare_routes(rows.withColumns({"old_s1": old, "old_s2": portrait, "chinese_terms": F.col("conv_id") % 4 == 0}))


_AXES = ORACLES["route_salience"].rsplit("\nSELECT", 1)[0]
_USE1, _USE2 = "greatest(value, entity, domain, keyphrase * 0.6::DOUBLE, affect * 0.35::DOUBLE)", "greatest(value, entity, keyphrase)"
_RANK = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in compare.ROUTE_RANK.items()) + " ELSE 0.0 END::DOUBLE"
_HAS = lambda names: f"(coalesce(old_s1 IN {names}, false) OR coalesce(old_s2 IN {names}, false))"
_RULES = (
    f"(old_s1 IS NOT NULL OR old_s2 IS NOT NULL) AND NOT {_HAS(compare.ACTIVE)} AND useful >= 4",
    f"{_HAS(compare.LLM)} AND useful <= 2 AND low >= 4",
    "useful >= 4 AND risk >= 4",
    "complexity >= 6 AND useful < 3",
    "entity >= 4",
    "low >= 5",
    "new_s1 <> new_s2",
    "conv_id % 4 = 0 AND domain >= 2",
)
_COMPARED = f"""{_AXES},
r0 AS (SELECT * EXCLUDE (useful), CASE WHEN low >= 5.869 AND useful < 2.582 THEN 'skip_or_background_only' WHEN useful < 2.217 AND low >= 3.439 THEN 'skip_or_background_only' WHEN useful >= 7.975 AND (stress >= 6.169 OR risk >= 5.104) THEN 'strong_llm_proposal'
  WHEN useful >= 3.417 AND (stress >= 4.856 OR risk >= 3.526) THEN 'weak_llm_proposal' WHEN useful >= 3.007 THEN 'script_only' ELSE 'skip_or_background_only' END AS old_s1,
  (SELECT CASE WHEN u.turn % 5 = 4 THEN NULL WHEN c.role = 'user' THEN 'weak_llm_proposal' ELSE 'skip_or_background_only' END FROM conversations c WHERE c.conv_id = u.conv_id AND c.turn = u.turn) AS old_s2,
  CASE WHEN (low >= 6 AND {_USE1} < 3) OR ({_USE1} < 2 AND low >= 4) THEN 'skip_or_background_only' WHEN {_USE1} >= 4 AND (risk >= 5.5 OR complexity >= 6) THEN 'strong_llm_proposal'
    WHEN {_USE1} >= 3 AND (risk >= 3 OR complexity >= 4) THEN 'weak_llm_proposal' WHEN {_USE1} >= 3 THEN 'script_only' ELSE 'skip_or_background_only' END AS new_s1,
  CASE WHEN (low >= 7 AND {_USE2} < 2.5) OR ({_USE2} < 1.5 AND low >= 4) THEN 'skip_or_background_only' WHEN {_USE2} >= 3 AND (risk >= 5.5 OR complexity >= 6.5) THEN 'strong_llm_proposal'
    WHEN {_USE2} >= 2 THEN 'weak_llm_proposal' WHEN entity >= 2 THEN 'script_only' ELSE 'weak_llm_proposal' END AS new_s2, greatest(value, entity, keyphrase, domain) AS useful FROM u),
r1 AS (SELECT *, greatest({_RANK('old_s1')}, {_RANK('old_s2')}) AS old_score, greatest({_RANK('new_s1')}, {_RANK('new_s2')}) AS new_score FROM r0),
r2 AS (SELECT *, new_score - old_score AS route_delta, round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, useful * 0.45::DOUBLE + risk * 0.25::DOUBLE + complexity * 0.2::DOUBLE + abs(new_score - old_score) * 0.35::DOUBLE - low * 0.2::DOUBLE)) + 1e-9::DOUBLE, 3) AS review_priority,
  list_filter([{', '.join(f"CASE WHEN {rule} THEN {k} END" for k, rule in enumerate(_RULES, 1))}], lambda x: x IS NOT NULL) AS b0 FROM r1),
r3 AS (SELECT *, CASE WHEN len(b0) > 0 THEN b0 ELSE [9] END AS bs, {list(compare.BUCKETS)} AS names FROM r2)"""


@oracle(f"{_COMPARED} SELECT conv_id, turn, old_s1, old_s2, new_s1, new_s2, useful, route_delta, review_priority, array_to_string(list_transform(bs, lambda k: names[k]), ',') AS buckets FROM r3")
def route_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's routes against those that its axes suggest."""
    rows = _compared(spark, d)
    return rows.select("conv_id", "turn", "old_s1", "old_s2", "new_s1", "new_s2", "useful", "route_delta", "review_priority", F.array_join("buckets", ",").alias("buckets"))


@oracle(f"""{_COMPARED}, ea AS (SELECT conv_id, turn, review_priority, names, unnest(bs) AS no FROM r3),
ofd AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY review_priority DESC, conv_id, turn) AS rank FROM ea QUALIFY rank <= 12)
SELECT conv_id, turn, names[no] AS bucket, rank, review_priority FROM (SELECT * FROM ofd QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY no) = 1) ORDER BY no, rank LIMIT 60""")
def route_samples(spark: SparkSession, d: str) -> DataFrame:
    """The sixty turns to review first, up to twelve of a bucket."""
    return compare.bucket_samples(_compared(spark, d), ["conv_id", "turn"], per_bucket=12, max_samples=60)
