"""Route comparison: suggested routes beside those that a span has, review priority, buckets and samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .routing import clamp

# Rank of each route, those that keep a span, and those that ask a model.
ROUTE_RANK = {"skip_or_background_only": 0.0, "split_or_segment_first": 1.5, "script_only": 3.0, "weak_llm_proposal": 5.5, "strong_llm_proposal": 8.0, "human_review": 9.0}
ACTIVE = ("script_only", "weak_llm_proposal", "strong_llm_proposal", "human_review")
LLM = ("weak_llm_proposal", "strong_llm_proposal", "human_review")
# The buckets in the order in which samples are drawn.
BUCKETS = (
    "old_skipped_but_high_v021_value",
    "old_llm_but_low_v021_value",
    "high_risk_and_high_value",
    "high_complexity_unclear_value",
    "high_entity_salience",
    "high_low_value",
    "s1_s2_route_disagreement",
    "chinese_specific_term_salience",
    "general_calibration",
)


def suggested_routes() -> tuple[Column, Column]:
    """Routes that the axes suggest for the memory and the portrait task; the first rule that fits decides."""
    c = F.col
    skip, script, weak, strong = "skip_or_background_only", "script_only", "weak_llm_proposal", "strong_llm_proposal"
    use1 = F.greatest(c("value"), c("entity"), c("domain"), c("keyphrase") * 0.6, c("affect") * 0.35)
    use2 = F.greatest(c("value"), c("entity"), c("keyphrase"))
    stressed = lambda risk, complexity: (c("risk") >= risk) | (c("complexity") >= complexity)
    memory = (
        F.when(((c("low") >= 6.0) & (use1 < 3.0)) | ((use1 < 2.0) & (c("low") >= 4.0)), skip)
        .when((use1 >= 4.0) & stressed(5.5, 6.0), strong)
        .when((use1 >= 3.0) & stressed(3.0, 4.0), weak)
        .when(use1 >= 3.0, script)
        .otherwise(skip)
    )
    portrait = (
        F.when(((c("low") >= 7.0) & (use2 < 2.5)) | ((use2 < 1.5) & (c("low") >= 4.0)), skip)
        .when((use2 >= 3.0) & stressed(5.5, 6.5), strong)
        .when(use2 >= 2.0, weak)
        .when(c("entity") >= 2.0, script)
        .otherwise(weak)
    )
    return memory, portrait


def route_rank(route: Column) -> Column:
    """Rank of a route; one that is missing or unknown has none."""
    out = F.when(F.lit(False), 0.0)
    for name, rank in ROUTE_RANK.items():
        out = out.when(route == name, rank)
    return out.otherwise(0.0)


def compare_routes(spans: DataFrame) -> DataFrame:
    """``spans`` with suggested routes, scores, ``review_priority`` and the ``buckets`` that each falls in.

    ``spans``: the axes of ``routing.salience_axes``, the routes it has (``old_s1``, ``old_s2``, null
    where it has none) and ``chinese_terms``, whether a lexicon of Chinese terms was at hand.  Null axes count 0.
    """
    c = F.col
    spans = spans.fillna(0.0, ["value", "entity", "keyphrase", "domain", "affect", "risk", "complexity", "low"])
    memory, portrait = suggested_routes()
    rows = spans.withColumns({"new_s1": memory, "new_s2": portrait})
    useful = F.greatest(c("value"), c("entity"), c("keyphrase"), c("domain"))
    rows = rows.withColumns({"useful": useful, "old_score": F.greatest(route_rank(c("old_s1")), route_rank(c("old_s2"))), "new_score": F.greatest(route_rank(c("new_s1")), route_rank(c("new_s2")))})
    has = lambda names: F.coalesce(c("old_s1").isin(*names), F.lit(False)) | F.coalesce(c("old_s2").isin(*names), F.lit(False))
    any_old = c("old_s1").isNotNull() | c("old_s2").isNotNull()
    delta = c("new_score") - c("old_score")
    priority = clamp(c("useful") * 0.45 + c("risk") * 0.25 + c("complexity") * 0.20 + F.abs(delta) * 0.35 - c("low") * 0.20)
    rules = (
        any_old & ~has(ACTIVE) & (c("useful") >= 4.0),
        has(LLM) & (c("useful") <= 2.0) & (c("low") >= 4.0),
        (c("useful") >= 4.0) & (c("risk") >= 4.0),
        (c("complexity") >= 6.0) & (c("useful") < 3.0),
        c("entity") >= 4.0,
        c("low") >= 5.0,
        c("new_s1") != c("new_s2"),
        F.coalesce("chinese_terms", F.lit(False)) & (c("domain") >= 2.0),
    )
    found = F.array_compact(F.array(*[F.when(rule, name) for rule, name in zip(rules, BUCKETS, strict=False)]))
    buckets = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(BUCKETS[-1])))
    return rows.withColumns({"route_delta": delta, "review_priority": priority, "buckets": buckets})


def bucket_samples(compared: DataFrame, keys: list[str], *, per_bucket: int, max_samples: int) -> DataFrame:
    """(keys, bucket, rank, review_priority): the spans to review first, bucket by bucket, each once.

    A bucket offers its ``per_bucket`` spans of highest priority, ties by keys; a span that an earlier
    bucket offers is not drawn again, nor replaced.  Partitions cut to ``per_bucket`` rows a bucket
    before the shuffle, so a bucket that holds most spans is no hot spot.
    """
    each = compared.select(*keys, "review_priority", F.posexplode(F.transform("buckets", lambda b: F.array_position(F.array(*[F.lit(x) for x in BUCKETS]), b).cast("int"))).alias("_at", "_no"))
    order = Window.partitionBy("_no").orderBy(F.col("review_priority").desc(), *keys)
    offered = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_bucket)
    drawn = offered.groupBy(*keys).agg(F.min(F.struct("_no", "rank", "review_priority")).alias("_s")).select(*keys, "_s.*")
    rows = drawn.orderBy("_no", "rank").limit(max_samples)
    return rows.select(*keys, F.element_at(F.array(*[F.lit(x) for x in BUCKETS]), F.col("_no")).alias("bucket"), "rank", "review_priority")
