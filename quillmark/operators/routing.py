"""Routing spans and packets by salience, risk and complexity; review pools; policy calibration."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Patterns of the package router.
ATTRIBUTION = r"\b(said|told|asked|wrote|heard|believe|believes|thought|claimed|according to)\b"
CONTEXT = r"\b(because|although|though|however|therefore|but|while|when|after|before|if|unless|despite)\b"
UPDATE = r"\b(change|changed|update|updated|replace|replaced|contradict|contradicts|conflict|conflicts|instead|no longer)\b"
PRONOUN = r"\b(he|she|they|it|this|that|someone|something)\b"
VERB_OBJECT = (
    r"\b(?:uses?|using|used|depends?\s+on|works?\s+on|visited|visits?|met|supports?|criticizes?|replaced|replaces?|updated|updates?)\b"
    r"\s+(?:a|an|the|this|that|my|your|his|her|our|their)?\s*[A-Za-z][^.;!?]{2,80}"
)
NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
COPULA = r"\b(?:is|are|was|were|made|found|led|joined|plays|taught|began|became|born|died|worked|located|based)\b"
PREPOSITION = r"\b(?:to|with|from|on|in|at|for|by|about)\s+[A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*)*"
CJK_RELATION = r"[\x{4e00}-\x{9fff}]{2,}(?:使用|依赖|反对|支持|更新|替代|属于|位于|参加|负责)[\x{4e00}-\x{9fff}A-Za-z0-9_-]{1,}"
CJK_TERM = r"[\x{4e00}-\x{9fff}]{2,8}"
TITLED = r"\b(Mr|Mrs|Ms|Dr|Sir)\.?\s+[A-Z][a-z]+"
SPEAKER = r"\bSpeaker\s+\d+\s*:"
LOW_VALUE = (r"(?i)^\s*(thanks|thank you|ok|okay|yes|no|lol|haha|hmm|uh+)[!.?]*\s*$", r"(?i)^\s*(\d{4}|\w{3}\.\s+\d{1,2}(?:,\s+\d{4})?)[!.?]*\s*$")
# Thresholds of the package route.
PACKAGE_POLICY = {
    "evidence_min": 5.0,
    "low_skip_floor": 7.0,
    "low_skip_relation_ceiling": 3.0,
    "entity_endpoint_floor": 3.0,
    "entity_relation_ceiling": 2.0,
    "nlp_surface_floor": 6.0,
    "nlp_endpoint_floor": 4.0,
    "nlp_direction_floor": 5.0,
    "nlp_attribution_ceiling": 4.0,
    "nlp_context_ceiling": 5.0,
    "strong_utility_floor": 5.0,
    "strong_context_floor": 6.0,
    "strong_attribution_floor": 5.0,
    "strong_merge_floor": 6.0,
    "weak_relation_floor": 3.5,
    "weak_utility_floor": 4.0,
}
# Calibrated salience router (weights, then floors of the first-layer task).
USEFUL = {"value": 0.944, "entity": 1.366, "domain": 1.015, "keyphrase": 0.567, "affect": 0.226}
STRESS = {"risk": 0.766, "complexity": 0.558}


def clamp(x: Column) -> Column:
    # a touch above the half, so that engines that round a half differently agree
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), x)) + 1e-9, 3)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def package_features(packets: DataFrame, text: str = "text") -> DataFrame:
    """Ten scores of a packet, each 0 to 10.

    Columns: text, perspective, attribution_status, subject_role, input_kind, neighbour_warning, and the
    numbers of references n_refs, n_sources, n_back, n_context.  Pattern counts come first, in a
    projection of their own.
    """
    t = T.squeeze(F.col(text))
    names = F.concat(T.found(t, NAME), T.found(t, CJK_TERM))
    rows = packets.select(
        "*", t.alias("_t"), F.size(F.array_distinct(names)).cast("double").alias("_names"), _count(t, NAME).alias("_proper"),
        (_count(t, "(?i)" + VERB_OBJECT) + _count(t, PREPOSITION) + _count(t, CJK_RELATION)).alias("_plain"),
        t.rlike("(?i)" + COPULA).alias("_copula"), t.rlike("(?i)" + PRONOUN).alias("_pronoun"), _count(t, "(?i)" + UPDATE).alias("_updates"),
        _count(t, "(?i)" + ATTRIBUTION).alias("_said"), _count(t, "(?i)" + CONTEXT).alias("_linked"),
        F.when(t == "", 0).otherwise(F.regexp_count(t, F.lit(r"(?<=[.!?;:])\s+|\s+(?:and|but|then|so)\s+")) + 1).alias("_clauses"),
        _count(t, SPEAKER).alias("_turns"), F.size(F.array_distinct(T.found(t, SPEAKER))).cast("double").alias("_speakers"),
    )
    c, one = F.col, (lambda cond, n: F.when(cond, F.lit(n)).otherwise(F.lit(0.0)))
    most = lambda top, x: F.least(F.lit(top), x)
    rows = rows.withColumn("_hits", c("_plain") + one((c("_proper") >= 2) & c("_copula"), 1.0))
    plain = ((F.length("_t") < 10) & ~c("_t").rlike(r"[A-Za-z\x{4e00}-\x{9fff}]")) | c("_t").rlike(LOW_VALUE[0]) | c("_t").rlike(LOW_VALUE[1])
    low = one((c("_t") == "") | plain, 8.0) + one((F.length("_t") < 25) & (c("_names") < 2) & (c("_hits") == 0), 2.0)
    endpoint = one(c("perspective") != "", 2.0) + most(5.0, c("_names") * 1.5) + most(3.0, c("_speakers") * 0.75) + one(c("_hits") > 0, 1.0) - one(c("_pronoun"), 1.5)
    rows = rows.withColumn("_endpoint", endpoint).withColumn("_surface", most(10.0, c("_hits") * 6.0))
    likely = c("_surface") * 0.45 + c("_endpoint") * 0.25 + 0.3 * most(4.0, F.length("_t") / 40.0) + F.when(c("_turns") >= 4, most(3.0, c("_turns") * 0.2)).otherwise(0.0) + one(c("n_context") > 0, 1.0) * most(1.5, c("n_context") * 0.3) + one(c("_updates") > 0, 1.0)
    rows = rows.withColumn("_likely", likely)
    direction = c("_surface") - one(F.contains("_t", F.lit("?")), 1.0) - most(3.0, c("_said"))
    context = F.when(c("_clauses") > 1, most(5.0, (c("_clauses") - 1) * 1.5)).otherwise(0.0) + most(3.0, c("_linked") * 1.5) + most(2.0, c("n_context") * 0.5) + one(c("input_kind").isin("reviewed_portrait_unit", "proposal_outcome"), 0.5) + one(c("neighbour_warning"), 2.0)
    attribution = one(~c("attribution_status").isin("strict", "source_text_only", "source", ""), 3.0) + most(4.0, c("_said") * 2.0) + one(~c("subject_role").isin("target", "target_subject", ""), 1.5)
    evidence = one(c("n_refs") > 0, 4.0) + one(c("n_sources") > 0, 2.0) + one(c("n_back") > 0, 3.0) + one(c("_t") != "", 1.0)
    utility = c("_likely") * 0.4 + c("_endpoint") * 0.3 + F.when(c("_turns") >= 4, most(2.0, c("_turns") * 0.15)).otherwise(0.0) + most(1.0, c("n_context") * 0.25) + one(c("input_kind").isin("reviewed_portrait_unit", "normalized_candidate", "proposal_outcome"), 1.5) + one(c("_updates") > 0, 2.0)
    merge = one(c("_names") == 1, 2.0) + one(c("_t").rlike(TITLED), 1.0) + one((c("_endpoint") < 3.0) & (c("_names") > 0), 2.0)
    scores = {"surface": c("_surface"), "endpoint": c("_endpoint"), "likelihood": c("_likely"), "direction": direction, "context": context, "attribution": attribution, "evidence": evidence, "low_value": low, "utility": utility, "merge": merge}
    rows = rows.withColumns({k: clamp(v) for k, v in scores.items()})
    return rows.drop(*[x for x in rows.columns if x.startswith("_")])


def package_route(policy: dict[str, float] = PACKAGE_POLICY) -> Column:
    """The first rule that fits."""
    p, c = policy, F.col
    clear = (c("surface") >= p["nlp_surface_floor"]) & (c("endpoint") >= p["nlp_endpoint_floor"]) & (c("direction") >= p["nlp_direction_floor"]) & (c("attribution") < p["nlp_attribution_ceiling"]) & (c("context") < p["nlp_context_ceiling"])
    hard = (c("context") >= p["strong_context_floor"]) | (c("attribution") >= p["strong_attribution_floor"]) | (c("merge") >= p["strong_merge_floor"])
    return (
        F.when(c("evidence") < p["evidence_min"], "repair_or_review")
        .when((c("low_value") >= p["low_skip_floor"]) & (c("likelihood") < p["low_skip_relation_ceiling"]), "skip_or_background_only")
        .when(clear, "nlp_openie_candidate")
        .when((c("utility") >= p["strong_utility_floor"]) & hard, "strong_llm_graph_extraction")
        .when((c("likelihood") >= p["weak_relation_floor"]) | (c("utility") >= p["weak_utility_floor"]), "weak_llm_graph_extraction")
        .when((c("endpoint") >= p["entity_endpoint_floor"]) & (c("likelihood") < p["entity_relation_ceiling"]), "entity_candidate_only")
        .otherwise("skip_or_background_only")
    )


def salience_axes(spans: DataFrame, text: str = "text") -> DataFrame:
    """Value, entity, domain, keyphrase, affect, risk, complexity and low-value axes from the text alone.

    Stand-ins for lexicon resources that are optional inputs; each axis is 0 to 10.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    tokens = T.rough_token_count(t)
    names = F.size(T.capitalized(t)).cast("double")
    longest = F.size(F.array_distinct(F.filter(T.lowered(T.found(t, T.LATIN)), lambda w: F.length(w) >= 8))).cast("double")
    return spans.withColumns(
        {
            "entity": clamp(names * 1.2),
            "keyphrase": clamp(longest * 0.8),
            "domain": clamp(longest * 0.4 + names * 0.4),
            "affect": clamp(F.regexp_count(t, F.lit("!")) * 2.0),
            "risk": clamp(F.regexp_count(F.lower(t), F.lit(r"\b(not|never|no|risk|wrong|stop)\b")) * 2.5),
            "complexity": clamp(tokens / 12.0 + T.sentence_count(t) * 0.4),
            "low": F.when(tokens == 0, 10.0).when((tokens <= 2) & (names == 0), 8.0).when((tokens <= 3) & (names == 0), 5.5).otherwise(0.0),
            "value": clamp(longest * 0.5 + names * 0.3 + F.least(tokens / 10.0, F.lit(4.0))),
        }
    )


def salience_route() -> Column:
    """Calibrated useful / stress thresholds, in order."""
    useful = sum((w * F.col(k) for k, w in USEFUL.items()), F.lit(0.0))
    stress = sum((w * F.col(k) for k, w in STRESS.items()), F.lit(0.0))
    low, risk = F.col("low"), F.col("risk")
    return (
        F.when((low >= 5.869) & (useful < 2.582), "skip")
        .when((useful < 2.217) & (low >= 3.439), "skip")
        .when((useful >= 7.975) & ((stress >= 6.169) | (risk >= 5.104)), "strong")
        .when((useful >= 3.417) & ((stress >= 4.856) | (risk >= 3.526)), "weak")
        .when(useful >= 3.007, "script")
        .otherwise("skip")
    )


# Word groups of the deterministic proposal provider.
VALUE_WORDS, PROCEDURE = r"prefer|love|enjoy|need|want", r"usually|always|workflow|process|procedure"
EPISODE = r"plan|goal|start|build|lost|launched"


def mock_proposal(text: Column) -> Column:
    """First-layer proposal of the deterministic provider; first match wins."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(F.contains(low, F.lit("human review")), "needs_human_review")
        .when(low.rlike("uncertain|ambiguous"), "model_uncertain")
        .when(low.rlike("hello|thanks|thank you") & ~low.rlike(VALUE_WORDS), "reject")
        .when(low.rlike(PROCEDURE), "procedural")
        .when(low.rlike(VALUE_WORDS), "semantic")
        .when(low.rlike(EPISODE), "episodic")
        .otherwise("reject")
    )


def confusion(rows: DataFrame, label: str, pred: str, weight: Column | None = None) -> DataFrame:
    return rows.groupBy(label, pred).agg(F.count("*").alias("n"), F.round(F.sum(weight if weight is not None else F.lit(1.0)), 6).alias("w"))


def policy_grid(rows: DataFrame, score: str, label: str, floors: list[float], ceilings: list[float]) -> DataFrame:
    """Every (floor, ceiling) policy's exact match and mean penalty over all rows, in one pass.

    The grid is a stated constant; rows are first reduced to counts of (score, label).
    """
    counts = rows.groupBy(F.col(score).alias("s"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    grid = F.array(*[F.struct(F.lit(float(a)).alias("floor"), F.lit(float(b)).alias("ceiling")) for a, b in itertools.product(floors, ceilings) if a <= b])
    each = counts.withColumn("p", F.explode(grid))
    pred = F.when(F.col("s") >= F.col("p.ceiling"), 1).when(F.col("s") < F.col("p.floor"), 0).otherwise(-1)
    each = each.withColumn("pred", pred)
    penalty = F.when(F.col("pred") == F.col("y"), 0.0).when(F.col("pred") == -1, 0.5).otherwise(1.0)
    return each.groupBy("p.floor", "p.ceiling").agg(
        F.round(F.sum(F.when(F.col("pred") == F.col("y"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("exact"),
        F.round(F.sum(penalty * F.col("n")) / F.sum("n"), 6).alias("penalty"),
    )


def hash_split(key: Column, ratio: float, seed: str = "split") -> Column:
    """Deterministic split by hash fraction: below the ratio is the training side."""
    part = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.when(part < ratio, "train").otherwise("held_out")


def review_pool(kind: Column, contaminated: Column, eligible: Column, supported: Column, sampled: Column) -> Column:
    """Pool of a proposal; first rule that fits."""
    return (
        F.when(kind == "model_failure", "provider_failure_pool")
        .when(contaminated, "contamination_risk_pool")
        .when(kind.endswith("fact_candidate"), F.when(eligible, "fact_promotion_review_queue").otherwise("uncertain_pool"))
        .when(kind == "hypothesis_candidate", F.when(supported, "hypothesis_pool_candidates").otherwise("uncertain_pool"))
        .when(kind.isin("model_uncertain", "needs_human_review"), "uncertain_pool")
        .when(kind == "reject", F.when(sampled, "reject_audit_sample").otherwise("rejected"))
        .otherwise("schema_unknown_pool")
    )
