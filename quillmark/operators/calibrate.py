"""Search for routing policies: all of a grid, or random and coordinate steps, each pass over grouped examples.

Examples are first reduced to counts of what the policies can tell apart.  The number of groups is
bounded by the grid (``package_groups``) or by the distinct rounded scores; every pass meets groups with
policies inside the tasks, so rows that come out are a row per policy and task.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import settled
from .routing import PACKAGE_POLICY, STRESS, USEFUL

# The grid of package policies, its routes, and the relation routes among them.
GRID = {
    "nlp_surface_floor": (4.0, 5.0, 6.0, 7.0),
    "nlp_context_ceiling": (4.0, 5.0, 6.0, 7.0),
    "strong_utility_floor": (3.5, 4.0, 4.5, 5.0, 5.5),
    "strong_context_floor": (3.5, 4.0, 4.5, 5.0, 6.0),
    "weak_relation_floor": (2.0, 2.5, 3.0, 3.5),
    "weak_utility_floor": (3.0, 3.5, 4.0, 4.5),
    "entity_relation_ceiling": (1.0, 1.5, 2.0, 2.5),
}
ROUTES = ("repair_or_review", "skip_or_background_only", "nlp_openie_candidate", "strong_llm_graph_extraction", "weak_llm_graph_extraction", "entity_candidate_only")
RELATION_ROUTES = ROUTES[2:5]
_SCORES = {"nlp_surface_floor": "surface", "nlp_context_ceiling": "context", "strong_utility_floor": "utility", "strong_context_floor": "context", "weak_relation_floor": "likelihood", "weak_utility_floor": "utility", "entity_relation_ceiling": "likelihood"}


def package_penalty(target: str, predicted: str) -> float:
    """What a wrong route of a package costs; the first case that fits."""
    if target == predicted:
        return 0.0
    skip, strong, weak, nlp, entity = ROUTES[1], ROUTES[3], ROUTES[4], ROUTES[2], ROUTES[5]
    cases = (
        (predicted == skip and target in RELATION_ROUTES, 8.0),
        (predicted == entity and target in (weak, strong), 7.0),
        (predicted == entity and target == nlp, 5.0),
        (target == strong and predicted in (weak, nlp), 1.5),
        (target in (weak, nlp) and predicted == strong, 0.75),
        (target == nlp and predicted == weak, 0.5),
    )
    return next((cost for fits, cost in cases if fits), 2.0)


def package_groups(rows: DataFrame, target: str = "target_route") -> DataFrame:
    """Counts of packets that no policy of the grid can tell apart.

    Of a score only its place between a threshold's grid values is kept, of fixed rules their outcome.
    """
    p, c = PACKAGE_POLICY, F.col
    first = F.when(c("evidence") < p["evidence_min"], 0).when((c("low_value") >= p["low_skip_floor"]) & (c("likelihood") < p["low_skip_relation_ceiling"]), 1).otherwise(-1)
    flags = {
        "first": first,
        "clear": (c("endpoint") >= p["nlp_endpoint_floor"]) & (c("direction") >= p["nlp_direction_floor"]) & (c("attribution") < p["nlp_attribution_ceiling"]),
        "hard": (c("attribution") >= p["strong_attribution_floor"]) | (c("merge") >= p["strong_merge_floor"]),
        "ends": c("endpoint") >= p["entity_endpoint_floor"],
    }
    place = lambda name: sum(((c(_SCORES[name]) >= v).cast("int") for v in GRID[name]), F.lit(0))
    keys = {**flags, **{name: place(name) for name in GRID}, "target": c(target)}
    return rows.select(*[v.alias(k) for k, v in keys.items()]).groupBy(*keys).agg(F.count("*").alias("n"))


def _grid_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every policy of the grid: exact matches, penalties, relation targets and those found, over the task's groups."""
    digits = {name: np.array(d) for name, d in zip(GRID, zip(*itertools.product(*[range(len(v)) for v in GRID.values()]), strict=True), strict=True)}
    policies = len(next(iter(digits.values())))
    out = {k: np.zeros(policies) for k in ("exact", "penalty", "targets", "found", "n")}
    costs = {t: np.array([package_penalty(t, p) for p in ROUTES]) for t in ROUTES}
    relation = np.array([r in RELATION_ROUTES for r in ROUTES])
    for batch in batches:
        for g in batch.to_pylist():
            reached = {name: g[name] > digits[name] for name in GRID}  # the score is at least the threshold
            if g["first"] >= 0:
                route = np.full(policies, g["first"])
            else:
                conditions = [
                    reached["nlp_surface_floor"] & ~reached["nlp_context_ceiling"] & g["clear"],
                    reached["strong_utility_floor"] & (reached["strong_context_floor"] | g["hard"]),
                    reached["weak_relation_floor"] | reached["weak_utility_floor"],
                    ~reached["entity_relation_ceiling"] & g["ends"],
                ]
                route = np.select(conditions, [2, 3, 4, 5], 1)
            out["exact"] += g["n"] * (route == ROUTES.index(g["target"]))
            out["penalty"] += g["n"] * costs[g["target"]][route]
            out["targets"] += g["n"] * (g["target"] in RELATION_ROUTES)
            out["found"] += g["n"] * (relation[route] & (g["target"] in RELATION_ROUTES))
            out["n"] += g["n"]
    if out["n"].any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(policies)), *[pa.array(v) for v in out.values()]], ["policy", *out])


def package_policies(rows: DataFrame, target: str = "target_route") -> DataFrame:
    """Every policy of the grid with its thresholds, exact match, mean penalty, relation recall and objective.

    Rows whose target is null or no route are left out.  Without rows there is no policy.
    """
    groups = settled(package_groups(rows.where(F.col(target).isin(*ROUTES)), target))
    sums = groups.mapInArrow(_grid_sums, "policy long, exact double, penalty double, targets double, found double, n double").groupBy("policy").agg(*[F.sum(c).alias(c) for c in ("exact", "penalty", "targets", "found", "n")])
    step, out = 1, []
    for name in reversed(GRID):
        out.append(F.element_at(F.array(*[F.lit(v) for v in GRID[name]]), (F.floor(F.col("policy") / step) % len(GRID[name]) + 1).cast("int")).alias(name))
        step *= len(GRID[name])
    recall = F.when(F.col("targets") > 0, F.col("found") / F.col("targets")).otherwise(1.0)
    objective = F.col("penalty") / F.col("n") + (1.0 - F.col("exact") / F.col("n")) + (1.0 - recall)
    half = 1e-9
    rate = {"exact_match": F.col("exact") / F.col("n"), "mean_penalty": F.col("penalty") / F.col("n"), "relation_recall": recall, "objective": objective}
    return sums.select("policy", *reversed(out), *[F.round(v + half, 6).alias(k) for k, v in rate.items()])


# Routes of the salience router in their order, and its first policy.
SALIENCE_ROUTES = ("skip", "script", "weak", "strong")
SALIENCE_START = {
    **{f"w_{k}": v for k, v in USEFUL.items()}, **{f"s_{k}": v for k, v in STRESS.items()},
    "low_value_skip_floor": 5.869, "low_value_useful_floor": 2.582, "skip_useful_floor": 2.217, "skip_low_value_floor": 3.439,
    "strong_useful_floor": 7.975, "strong_stress_floor": 6.169, "strong_risk_floor": 5.104, "weak_useful_floor": 3.417,
    "weak_stress_floor": 4.856, "weak_risk_floor": 3.526, "script_useful_floor": 3.007,
}
AXES = (*USEFUL, *STRESS, "low")


def salience_penalty(target: int, predicted: int) -> float:
    """What a wrong route of a span costs: the gap, and more for work done in vain or left undone."""
    extra = {(0, 2): 2.0, (0, 3): 2.0, (1, 3): 1.4, (2, 0): 1.8, (3, 0): 2.6, (3, 1): 1.3}
    return abs(target - predicted) * 0.85 + extra.get((target, predicted), 0.0)


def salience_predictions(axes: dict[str, np.ndarray], p: dict[str, float]) -> np.ndarray:
    """Routes by number; the first rule that fits."""
    useful = sum(p[f"w_{k}"] * axes[k] for k in USEFUL)
    stress = sum(p[f"s_{k}"] * axes[k] for k in STRESS)
    low, risk = axes["low"], axes["risk"]
    rules = [
        (low >= p["low_value_skip_floor"]) & (useful < p["low_value_useful_floor"]),
        (useful < p["skip_useful_floor"]) & (low >= p["skip_low_value_floor"]),
        (useful >= p["strong_useful_floor"]) & ((stress >= p["strong_stress_floor"]) | (risk >= p["strong_risk_floor"])),
        (useful >= p["weak_useful_floor"]) & ((stress >= p["weak_stress_floor"]) | (risk >= p["weak_risk_floor"])),
        useful >= p["script_useful_floor"],
    ]
    return np.select(rules, [0, 0, 3, 2, 1], 0)


def salience_groups(rows: DataFrame, target: str, digits: int = 1) -> DataFrame:
    """Counts of examples with equal axes, rounded so that groups are bounded; ``target`` is a route's number."""
    axes = [F.round(F.col(a), digits).alias(a) for a in AXES]
    return settled(rows.select(*axes, F.col(target).cast("int").alias("target")).groupBy(*AXES, "target").agg(F.count("*").alias("n")))


def _evaluated(groups: DataFrame, policies: list[dict[str, float]]) -> list[float]:
    """Objective of each policy, (mean penalty) + .35 (1 - exact) + .15 (1 - macro F1), in one pass."""
    costs = np.array([[salience_penalty(t, p) for p in range(4)] for t in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(policies), 16))
        for batch in batches:
            axes = {a: batch.column(a).to_numpy() for a in AXES}
            target, n = batch.column("target").to_numpy(), batch.column("n").to_numpy()
            for k, p in enumerate(policies):
                cells[k] += np.bincount(4 * target + salience_predictions(axes, p), weights=n, minlength=16)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at // 16), pa.array(at % 16), pa.array(cells.ravel()[at])], ["policy", "cell", "n"])

    cells = np.zeros((len(policies), 4, 4))
    for k, cell, n in groups.mapInArrow(run, "policy long, cell long, n double").groupBy("policy", "cell").agg(F.sum("n")).collect():
        cells[k, cell // 4, cell % 4] = n
    out = []
    for m in cells:
        total, hit = m.sum(), np.diag(m)
        present = (m.sum(0) + m.sum(1)) > 0
        f1 = 2 * hit[present] / (m.sum(0) + m.sum(1))[present]
        out.append(float((m * costs).sum() / total + 0.35 * (1 - hit.sum() / total) + 0.15 * (1 - f1.mean())) if total else 0.0)
    return out


def search_salience(rows: DataFrame, target: str, *, random_count: int = 64, passes: int = 2, seed: int = 17) -> tuple[dict[str, float], list[float]]:
    """The best policy found, and the objective after the start, the random pass and each coordinate pass.

    A pass is one job over the groups, whatever the number of policies; seeds make it repeatable, ties
    keep the earlier policy, so the objective never rises.
    """
    groups, draw = salience_groups(rows, target), random.Random(seed)
    best = dict(SALIENCE_START)
    tried = [best, *[{k: round(v * draw.uniform(0.6, 1.4), 3) for k, v in best.items()} for _ in range(random_count)]]
    scores = _evaluated(groups, tried)
    course = [scores[0]]
    lowest = min(range(len(tried)), key=lambda k: (scores[k], k))
    best, at = tried[lowest], scores[lowest]
    course.append(at)
    for turn in range(passes):
        step = 0.25 / 2**turn
        tried = [{**best, k: round(best[k] * (1 + s * step), 3)} for k in best for s in (-1, 1)]
        scores = _evaluated(groups, tried)
        lowest = min(range(len(tried)), key=lambda k: (scores[k], k))
        if scores[lowest] < at:
            best, at = tried[lowest], scores[lowest]
        course.append(at)
    return best, course


def outcome(column: str) -> Column:
    """A route's number from its name."""
    out = F.when(F.col(column) == SALIENCE_ROUTES[0], 0)
    for k, name in enumerate(SALIENCE_ROUTES[1:], 1):
        out = out.when(F.col(column) == name, k)
    return out
