"""Route classifiers and a calibrated reranker on Spark ML, with out-of-fold predictions and metrics as DataFrames.

Folds come from a hash of the example's id, so they are the same on every run and layout and hold every
class in proportion; classes are balanced by weights from one count.  Metrics are sums over predictions,
which SQL can check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import settled

# Routes in their order, and what a wrong one costs beyond .85 a step (target, predicted).
ROUTE_ORDER = ("skip_or_background_only", "script_only", "weak_llm_proposal", "strong_llm_proposal", "human_review")
EXTRA_COST = {(0, 2): 2.0, (0, 3): 2.0, (0, 4): 2.0, (1, 3): 1.4, (1, 4): 1.4, (2, 0): 1.8, (3, 0): 2.6, (3, 1): 1.3}
STEP_COST = 0.85
FOLDS = 5


def fold(key: Column, folds: int = FOLDS, seed: str = "fold") -> Column:
    """A stable fold of an id."""
    part = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return (part % folds).cast("int")


def proxy_route(quality: Column, toxic: Column, tokens: Column) -> Column:
    """A proxy label from human judgements: toxic texts need the strong route, poor ones none, long good ones a weak model."""
    return F.when(toxic == 1, 3).when(quality == 0, 0).when(tokens >= 120, 2).otherwise(1).cast("double")


def balanced(rows: DataFrame, label: str, weight: str) -> DataFrame:
    """Rows times the inverse share of their class; a row a class is broadcast."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    shares = counts.join(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("_b"))
    return rows.join(F.broadcast(shares), label).withColumn(weight, F.col(weight) * F.col("_b")).drop("_b")


def route_models(seed: int = 17, *, trees: int = 20, rounds: int = 5) -> dict[str, Callable[[], Estimator]]:
    """Estimators by name; each takes ``features``, ``label`` and ``weight``.  Sizes are parameters."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    boosted = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=4, maxIter=rounds, seed=seed)
    scaled = lambda: Pipeline(
        stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(**{**common, "featuresCol": "scaled"}, maxIter=60, regParam=0.01)]
    )
    return {
        "logistic_regression": scaled,
        "decision_tree": lambda: DecisionTreeClassifier(**common, maxDepth=6, minInstancesPerNode=3, seed=seed),
        "random_forest": lambda: RandomForestClassifier(**common, numTrees=trees, maxDepth=10, minInstancesPerNode=2, seed=seed),
        "gradient_boosting": lambda: OneVsRest(classifier=boosted, featuresCol="features", labelCol="label", weightCol="weight"),
    }


def examples(rows: DataFrame, key: str, features: Iterable[str], label: str, weight: str | None = None) -> DataFrame:
    """(id, label, weight, given_weight, features, fold) as a written table; null features count as 0, null labels are left out."""
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    given = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    plain = rows.where(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("double").alias("label"), given.alias("weight"), given.alias("given_weight"), fold(F.col(key)).alias("fold"), *cols)
    whole = VectorAssembler(inputCols=list(features), outputCol="features").transform(balanced(plain, "label", "weight"))
    return settled(whole.select("id", "label", "weight", "given_weight", "features", "fold"))


def out_of_fold(rows: DataFrame, make: Callable[[], Estimator], folds: int = FOLDS) -> DataFrame:
    """(id, label, given_weight, prediction): every example is judged by a model that has not seen it."""
    out = None
    for k in range(folds):
        model = make().fit(rows.where(F.col("fold") != k))
        part = model.transform(rows.where(F.col("fold") == k)).select("id", "label", "given_weight", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def penalty(target: Column, predicted: Column) -> Column:
    out = F.abs(target - predicted) * STEP_COST
    for (t, p), cost in EXTRA_COST.items():
        out = out + F.when((target == t) & (predicted == p), F.lit(cost)).otherwise(F.lit(0.0))
    return out


def route_metrics(predictions: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Per ``by``: n, exact, macro_f1, balanced_accuracy, penalty, objective from (label, prediction, given_weight).

    Exact match and penalty are weighted; the F1 of a class that neither occurs nor is predicted does not
    count.  The objective is penalty + .35 (1 - exact) + .15 (1 - macro F1).
    """
    keys = list(by)
    cells = predictions.groupBy(*keys, "label", "prediction").agg(F.count("*").alias("n"), F.sum("given_weight").alias("w"))  # a row a pair of routes
    hit = F.col("label") == F.col("prediction")
    whole = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.when(hit, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("exact"),
        (F.sum(F.col("w") * penalty(F.col("label"), F.col("prediction"))) / F.sum("w")).alias("penalty"),
    )
    side = lambda c, n: cells.groupBy(*keys, F.col(c).alias("route")).agg(F.sum("n").alias(n), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(f"hit_{n}"))
    classes = side("label", "true").join(side("prediction", "said"), [*keys, "route"], "full").fillna(0)
    scores = classes.groupBy(*keys).agg(
        F.avg(2.0 * F.col("hit_true") / (F.col("true") + F.col("said"))).alias("macro_f1"),
        F.avg(F.when(F.col("true") > 0, F.col("hit_true") / F.col("true"))).alias("balanced_accuracy"),
    )
    out = whole.join(scores, keys)
    objective = F.col("penalty") + 0.35 * (1.0 - F.col("exact")) + 0.15 * (1.0 - F.col("macro_f1"))
    rounded = {c: F.round(F.col(c) + 1e-9, 6) for c in ("exact", "macro_f1", "balanced_accuracy", "penalty")}
    return out.withColumn("objective", F.round(objective + 1e-9, 6)).withColumns(rounded).select(*keys, "n", "exact", "macro_f1", "balanced_accuracy", "penalty", "objective")


def evaluate_models(rows: DataFrame, models: dict[str, Callable[[], Estimator]], folds: int = FOLDS) -> DataFrame:
    """(model, id, label, given_weight, prediction) of every model, as a written table."""
    out = None
    for name, make in models.items():
        part = out_of_fold(rows, make, folds).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return settled(out)


def importances(model: Model, names: list[str], top: int = 10) -> list[tuple[str, str, float]]:
    """(class or 'all', feature, weight) by size: a linear model's weights a class, a tree model's importances.

    A model has a number a feature, so this is small whatever the data.
    """
    last = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(last, "models"):  # one against the rest
        return [(str(k), f, w) for k, m in enumerate(last.models) for _, f, w in importances(m, names, top)]
    if hasattr(last, "coefficientMatrix"):
        rows = last.coefficientMatrix.toArray()
        return [(str(k), *x) for k, row in enumerate(rows) for x in sorted(zip(names, map(float, row), strict=True), key=lambda x: (-abs(x[1]), x[0]))[:top]]
    weights = last.featureImportances.toArray()
    return [("all", *x) for x in sorted(zip(names, map(float, weights), strict=True), key=lambda x: (-x[1], x[0]))[:top]]


# --- calibrated reranker


def candidate_features(rows: DataFrame) -> DataFrame:
    """The numbers of a retrieved candidate; null counts and scores are 0, a null rank is 9999."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rank = F.coalesce(F.col("rank").cast("double"), F.lit(9999.0))
    log = lambda c: F.log1p(F.greatest(zero(c), F.lit(0.0)))
    return rows.withColumns(
        {
            "f_rank": rank,
            "f_inverse_rank": 1.0 / F.greatest(rank, F.lit(1.0)),
            "f_score": zero("score"),
            "f_log_score": log("score"),
            "f_lexical": zero("lexical_score"),
            "f_log_lexical": log("lexical_score"),
            "f_exact_hits": zero("exact_hits"),
            "f_matched": zero("matched"),
            "f_sources": zero("source_count"),
            "f_log_sources": log("source_count"),
            "f_multi_source": (zero("source_count") > 1).cast("double"),
            "f_aliases": zero("alias_count"),
        }
    )


NUMBERS = ("f_rank", "f_inverse_rank", "f_score", "f_log_score", "f_lexical", "f_log_lexical", "f_exact_hits", "f_matched", "f_sources", "f_log_sources", "f_multi_source", "f_aliases")


def calibrated_probabilities(rows: DataFrame, *, folds: int = 3, words: str = "relation_type", slots: int = 1 << 12) -> DataFrame:
    """(id, packet_id, label, inverse_rank, probability) of candidates (id, packet_id, label, candidate columns, ``words``).

    A balanced logistic regression over numbers and hashed words gives margins out of fold; a sigmoid of
    the margin, fitted on them, gives probabilities.  Folds are packets, so no packet is on both sides.
    The vector has a fixed size, however many words there are.
    """
    from pyspark.ml.feature import FeatureHasher

    labelled = candidate_features(rows).where(F.col("label").isNotNull()).withColumns({"label": F.col("label").cast("double"), "weight": F.lit(1.0), "fold": fold(F.col("packet_id"), folds)})
    labelled = balanced(labelled, "label", "weight").withColumn(words, F.coalesce(words, F.lit("unknown")))
    hashed = FeatureHasher(inputCols=[words], outputCol="_words", numFeatures=slots).transform(labelled)
    vectors = VectorAssembler(inputCols=[*NUMBERS, "_words"], outputCol="features").transform(hashed)
    vectors = settled(vectors.select("id", "packet_id", "label", "weight", "fold", F.col("f_inverse_rank").alias("inverse_rank"), "features"))
    margins = None
    for k in range(folds):
        model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=60, regParam=0.01).fit(vectors.where(F.col("fold") != k))
        part = model.transform(vectors.where(F.col("fold") == k)).withColumn("margin", F.get(vector_to_array("rawPrediction"), F.lit(1)))
        part = part.select("id", "packet_id", "label", "inverse_rank", "margin")
        margins = part if margins is None else margins.unionByName(part)
    margins = settled(margins)
    one = VectorAssembler(inputCols=["margin"], outputCol="features").transform(margins)
    sigmoid = LogisticRegression(featuresCol="features", labelCol="label", maxIter=60).fit(one)
    fitted = sigmoid.transform(one).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return settled(fitted.select("id", "packet_id", "label", "inverse_rank", "probability"))


def ranking_metrics(scored: DataFrame, score: str = "probability", bins: int = 10) -> DataFrame:
    """One row: n, positives, packets, recall_at_5, recall_at_10, mrr, average_precision, roc_auc, calibration_error, brier.

    Ranking is by score, ties by id; only packets with a true candidate count in the first three.  Average
    precision and AUC treat equal scores alike; both are sums over distinct scores in blocks (ordered
    ranges), so no task orders the whole table.
    """
    ranked = scored.withColumn("_r", F.row_number().over(Window.partitionBy("packet_id").orderBy(F.col(score).desc(), "id")))
    firsts = ranked.where("label = 1").groupBy("packet_id").agg(F.min("_r").alias("r"))
    packets = firsts.agg(
        F.count("*").alias("packets"),
        F.avg((F.col("r") <= 5).cast("double")).alias("recall_at_5"),
        F.avg((F.col("r") <= 10).cast("double")).alias("recall_at_10"),
        F.avg(1.0 / F.col("r")).alias("mrr"),
    )
    levels = settled(scored.groupBy(F.col(score).alias("s")).agg(F.sum("label").alias("pos"), F.sum(1.0 - F.col("label")).alias("neg")))
    total = levels.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    above = _running(levels)
    ap = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    wins = F.sum(F.col("pos") * (F.col("all_neg") - F.col("cum_neg")) + 0.5 * F.col("pos") * F.col("neg"))
    curve = above.join(F.broadcast(total)).agg(ap.alias("_ap"), wins.alias("_wins"), F.first("all_pos").alias("_pos"), F.first("all_neg").alias("_neg"))
    curve = curve.select((F.col("_pos") + F.col("_neg")).cast("long").alias("n"), F.col("_pos").cast("long").alias("positives"), F.when(F.col("_pos") > 0, F.col("_ap") / F.col("_pos")).alias("average_precision"), F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), F.col("_wins") / (F.col("_pos") * F.col("_neg"))).alias("roc_auc"))
    binned = scored.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("c"), F.avg("label").alias("y"), F.avg(score).alias("p"))
    error = binned.agg((F.sum(F.col("c") * F.abs(F.col("y") - F.col("p"))) / F.sum("c")).alias("calibration_error"))
    brier = scored.agg(F.avg((F.col("label") - F.col(score)) * (F.col("label") - F.col(score))).alias("brier"))
    out = curve.join(F.broadcast(packets)).join(F.broadcast(error)).join(F.broadcast(brier))  # single rows
    names = ("recall_at_5", "recall_at_10", "mrr", "average_precision", "roc_auc", "calibration_error", "brier")
    return out.select("n", "positives", "packets", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in names])


def _running(levels: DataFrame, blocks: int = 256) -> DataFrame:
    """Sums of pos and neg over all scores from the highest down to each, by quantile blocks.

    A block's rows are ordered in one task; blocks add the sums of those above them, a row a block.
    """
    cuts = levels.agg(F.percentile_approx("s", [k / blocks for k in range(1, blocks)], 20 * blocks)).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    placed = levels.withColumn("block", F.size(F.filter(bounds, lambda b: b <= F.col("s"))))
    sums = placed.groupBy("block").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    higher = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most ``blocks`` rows
    sums = sums.select("block", F.coalesce(F.sum("bp").over(higher), F.lit(0.0)).alias("hp"), F.coalesce(F.sum("bn").over(higher), F.lit(0.0)).alias("hn"))
    inside = Window.partitionBy("block").orderBy(F.col("s").desc())
    running = placed.withColumn("cp", F.sum("pos").over(inside)).withColumn("cn", F.sum("neg").over(inside))
    return running.join(F.broadcast(sums), "block").select("pos", "neg", (F.col("cp") + F.col("hp")).alias("cum_pos"), (F.col("cn") + F.col("hn")).alias("cum_neg"))
