"""Retrieval over indexes in the mode that each question's request and the state of the indexes allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.session import bounded, settled
from . import retrieval, service

#: Dimensions of the hash embedding; units meet a question only over dimensions that both have.
DIMS = 256
LEXICAL, VECTOR = ("bm25_indexed", "hybrid_indexed"), ("embedding_indexed", "hybrid_indexed")


def vector_hits(asked: DataFrame, units: DataFrame, *, dims: int = DIMS) -> DataFrame:
    """(query_id, unit_id, cosine) above 0, by an equi-join on the dimensions of sparse hash embeddings."""
    said = asked.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    left = V.sparse_hash_embedding(said, "query_id", "question", dims).withColumnRenamed("value", "_q")
    right = V.sparse_hash_embedding(units, "unit_id", "text", dims)
    pairs = right.join(bounded(left), "dim").groupBy("query_id", "unit_id")
    return pairs.agg(F.round(F.sum(F.col("_q") * F.col("value")), 6).alias("cosine")).where("cosine > 0")


def planned(requests: DataFrame) -> DataFrame:
    """Requests with the ``mode`` that runs and the ``reason`` of a degraded one.

    ``requests``: (query_id, question, route, requested, bm25_fresh, embedding_fresh, embedding_usable).
    """
    c = F.col
    mode = service.plan_mode(c("requested"), c("bm25_fresh"), c("embedding_fresh"), c("embedding_usable"))
    return requests.withColumn("mode", mode).withColumn("reason", service.degraded_reason(c("requested"), c("mode")))


def retrieve(requests: DataFrame, units: DataFrame, *, top_k: int = 5, dims: int = DIMS) -> DataFrame:
    """(query_id, unit_id, method, score, bm25_norm, embedding_norm, backends, warnings, rank): each request in its mode.

    ``units``: (unit_id, text, subject_role).  Both scores are scaled by the question's best; a hybrid
    with hits of one index only trusts that one.  Whose the unit is weighs by route.  What no index
    answers is scanned directly, with the reason.  Ties go by unit_id; null texts are empty, a null
    question finds nothing, null modes count as auto and null states of an index as stale.
    """
    flags = ["bm25_fresh", "embedding_fresh", "embedding_usable"]
    asked = planned(requests.fillna(False, flags).withColumn("requested", F.coalesce("requested", F.lit("auto"))))
    found = settled(_top(_indexed(asked, units, dims), top_k))  # at most top_k rows a question
    left = asked.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(_top(_scanned(left, units), top_k))


def _indexed(asked: DataFrame, units: DataFrame, dims: int) -> DataFrame:
    c = F.col
    lexical = asked.where(c("mode").isin(*LEXICAL) & c("bm25_fresh"))
    vector = asked.where(c("mode").isin(*VECTOR) & c("embedding_fresh") & c("embedding_usable"))
    bm25 = retrieval.bm25(lexical, units, ["unit_id"])
    hits = bm25.join(vector_hits(vector, units, dims=dims), ["query_id", "unit_id"], "full_outer")
    by_query = Window.partitionBy("query_id")
    hits = hits.withColumns({"_l": F.max("bm25").over(by_query), "_v": F.max("cosine").over(by_query)})
    hits = hits.join(asked.select("query_id", "route", "mode"), "query_id").join(units.select("unit_id", "subject_role"), "unit_id")
    a, b = F.coalesce(c("bm25") / c("_l"), F.lit(0.0)), F.coalesce(c("cosine") / c("_v"), F.lit(0.0))
    wl, wv = retrieval.route_weights(c("route"))
    hybrid = c("mode") == "hybrid_indexed"
    score = F.when(c("_v").isNull(), a).when(c("_l").isNull(), b).otherwise(wl * a + wv * b)
    factor = retrieval.subject_factor(c("subject_role"), c("route").isin("fact", "evidence_first", "exact"))
    warnings = F.array(
        F.when(hybrid & c("_l").isNull(), "hybrid_bm25_path_unavailable"),
        F.when(hybrid & c("_v").isNull(), "hybrid_embedding_path_unavailable"),
        F.when(factor < 1, "subject_downranked"),
    )
    backends = F.array(F.when(c("bm25").isNotNull(), "bm25"), F.when(c("cosine").isNotNull(), "embedding"))
    return hits.select(
        "query_id",
        "unit_id",
        c("mode").alias("method"),
        F.round(score * factor, 6).alias("score"),
        F.round(c("bm25") / c("_l"), 6).alias("bm25_norm"),
        F.round(c("cosine") / c("_v"), 6).alias("embedding_norm"),
        F.array_join(F.array_compact(backends), ",").alias("backends"),
        F.array_join(F.array_compact(warnings), ",").alias("warnings"),
    )


def _scanned(asked: DataFrame, units: DataFrame) -> DataFrame:
    """Direct scan of the requests whose mode is one, is degraded, or has found nothing."""
    c, none = F.col, F.lit(None).cast("double")
    empty = F.when(~c("mode").isin("direct_scan", "degraded_direct_scan"), F.concat("mode", F.lit("_returned_no_hits")))
    why = F.array(F.when(c("mode") != "direct_scan", "degraded_direct_scan"), F.coalesce("reason", empty))
    method = F.when(c("mode") == "direct_scan", "direct_scan").otherwise("degraded_direct_scan")
    said = asked.select("query_id", method.alias("method"), F.array_join(F.array_distinct(F.array_compact(why)), ",").alias("warnings"))
    hits = service.lexical_hits(asked, units, "unit_id", "text").join(said, "query_id")
    return hits.select("query_id", "unit_id", "method", "score", none.alias("bm25_norm"), none.alias("embedding_norm"), F.lit("").alias("backends"), "warnings")


def _top(rows: DataFrame, k: int) -> DataFrame:
    return retrieval.top_k(rows, k, "score", ["unit_id"])


def compared(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """(query_id, n_found, n_baseline, n_both, only_found, only_baseline): what one way finds and the other does not.

    Both: (query_id, unit_id).  Differences come sorted, twenty at most.
    """
    mark = lambda df, name: df.select("query_id", "unit_id").distinct().withColumn(name, F.lit(True))
    both = mark(found, "_f").join(mark(baseline, "_b"), ["query_id", "unit_id"], "full_outer")
    f, b = F.col("_f").isNotNull(), F.col("_b").isNotNull()
    only = lambda mine, name: F.array_join(F.slice(F.array_sort(F.collect_list(F.when(mine, F.col("unit_id")))), 1, 20), ",").alias(name)
    return both.groupBy("query_id").agg(
        F.count_if(f).alias("n_found"), F.count_if(b).alias("n_baseline"), F.count_if(f & b).alias("n_both"), only(f & ~b, "only_found"), only(b & ~f, "only_baseline")
    )


def mode_totals(found: DataFrame) -> DataFrame:
    """(method, n_queries, n_results, n_downranked, n_both_backends, mean_best): sums over all questions of a method."""
    rows = found.groupBy("method").agg(
        F.count_distinct("query_id").alias("n_queries"),
        F.count("*").alias("n_results"),
        F.count_if(F.contains("warnings", F.lit("subject_downranked"))).alias("n_downranked"),
        F.count_if(F.col("backends") == "bm25,embedding").alias("n_both_backends"),
        F.avg(F.when(F.col("rank") == 1, F.col("score"))).alias("_best"),
    )
    return rows.withColumn("mean_best", F.round(F.col("_best") + 1e-9, 4)).drop("_best")
