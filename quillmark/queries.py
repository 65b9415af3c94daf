"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import text as T
from .functions import vectors as V
from .operators import community, consolidate, graph, maintain, memory, retrieval, routing
from .plans import model

QUERIES: dict = {}
CONV = ["conv_id", "turn"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return model.table(spark, d, "conversations")


def joined(words) -> F.Column:
    return F.array_join(words, " ")


# --- tokenizers and text measures


@query
def tok_set(spark: SparkSession, d: str) -> DataFrame:
    w = F.array_sort(T.word_set(F.col("text")))
    return model.table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(joined(w)).alias("words_md5"))


@query
def tok_bm25_bag(spark: SparkSession, d: str) -> DataFrame:
    w = T.bm25_bag(F.col("text"))
    return conversations(spark, d).select(*CONV, F.size(w).cast("long").alias("n"), joined(w).alias("bag"))


@query
def tok_graph(spark: SparkSession, d: str) -> DataFrame:
    w = T.graph_tokens(F.col("text"))
    return conversations(spark, d).select(*CONV, F.size(w).cast("long").alias("n"), joined(w).alias("words"))


@query
def tok_schema(spark: SparkSession, d: str) -> DataFrame:
    w = T.schema_tokens(F.col("text"))
    return model.table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(joined(w)).alias("words_md5"))


@query
def tok_delta(spark: SparkSession, d: str) -> DataFrame:
    w = T.delta_tokens(F.col("text"))
    return conversations(spark, d).select(*CONV, F.size(w).cast("long").alias("n"), joined(w).alias("words"))


@query
def tok_smoke(spark: SparkSession, d: str) -> DataFrame:
    w = T.smoke_tokens(F.col("text"))
    return conversations(spark, d).select(*CONV, F.size(w).cast("long").alias("n"), joined(w).alias("words"))


@query
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return conversations(spark, d).select(
        *CONV, T.entity_key(t).alias("entity_key"), T.relation_key(t).alias("relation_key"), T.excerpt(t, 80).alias("excerpt"), T.stable_id("turn", F.col("conv_id"), F.col("turn")).alias("id")
    )


@query
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("text"), T.rough_token_count(F.col("text"))
    hits = T.term_count(t, ("the", "and", "of"))
    return model.table(spark, d, "documents").select(
        "doc_id", n.alias("tokens"), T.sentence_count(t).alias("sentences"), hits.alias("hits"), T.per_100(hits, n).alias("hits_per_100"), T.is_question(t).alias("is_question"), T.is_commitment(t).alias("is_commitment")
    )


@query
def readability(spark: SparkSession, d: str) -> DataFrame:
    docs = model.table(spark, d, "documents").where("lang = 'en'")
    return docs.select("doc_id", *[v.alias(k) for k, v in T.readability(F.col("text")).items()])


@query
def language_scores(spark: SparkSession, d: str) -> DataFrame:
    zh, latin = T.language_scores(F.col("text"))
    return model.table(spark, d, "documents").select("doc_id", zh.alias("zh"), latin.alias("latin"), ((zh >= 6) & (latin >= 2)).alias("mixed"))


@query
def capitalized_terms(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select(*CONV, F.array_join(T.capitalized(F.col("text")), "|").alias("names"))


# --- evidence, memory, context


@query
def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    return model.evidence(spark, d).withColumn("content_hash", F.sha2("text", 256)).drop("text")


@query
def context_envelope(spark: SparkSession, d: str) -> DataFrame:
    rows = memory.context_envelope(model.evidence(spark, d), ["source_id"], "turn", "evidence_ref", "text")
    return rows.select("evidence_ref", "context_before", "context_after")


@query
def neighbour_ids(spark: SparkSession, d: str) -> DataFrame:
    return memory.neighbour_ids(model.evidence(spark, d), ["source_id"], "turn", "evidence_ref").select("evidence_ref", "prev_ref", "next_ref", "unit_no")


@query
def sentence_units(spark: SparkSession, d: str) -> DataFrame:
    return memory.sentence_units(model.table(spark, d, "documents"), "doc_id")


@query
def paragraph_units(spark: SparkSession, d: str) -> DataFrame:
    return memory.paragraph_units(model.table(spark, d, "documents"), "doc_id")


# --- retrieval


@query
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    ev = conversations(spark, d)
    stats = retrieval.corpus_stats(ev)
    idf = retrieval.idf_table(retrieval.postings(ev, CONV), stats)
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(conversations(spark, d), CONV)


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = retrieval.bm25(model.questions(spark, d), conversations(spark, d), CONV).withColumn("bm25", F.round("bm25", 6))
    return retrieval.top_k(scored, 8, "bm25", CONV)


@query
def lexical_direct_scan(spark: SparkSession, d: str) -> DataFrame:
    scored = retrieval.lexical_scan(model.questions(spark, d), conversations(spark, d), CONV).withColumn("score", F.round("score", 6))
    return retrieval.top_k(scored, 8, "score", CONV)


@query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of the stated queries, every fiftieth vector, among all others."""
    rows = model.table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(asked, rows, 10, key="vec_id")


@query
def vector_check(spark: SparkSession, d: str) -> DataFrame:
    rows = model.table(spark, d, "embeddings")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != 64).alias("bad_dims"), F.round(F.avg(V.norm(F.col("embedding"))), 5).alias("mean_norm"))


@query
def hash_embed_wide(spark: SparkSession, d: str) -> DataFrame:
    bag = T.bm25_bag(F.col("text"))
    tokens = F.when(F.size(bag) > 0, bag).otherwise(F.array("text"))
    v = V.hash_embedding(model.table(spark, d, "benchmark"), "item_id", tokens, 32, wide=True)
    return v.withColumn("value", F.round("value", 6))


@query
def hash_embed_token(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "\n", " "), " "), lambda w: w != "")
    tokens = F.when(F.size(words) > 0, words).otherwise(F.array("text"))
    v = V.hash_embedding(model.table(spark, d, "benchmark"), "item_id", tokens, 32, wide=False)
    return v.withColumn("value", F.round("value", 6))


def _both_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lexical hits, and Jaccard as the second branch (no model embeddings of turns are given)."""
    q, ev = model.questions(spark, d), conversations(spark, d)
    second = retrieval.lexical_scan(q, ev, CONV).withColumn("cosine", F.col("score") / 10)
    return retrieval.bm25(q, ev, CONV), second.select("query_id", *CONV, "cosine")


@query
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.fuse(*_both_sides(spark, d), F.when(F.col("query_id") % 2 == 0, "fact").otherwise("semantic"), CONV)
    fused = fused.withColumn("score", F.round("score", 6))
    return retrieval.top_k(fused, 8, "score", CONV).select("query_id", *CONV, "score", "rank", retrieval.bucket(F.col("score")).alias("bucket"))


@query
def subject_adjusted(spark: SparkSession, d: str) -> DataFrame:
    scored = retrieval.bm25(model.questions(spark, d), conversations(spark, d), CONV)
    rows = scored.join(model.evidence(spark, d).select(*CONV, "subject_role"), CONV)
    strict = F.col("query_id") % 2 == 0
    rows = rows.withColumn("score", F.round(F.col("bm25") * retrieval.subject_factor(F.col("subject_role"), strict), 6))
    return retrieval.top_k(rows.select("query_id", *CONV, "subject_role", "score"), 5, "score", CONV)


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each session's first target turn as a claim, checked on the session's other turns."""
    ev = model.evidence(spark, d)
    first = ev.where("subject_role = 'target'").groupBy("source_id").agg(F.min_by("text", "turn").alias("claim"), F.min("turn").alias("t0"))
    claims = first.select(F.col("source_id").alias("claim_id"), "claim")
    others = ev.join(first.select("source_id", "t0"), "source_id").where("turn <> t0")
    return claims, others.select(F.col("source_id").alias("claim_id"), "evidence_ref", "text")


@query
def claim_support(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.claim_support(*_claims(spark, d))


@query
def grounding(spark: SparkSession, d: str) -> DataFrame:
    checks = retrieval.claim_support(*_claims(spark, d)).withColumn("grp", F.concat(F.lit("g"), F.substring("claim_id", -1, 1)))
    return retrieval.grounding(checks, "grp")


@query
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    q, ev = model.questions(spark, d), conversations(spark, d)
    unit = F.concat_ws(":", "conv_id", "turn").alias("unit_id")
    a = retrieval.top_k(retrieval.bm25(q, ev, CONV).withColumn("s", F.round("bm25", 6)), 24, "s", CONV).select("query_id", unit, F.lit("bm25").alias("branch"), "rank")
    b = retrieval.top_k(retrieval.lexical_scan(q, ev, CONV).withColumn("s", F.round("score", 6)), 24, "s", CONV).select("query_id", unit, F.lit("direct").alias("branch"), "rank")
    return retrieval.reciprocal_rank_fusion(a.unionByName(b), by=["query_id"])


@query
def dual_branch(spark: SparkSession, d: str) -> DataFrame:
    return rrf_fuse(spark, d).groupBy("query_id").agg(
        F.count_if(F.col("branches") == "bm25").alias("bm25_only"), F.count_if(F.col("branches") == "direct").alias("direct_only"), F.count_if(F.col("branch_count") == 2).alias("overlap")
    )


# --- property graph


@query
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(model.graph_nodes(spark, d), model.graph_edges(spark, d))


@query
def graph_projection_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.projection_stats(model.graph_nodes(spark, d), model.graph_edges(spark, d))


@query
def graph_review_projection(spark: SparkSession, d: str) -> DataFrame:
    _, edges = graph.project(model.graph_nodes(spark, d), model.graph_edges(spark, d), F.col("entity_type") != "person", F.col("evidence_count") >= 2)
    return edges.select("edge_id", "source", "target", "evidence_count")


@query
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(model.graph_nodes(spark, d), model.graph_edges(spark, d))


@query
def pagerank_fixed_iters(spark: SparkSession, d: str) -> DataFrame:
    ranks = graph.pagerank(model.graph_nodes(spark, d), model.graph_edges(spark, d), rounds=5)
    return ranks.select("node_id", F.round("rank", 8).alias("rank"))


@query
def ego_1hop(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = model.graph_nodes(spark, d), model.graph_edges(spark, d)
    top = graph.degrees(nodes, edges).orderBy(F.col("degree").desc(), "node_id").limit(5)
    return graph.ego(edges, top)


@query
def node_jaccard(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = model.graph_nodes(spark, d), model.graph_edges(spark, d)
    top = graph.degrees(nodes, edges).orderBy(F.col("degree").desc(), "node_id").limit(12)
    return graph.neighbour_jaccard(edges, top)


@query
def shortest_paths_4hop(spark: SparkSession, d: str) -> DataFrame:
    """Between the eight nodes of highest degree, over all edges."""
    nodes, edges = model.graph_nodes(spark, d), model.graph_edges(spark, d)
    seeds = graph.degrees(nodes, edges).orderBy(F.col("degree").desc(), "node_id").limit(8).select("node_id")
    paths = graph.shortest_paths(edges, seeds)
    return paths.select("a", "b", F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"))


@query
def hop_distances(spark: SparkSession, d: str) -> DataFrame:
    seeds = model.graph_nodes(spark, d).where("node_id LIKE 'region:%'").select("node_id")
    return graph.hop_distances(model.graph_edges(spark, d), seeds, 3).select("seed", "node_id", F.col("hops").cast("long").alias("hops"))


@query
def node_profiles(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_profiles(model.graph_nodes(spark, d), model.graph_edges(spark, d))


@query
def relation_profiles(spark: SparkSession, d: str) -> DataFrame:
    return graph.relation_profiles(model.graph_edges(spark, d))


@query
def communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of high modularity over the whole graph; rounds that gain under a thousandth end a phase."""
    return community.modularity_communities(model.graph_nodes(spark, d), model.graph_edges(spark, d), min_gain=1e-3)


@query
def community_activation(spark: SparkSession, d: str) -> DataFrame:
    """Nations with their people and suppliers as communities."""
    edges = model.graph_edges(spark, d)
    members = edges.where("relation_type = 'located_in'").select(F.col("source").alias("node_id"), F.col("target").alias("community"))
    members = members.unionByName(members.select(F.col("community").alias("node_id"), "community").distinct())
    return graph.community_activation(members, edges)


# --- consolidation


def _entity_candidates(spark: SparkSession, d: str) -> DataFrame:
    part = model.table(spark, d, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("label"), F.when(F.col("p_size") > 45, "project").when(F.col("p_size") < 3, "event").otherwise("concept").alias("entity_type"))
    return part


@query
def entity_groups(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.entity_quality(consolidate.entity_groups(_entity_candidates(spark, d)))


@query
def edge_groups(spark: SparkSession, d: str) -> DataFrame:
    li = model.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("relation_type"), F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("evidence_ref"))
    return consolidate.edge_groups(li)


@query
def regex_relations(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.relation_candidates(model.evidence(spark, d), ["evidence_ref"], "speaker")


@query
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.quality_gate(model.graph_nodes(spark, d), model.graph_edges(spark, d))


# --- routing


@query
def route_salience(spark: SparkSession, d: str) -> DataFrame:
    rows = routing.salience_axes(conversations(spark, d)).withColumn("route", routing.salience_route())
    return rows.select(*CONV, "value", "entity", "keyphrase", "risk", "complexity", "low", "route")


@query
def mock_proposals(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select(*CONV, routing.mock_proposal(F.col("text")).alias("proposal"))


@query
def review_pools(spark: SparkSession, d: str) -> DataFrame:
    ev = model.evidence(spark, d).withColumn("kind", routing.mock_proposal(F.col("text")))
    kind = F.when(F.col("kind").isin("semantic", "procedural"), "portrait_fact_candidate").when(F.col("kind") == "episodic", "hypothesis_candidate").otherwise(F.col("kind"))
    sampled = routing.hash_split(F.col("evidence_ref"), 0.1, "audit") == "train"
    pool = routing.review_pool(kind, F.col("contamination_risk") == "high", F.col("subject_role") == "target", F.length("text") > 80, sampled)
    return ev.withColumn("pool", pool).groupBy("pool").agg(F.count("*").alias("n"))


@query
def policy_grid(spark: SparkSession, d: str) -> DataFrame:
    docs = model.table(spark, d, "documents").join(model.table(spark, d, "labels"), "doc_id").withColumn("s", T.sentence_count(F.col("text")))
    return routing.policy_grid(docs, "s", "quality", [1, 2, 4, 8, 16], [2, 4, 8, 16, 32])


@query
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return model.table(spark, d, "documents").select("doc_id", routing.hash_split(F.col("doc_id"), 0.8).alias("part"))


# --- incremental maintenance


@query
def op_status_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = maintain.latest_rows(model.operations(spark, d), ["operation_id"], ["ts", "event_id"])
    return rows.select("operation_id", "n_rows", "event_id", "operation_type", "status")


@query
def latest_view(spark: SparkSession, d: str) -> DataFrame:
    rows = maintain.latest_rows(model.operations(spark, d), ["operation_id"], ["ts", "event_id"])
    late = model.table(spark, d, "events").where("value > 90").select(F.concat_ws(":", F.lit("op"), "user_id", "event_type").alias("operation_id"), F.lit("review").alias("action"))
    return maintain.latest_view(rows, late, "operation_id", ["status"]).select("operation_id", "view_status", "view_reason")


@query
def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    orders = model.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = orders.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("X"))
    return maintain.overlay(orders, changed, "o_orderkey", F.col("o_orderstatus") == "X")


@query
def change_detect(spark: SparkSession, d: str) -> DataFrame:
    orders = model.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    before = orders.where("o_orderkey % 5 <> 0")
    after = orders.where("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return maintain.compare_tables(before, after, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query
def rebuild_compare(spark: SparkSession, d: str) -> DataFrame:
    return change_detect(spark, d).groupBy("change").agg(F.count("*").alias("n"))


@query
def add_only_batch(spark: SparkSession, d: str) -> DataFrame:
    """All orders are registered; the batch holds a row an order line under twice its key, so most keys
    repeat and half of them are known."""
    orders = model.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    batch = model.table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("o_orderkey"), F.col("l_partkey").alias("o_custkey"))
    _, rejected = maintain.append_batch(orders, batch, "o_orderkey")
    return rejected


@query
def dependency_reverse_index(spark: SparkSession, d: str) -> DataFrame:
    return maintain.reverse_index(model.table(spark, d, "lineitem"), "l_orderkey", {"part": "l_partkey", "supplier": "l_suppkey", "flag": "l_returnflag"})


@query
def impact(spark: SparkSession, d: str) -> DataFrame:
    ev = model.evidence(spark, d)
    scope = ev.where("conv_id % 10 = 3").select(F.lit("source_id").alias("kind"), F.col("source_id").alias("id")).unionByName(ev.where("turn = 0 AND conv_id % 10 = 4").select(F.lit("evidence_ref").alias("kind"), F.col("evidence_ref").alias("id")))
    units = memory.memory_units(ev).select(F.col("memory_id").alias("unit_id"), "source_id", "evidence_ref")
    return maintain.impact(scope, {"evidence": ev.withColumn("unit_id", F.col("evidence_ref")), "memory": units})


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Early target turns as known units, late ones as new ones."""
    ev = model.evidence(spark, d).where("subject_role = 'target'")
    row = lambda df: df.select(F.col("evidence_ref").alias("id"), F.col("speaker").alias("subject"), "text", F.array("evidence_ref").alias("evidence_refs"), F.array("source_id").alias("source_refs"))
    return row(ev.where("turn >= 2")), row(ev.where("turn < 2"))


@query
def s1_matches(spark: SparkSession, d: str) -> DataFrame:
    m = maintain.compare_units(*_versions(spark, d))
    return m.select("new_id", "old_id", F.round("jaccard", 6).alias("jaccard"), F.round("cosine", 6).alias("cosine"), "score")


@query
def s1_delta(spark: SparkSession, d: str) -> DataFrame:
    new, old = _versions(spark, d)
    return maintain.delta_types(new, maintain.compare_units(new, old, best_only=True))


@query
def s2_affected(spark: SparkSession, d: str) -> DataFrame:
    new, old = _versions(spark, d)
    deltas = maintain.delta_types(new, maintain.compare_units(new, old, best_only=True))
    deltas = new.select(F.col("id").alias("new_id"), F.element_at("source_refs", 1).alias("subject"), F.col("source_refs").alias("evidence_refs")).join(deltas, "new_id")
    units = old.select(F.col("id").alias("unit_id"), F.element_at("source_refs", 1).alias("subject"), F.col("source_refs").alias("evidence_refs"))
    return maintain.affected_units(deltas, units).select("new_id", "unit_id", "hit", "s2_signal", "graph_signal")


@query
def overlap_measures(spark: SparkSession, d: str) -> DataFrame:
    """Set measures between a turn and the next one of its session."""
    rows = memory.neighbour_ids(model.evidence(spark, d), ["source_id"], "turn", "text")
    a, b = T.delta_tokens(F.col("text")), T.delta_tokens(F.col("next_ref"))
    return rows.where("next_ref IS NOT NULL").select("evidence_ref", F.round(A.overlap_ratio(a, b), 6).alias("overlap"), F.round(A.jaccard(a, b), 6).alias("jaccard"))


@query
def stream_latest_view(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.latest import stream_latest

    return stream_latest(spark, f"{d}/events.parquet")


from . import candidate_queries, community_queries, compare_queries, graph_queries, indexed_queries, learning_queries, review_queries, segment_queries, service_queries, span_queries  # noqa: E402, F401  (register themselves)
