"""Queries of the evidence service over whole tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import retrieval, service
from .oracles import ORACLES, word_set
from .plans import model, store
from .plans.session import bounded, settled
from .queries import query


def oracle(sql: str):
    def keep(f):
        ORACLES[f.__name__] = sql
        return query(f)

    return keep


_ALIAS_SQL = f"""{store.SQL},
flat AS (SELECT unnest(list_distinct([evidence_ref, display_ref, source_specific_ref, alias])) AS ref, evidence_ref, ordinal FROM ev),
names AS (SELECT ref, arg_min(evidence_ref, ordinal) AS evidence_ref FROM flat GROUP BY ref)"""


@oracle(f"WITH {_ALIAS_SQL} SELECT ref, evidence_ref FROM names")
def alias_evidence(spark: SparkSession, d: str) -> DataFrame:
    return service.alias_map(store.evidence(spark, d))


@oracle(f"""WITH {store.SQL}
SELECT e.evidence_ref, s.path_or_uri AS source_path, coalesce(e.raw_source_id, s.raw_source_id) AS raw_id, r.raw_source_id IS NOT NULL AS raw_resolved,
  CASE WHEN e.raw_source_id IS NULL THEN 'missing_raw_source_id' WHEN r.raw_source_id IS NULL THEN 'raw_source_manifest_missing' END AS alignment_warning
FROM ev e LEFT JOIN src s USING (source_id) LEFT JOIN raws r ON r.raw_source_id = coalesce(e.raw_source_id, s.raw_source_id)""")
def evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = service.with_sources(store.evidence(spark, d), store.sources(spark, d), store.raw_sources(spark, d))
    return rows.select("evidence_ref", "source_path", "raw_id", "raw_resolved", "alignment_warning")


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """References of every kind, some of them to nothing, a few for each turn."""
    c, t = F.col("conv_id"), F.col("turn")
    kinds = ["evidence_ref", "display_ref", "source_specific_ref", F.element_at("ref_aliases", 1), F.concat_ws(":", F.lit("memory"), c, t), "source_id"]
    kinds += [F.concat_ws(":", F.lit(k), c, t) for k in ("evidence:lost", "report", "audit", "cache", "other")]
    return store.evidence(spark, d).select(F.explode(F.array(*kinds)).alias("ref_id"))


_REFS_SQL = """refs AS (SELECT unnest([evidence_ref, display_ref, source_specific_ref, alias, concat_ws(':', 'memory', conv_id, turn), source_id,
  concat_ws(':', 'evidence:lost', conv_id, turn), concat_ws(':', 'report', conv_id, turn), concat_ws(':', 'audit', conv_id, turn),
  concat_ws(':', 'cache', conv_id, turn), concat_ws(':', 'other', conv_id, turn)]) AS ref_id FROM ev)"""


@oracle(f"""WITH {_ALIAS_SQL}, {_REFS_SQL},
typed AS (SELECT ref_id, n.evidence_ref AS e, CASE WHEN starts_with(ref_id, 'evidence:') OR n.ref IS NOT NULL THEN 'evidence_ref' WHEN starts_with(ref_id, 'memory:') THEN 'memory_id'
  WHEN starts_with(ref_id, 'source:') THEN 'source_ref' WHEN starts_with(ref_id, 'report:') THEN 'report_ref' WHEN starts_with(ref_id, 'audit:') THEN 'audit_ref'
  WHEN starts_with(ref_id, 'cache:') THEN 'cache_ref' ELSE 'unknown' END AS ref_type FROM refs LEFT JOIN names n ON n.ref = ref_id),
found AS (SELECT t.ref_id, t.ref_type, t.e, CASE t.ref_type WHEN 'evidence_ref' THEN ev.text WHEN 'memory_id' THEN mem.content WHEN 'source_ref' THEN src.path_or_uri END AS x
  FROM typed t LEFT JOIN ev ON ev.evidence_ref = t.e LEFT JOIN mem ON mem.memory_id = t.ref_id LEFT JOIN src ON src.source_id = t.ref_id)
SELECT ref_id, ref_type, x IS NOT NULL AS resolved, CASE WHEN x IS NOT NULL THEN CASE WHEN ref_type = 'evidence_ref' THEN e ELSE ref_id END END AS target, coalesce(x, '') AS text,
  CASE WHEN x IS NOT NULL THEN NULL WHEN ref_type IN ('report_ref', 'audit_ref', 'cache_ref') THEN 'extension_store_not_configured'
    WHEN ref_type = 'unknown' THEN 'unsupported_ref_type' ELSE 'ref_not_found' END AS failure_reason,
  CASE WHEN x IS NOT NULL THEN NULL WHEN ref_type = 'report_ref' THEN 'report_context_not_evidence' WHEN ref_type = 'audit_ref' THEN 'audit_context_not_evidence'
    WHEN ref_type = 'cache_ref' THEN 'cache_not_truth' ELSE 'unresolved_ref' END AS warning
FROM found""")
def resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    return service.resolve_refs(_refs(spark, d), store.evidence(spark, d), store.memory_units(spark, d), store.sources(spark, d), extensions=True)


@oracle(f"""WITH {_ALIAS_SQL}, {_REFS_SQL}
SELECT ref_id, CASE WHEN starts_with(ref_id, 'evidence:') OR ref_id IN (SELECT ref FROM names) THEN 'evidence_ref' ELSE coalesce(
  CASE split_part(ref_id, ':', 1) WHEN 'memory' THEN 'memory_id' WHEN 'source' THEN 'source_ref' WHEN 'report' THEN 'report_ref' WHEN 'audit' THEN 'audit_ref' WHEN 'cache' THEN 'cache_ref' END, 'unknown') END AS ref_type,
  count(*) AS n FROM refs GROUP BY ALL""")
def ref_types(spark: SparkSession, d: str) -> DataFrame:
    names = service.alias_map(store.evidence(spark, d)).withColumnRenamed("ref", "ref_id")
    rows = _refs(spark, d).join(names, "ref_id", "left")
    return rows.groupBy("ref_id", service.ref_type(F.col("ref_id"), F.col("evidence_ref").isNotNull()).alias("ref_type")).agg(F.count("*").alias("n"))


@oracle(f"WITH {store.SQL} SELECT evidence_ref, source_id FROM ev WHERE speaker IN ('user', 'system') AND conv_id % 20 IN (3, 4, 5)")
def evidence_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = service.evidence_filter(store.evidence(spark, d), subject_ids=("user", "system"), participant_ids=("p3", "p4", "p5"))
    return rows.select("evidence_ref", "source_id")


@oracle(f"""WITH {store.SQL} SELECT memory_id, status, status NOT IN ('rejected', 'archived', 'superseded', 'unresolved') AS query_eligible
FROM mem WHERE status IN ('accepted_for_experiment', 'accepted_by_user', 'archived')""")
def memory_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = service.memory_filter(store.memory_units(spark, d), (*service.DEFAULT_MEMORY_STATUSES, "archived"))
    return rows.select("memory_id", "status", service.query_eligible(F.col("status")).alias("query_eligible"))


@oracle("""SELECT o_orderkey, CASE WHEN s <> '' THEN s WHEN r <> '' THEN r ELSE 'active' END AS status,
  CASE WHEN s <> '' THEN s WHEN r <> '' THEN r ELSE 'active' END NOT IN ('rejected', 'archived', 'superseded', 'unresolved') AS query_eligible,
  CASE WHEN e <> '' THEN e WHEN v IN ('current', 'recurring', 'historical', 'temporary', 'unknown') THEN v ELSE 'unknown' END AS temporal_status
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'P' THEN '' END AS s, CASE WHEN o_orderkey % 5 = 0 THEN 'rejected' END AS r,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'current' END AS e,
  CASE o_orderkey % 4 WHEN 0 THEN 'historical' WHEN 1 THEN 'forever' WHEN 2 THEN 'recurring' END AS v FROM orders)""")
def unit_status(spark: SparkSession, d: str) -> DataFrame:
    """Status and temporal status of orders as units whose fields are filled unevenly."""
    k = F.col("o_orderkey")
    s = F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "P", "")
    status = service.unit_status(s, F.when(k % 5 == 0, "rejected"))
    explicit = F.when(k % 3 == 0, "").when(k % 3 == 1, "current")
    validity = F.when(k % 4 == 0, "historical").when(k % 4 == 1, "forever").when(k % 4 == 2, "recurring")
    return model.table(spark, d, "orders").select("o_orderkey", status.alias("status"), service.query_eligible(status).alias("query_eligible"), service.temporal_status(explicit, validity).alias("temporal_status"))


def _owners(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that refer to their turns by three kinds of name, one in four to a lost one too."""
    rows = store.evidence(spark, d)
    name = F.when(F.col("turn") % 3 == 0, F.col("evidence_ref")).when(F.col("turn") % 3 == 1, F.col("source_specific_ref")).otherwise(F.element_at("ref_aliases", 1))
    refs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(name)).alias("refs"))
    lost = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("evidence:lost"))).otherwise(F.array().cast("array<string>"))
    return refs.select("conv_id", F.when(F.col("conv_id") % 9 == 0, lost).otherwise(F.concat("refs", lost)).alias("refs"))


@oracle(f"""WITH {_ALIAS_SQL},
r AS (SELECT conv_id, CASE turn % 3 WHEN 0 THEN evidence_ref WHEN 1 THEN source_specific_ref ELSE alias END AS ref FROM ev WHERE conv_id % 9 <> 0
  UNION ALL SELECT DISTINCT conv_id, 'evidence:lost' FROM ev WHERE conv_id % 4 = 0),
n AS (SELECT c.conv_id, count(r.ref) AS n_refs, count(names.evidence_ref) AS n_resolved FROM (SELECT DISTINCT conv_id FROM ev) c
  LEFT JOIN r USING (conv_id) LEFT JOIN names USING (ref) GROUP BY c.conv_id)
SELECT *, CASE WHEN n_refs = 0 THEN 'unknown' WHEN n_refs = n_resolved THEN 'direct_refs_resolved' WHEN n_resolved > 0 THEN 'partial_refs_resolved' ELSE 'unresolved_refs' END AS status FROM n""")
def ref_resolution(spark: SparkSession, d: str) -> DataFrame:
    names = service.alias_map(store.evidence(spark, d))
    return service.resolution_status(_owners(spark, d), names, "conv_id", "refs")


@oracle(f"""WITH {store.SQL}, e AS (SELECT conv_id, text, min(turn) AS turn FROM ev WHERE text <> '' GROUP BY ALL)
SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM e GROUP BY conv_id""")
def evidence_texts(spark: SparkSession, d: str) -> DataFrame:
    """The joined texts of every session's turns."""
    ev = store.evidence(spark, d)
    owners = ev.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "evidence_ref"))), lambda x: x["evidence_ref"]).alias("refs"))
    rows = service.gathered_text(owners, ev, "conv_id", "refs")
    return rows.select("conv_id", F.md5("text").alias("text_md5"))


_MODE_SQL = """m AS (SELECT source_id, ['direct_scan', 'auto', 'bm25_indexed', 'embedding_indexed', 'hybrid_indexed', 'degraded_direct_scan', 'nonsense'][k % 7 + 1] AS requested,
  (k // 7) % 2 = 0 AS b, (k // 14) % 2 = 0 AS e, (k // 28) % 2 = 0 AS u FROM (SELECT DISTINCT source_id, conv_id AS k FROM ev))"""


@oracle(f"""WITH {store.SQL}, {_MODE_SQL},
a AS (SELECT *, CASE WHEN requested = 'nonsense' THEN 'auto' ELSE requested END AS asked FROM m),
p AS (SELECT *, CASE asked WHEN 'direct_scan' THEN 'direct_scan' WHEN 'auto' THEN CASE WHEN b AND e AND u THEN 'hybrid_indexed' WHEN b THEN 'bm25_indexed' WHEN e AND u THEN 'embedding_indexed' ELSE 'degraded_direct_scan' END
  WHEN 'bm25_indexed' THEN CASE WHEN b THEN asked ELSE 'degraded_direct_scan' END WHEN 'embedding_indexed' THEN CASE WHEN e AND u THEN asked ELSE 'degraded_direct_scan' END
  WHEN 'hybrid_indexed' THEN CASE WHEN b OR (e AND u) THEN asked ELSE 'degraded_direct_scan' END ELSE 'degraded_direct_scan' END AS mode FROM a)
SELECT source_id, requested, mode, CASE WHEN mode = 'degraded_direct_scan' THEN CASE asked WHEN 'auto' THEN 'index_missing_or_stale' WHEN 'bm25_indexed' THEN 'bm25_index_missing_or_stale'
  WHEN 'embedding_indexed' THEN 'embedding_index_missing_stale_or_unusable' WHEN 'hybrid_indexed' THEN 'hybrid_indexes_missing_or_stale' ELSE 'degraded_direct_scan_returned_no_hits' END END AS reason FROM p""")
def retrieval_modes(spark: SparkSession, d: str) -> DataFrame:
    """The mode of every store for its request and the state of its indexes."""
    k = F.col("conv_id")
    asked = F.element_at(F.array(*[F.lit(m) for m in (*service.MODES, "nonsense")]), (k % 7 + 1).cast("int"))
    on = lambda n: F.floor(k / n) % 2 == 0
    rows = store.evidence(spark, d).select("source_id", "conv_id").distinct().withColumn("requested", asked)
    rows = rows.withColumn("mode", service.plan_mode(F.col("requested"), on(7), on(14), on(28)))
    return rows.select("source_id", "requested", "mode", service.degraded_reason(F.col("requested"), F.col("mode")).alias("reason"))


_LEX = f"""q AS (SELECT item_id AS query_id, text AS question, {word_set('text')} AS w FROM benchmark),
qw AS (SELECT query_id, len(w) AS n_q, unnest(w) AS word FROM q),
ew AS (SELECT evidence_ref AS id, unnest({word_set('text')}) AS word FROM ev),
eh AS (SELECT query_id, 'rr:' || id AS result_id, 'raw_evidence' AS item_layer, round(count(*) + count(*) / any_value(n_q), 6) AS score, '' AS warnings FROM ew JOIN qw USING (word) GROUP BY query_id, id),
mw AS (SELECT memory_id AS id, unnest({word_set('content')}) AS word FROM mem WHERE status IN ('accepted_for_experiment', 'accepted_by_user')),
mh AS (SELECT query_id, id, round(count(*) + count(*) / any_value(n_q), 6) AS score FROM mw JOIN qw USING (word) GROUP BY query_id, id),
mr AS (SELECT query_id, 'rr:' || id AS result_id, 'memory_unit' AS item_layer, score, array_to_string(list_sort(list_filter(['memory_unit_not_raw_evidence',
   CASE WHEN NOT has_back THEN 'memory_summary_without_backpointer' END, CASE WHEN inference_level <> 'direct' THEN 'inference_level:' || inference_level END], lambda x: x IS NOT NULL)), ',') AS warnings,
   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM mh JOIN mem ON memory_id = id QUALIFY rank <= 5),
res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_layer DESC, result_id) AS rank
  FROM (SELECT * FROM eh UNION ALL SELECT * EXCLUDE (rank) FROM mr) QUALIFY rank <= 5)"""


@oracle(f"WITH {store.SQL}, {_LEX} SELECT * FROM mr")
def retrieve_memory(spark: SparkSession, d: str) -> DataFrame:
    return service.retrieve_memory(model.questions(spark, d), store.memory_units(spark, d))


def _results(spark: SparkSession, d: str) -> DataFrame:
    return service.retrieve(model.questions(spark, d), store.evidence(spark, d), store.memory_units(spark, d))


@oracle(f"WITH {store.SQL}, {_LEX} SELECT * FROM res")
def retrieve_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d)


@oracle(f"""WITH {store.SQL}, {_LEX}, t AS (SELECT 'rr:' || evidence_ref AS result_id, text FROM ev UNION ALL SELECT 'rr:' || memory_id, content FROM mem)
SELECT query_id, result_id, rank, CASE item_layer WHEN 'raw_evidence' THEN 'assert' ELSE 'background_only' END AS use_policy,
  CASE WHEN length(text) <= 160 THEN text ELSE rtrim(substr(text, 1, 157)) || '...' END AS summary, text FROM res JOIN t USING (result_id)""")
def handoff_packets(spark: SparkSession, d: str) -> DataFrame:
    texts = store.evidence(spark, d).select(F.concat(F.lit("rr:"), F.col("evidence_ref")).alias("result_id"), "text")
    texts = texts.unionByName(store.memory_units(spark, d).select(F.concat(F.lit("rr:"), F.col("memory_id")).alias("result_id"), F.col("content").alias("text")))
    return service.handoff(_results(spark, d), texts, by_value=True)


@oracle(f"""WITH {store.SQL}, {_LEX}, n AS (SELECT query_id, count(DISTINCT result_id) AS n_refs FROM res WHERE item_layer = 'raw_evidence' GROUP BY query_id),
j AS (SELECT query_id, question, coalesce(n_refs, 0) AS n_refs, ends_with(lower(trim(question)), '?') OR regexp_matches(lower(trim(question)), '^({'|'.join(T.QUESTION)}) ') AS asked FROM q LEFT JOIN n USING (query_id))
SELECT query_id, n_refs, CASE WHEN asked OR n_refs = 0 THEN 'not_checked' ELSE 'checked' END AS support_status,
  CASE WHEN asked THEN 'query_is_question_not_claim' WHEN n_refs = 0 THEN 'no_raw_evidence_refs_from_step1_retrieval' END AS warning FROM j""")
def question_support(spark: SparkSession, d: str) -> DataFrame:
    return service.question_support(model.questions(spark, d), _results(spark, d))


@oracle(f"""WITH {store.SQL} SELECT memory_id, p.support AS support, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'do_not_use' WHEN p.support = 'direct' THEN 'assert' WHEN p.support = 'partial' THEN 'cautious_assert'
  WHEN p.support IN ('weak', 'unknown', 'contradicts') THEN 'do_not_assert' WHEN turn % 3 = 0 THEN 'assert' WHEN turn % 3 = 1 THEN 'background_only' ELSE 'do_not_assert' END AS use_policy
FROM mem, (SELECT unnest(['direct', 'partial', 'weak', 'unknown', 'contradicts', NULL]) AS support) p""")
def use_policies(spark: SparkSession, d: str) -> DataFrame:
    """Every memory unit under every support strength, with layer and warning by its place."""
    support = F.explode(F.array(*[F.lit(s) for s in ("direct", "partial", "weak", "unknown", "contradicts", None)]))
    t = F.col("turn")
    layer = F.when(t % 3 == 0, "raw_evidence").when(t % 3 == 1, "memory_unit").otherwise("doc_level_summary")
    warned = F.when((F.col("conv_id") + t) % 13 == 0, "cache_not_truth").otherwise("")
    rows = store.memory_units(spark, d).select("memory_id", layer.alias("layer"), warned.alias("warned"), support.alias("support"))
    return rows.select("memory_id", "support", service.use_policy(F.col("layer"), F.col("warned"), F.col("support")).alias("use_policy"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as index entries that name their unit in one of three ways; ``raw`` is the product with vector 0."""
    rows = model.table(spark, d, "embeddings")
    asked = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    v = F.col("vec_id")
    return rows.join(asked).select(
        v.alias("vector_entry_id"),
        F.when(v % 3 == 0, F.concat(F.lit("qu:"), v % 100)).alias("query_unit_id"),
        F.when(v % 3 != 2, F.concat(F.lit("obj:"), v % 250)).alias("object_id"),
        F.when(v % 2 == 0, F.concat(F.lit("obj:"), v % 700)).alias("artifact_ref"),
        F.round(V.dot(F.col("embedding"), F.col("q")), 5).alias("raw"),
    )


_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@oracle(f"""WITH x AS (SELECT e.vec_id AS v, round({_DOT}, 5) AS raw FROM embeddings e, embeddings q WHERE q.vec_id = 0),
u AS (SELECT DISTINCT doc_id FROM documents),
k AS (SELECT 1 AS o, 'exact_query_unit_id' AS alignment, 'qu:' || (v % 100) AS key, v, raw FROM x WHERE v % 3 = 0
  UNION ALL SELECT 2, 'object_id_fallback', 'obj:' || (v % 250), v, raw FROM x WHERE v % 3 <> 2 UNION ALL SELECT 3, 'artifact_ref_fallback', 'obj:' || (v % 700), v, raw FROM x WHERE v % 2 = 0),
b AS (SELECT o, alignment, key, arg_min(v, (-raw, v)) AS vector_entry_id, max(raw) AS embedding_raw, count(*) AS n_hits FROM k GROUP BY ALL),
j AS (SELECT doc_id, arg_min(b, o) AS b FROM u JOIN b ON (o = 1 AND key = 'qu:' || doc_id) OR (o > 1 AND key = 'obj:' || doc_id) GROUP BY doc_id)
SELECT 'qu:' || u.doc_id AS query_unit_id, 'obj:' || u.doc_id AS artifact_ref, j.b.alignment AS alignment, j.b.vector_entry_id AS vector_entry_id, j.b.embedding_raw AS embedding_raw, coalesce(j.b.n_hits, 0) AS n_hits
FROM u LEFT JOIN j USING (doc_id)""")
def vector_alignment(spark: SparkSession, d: str) -> DataFrame:
    units = model.table(spark, d, "documents").select("doc_id").distinct()
    units = units.select(F.concat(F.lit("qu:"), F.col("doc_id")).alias("query_unit_id"), F.concat(F.lit("obj:"), F.col("doc_id")).alias("artifact_ref"))
    return service.align_vectors(units, _entries(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """All questions against user turns: BM25, and the vectors that stand for question and session."""
    turns = model.table(spark, d, "conversations").where("role = 'user'")
    q = model.questions(spark, d)
    bm25 = retrieval.bm25(q, turns, ["conv_id", "turn"])
    vec = model.table(spark, d, "embeddings")
    n = vec.agg(F.count("*").alias("n"))  # one row
    place = lambda df, k, c: df.join(F.broadcast(n)).withColumn("vec_id", F.expr(k) % F.col("n")).join(vec.select("vec_id", F.col("embedding").alias(c)), "vec_id").drop("n", "vec_id")
    raw = V.dot(F.col("qv"), F.col("uv")).alias("embedding_raw")
    held = place(turns.where("turn % 5 <> 4").select("conv_id", "turn"), "conv_id * 13 + turn", "uv")  # one turn in five has no vector
    asked = bounded(place(q.select("query_id"), "query_id * 7", "qv"))
    # every question meets every vector; a pair that BM25 does not find can only be among the best if its vector is
    near = retrieval.top_k(held.join(asked).select("query_id", "conv_id", "turn", raw).where("embedding_raw > 0"), 8, "embedding_raw", ["conv_id", "turn"])
    hits = bm25.select("query_id", "conv_id", "turn").unionByName(near.select("query_id", "conv_id", "turn")).distinct()
    pairs = hits.join(asked, "query_id").join(held, ["conv_id", "turn"])
    vectors = pairs.select("query_id", "conv_id", "turn", raw)
    rows = service.unit_scores(bm25, vectors, ["conv_id", "turn"])
    best = retrieval.top_k(rows, 8, "score", ["conv_id", "turn"])
    return service.pruned(best, (F.col("rank") <= 3) & (F.col("score") >= 0.25), retrieval.bucket(F.col("score")))


@query
def pruned_context(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("query_id", "conv_id", "turn", "score", "bm25_norm", "embedding_norm", "rank", "bucket", "prune_status", "use_policy")


@query
def packet_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = settled(_scored(spark, d))  # a few rows a question, read twice
    turns = model.table(spark, d, "conversations").select("conv_id", "turn", "text")
    q = model.questions(spark, d)
    chosen = rows.where("prune_status = 'selected'").join(turns, ["conv_id", "turn"]).join(q, "query_id")
    common = F.size(F.array_intersect(T.word_set(F.col("question")), T.word_set(F.col("text"))))
    strength = F.when(common >= 4, "direct").when(common > 0, "partial").otherwise("weak")
    return service.packet_quality(q, rows, chosen.select("query_id", strength.alias("support_strength")))

