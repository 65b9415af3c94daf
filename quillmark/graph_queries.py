"""Queries of graph retrieval over the whole graph, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph
from .operators import graphquery as GQ
from .oracles import G
from .plans import model
from .plans.session import settled
from .service_queries import oracle

TOP_K = 12


def questions(spark: SparkSession, d: str) -> DataFrame:
    """A question a nation, which also names a part."""
    n = model.table(spark, d, "nation").select("n_nationkey", "n_name")
    p = model.table(spark, d, "part").select((F.col("p_partkey") - 1).alias("k"), "p_name").where("k % 7 = 0 AND k < 175")
    return n.join(p, F.col("k") == F.col("n_nationkey") * 7).select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("What is part_of "), "n_name", F.lit(" and the "), "p_name").alias("question"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Graph nodes with a quality hint: parts are fragments, persons stable."""
    hint = F.when(F.col("entity_type") == "concept", "generic_fragment").otherwise("stable")
    return model.graph_nodes(spark, d).withColumn("hint", hint)


def edges(spark: SparkSession, d: str, written: bool = False) -> DataFrame:
    """Edges; what a supplier sends once only is a generic relation.  ``written``: for a query that reads them several times."""
    e = model.graph_edges(spark, d, settled(model.sent_parts(spark, d)) if written else None)
    once = (F.col("relation_type") == "supplies") & (F.col("evidence_count") == 1)
    return e.withColumn("relation_type", F.when(once, "related_to_generic").otherwise(F.col("relation_type")))


_STOP = ", ".join(f"'{w}'" for w in T.GRAPH_STOPWORDS)
_TOK = lambda c: rf"list_filter(regexp_extract_all(lower(trim({c})), '[a-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]'), lambda w: w NOT IN ({_STOP}))"
_SQL = f"""{G}, gn AS (SELECT *, CASE WHEN entity_type = 'concept' THEN 'generic_fragment' ELSE 'stable' END AS hint FROM nodes),
ge AS (SELECT edge_id, source, target, CASE WHEN relation_type = 'supplies' AND evidence_count = 1 THEN 'related_to_generic' ELSE relation_type END AS relation_type, evidence_count FROM edges),
q AS (SELECT n_nationkey AS query_id, 'What is part_of ' || n_name || ' and the ' || p_name AS question FROM nation JOIN part ON p_partkey - 1 = n_nationkey * 7 WHERE (p_partkey - 1) % 7 = 0 AND p_partkey - 1 < 175),
un AS (SELECT 'node:' || node_id AS unit_id, 'node' AS kind, node_id AS object_id, label || ' ' || entity_type AS text, 1::BIGINT AS n_refs, false AS generic, hint = 'generic_fragment' AS weak FROM gn
  UNION ALL SELECT 'edge:' || edge_id, 'edge', edge_id, a.label || ' ' || relation_type || ' ' || b.label, evidence_count, relation_type = 'related_to_generic', false FROM ge JOIN nodes a ON a.node_id = source JOIN nodes b ON b.node_id = target),
ub AS (SELECT unit_id, {_TOK('text')} AS b FROM un), us AS (SELECT count(*) AS n, avg(len(b)) AS al FROM ub),
up AS (SELECT unit_id, l, term, count(*) AS tf FROM (SELECT unit_id, len(b) AS l, unnest(b) AS term FROM ub) GROUP BY ALL), ud AS (SELECT term, count(*) AS df FROM up GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK('question')}) AS term FROM q) GROUP BY ALL),
bs AS (SELECT query_id, unit_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))) AS s FROM qt JOIN up USING (term) JOIN ud USING (term), us GROUP BY ALL),
bm AS (SELECT query_id, 'bm25_graph_units' AS branch, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, unit_id) AS rank, unit_id, round(s, 6) AS raw_score, round(s / max(s) OVER (PARTITION BY query_id), 6) AS norm_score FROM bs WHERE s > 0 QUALIFY rank <= 36),
st0 AS (SELECT query_id, {_TOK('question')} AS w FROM q),
st AS (SELECT query_id, list_slice(t, 1, 16) AS ts FROM (SELECT query_id, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_filter(w, lambda x: length(x) > 1)) AS t0,
  list_transform(list_sort(list_transform(list_distinct(t0), lambda x: struct_pack(p := list_position(t0, x), x := x))), lambda z: z.x) AS t FROM st0)),
sa AS (SELECT query_id, unnest(range(0, len(ts))) AS term_no, unnest(ts) AS term FROM st),
sc AS (SELECT term, node_id, label, CASE WHEN lower(trim(label)) = term THEN 20 WHEN contains(lower(trim(label)), term) OR contains(term, lower(trim(label))) THEN 10 ELSE 0 END + 3 * len(list_intersect({_TOK('label')}, {_TOK('term')})) AS raw_score
  FROM gn, (SELECT DISTINCT term FROM sa)),
sb AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY raw_score DESC, label, node_id) AS rn FROM sc WHERE raw_score > 0 QUALIFY rn <= 3),
sd AS (SELECT query_id, 'seed_node_match' AS branch, row_number() OVER (PARTITION BY query_id ORDER BY term_no, rn) AS rank, 'node:' || node_id AS unit_id, term, node_id, raw_score::BIGINT AS raw_score FROM sa JOIN sb USING (term)),
ar AS (SELECT n_nationkey AS query_id, 0 AS ref_no, 'nation:' || n_nationkey AS ref FROM nation UNION ALL SELECT n_nationkey, 1, 'supplier:' || (n_nationkey * 3 + 1) FROM nation),
aa AS (SELECT query_id, ref_no, 0 AS k, 'node:' || ref AS unit_id FROM ar JOIN gn ON node_id = ref UNION ALL SELECT DISTINCT query_id, ref_no, 1, 'edge:' || edge_id FROM ar JOIN ge ON ref IN (edge_id, source, target)),
an AS (SELECT query_id, 'selected_context_anchor' AS branch, row_number() OVER (PARTITION BY query_id ORDER BY ref_no, k, unit_id) AS rank, unit_id FROM aa QUALIFY rank <= 24),
se AS (SELECT DISTINCT query_id, substr(unit_id, 6) AS node_id FROM (SELECT query_id, unit_id FROM sd UNION ALL SELECT query_id, unit_id FROM an) WHERE starts_with(unit_id, 'node:')),
ne AS (SELECT query_id, edge_id, count(*) AS e FROM (SELECT DISTINCT query_id, edge_id, node_id FROM se JOIN ge ON node_id IN (source, target)) GROUP BY ALL),
nr AS (SELECT query_id, ne.edge_id, relation_type, a.label || ' --' || relation_type || '--> ' || b.label AS text, 2 * len(list_intersect({_TOK('a.label')}, {_TOK('question')})) + 2 * len(list_intersect({_TOK('b.label')}, {_TOK('question')})) + 3 * len(list_intersect({_TOK('relation_type')}, {_TOK('question')}))
  + CASE WHEN e = 2 OR source = target THEN 8 ELSE 0 END + CASE WHEN relation_type <> 'related_to_generic' THEN 2 ELSE 0 END + least(evidence_count, 3) AS raw_score FROM ne JOIN ge USING (edge_id) JOIN nodes a ON a.node_id = source JOIN nodes b ON b.node_id = target JOIN q USING (query_id)),
nb AS (SELECT query_id, 'graph_neighborhood_bfs_1hop' AS branch, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, relation_type = 'related_to_generic', text, edge_id) AS rank, 'edge:' || edge_id AS unit_id, raw_score::BIGINT AS raw_score FROM nr QUALIFY rank <= 36),
al AS (SELECT query_id, branch, rank, unit_id FROM bm UNION ALL SELECT query_id, branch, rank, unit_id FROM sd UNION ALL SELECT * FROM an UNION ALL SELECT query_id, branch, rank, unit_id FROM nb),
rr AS (SELECT query_id, unit_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf_score, count(DISTINCT branch) AS branch_count, array_to_string(list_sort(list(DISTINCT branch)), ',') AS branches FROM al GROUP BY ALL),
po AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, branch_count DESC, unit_id) <= 36),
pq AS (SELECT po.*, un.* EXCLUDE (unit_id), (n_refs = 0)::INT + generic::INT AS n_warnings, least(1.0::DOUBLE, len(list_intersect({_TOK('un.text')}, {_TOK('question')})) / 3.0::DOUBLE) AS ov,
  CASE WHEN max(rrf_score) OVER w > min(rrf_score) OVER w THEN (rrf_score - min(rrf_score) OVER w) / (max(rrf_score) OVER w - min(rrf_score) OVER w) ELSE 0.5 END AS nm FROM po JOIN un USING (unit_id) JOIN q USING (query_id) WINDOW w AS (PARTITION BY query_id)),
pr AS (SELECT *, round(0.58::DOUBLE * nm + least(0.16::DOUBLE, 0.055::DOUBLE * (branch_count - 1)) + CASE WHEN n_refs > 0 THEN 0.10::DOUBLE ELSE -0.18::DOUBLE END + CASE kind WHEN 'edge' THEN 0.09::DOUBLE ELSE -0.035::DOUBLE END + 0.07::DOUBLE * ov
  - CASE WHEN generic THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN weak THEN 0.08::DOUBLE ELSE 0 END - least(0.14::DOUBLE, 0.028::DOUBLE * n_warnings), 6) AS rerank_score FROM pq),
it AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_score DESC, unit_id) AS item_rank FROM pr QUALIFY item_rank <= 12),
cx AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY kind <> 'edge', rerank_score DESC, unit_id) AS context_no, 'graphctx:' || substr(sha256(unit_id), 1, 12) AS graph_context_ref,
  CASE kind WHEN 'edge' THEN 'v03_ranked_relation' ELSE 'v03_ranked_node' END AS kind, text AS summary, CASE WHEN generic THEN 'low_graph_value' ELSE 'not_generic' END AS confidence, n_refs FROM it)"""


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """Selected context names each nation and one supplier."""
    n = model.table(spark, d, "nation")
    k = F.col("n_nationkey")
    one = n.select(k.alias("query_id"), F.lit(0).alias("ref_no"), F.concat(F.lit("nation:"), k).alias("ref"))
    return one.unionByName(n.select(k.alias("query_id"), F.lit(1).alias("ref_no"), F.concat(F.lit("supplier:"), k * 3 + 1).alias("ref")))


def _near(spark: SparkSession, d: str, n: DataFrame, e: DataFrame) -> dict[str, DataFrame]:
    """The branches that start at nodes."""
    q = questions(spark, d)
    seeds = settled(GQ.seed_branch(q, n))
    anchors = settled(GQ.anchor_branch(_refs(spark, d), n, e, 2 * TOP_K))
    found = seeds.select("query_id", "unit_id").unionByName(anchors.select("query_id", "unit_id")).where("unit_id LIKE 'node:%'")
    found = found.select("query_id", F.substring("unit_id", 6, 1000).alias("node_id"))
    return {"seed": seeds, "anchor": anchors, "near": GQ.neighbourhood_branch(q, found, n, e, 3 * TOP_K)}


def _pool(spark: SparkSession, d: str, n: DataFrame | None = None, e: DataFrame | None = None) -> DataFrame:
    q, n, e = questions(spark, d), n or nodes(spark, d), e or edges(spark, d, written=True)
    branches = [GQ.graph_bm25_branch(q, n, e, 3 * TOP_K), *_near(spark, d, n, e).values()]
    pool = settled(GQ.fused(branches, 3 * TOP_K))
    return GQ.rerank(pool, q, GQ.units_of(pool, n, e))


def _items(spark: SparkSession, d: str, n: DataFrame | None = None, e: DataFrame | None = None) -> DataFrame:
    return GQ.top_items(_pool(spark, d, n, e), "rerank_score", TOP_K)


@oracle(f"WITH {_SQL} SELECT unit_id, kind, object_id, md5(text) AS text_md5, n_refs, generic, weak FROM un")
def graph_units(spark: SparkSession, d: str) -> DataFrame:
    return GQ.units(nodes(spark, d), edges(spark, d)).withColumn("text_md5", F.md5("text")).drop("text")


@oracle(f"WITH {_SQL} SELECT * FROM bm")
def graph_bm25_branch(spark: SparkSession, d: str) -> DataFrame:
    return GQ.graph_bm25_branch(questions(spark, d), nodes(spark, d), edges(spark, d, written=True), 3 * TOP_K)


@oracle(f"WITH {_SQL} SELECT query_id, array_to_string(ts, '|') AS terms FROM st")
def seed_terms(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", F.array_join(GQ.seed_terms(F.col("question")), "|").alias("terms"))


@oracle(f"WITH {_SQL} SELECT query_id, rank, unit_id, term, raw_score FROM sd")
def seed_match(spark: SparkSession, d: str) -> DataFrame:
    return GQ.seed_branch(questions(spark, d), nodes(spark, d)).select("query_id", "rank", "unit_id", "term", "raw_score")


@oracle(f"WITH {_SQL} SELECT * FROM an")
def graph_anchors(spark: SparkSession, d: str) -> DataFrame:
    return GQ.anchor_branch(_refs(spark, d), nodes(spark, d), edges(spark, d), 2 * TOP_K)


@oracle(f"WITH {_SQL} SELECT * FROM nb")
def neighbourhood_score(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, nodes(spark, d), edges(spark, d, written=True))["near"]


@oracle(f"WITH {_SQL} SELECT query_id, unit_id, rrf_score, branch_count, branches, rerank_score FROM pr")
def feature_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d).select("query_id", "unit_id", "rrf_score", "branch_count", "branches", "rerank_score")


@oracle(f"""WITH {_SQL}, m AS (SELECT *, (length(text) % 17)::DOUBLE AS ms FROM pr), n AS (SELECT *, CASE WHEN max(ms) OVER w > min(ms) OVER w THEN (ms - min(ms) OVER w) / (max(ms) OVER w - min(ms) OVER w) ELSE 0.5 END AS a,
  CASE WHEN max(rerank_score) OVER w > min(rerank_score) OVER w THEN (rerank_score - min(rerank_score) OVER w) / (max(rerank_score) OVER w - min(rerank_score) OVER w) ELSE 0.5 END AS b FROM m WINDOW w AS (PARTITION BY query_id))
SELECT query_id, unit_id, round(0.5::DOUBLE * a + 0.5::DOUBLE * b - CASE WHEN generic THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN n_refs = 0 THEN 0.16::DOUBLE ELSE 0 END - least(0.12::DOUBLE, 0.025::DOUBLE * n_warnings), 6) AS blend_score FROM n""")
def model_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The blend with a stand-in for a model's score, a function of the text."""
    rows = GQ.model_blend(_pool(spark, d), (F.length("text") % 17).cast("double"))
    return rows.select("query_id", "unit_id", "blend_score")


@oracle(f"WITH {_SQL} SELECT * FROM cx")
def graph_context(spark: SparkSession, d: str) -> DataFrame:
    return GQ.context_rows(_items(spark, d), TOP_K)


@oracle(f"""WITH {_SQL} SELECT query_id, CASE WHEN n_refs = 0 THEN 'unresolved_or_unsafe_graph_items' WHEN confidence = 'low_graph_value' THEN 'cautious_graph_relations'
  WHEN kind = 'v03_ranked_relation' THEN 'supported_graph_relations' ELSE 'query_expansion_terms' END AS bucket, count(*) AS n FROM cx GROUP BY ALL""")
def graph_answer_buckets(spark: SparkSession, d: str) -> DataFrame:
    bucket = GQ.answer_bucket(F.col("kind"), F.lit(None).cast("string"), F.col("confidence"), F.col("n_refs"))
    return GQ.context_rows(_items(spark, d), TOP_K).groupBy("query_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@oracle(f"""WITH {_SQL}, f AS (SELECT query_id, unnest([a.label, relation_type, b.label]) AS term FROM it JOIN ge ON edge_id = object_id JOIN nodes a ON a.node_id = source JOIN nodes b ON b.node_id = target WHERE kind = 'edge')
SELECT * FROM (SELECT query_id, term, count(*) AS n FROM f WHERE term <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) <= 12""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    n, e = nodes(spark, d), edges(spark, d, written=True)
    return GQ.expansion_terms(_items(spark, d, n, e), n, e)


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Two-step paths from every supplier through its nation to the region, and three-step ones to a part."""
    e = edges(spark, d)
    home = e.where("relation_type = 'located_in' AND source LIKE 'supplier:%'").select(F.col("source").alias("s"), F.col("target").alias("n"))
    up = e.where("relation_type = 'part_of'").select(F.col("source").alias("n"), F.col("target").alias("r"))
    sent = e.where("target LIKE 'part:%'").groupBy(F.col("source").alias("s")).agg(F.min("target").alias("p"))
    rows = home.join(up, "n").join(sent, "s")
    two = rows.select(F.concat(F.lit("up:"), "s").alias("path_id"), F.array("s", "n", "r").alias("path"))
    return two.unionByName(rows.select(F.concat(F.lit("down:"), "s").alias("path_id"), F.array("r", "n", "s", "p").alias("path"))).unionByName(rows.select(F.concat(F.lit("odd:"), "s").alias("path_id"), F.array("n", "s", "p", "s").alias("path")))


_PATHS = f"""{_SQL}, hp AS (SELECT a.source AS s, a.target AS n, b.target AS r, (SELECT min(target) FROM ge c WHERE c.source = a.source AND c.target LIKE 'part:%') AS p FROM ge a JOIN ge b ON b.source = a.target AND b.relation_type = 'part_of'
  WHERE a.relation_type = 'located_in' AND a.source LIKE 'supplier:%'),
pa AS (SELECT 'up:' || s AS path_id, [s, n, r] AS path FROM hp WHERE p IS NOT NULL UNION ALL SELECT 'down:' || s, [r, n, s, p] FROM hp WHERE p IS NOT NULL UNION ALL SELECT 'odd:' || s, [n, s, p, s] FROM hp WHERE p IS NOT NULL),
sp AS (SELECT path_id, i - 1 AS step, path[i] AS a, path[i + 1] AS b FROM (SELECT path_id, path, unnest(range(1, len(path))) AS i FROM pa)),
sg AS (SELECT path_id, step, a, b, max(struct_pack(w := w, e := evidence_count, t := relation_type)) AS m FROM sp JOIN (SELECT source AS a, target AS b, 1 AS w, evidence_count, relation_type FROM ge UNION ALL SELECT target, source, 0, evidence_count, relation_type FROM ge) USING (a, b) GROUP BY ALL)"""


@oracle(f"WITH {_PATHS} SELECT path_id, step, a, b, m.t AS relation_type, m.e AS evidence_count FROM sg")
def path_segments(spark: SparkSession, d: str) -> DataFrame:
    return GQ.segments(_paths(spark, d), edges(spark, d))


@oracle(f"""WITH {_PATHS}, ni AS (SELECT path_id, count(*) FILTER (hint = 'generic_fragment') AS noisy_nodes FROM (SELECT path_id, unnest(list_slice(path, 2, len(path) - 1)) AS node_id FROM pa) JOIN gn USING (node_id) GROUP BY path_id),
sr AS (SELECT path_id, count(*) FILTER (m.t = 'related_to_generic' OR m.e = 0) AS segment_reasons FROM sg GROUP BY path_id)
SELECT path_id, CASE WHEN noisy_nodes > 0 THEN 'noisy_navigation' WHEN segment_reasons > 0 THEN 'caution' ELSE 'clean' END AS status, CASE WHEN noisy_nodes > 0 THEN 'navigation_debug_only' WHEN segment_reasons > 0 THEN 'navigation_context_only'
  ELSE 'candidate_evidence_navigation' END AS use_policy, noisy_nodes, segment_reasons FROM pa JOIN ni USING (path_id) JOIN sr USING (path_id)""")
def path_quality(spark: SparkSession, d: str) -> DataFrame:
    return GQ.path_quality(_paths(spark, d), nodes(spark, d), edges(spark, d))


@oracle(f"WITH {G} SELECT least(source, target) AS a, greatest(source, target) AS b, sum(evidence_count)::BIGINT AS weight FROM edges WHERE source <> target GROUP BY ALL")
def simple_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_pairs(model.graph_edges(spark, d))
