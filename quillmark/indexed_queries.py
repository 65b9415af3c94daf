"""Queries of indexed retrieval over whole tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import indexed, service
from .oracles import BM25, _num, word_set
from .plans import model, store
from .service_queries import oracle


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Questions that ask for every mode under every state of the indexes, by their id."""
    k = F.col("query_id")
    asked = F.element_at(F.array(*[F.lit(m) for m in (*service.MODES, "nonsense")]), (k % 7 + 1).cast("int"))
    on = lambda n: F.floor(k / n) % 2 == 0
    route = F.when(k % 2 == 0, "fact").otherwise("semantic")
    return model.questions(spark, d).select("query_id", "question", route.alias("route"), asked.alias("requested"), on(7).alias("bm25_fresh"), on(14).alias("embedding_fresh"), on(28).alias("embedding_usable"))


def _evidence_units(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("speaker") == "user", "target").otherwise("other_participant")
    return store.evidence(spark, d).select(F.col("evidence_ref").alias("unit_id"), "text", role.alias("subject_role"))


def _memory_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of the default statuses; those without a way back to their evidence count as mixed."""
    role = F.when(F.size("backpointer_refs") == 0, "mixed").otherwise("target")
    return service.memory_filter(store.memory_units(spark, d)).select(F.col("memory_id").alias("unit_id"), F.col("content").alias("text"), role.alias("subject_role"))


_WS = r"list_filter(string_split(replace(lower(text), chr(10), ' '), ' '), lambda x: x <> '')"


def _entries(name: str, key: str, source: str) -> str:
    return f"""{name}_t AS (SELECT {key}, unnest(CASE WHEN len({_WS}) > 0 THEN {_WS} ELSE [text] END) AS tok FROM {source}),
{name}_b AS (SELECT {key}, {_num('sha256(tok)', 1, 8)} % {indexed.DIMS} AS dim, sum(CASE WHEN {_num('sha256(tok)', 9, 2)} % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_t GROUP BY ALL HAVING v <> 0),
{name} AS (SELECT {key}, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY {key})), 8) AS v FROM {name}_b)"""


def _sql(units: str) -> str:
    return f"""{store.SQL}, units AS ({units}), {BM25.replace('FROM conversations', 'FROM units')},
{_entries('ue', 'unit_id', 'units')}, {_entries('qe', 'item_id', "(SELECT item_id, coalesce(text, '') AS text FROM benchmark)")},
co AS (SELECT item_id AS query_id, unit_id, round(sum(ue.v * qe.v), 6) AS cosine FROM ue JOIN qe USING (dim) GROUP BY ALL HAVING cosine > 0),
rq AS (SELECT item_id AS query_id, text, CASE WHEN item_id % 2 = 0 THEN 'fact' ELSE 'semantic' END AS route, ['direct_scan', 'auto', 'bm25_indexed', 'embedding_indexed', 'hybrid_indexed', 'degraded_direct_scan', 'auto'][item_id % 7 + 1] AS asked,
  (item_id // 7) % 2 = 0 AS b, (item_id // 14) % 2 = 0 AND (item_id // 28) % 2 = 0 AS e FROM benchmark),
md AS (SELECT *, CASE asked WHEN 'direct_scan' THEN asked WHEN 'auto' THEN CASE WHEN b AND e THEN 'hybrid_indexed' WHEN b THEN 'bm25_indexed' WHEN e THEN 'embedding_indexed' ELSE 'degraded_direct_scan' END
  WHEN 'bm25_indexed' THEN CASE WHEN b THEN asked ELSE 'degraded_direct_scan' END WHEN 'embedding_indexed' THEN CASE WHEN e THEN asked ELSE 'degraded_direct_scan' END
  WHEN 'hybrid_indexed' THEN CASE WHEN b OR e THEN asked ELSE 'degraded_direct_scan' END ELSE 'degraded_direct_scan' END AS mode FROM rq),
l AS (SELECT query_id, unit_id, bm25 FROM bm JOIN units USING (conv_id, turn) JOIN md USING (query_id) WHERE b AND mode IN ('bm25_indexed', 'hybrid_indexed')),
v AS (SELECT query_id, unit_id, cosine FROM co JOIN md USING (query_id) WHERE e AND mode IN ('embedding_indexed', 'hybrid_indexed')),
j AS (SELECT *, max(bm25) OVER w AS ml, max(cosine) OVER w AS mv FROM l FULL JOIN v USING (query_id, unit_id) WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT *, coalesce(bm25 / ml, 0) AS a, coalesce(cosine / mv, 0) AS c, CASE subject_role WHEN 'target' THEN 1.0 WHEN 'mixed' THEN CASE route WHEN 'fact' THEN 0.75 ELSE 0.85 END ELSE CASE route WHEN 'fact' THEN 0.25 ELSE 0.55 END END::DOUBLE AS f
  FROM j JOIN md USING (query_id) JOIN units USING (unit_id)),
ix AS (SELECT query_id, unit_id, mode AS method, round(f * CASE WHEN mv IS NULL THEN a WHEN ml IS NULL THEN c WHEN route = 'fact' THEN 0.55::DOUBLE * a + 0.45::DOUBLE * c ELSE 0.25::DOUBLE * a + 0.75::DOUBLE * c END, 6) AS score,
  round(bm25 / ml, 6) AS bm25_norm, round(cosine / mv, 6) AS embedding_norm, concat_ws(',', CASE WHEN bm25 IS NOT NULL THEN 'bm25' END, CASE WHEN cosine IS NOT NULL THEN 'embedding' END) AS backends,
  concat_ws(',', CASE WHEN mode = 'hybrid_indexed' AND ml IS NULL THEN 'hybrid_bm25_path_unavailable' END, CASE WHEN mode = 'hybrid_indexed' AND mv IS NULL THEN 'hybrid_embedding_path_unavailable' END, CASE WHEN f < 1 THEN 'subject_downranked' END) AS warnings FROM s),
qw AS (SELECT query_id, len(w) AS n_q, unnest(w) AS word FROM (SELECT query_id, {word_set('text')} AS w FROM rq)), uw AS (SELECT unit_id, unnest({word_set('text')}) AS word FROM units),
ds AS (SELECT query_id, unit_id, round(count(*) + count(*) / any_value(n_q), 6) AS score FROM uw JOIN qw USING (word) GROUP BY query_id, unit_id),
dr AS (SELECT query_id, unit_id, CASE mode WHEN 'direct_scan' THEN mode ELSE 'degraded_direct_scan' END AS method, score, NULL::DOUBLE AS bm25_norm, NULL::DOUBLE AS embedding_norm, '' AS backends,
  CASE mode WHEN 'direct_scan' THEN '' WHEN 'degraded_direct_scan' THEN 'degraded_direct_scan,' || CASE asked WHEN 'auto' THEN 'index_missing_or_stale' WHEN 'bm25_indexed' THEN 'bm25_index_missing_or_stale' WHEN 'embedding_indexed' THEN 'embedding_index_missing_stale_or_unusable'
    WHEN 'hybrid_indexed' THEN 'hybrid_indexes_missing_or_stale' ELSE 'degraded_direct_scan_returned_no_hits' END ELSE 'degraded_direct_scan,' || mode || '_returned_no_hits' END AS warnings
  FROM ds JOIN md USING (query_id) WHERE query_id NOT IN (SELECT query_id FROM ix)),
got AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM (SELECT * FROM ix UNION ALL SELECT * FROM dr) QUALIFY rank <= 5)"""


_EVIDENCE = _sql("SELECT conv_id, turn, text, evidence_ref AS unit_id, CASE speaker WHEN 'user' THEN 'target' ELSE 'other_participant' END AS subject_role FROM ev")
_MEMORY = _sql("SELECT conv_id, turn, content AS text, memory_id AS unit_id, CASE WHEN has_back THEN 'target' ELSE 'mixed' END AS subject_role FROM mem WHERE status IN ('accepted_for_experiment', 'accepted_by_user')")


@oracle(f"WITH {_EVIDENCE} SELECT * FROM got")
def indexed_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every question over all turns, in the mode that its request and the indexes allow."""
    return indexed.retrieve(_requests(spark, d), _evidence_units(spark, d))


@oracle(f"WITH {_MEMORY} SELECT * FROM got")
def indexed_memory(spark: SparkSession, d: str) -> DataFrame:
    """Every question over the accepted memory units, in the mode that its request and the indexes allow."""
    return indexed.retrieve(_requests(spark, d), _memory_units(spark, d))


@oracle(f"""WITH {_EVIDENCE}, bs AS (SELECT query_id, unit_id FROM ds QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) <= 5),
fj AS (SELECT query_id, unit_id, g.unit_id IS NOT NULL AS f, b.unit_id IS NOT NULL AS b FROM got g FULL JOIN bs b USING (query_id, unit_id))
SELECT query_id, count(*) FILTER (f) AS n_found, count(*) FILTER (b) AS n_baseline, count(*) FILTER (f AND b) AS n_both,
  coalesce(string_agg(unit_id, ',' ORDER BY unit_id) FILTER (f AND NOT b), '') AS only_found, coalesce(string_agg(unit_id, ',' ORDER BY unit_id) FILTER (b AND NOT f), '') AS only_baseline FROM fj GROUP BY query_id""")
def mode_differences(spark: SparkSession, d: str) -> DataFrame:
    """What every question finds in its mode, against a direct scan."""
    direct = _requests(spark, d).withColumn("requested", F.lit("direct_scan"))
    return indexed.compared(indexed_evidence(spark, d), indexed.retrieve(direct, _evidence_units(spark, d)))


@oracle(f"""WITH {_EVIDENCE} SELECT method, count(DISTINCT query_id) AS n_queries, count(*) AS n_results, count(*) FILTER (contains(warnings, 'subject_downranked')) AS n_downranked,
  count(*) FILTER (backends = 'bm25,embedding') AS n_both_backends, round(avg(score) FILTER (rank = 1) + 1e-9::DOUBLE, 4) AS mean_best FROM got GROUP BY method""")
def mode_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every method over all questions."""
    return indexed.mode_totals(indexed_evidence(spark, d))
