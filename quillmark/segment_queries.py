"""Queries of texts in spans, of co-occurrence graphs and of vector files, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import segments
from .plans import model
from .plans.session import shared_root
from .queries import query
from .service_queries import oracle
from .sources import vectors


@oracle(r"""WITH p AS (SELECT doc_id, text, regexp_split_to_array(text, '\n\s*\n') AS w, regexp_extract_all(text, '\n\s*\n') AS s FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w, s FROM p),
o AS (SELECT doc_id, i, w[i] AS body, coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x))), 0) AS off FROM l),
t AS (SELECT *, length(body) - length(regexp_replace(body, '^\s+', '')) AS lead, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM o)
SELECT doc_id, 'P' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY i))::VARCHAR, 4, '0') AS unit_id, (off + lead)::BIGINT AS start, (off + lead + length(regexp_replace(regexp_replace(body, '^\s+', ''), '\s+$', '')))::BIGINT AS "end", md5(text) AS text_md5 FROM t WHERE text <> ''""")
def paragraph_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph of every document with its span."""
    units = segments.text_units(model.table(spark, d, "documents"), "doc_id").where("sentence = 0")
    return units.select("doc_id", "unit_id", "start", "end", F.md5("text").alias("text_md5"))


@query
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document with its span and warnings."""
    units = segments.text_units(model.table(spark, d, "documents"), "doc_id").where("sentence > 0")
    return units.select("doc_id", "unit_id", "start", "end", F.md5("text").alias("text_md5"), F.array_join("warnings", ",").alias("warnings"))


@oracle(r"""WITH t AS (SELECT list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT least(w[i], w[i + k]) AS a, greatest(w[i], w[i + k]) AS b FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM t), (SELECT unnest(range(1, 5)) AS k) WHERE i + k <= len(w) AND w[i] <> w[i + k])
SELECT a, b, count(*) AS n FROM p GROUP BY a, b""")
def word_cooccurrences(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents at most four places apart."""
    words = model.table(spark, d, "documents").select(T.lowered(T.found(F.col("text"), T.LATIN)).alias("w"))
    return segments.cooccurrences(words, "w", 4)


@oracle(r"""WITH c AS (SELECT conv_id, turn, unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\p{L}\p{N}_]*[\x{C0}-\x{24F}][\p{L}\p{N}_]*', '_', 'g'), '\b[A-Za-z]+\b')) AS w FROM conversations),
m AS (SELECT DISTINCT conv_id, turn, CASE WHEN regexp_full_match(w, '[A-Z][a-z]+') THEN 'entity' ELSE 'event' END AS kind, lower(w) AS name FROM c WHERE regexp_full_match(w, '[A-Z][a-z]+') OR regexp_full_match(w, '[a-z]+ed')),
n AS (SELECT conv_id, count(DISTINCT kind || ':' || name) AS nodes FROM m GROUP BY conv_id),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, turn, kind ORDER BY name) <= 8),
e AS (SELECT DISTINCT a.conv_id, a.name AS a, b.name AS b FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.kind = 'entity' AND b.kind = 'event'),
v AS (SELECT conv_id, k, count(*) AS n FROM (SELECT conv_id, 'entity:' || a AS k FROM e UNION ALL SELECT conv_id, 'event:' || b FROM e) GROUP BY ALL), g AS (SELECT conv_id, max(n) AS t, sum(n) AS s FROM v GROUP BY conv_id),
x AS (SELECT n.conv_id, nodes, coalesce(c.edges, 0) AS edges, coalesce(t::DOUBLE / s, 0) AS share FROM n LEFT JOIN (SELECT conv_id, count(*) AS edges FROM e GROUP BY conv_id) c USING (conv_id) LEFT JOIN g USING (conv_id))
SELECT conv_id, nodes, edges, round(share + 1e-9::DOUBLE, 4) AS top_share, CASE WHEN nodes >= 25 AND edges >= 40 AND share <= 0.2 THEN 'good' ELSE 'limited' END AS mesh_potential,
  (edges + nodes - floor(round(share + 1e-9::DOUBLE, 4) * 100 + 1e-9::DOUBLE))::BIGINT AS score FROM x""")
def sample_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as samples: capitalized words are entities, past forms are events, turns are the units."""
    words = T.found(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\p{L}\p{N}_]*[\x{C0}-\x{24F}][\p{L}\p{N}_]*", "_"), r"\b[A-Za-z]+\b")
    rows = model.table(spark, d, "conversations").select("conv_id", "turn", F.explode(words).alias("name"))
    kind = F.when(F.col("name").rlike("^[A-Z][a-z]+$"), "entity").when(F.col("name").rlike("^[a-z]+ed$"), "event")
    return segments.sample_graphs(rows.withColumn("kind", kind).where("kind IS NOT NULL"), "conv_id", "turn")


@oracle("SELECT vec_id, len(embedding)::BIGINT AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-9::DOUBLE, 4) AS norm FROM embeddings WHERE embedding IS NOT NULL")
def vector_files(spark: SparkSession, d: str) -> DataFrame:
    """All vectors, written as an index of files and read again by ranges of rows."""
    folder = f"{shared_root(spark)}/quillmark/vectors-{uuid.uuid4().hex}"
    vectors.write_vectors(model.table(spark, d, "embeddings"), "vec_id", "embedding", folder)
    v = F.transform("vector", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.read_vectors(spark, folder).select(F.col("id").alias("vec_id"), F.size("vector").cast("long").alias("dim"), F.round(norm + 1e-9, 4).alias("norm"))
