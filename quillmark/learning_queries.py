"""Queries of vocabularies, policy search, classifiers, reranking and answer items, each beside its DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import review_queries, span_queries
from .functions import text as T
from .operators import answers, calibrate, learning, routing, spans, terms
from .oracles import EV, FLAT
from .plans import model, session
from .plans.lexicon import GROUPS
from .queries import query
from .service_queries import oracle

# --- vocabularies

_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_CJK = "regexp_matches(w, '[\\x{4e00}-\\x{9fff}]')"
_TFIDF = rf"""a AS (SELECT doc_id, list_concat(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''\-]*'), regexp_extract_all(coalesce(text, ''), '[\x{{4e00}}-\x{{9fff}}]+')) AS w FROM documents),
b AS (SELECT doc_id, list_filter(list_transform(w, lambda x: lower(regexp_replace(x, '^[''_\-]+|[''_\-]+$', '', 'g'))), lambda w: CASE WHEN {_CJK} THEN length(w) >= 2 AND w NOT IN ({_LIST(terms.CHINESE_STOPWORDS)}) ELSE length(w) > 2 AND w NOT IN ({_LIST(terms.STOPWORDS)}) END) AS w FROM a),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM b),
v AS (SELECT term FROM g GROUP BY term ORDER BY count(*) DESC, term LIMIT 2000),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g WHERE term IN (SELECT term FROM v) GROUP BY ALL),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY term),
x AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
y AS (SELECT doc_id, count(*) AS n, max(w) / sqrt(sum(w * w)) AS m, sum(w) / sqrt(sum(w * w)) AS s, array_to_string(list_slice(list(term ORDER BY w DESC, term), 1, 8), ',') AS best FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_terms, round(coalesce(m, 0) + 1e-9::DOUBLE, 4) AS max_tfidf, round(coalesce(s, 0) + 1e-9::DOUBLE, 4) AS sum_tfidf,
  round(least(10.0::DOUBLE, coalesce(s, 0) / 3.0::DOUBLE * 10.0::DOUBLE) + 1e-9::DOUBLE, 3) AS score, coalesce(best, '') AS top_terms FROM documents LEFT JOIN y USING (doc_id)"""


@oracle(f"WITH {_TFIDF}")
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every document's weights over the 2000 commonest uni- and bigrams of the corpus."""
    return terms.tfidf(model.table(spark, d, "documents"), "doc_id")


_LEARNED = r"""c AS (SELECT trim(speaker) AS term, 3 AS n, 1 AS sure FROM ev WHERE trim(speaker) <> ''
  UNION ALL SELECT p, 1, 0 FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '[\p{L}\p{N}_]*[\x{C0}-\x{24F}][\p{L}\p{N}_]*', '_', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b')) AS p FROM ev)),
d AS (SELECT term, sum(n)::BIGINT AS n, max(sure) AS sure FROM c WHERE sure = 1 OR lower(term) NOT IN (STOPS) GROUP BY term)
SELECT term, n, CASE WHEN sure = 1 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN sure = 1 THEN 4 ELSE 3 END AS weight FROM d WHERE length(term) >= 2 AND (sure = 1 OR n >= 2)""".replace("STOPS", _LIST(terms.STOPWORDS))


@oracle(EV.rstrip() + f", {_LEARNED}")
def learned_terms(spark: SparkSession, d: str) -> DataFrame:
    """The term dictionary that speakers and capitalized phrases of all turns give."""
    return terms.learned_terms(model.evidence(spark, d))


@query
def term_salience(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's hits of the dictionary that all turns give."""
    turns = model.evidence(spark, d)
    return terms.term_salience(turns, terms.learned_terms(turns), "evidence_ref").withColumnRenamed("id", "evidence_ref")


# --- policies


def _labelled_packages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as packets with their scores, and a proxy target from length, speaker and position."""
    n, t = T.rough_token_count(F.col("text")), F.col("turn")
    target = F.when(t % 4 == 3, "repair_or_review").when(n < 12, "skip_or_background_only").when(n < 20, "entity_candidate_only").when(F.col("speaker") == "system", "nlp_openie_candidate").when(n >= 60, "strong_llm_graph_extraction").otherwise("weak_llm_graph_extraction")
    return routing.package_features(span_queries.packages(spark, d)).withColumn("target_route", target)


_GRID = ", ".join(f"p{k} AS (SELECT unnest([{', '.join(map(str, v))}])::DOUBLE AS {n}, unnest(range({len(v)})) AS i{k})" for k, (n, v) in enumerate(calibrate.GRID.items()))
_STEPS = [4 * 5 * 5 * 4 * 4 * 4, 5 * 5 * 4 * 4 * 4, 5 * 4 * 4 * 4, 4 * 4 * 4, 4 * 4, 4, 1]
_P = routing.PACKAGE_POLICY
_SEARCH = f"""tg AS (SELECT evidence_ref, CASE WHEN turn % 4 = 3 THEN 'repair_or_review' WHEN n < 12 THEN 'skip_or_background_only' WHEN n < 20 THEN 'entity_candidate_only' WHEN speaker = 'system' THEN 'nlp_openie_candidate'
  WHEN n >= 60 THEN 'strong_llm_graph_extraction' ELSE 'weak_llm_graph_extraction' END AS target FROM (SELECT evidence_ref, turn, speaker, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) AS n FROM ev)),
ex AS (SELECT surface, endpoint, likelihood, direction, context, attribution, evidence, low_value, utility, merge, target, count(*) AS n FROM k6 JOIN tg USING (evidence_ref) GROUP BY ALL),
{_GRID}, po AS (SELECT *, {' + '.join(f'i{k} * {s}' for k, s in enumerate(_STEPS))} AS policy FROM {', '.join(f'p{k}' for k in range(7))}),
pr AS (SELECT policy, target, n, CASE WHEN evidence < {_P['evidence_min']} THEN 'repair_or_review' WHEN low_value >= {_P['low_skip_floor']} AND likelihood < {_P['low_skip_relation_ceiling']} THEN 'skip_or_background_only'
  WHEN surface >= nlp_surface_floor AND endpoint >= {_P['nlp_endpoint_floor']} AND direction >= {_P['nlp_direction_floor']} AND attribution < {_P['nlp_attribution_ceiling']} AND context < nlp_context_ceiling THEN 'nlp_openie_candidate'
  WHEN utility >= strong_utility_floor AND (context >= strong_context_floor OR attribution >= {_P['strong_attribution_floor']} OR merge >= {_P['strong_merge_floor']}) THEN 'strong_llm_graph_extraction'
  WHEN likelihood >= weak_relation_floor OR utility >= weak_utility_floor THEN 'weak_llm_graph_extraction' WHEN endpoint >= {_P['entity_endpoint_floor']} AND likelihood < entity_relation_ceiling THEN 'entity_candidate_only'
  ELSE 'skip_or_background_only' END AS route FROM ex, po),
co AS (SELECT policy, target, route, sum(n) AS n, target IN ({_LIST(calibrate.RELATION_ROUTES)}) AS r, route IN ({_LIST(calibrate.RELATION_ROUTES)}) AS f FROM pr GROUP BY policy, target, route),
pe AS (SELECT *, CASE WHEN target = route THEN 0 WHEN route = 'skip_or_background_only' AND r THEN 8 WHEN route = 'entity_candidate_only' AND target IN ('weak_llm_graph_extraction', 'strong_llm_graph_extraction') THEN 7
  WHEN route = 'entity_candidate_only' AND target = 'nlp_openie_candidate' THEN 5 WHEN target = 'strong_llm_graph_extraction' AND route IN ('weak_llm_graph_extraction', 'nlp_openie_candidate') THEN 1.5
  WHEN target IN ('weak_llm_graph_extraction', 'nlp_openie_candidate') AND route = 'strong_llm_graph_extraction' THEN 0.75 WHEN target = 'nlp_openie_candidate' AND route = 'weak_llm_graph_extraction' THEN 0.5 ELSE 2 END::DOUBLE AS c FROM co),
su AS (SELECT policy, sum(n)::DOUBLE AS n, coalesce(sum(n) FILTER (target = route), 0)::DOUBLE / sum(n) AS e, sum(n * c) / sum(n) AS p, CASE WHEN coalesce(sum(n) FILTER (r), 0) > 0 THEN coalesce(sum(n) FILTER (r AND f), 0)::DOUBLE / sum(n) FILTER (r) ELSE 1.0 END AS f FROM pe GROUP BY policy)
SELECT policy, {', '.join(calibrate.GRID)}, round(e + 1e-9::DOUBLE, 6) AS exact_match, round(p + 1e-9::DOUBLE, 6) AS mean_penalty, round(f + 1e-9::DOUBLE, 6) AS relation_recall, round(p + (1 - e) + (1 - f) + 1e-9::DOUBLE, 6) AS objective FROM su JOIN po USING (policy)"""


@oracle(EV.rstrip() + f", {span_queries._PACKAGE}, {_SEARCH}")
def package_policy_search(spark: SparkSession, d: str) -> DataFrame:
    """All 25,600 policies of the package router over all turns."""
    return calibrate.package_policies(_labelled_packages(spark, d))


def _labelled_spans(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with their axes and proxy route."""
    docs = model.table(spark, d, "documents").join(model.table(spark, d, "labels"), "doc_id")
    route = learning.proxy_route(F.col("quality"), F.col("toxic"), T.rough_token_count(F.col("text")))
    return routing.salience_axes(docs).withColumn("target", route.cast("int"))


@query
def salience_policy_search(spark: SparkSession, d: str) -> DataFrame:
    """The salience policy that random and coordinate search find over all labelled documents, and the course of its objective."""
    best, course = calibrate.search_salience(_labelled_spans(spark, d), "target")
    rows = [("policy", k, float(v)) for k, v in best.items()] + [("objective", f"after pass {k}", v) for k, v in enumerate(course)]
    return spark.createDataFrame(rows, "part string, name string, value double")


# --- classifiers

FEATURES = ["chars", "tokens", "punctuation", "sentences", "max_sentence", "mean_sentence", "clause_markers", *[f"{g}_count" for g in GROUPS], *[f"{g}_per_100" for g in GROUPS]]


def _route_examples(spark: SparkSession, d: str) -> DataFrame:
    docs = spans.lexicon_features(model.table(spark, d, "documents").join(model.table(spark, d, "labels"), "doc_id"))
    return docs.withColumn("route", learning.proxy_route(F.col("quality"), F.col("toxic"), F.col("tokens")))


def _rule_predictions(spark: SparkSession, d: str) -> DataFrame:
    """What the additive router says of the labelled documents."""
    every = lambda n: F.col("doc_id") % n == 0
    _, route = spans.additive_route("s1", background=every(17), non_target=every(5), fallback_span=every(2), low_confidence=every(7), mixed=every(11))
    said = F.when(route == "skip", 0.0).when(route == "script", 1.0).when(route.isin("weak", "split_or_segment_first"), 2.0).when(route == "strong", 3.0).otherwise(4.0)
    rows = _route_examples(spark, d).select("doc_id", "lang", F.col("route").alias("label"), F.lit(1.0).alias("given_weight"), said.alias("prediction"))
    return rows


_ROUTE_METRICS = f"""rt AS ({span_queries._task_sql('s1')}),
pr AS (SELECT lang, CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 0 WHEN tokens >= 120 THEN 2 ELSE 1 END AS t, CASE route WHEN 'skip' THEN 0 WHEN 'script' THEN 1 WHEN 'weak' THEN 2 WHEN 'split_or_segment_first' THEN 2 WHEN 'strong' THEN 3 ELSE 4 END AS p
  FROM rt JOIN feat USING (doc_id) JOIN labels USING (doc_id) JOIN documents USING (doc_id)),
ce AS (SELECT lang, t, p, count(*) AS n FROM pr GROUP BY ALL),
co AS (SELECT *, 0.85::DOUBLE * abs(t - p) + CASE WHEN t = 0 AND p >= 2 THEN 2.0 WHEN t = 1 AND p >= 3 THEN 1.4 WHEN t = 2 AND p = 0 THEN 1.8 WHEN t = 3 AND p = 0 THEN 2.6 WHEN t = 3 AND p = 1 THEN 1.3 ELSE 0 END::DOUBLE AS c FROM ce),
wh AS (SELECT lang, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (t = p), 0)::DOUBLE / sum(n) AS e, sum(n * c) / sum(n) AS pe FROM co GROUP BY lang),
tr AS (SELECT lang, t AS r, sum(n) AS a, coalesce(sum(n) FILTER (t = p), 0) AS h FROM ce GROUP BY ALL), sa AS (SELECT lang, p AS r, sum(n) AS b FROM ce GROUP BY ALL),
f AS (SELECT lang, avg(2.0::DOUBLE * coalesce(h, 0) / (coalesce(a, 0) + coalesce(b, 0))) AS f1, avg(CASE WHEN coalesce(a, 0) > 0 THEN h::DOUBLE / a END) AS ba FROM tr FULL JOIN sa USING (lang, r) GROUP BY lang)
SELECT lang, n, round(e + 1e-9::DOUBLE, 6) AS exact, round(f1 + 1e-9::DOUBLE, 6) AS macro_f1, round(ba + 1e-9::DOUBLE, 6) AS balanced_accuracy, round(pe + 1e-9::DOUBLE, 6) AS penalty,
  round(pe + 0.35::DOUBLE * (1 - e) + 0.15::DOUBLE * (1 - f1) + 1e-9::DOUBLE, 6) AS objective FROM wh JOIN f USING (lang)"""


@oracle(f"WITH {span_queries._features_sql('documents', 'doc_id')}, {span_queries._FLAGS}, {_ROUTE_METRICS}")
def route_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The additive router against the proxy labels, by language."""
    return learning.route_metrics(_rule_predictions(spark, d), ("lang",))


@query
def route_classifiers(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold metrics of every classifier, and of the additive router on the same rows."""
    rows = learning.examples(_route_examples(spark, d), "doc_id", FEATURES, "route")
    judged = learning.evaluate_models(rows, learning.route_models())
    rules = _rule_predictions(spark, d).select(F.lit("additive_router").alias("model"), F.col("doc_id").alias("id"), "label", "given_weight", "prediction")
    return learning.route_metrics(judged.unionByName(rules))


@query
def route_importances(spark: SparkSession, d: str) -> DataFrame:
    """What each classifier, fitted on all labelled rows, looks at."""
    rows = learning.examples(_route_examples(spark, d), "doc_id", FEATURES, "route")
    found = [(name, *x) for name, make in learning.route_models().items() for x in learning.importances(make().fit(rows), FEATURES)]
    return spark.createDataFrame(found, "model string, route string, feature string, weight double")


# --- reranking


def _schema_examples(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved relation types of every packet; the packet's own type is the true one."""
    own = model.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.regexp_replace("p_name", " ", "_").alias("own"))
    found = review_queries.schema_retrieval(spark, d).join(own, "query_id")
    label = (F.col("relation_type") == F.col("own")).cast("double")
    none = F.lit(None).cast("int")
    return found.select(F.concat_ws("|", "query_id", "relation_type").alias("id"), F.col("query_id").alias("packet_id"), "relation_type", label.alias("label"), "rank", "score", F.col("lexical").alias("lexical_score"), F.col("n_alias").alias("exact_hits"), none.alias("matched"), none.alias("source_count"), none.alias("alias_count"))


_RANKING = """s AS (SELECT query_id AS packet_id, query_id || '|' || relation_type AS id, (relation_type = replace(p_name, ' ', '_'))::INT AS y, 1.0::DOUBLE / rank AS p FROM tx JOIN part ON p_partkey = query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY p DESC, id) AS r FROM s), f AS (SELECT packet_id, min(r) AS r FROM r WHERE y = 1 GROUP BY packet_id),
l AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p), c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM l WINDOW w AS (ORDER BY p DESC)),
b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(y) AS y, avg(p) AS p FROM s GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS n, (SELECT sum(y)::BIGINT FROM s) AS positives, (SELECT count(*) FROM f) AS packets, round((SELECT avg((r <= 5)::INT) FROM f) + 1e-9::DOUBLE, 6) AS recall_at_5,
  round((SELECT avg((r <= 10)::INT) FROM f) + 1e-9::DOUBLE, 6) AS recall_at_10, round((SELECT avg(1.0::DOUBLE / r) FROM f) + 1e-9::DOUBLE, 6) AS mrr,
  round((SELECT sum(pos * cp::DOUBLE / (cp + cn)) / any_value(ap) FROM c) + 1e-9::DOUBLE, 6) AS average_precision, round((SELECT sum(pos * (an - cn) + 0.5::DOUBLE * pos * neg) / (any_value(ap)::DOUBLE * any_value(an)) FROM c) + 1e-9::DOUBLE, 6) AS roc_auc,
  round((SELECT sum(n * abs(y - p)) / sum(n) FROM b) + 1e-9::DOUBLE, 6) AS calibration_error, round((SELECT avg((y - p) * (y - p)) FROM s) + 1e-9::DOUBLE, 6) AS brier"""


@oracle(f"WITH {review_queries._SCHEMA}, {_RANKING}")
def schema_ranking(spark: SparkSession, d: str) -> DataFrame:
    """How well the retrieval's own order ranks, with the inverse rank as its score."""
    rows = learning.candidate_features(_schema_examples(spark, d))
    return learning.ranking_metrics(session.settled(rows.select("id", "packet_id", "label", F.col("f_inverse_rank").alias("probability"))))


@query
def schema_reranking(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold metrics of the calibrated reranker beside those of the retrieval's order."""
    scored = learning.calibrated_probabilities(_schema_examples(spark, d))
    each = [learning.ranking_metrics(scored, column).withColumn("ranking", F.lit(name)) for name, column in (("calibrated", "probability"), ("baseline", "inverse_rank"))]
    return each[0].unionByName(each[1])


# --- answer items

_ITEMS = f"""it AS (SELECT doc_id, lang, text, {FLAT} AS x, ['raw_evidence', 'doc_level_summary', 'memory_unit', 'portrait_unit'][doc_id % 4 + 1] AS layer, doc_id % 5 = 0 AS chosen, doc_id % 3 <> 0 AS refs,
  CASE WHEN doc_id % 2 = 0 THEN 'checked' ELSE 'not_checked' END AS support, doc_id % 8 = 0 AS direct, CASE WHEN doc_id % 6 = 1 THEN 'evidence_bound' ELSE 'not_checked' END AS status, doc_id % 7 = 0 AS strange, source FROM documents),
cl AS (SELECT *, CASE WHEN refs THEN support ELSE 'not_checked' END AS of_item, CASE WHEN layer = 'raw_evidence' THEN 'direct_evidence' WHEN layer IN ('doc_level_summary', 'memory_unit') THEN 'context_only'
  WHEN chosen THEN CASE WHEN contains(text, ' is ') THEN 'graph_relation' ELSE 's2_summary' END ELSE 'context_only' END AS type,
  CASE WHEN layer = 'raw_evidence' THEN CASE WHEN support = 'checked' THEN 'checked' ELSE status END WHEN layer = 'doc_level_summary' THEN 'not_checked' WHEN layer = 'memory_unit' THEN CASE WHEN refs THEN 'evidence_bound' ELSE 'not_checked' END
  WHEN chosen THEN CASE WHEN refs THEN 'evidence_bound' ELSE status END ELSE status END AS ev FROM it),
po AS (SELECT *, CASE WHEN layer = 'raw_evidence' THEN CASE WHEN direct THEN 'can_answer' ELSE 'supporting_context' END WHEN layer = 'doc_level_summary' THEN 'background_only'
  WHEN layer = 'memory_unit' OR chosen THEN CASE WHEN ev = 'evidence_bound' THEN 'supporting_context' ELSE 'background_only' END WHEN strange THEN 'do_not_use_as_fact' WHEN status = 'not_checked' THEN 'background_only' ELSE 'supporting_context' END AS policy,
  list_filter([CASE WHEN NOT refs THEN 'no_evidence_refs' END, CASE WHEN strange THEN 'subject_mixed_participant' END], lambda w: w IS NOT NULL) AS ws,
  CASE WHEN doc_id % 3 = 1 THEN ['bm25', 'embedding'] ELSE ['bm25'] END AS by_, [concat('found in ', source), concat('layer ', layer)] AS rs,
  CASE WHEN x = '' THEN 'refs:' || CASE WHEN refs THEN coalesce(source, '') ELSE '' END ELSE substr(lower(x), 1, 140) END AS k FROM cl),
mg AS (SELECT lang, k, type, ev, min(doc_id) AS position, count(*) AS n_items, first(text ORDER BY length(coalesce(text, '')) DESC, doc_id) AS text, bool_or(policy = 'can_answer') AS can, first(policy ORDER BY doc_id) AS first_policy,
  flatten(list(ws ORDER BY doc_id)) AS ws, flatten(list(by_ ORDER BY doc_id)) AS by_, flatten(list(rs ORDER BY doc_id)) AS rs FROM po GROUP BY lang, k, type, ev)
SELECT lang, md5(k) AS text_key, type, ev AS evidence_support, position, n_items, md5(text) AS text_md5, CASE WHEN can THEN 'can_answer' ELSE first_policy END AS use_policy,
  array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ',') AS warnings, array_to_string(list_filter(by_, lambda x, i: list_position(by_, x) = i), ',') AS retrieved_by,
  array_to_string(list_slice(list_filter(rs, lambda x, i: list_position(rs, x) = i), 1, 4), ',') AS reasons FROM mg"""


@oracle(f"WITH {_ITEMS}")
def answer_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as retrieved context of several layers, classified and merged by language."""
    k, c = F.col("doc_id"), F.col
    layer = F.element_at(F.array(*[F.lit(x) for x in ("raw_evidence", "doc_level_summary", "memory_unit", "portrait_unit")]), (k % 4 + 1).cast("int"))
    refs, strange = k % 3 != 0, k % 7 == 0
    warnings = F.filter(F.array(F.when(~refs, "no_evidence_refs"), F.when(strange, "subject_mixed_participant")), lambda w: w.isNotNull())
    rows = model.table(spark, d, "documents").select("doc_id", "lang", "text", "source", layer.alias("layer"), refs.alias("refs"), warnings.alias("warnings"))
    source = F.when(k % 5 == 0, "step2_selected_context").otherwise("retrieval")
    status = F.when(k % 6 == 1, "evidence_bound")
    found = answers.classify_item(c("layer"), c("layer"), source, c("refs"), F.when(k % 2 == 0, "checked"), F.when(k % 8 == 0, "direct"), status, c("warnings"), F.contains("text", F.lit(" is ")))
    rows = rows.select("*", found.alias("_c")).select("*", "_c.*")
    by = F.when(k % 3 == 1, F.array(F.lit("bm25"), F.lit("embedding"))).otherwise(F.array(F.lit("bm25")))
    own = F.when(c("refs"), F.array(F.coalesce("source", F.lit("")))).otherwise(F.array().cast("array<string>"))
    reasons = F.array(F.concat(F.lit("found in "), F.coalesce("source", F.lit(""))), F.concat(F.lit("layer "), c("layer")))
    items = rows.select(k.alias("position"), "lang", "text", "type", "use_policy", "evidence_support", "warnings", by.alias("retrieved_by"), reasons.alias("reasons"), own.alias("evidence_refs"))
    merged = answers.merge_items(items, ["lang"])
    text = lambda x: F.array_join(x, ",").alias(x)
    return merged.select("lang", F.md5("text_key").alias("text_key"), "type", "evidence_support", "position", "n_items", F.md5("text").alias("text_md5"), "use_policy", text("warnings"), text("retrieved_by"), text("reasons"))
