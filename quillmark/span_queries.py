"""Queries of the span rules over whole tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import memory, routing, spans
from .oracles import EV, FLAT, ROUGH, TXT
from .plans import model
from .plans.lexicon import GROUPS
from .service_queries import oracle

CONV = ["conv_id", "turn"]


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_QUOTE = "\"''“"
_SECTION = rf"""f AS (SELECT doc_id, doc_id % 6 + 1 AS ix, doc_id % 2 = 0 AS book, {FLAT} AS x FROM documents),
l AS (SELECT *, lower(x) AS low, x = upper(x) AND x <> lower(x) AS up FROM f),
s AS (SELECT doc_id, CASE
  WHEN regexp_matches(x, '^\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}\b') OR regexp_matches(x, '^[A-Z][a-z]{{2,8}}\. +\d{{1,2}},') OR regexp_matches(low, '^({spans.MONTHS})[a-z]*\. +\d') THEN ['body', 'high', 'author']
  WHEN contains(low, 'project gutenberg') OR contains(low, 'gutenberg license') THEN ['license', 'high', 'editor']
  WHEN contains(low, 'copyright') OR contains(low, 'all rights reserved') OR contains(low, 'license') THEN ['copyright', 'medium', 'editor']
  WHEN contains(low, 'transcriber''s note') OR contains(low, 'editor''s note') OR contains(low, 'editorial note') THEN ['editorial_note', 'high', 'editor']
  WHEN regexp_matches(low, '^(footnote|endnote)\b') OR regexp_matches(low, '^\[[0-9ivxlcdm]+\]') THEN ['footnote', 'medium', 'editor']
  WHEN regexp_matches(low, '^appendix\b') THEN ['appendix', 'high', 'editor'] WHEN regexp_matches(low, '^(bibliography|references)\b') THEN ['bibliography', 'high', 'editor']
  WHEN regexp_matches(low, '^(persons?|dramatis personae|list of)\b') THEN ['person_list', 'medium', 'editor'] WHEN {_any('low', spans.FRONT_MATTER)} THEN ['front_matter', 'high', 'editor']
  WHEN book AND length(x) < 80 AND up THEN [CASE WHEN ix <= 3 THEN 'front_matter' ELSE 'metadata' END, 'medium', 'editor']
  WHEN regexp_matches(x, '^[{_QUOTE}]') OR (length(x) <= 800 AND regexp_matches(low, '\bsaid\b.*[{_QUOTE}]')) THEN ['quote', 'medium', 'quoted_speaker']
  WHEN book AND ix <= 2 AND length(x) < 200 THEN ['front_matter', 'low', 'unknown'] ELSE ['body', 'medium', 'author'] END AS k FROM l),
p AS (SELECT doc_id, k[1] AS section_type, k[2] AS confidence, k[3] AS perspective, CASE WHEN k[1] = 'body' THEN ['ordinary_evidence', 'default_retrieval', 'candidate_allowed']
  WHEN k[1] IN ({_quoted(spans.RAW_ONLY)}) THEN ['recoverable_raw_only', 'excluded_from_default_retrieval', 'blocked_from_portrait']
  WHEN k[1] IN ({_quoted(spans.BACKGROUND)}) THEN ['background_evidence', 'explicit_query_only', 'background_only'] ELSE ['needs_review', 'needs_review', 'needs_review'] END AS q FROM s),
sec AS (SELECT doc_id, section_type, confidence, perspective, q[1] AS storage_policy, q[2] AS retrieval_policy, q[3] AS s2_policy FROM p)"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sections; even ones are laid out like books."""
    kind = spans.classify_section(F.col("text"), F.col("doc_id") % 6 + 1, F.col("doc_id") % 2 == 0)
    rows = model.table(spark, d, "documents").select("doc_id", kind.alias("k")).select("doc_id", "k.*")
    return rows.select("*", spans.section_policies(F.col("section_type")).alias("p")).select("doc_id", "section_type", "confidence", "perspective", "p.*")


@oracle(f"WITH {_SECTION} SELECT * FROM sec")
def section_policy(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d)


@oracle(f"""WITH {_SECTION}, t AS (SELECT *, confidence <> 'high' AS u FROM sec)
SELECT doc_id, array_to_string(list_filter([CASE WHEN confidence = 'low' THEN 'low_script_confidence' END, CASE WHEN section_type IN ({_quoted(spans.HIGH_RISK)}) AND u THEN 'high_risk_section' END,
  CASE WHEN perspective IN ('mixed', 'unknown') AND s2_policy = 'candidate_allowed' THEN 'perspective_ambiguity' END, CASE WHEN s2_policy IN ('candidate_allowed', 'needs_review') AND u THEN 'high_downstream_impact' END,
  CASE WHEN doc_id % 3 = 0 AND u THEN 'high_value_source' END], lambda x: x IS NOT NULL), ',') AS triggers FROM t""")
def assist_triggers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    priority = F.when(c("doc_id") % 3 == 0, "high").otherwise("normal")
    found = spans.assist_triggers(c("section_type"), c("confidence"), c("perspective"), c("s2_policy"), priority)
    return _sections(spark, d).select("doc_id", F.array_join(found, ",").alias("triggers"))


def _count_sql(group: str) -> str:
    english, chinese = GROUPS[group]
    single = [t for t in english if " " not in t]
    parts = [f"len(list_filter(ws, lambda w: w IN ({_quoted(single)})))"]
    parts += [rf"len(regexp_extract_all(dbl, '(^|[^a-z0-9_]){t.replace(' ', '[^a-z0-9_]+')}([^a-z0-9_]|$)'))" for t in english if " " in t]
    parts += [f"(length(low) - length(replace(low, '{t}', ''))) // {len(t)}" for t in chinese]
    return " + ".join(parts)


def _features_sql(source: str, keys: str) -> str:
    return rf"""t0 AS (SELECT {keys}, {TXT} AS x, lower({TXT}) AS low FROM {source}),
t1 AS (SELECT *, regexp_extract_all(low, '[a-z0-9_]+') AS ws, regexp_replace(low, '([^a-z0-9_])', '\1\1', 'g') AS dbl, {ROUGH.replace(TXT, 'x')} AS tokens,
  list_transform(list_filter(list_transform(regexp_split_to_array(x, '[.!?。！？]+'), lambda p: trim(p)), lambda p: p <> ''), lambda p: length(p)) AS lens FROM t0),
t2 AS (SELECT *, length(x) AS chars, len(regexp_extract_all(x, '[,;:，；：]')) AS punctuation, greatest(len(lens), 1) AS sentences, coalesce(list_max(lens), length(x)) AS max_sentence,
  CASE WHEN len(lens) > 0 THEN round(list_sum(lens) / len(lens), 4) ELSE length(x) END::DOUBLE AS mean_sentence, {', '.join(f'({_count_sql(g)})::BIGINT AS {g}_count' for g in GROUPS)} FROM t1),
feat AS (SELECT *, punctuation + logical_count AS clause_markers, {', '.join(f'CASE WHEN tokens > 0 THEN round({g}_count / tokens * 100, 4) ELSE 0 END::DOUBLE AS {g}_per_100' for g in GROUPS)} FROM t2)"""


_COLUMNS = ["chars", "tokens", "punctuation", "sentences", "max_sentence", "mean_sentence", "clause_markers", *[f"{g}_count" for g in GROUPS], *[f"{g}_per_100" for g in GROUPS]]


@oracle(f"WITH {_features_sql('documents', 'doc_id')} SELECT doc_id, {', '.join(_COLUMNS)} FROM feat")
def lexicon_features(spark: SparkSession, d: str) -> DataFrame:
    return spans.lexicon_features(model.table(spark, d, "documents")).select("doc_id", *_COLUMNS)


_TASK_SQL = {"s1": "0", "graph": "CASE WHEN role_count > 0 OR logical_count > 0 THEN 2 ELSE 1 END", "s2": "1", "support": "1", "s0b": "low_confidence::INT"}
_SCORE = """(chars > 260)::INT + (tokens > 65)::INT + least(2, punctuation // 2) + least(2, event_count) + 2 * (role_count > 0)::INT + (pronoun_count >= 2)::INT + (logical_count > 0)::INT
  + 2 * (importance_count > 0)::INT + (event_per_100 >= 2)::INT + (role_per_100 >= 1)::INT + (logical_per_100 >= 1)::INT + (importance_per_100 >= 1)::INT + low_confidence::INT + mixed::INT"""
_ROUTE = "CASE WHEN skipped THEN 'skip' WHEN coarse THEN 'split_or_segment_first' WHEN s <= 1 THEN 'script' WHEN s <= 4 THEN 'weak' WHEN s <= 7 THEN 'strong' ELSE 'human' END"


def _task_sql(task: str) -> str:
    skipped = "background OR non_target" if task == "s2" else "background"
    return f"""SELECT doc_id, '{task}' AS task, s::BIGINT AS route_score, {_ROUTE} AS route FROM (SELECT *, CASE WHEN skipped OR coarse THEN 0 ELSE least(12, {_SCORE} + {_TASK_SQL[task]}) END AS s
  FROM (SELECT *, {skipped} AS skipped, whole AND (chars > 900 OR tokens > 180) AS coarse FROM flags))"""


_FLAGS = "flags AS (SELECT *, doc_id % 17 = 0 AS background, doc_id % 5 = 0 AS non_target, doc_id % 2 = 0 AS whole, doc_id % 7 = 0 AS low_confidence, doc_id % 11 = 0 AS mixed FROM feat)"


@oracle(f"WITH {_features_sql('documents', 'doc_id')}, {_FLAGS} {' UNION ALL '.join(_task_sql(t) for t in _TASK_SQL)}")
def route_additive(spark: SparkSession, d: str) -> DataFrame:
    """Every document's route in every task; metadata flags follow the id."""
    every = lambda n: F.col("doc_id") % n == 0
    rows = spans.lexicon_features(model.table(spark, d, "documents"))
    each = []
    for task in _TASK_SQL:
        score, route = spans.additive_route(task, background=every(17), non_target=every(5), fallback_span=every(2), low_confidence=every(7), mixed=every(11))
        each.append(F.struct(F.lit(task).alias("task"), score.alias("route_score"), route.alias("route")))
    return rows.select("doc_id", F.explode(F.array(*each)).alias("r")).select("doc_id", "r.*")


@oracle(f"""WITH {_features_sql('documents JOIN labels USING (doc_id)', 'doc_id, quality')}, {_FLAGS}
SELECT quality::BIGINT AS quality, route, count(*) AS n, round(count(*)::DOUBLE, 6) AS w FROM flags JOIN ({_task_sql('s1')}) USING (doc_id) GROUP BY ALL""")
def route_confusion(spark: SparkSession, d: str) -> DataFrame:
    every = lambda n: F.col("doc_id") % n == 0
    docs = spans.lexicon_features(model.table(spark, d, "documents").join(model.table(spark, d, "labels"), "doc_id"))
    _, route = spans.additive_route("s1", background=every(17), non_target=every(5), fallback_span=every(2), low_confidence=every(7), mixed=every(11))
    return routing.confusion(docs.withColumn("quality", F.col("quality").cast("long")).withColumn("route", route), "quality", "route")


_VALUE_FLAGS = """vf AS (SELECT *, (importance_count * 2 + role_count)::DOUBLE AS positive, CASE WHEN tokens <= 3 THEN 8.0 ELSE 0.0 END AS low_, (tokens / 20.0)::DOUBLE AS keyphrase, importance_count * 2.0 AS risk,
  logical_count * 1.0 AS constraint_, event_count * 1.0 AS attribution, least(10.0, tokens / 15.0 + sentences * 0.5) AS complexity, doc_id % 13 = 0 AS fragment, doc_id % 19 = 0 AS quote_warning, doc_id % 11 = 0 AS mixed, doc_id % 7 = 0 AS low_confidence FROM feat),
vv AS (SELECT *, CASE WHEN low_ >= 5 AND positive <= 3 THEN false WHEN fragment AND positive <= 0 AND tokens <= 3 THEN false WHEN positive > 0 OR event_count > 0 THEN true WHEN first_person_count > 0 AND tokens >= 4 THEN true
  ELSE keyphrase >= 2 AND tokens >= 4 AND chars >= 20 END AS has_value, 4 * quote_warning::INT + 4 * (risk >= 5)::INT + 2 * (constraint_ >= 5)::INT + 2 * (attribution >= 4)::INT
  + CASE WHEN complexity >= 8 THEN 4 WHEN complexity >= 6 THEN 2 ELSE 0 END + (pronoun_count >= 2)::INT + CASE WHEN mixed THEN 3 WHEN low_confidence THEN 2 ELSE 0 END AS r FROM vf)"""


@oracle(f"""WITH {_features_sql('documents', 'doc_id')}, {_VALUE_FLAGS}
SELECT doc_id, has_value, r::BIGINT AS risk_score, CASE WHEN NOT has_value THEN 'skip' WHEN r >= 6 THEN 'strong' WHEN r >= 3 THEN 'weak' ELSE 'script' END AS route FROM vv""")
def route_value_risk(spark: SparkSession, d: str) -> DataFrame:
    """The second router; its salience scores are given inputs, here plain functions of the counts."""
    c = F.col
    rows = spans.lexicon_features(model.table(spark, d, "documents")).withColumns(
        {
            "positive": (c("importance_count") * 2 + c("role_count")).cast("double"),
            "low": F.when(c("tokens") <= 3, 8.0).otherwise(0.0),
            "keyphrase": c("tokens") / 20.0,
            "risk": c("importance_count") * 2.0,
            "constraint": c("logical_count") * 1.0,
            "attribution": c("event_count") * 1.0,
            "complexity": F.least(F.lit(10.0), c("tokens") / 15.0 + c("sentences") * 0.5),
            "fragment": c("doc_id") % 13 == 0,
            "quote_warning": c("doc_id") % 19 == 0,
            "mixed": c("doc_id") % 11 == 0,
            "low_confidence": c("doc_id") % 7 == 0,
        }
    )
    value, risk, route = spans.value_risk_route()
    return rows.select("doc_id", value.alias("has_value"), risk.alias("risk_score"), route.alias("route"))


_PRAISE_SQL = f"""((regexp_matches(low, '\\byou(''?re| are)\\b') AND {_any('low', spans.PRAISE)}) OR regexp_matches(x, '^[A-Z][A-Za-z]+(\\s+[A-Z][A-Za-z]+)?,\\s+you\\b')
  OR (nm <> '' AND nm NOT IN ('that', 'this', 'it')) OR regexp_matches(x, '你.*(聪明|厉害|优秀)'))"""
_ATTRIBUTION = rf"""a0 AS (SELECT conv_id, turn, ['portrait_fact_candidate', 'portrait_hypothesis_candidate', 'reject', 'model_failure', 'other'][(conv_id + turn) % 5 + 1] AS kind, {FLAT} AS x FROM conversations),
a1 AS (SELECT *, lower(x) AS low, lower(regexp_extract(x, '\b([A-Z][A-Za-z]+)\s+is\s+(?:really\s+)?(?:smart|talented|great|excellent|brilliant|clever|capable)\b', 1)) AS nm FROM a0),
a2 AS (SELECT conv_id, turn, CASE WHEN kind = 'model_failure' THEN ['no_useful_modeling_value', 'unknown', 'no_promotion', 'ineligible']
  WHEN low = '' OR low IN ({_quoted(spans.NO_USE)}) THEN ['no_useful_modeling_value', CASE WHEN low <> '' THEN 'explicit' ELSE 'unknown' END, 'no_promotion', 'ineligible']
  WHEN contains(low, 'encourages') AND contains(low, 'exchange') THEN ['interaction_hypothesis', 'inferred', 'hypothesis_pool_candidates', 'ineligible']
  WHEN {_PRAISE_SQL} THEN ['subject_belief_about_node', 'inferred', 'hypothesis_pool_candidates', 'ineligible']
  WHEN regexp_matches(low, '\bi should learn from\b|\blearn from you\b|\blet''?s\b.*\b(discuss|meet|work|collaborate|eat|dinner)\b|\bi use\b.*\b(tool|project|for this project)\b')
    THEN ['subject_relation_to_node', CASE WHEN contains(low, 'i ') OR contains(x, '我') THEN 'explicit' ELSE 'inferred' END, 'future_relation_candidate', 'ineligible']
  WHEN contains(x, '?') AND regexp_matches(low, '\b(you|your|do you|got any)\b') THEN ['subject_relation_to_node', 'inferred', 'hypothesis_pool_candidates', 'ineligible']
  WHEN kind = 'portrait_hypothesis_candidate' THEN ['interaction_hypothesis', 'inferred', 'hypothesis_pool_candidates', 'ineligible']
  WHEN kind = 'portrait_fact_candidate' AND regexp_matches(low, '\b(i prefer|i like|i need|i want|i cannot|i can''t|i am|i''m|my|me too|same here|go-to|speaks to me)\b') THEN ['subject_intrinsic_fact', 'explicit', 'fact_promotion_review_queue', 'eligible']
  WHEN kind IN ('reject', 'skipped') THEN ['no_useful_modeling_value', 'unknown', 'no_promotion', 'ineligible'] ELSE ['unknown', 'ambiguous', 'uncertain_pool', 'uncertain'] END AS k FROM a1)"""


@oracle(f"WITH {_ATTRIBUTION} SELECT conv_id, turn, k[1] AS claim_type, k[2] AS attribution_status, k[3] AS promotion_path, k[4] AS fact_eligibility FROM a2")
def claim_attribution(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("portrait_fact_candidate", "portrait_hypothesis_candidate", "reject", "model_failure", "other")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    rows = model.table(spark, d, "conversations").select(*CONV, spans.claim_attribution(F.col("text"), kind).alias("k"))
    return rows.select(*CONV, "k.*")


_CLASS = f"""CASE WHEN {_any('lower(text)', ('prefer', 'favorite', 'favourite', 'love', 'enjoy', 'stress relief', 'go-to'))} THEN ['preference', 'semantic', 'global']
  WHEN {_any('lower(text)', ('job', 'business', 'store', 'work', 'career', 'lost'))} THEN ['life_stage', 'episodic', 'temporary']
  WHEN {_any('lower(text)', ('plan', 'routine', 'usually', 'schedule', 'practice'))} THEN ['routine', 'procedural', 'task'] ELSE ['observation', 'episodic', 'conversation'] END"""


@oracle(EV + rf"""SELECT 'memory:' || substr(sha256(evidence_ref), 1, 16) AS memory_id, evidence_ref, source_id, turn, CASE WHEN length(f) > 220 THEN rtrim(substr(f, 1, 217)) || '...' ELSE f END AS content,
  k[1] AS unit_type, k[2] AS memory_class, k[3] AS scope, CASE WHEN subject_role = 'target' AND trim(text) <> '' THEN 'accepted_for_experiment' ELSE 'context_only' END AS status, sha256(text) AS content_hash
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f, {_CLASS} AS k FROM ev)""")
def memory_units(spark: SparkSession, d: str) -> DataFrame:
    return memory.memory_units(model.evidence(spark, d))


_COMMIT = f"regexp_matches(lower(text), '{'|'.join(w.replace(chr(39), chr(39) * 2) for w in spans.T.COMMITMENT)}')"


@oracle(EV + f"""SELECT source_id, count(*) AS n_turns, count(*) FILTER (subject_role = 'target') AS n_target_turns, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS participants,
  CASE WHEN count(*) FILTER (subject_role <> 'target') = 0 THEN 'target_only' ELSE 'mixed_participant' END AS subject_scope,
  coalesce(array_to_string(list_slice(CASE WHEN count(*) FILTER (subject_role = 'target') > 0 THEN list(evidence_ref ORDER BY turn, evidence_ref) FILTER (subject_role = 'target')
    ELSE list(evidence_ref ORDER BY turn, evidence_ref) END, 1, 3), ','), '') AS main_events,
  coalesce(array_to_string(list_slice(list(evidence_ref ORDER BY turn, evidence_ref) FILTER (subject_role = 'target' AND {_COMMIT}), 1, 5), ','), '') AS commitments FROM ev GROUP BY source_id""")
def session_summaries(spark: SparkSession, d: str) -> DataFrame:
    return memory.session_summaries(model.evidence(spark, d))



_ASCII = r"regexp_replace(x, '[\p{L}\p{N}_]*[\x{C0}-\x{24F}][\p{L}\p{N}_]*', '_', 'g')"  # RE2 knows ASCII word boundaries only
_RX = lambda p, i="": "'" + (i + p).replace("'", "''") + "'"
_N = lambda p, i="": f"len(regexp_extract_all(t, {_RX(p, i)}))"
_CLAMP = lambda x: f"round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, {x})) + 1e-9::DOUBLE, 3)"
_P = {k: f"{v}::DOUBLE" for k, v in routing.PACKAGE_POLICY.items()}
_PACKAGE = rf"""k0 AS (SELECT evidence_ref, turn, speaker, {FLAT.replace(TXT, 'text')} AS x, least(turn, 2) AS n_context, subject_role, ['source_span', 'proposal_outcome', 'normalized_candidate'][conv_id % 3 + 1] AS input_kind,
  ['strict', 'inferred', ''][(conv_id + turn) % 3 + 1] AS status, turn % 4 <> 3 AS has_source, conv_id % 9 = 0 AS neighbour FROM ev),
k1 AS (SELECT *, {_ASCII} AS t FROM k0),
k2 AS (SELECT *, len(list_distinct(regexp_extract_all(t, {_RX(routing.NAME)}))) AS nn, {_N(routing.NAME)} AS pc, {_N(routing.VERB_OBJECT, '(?i)')} + {_N(routing.PREPOSITION)} AS plain, regexp_matches(t, {_RX(routing.COPULA, '(?i)')}) AS cop,
  regexp_matches(t, {_RX(routing.PRONOUN, '(?i)')}) AS pron, {_N(routing.UPDATE, '(?i)')} AS upd, {_N(routing.ATTRIBUTION, '(?i)')} AS said, {_N(routing.CONTEXT, '(?i)')} AS linked,
  CASE WHEN x = '' THEN 0 ELSE len(regexp_extract_all(x, '[.!?;:]\s+|\s+(?:and|but|then|so)\s+')) + 1 END AS cl, {_N(routing.SPEAKER)} AS tn, len(list_distinct(regexp_extract_all(t, {_RX(routing.SPEAKER)}))) AS sp FROM k1),
k3 AS (SELECT *, plain + (pc >= 2 AND cop)::INT AS hits FROM k2),
k4 AS (SELECT *, CASE WHEN speaker <> '' THEN 2.0::DOUBLE ELSE 0 END + least(5.0::DOUBLE, nn * 1.5::DOUBLE) + least(3.0::DOUBLE, sp * 0.75::DOUBLE) + (hits > 0)::INT - 1.5::DOUBLE * pron::INT AS ep, least(10.0::DOUBLE, hits * 6.0::DOUBLE) AS sf,
  CASE WHEN x = '' OR (length(x) < 10 AND NOT regexp_matches(x, '[A-Za-z]')) OR regexp_matches(x, {_RX(routing.LOW_VALUE[0])}) OR regexp_matches(x, {_RX(routing.LOW_VALUE[1])}) THEN 8.0::DOUBLE ELSE 0 END + CASE WHEN length(x) < 25 AND nn < 2 AND hits = 0 THEN 2 ELSE 0 END AS lo FROM k3),
k5 AS (SELECT *, sf * 0.45::DOUBLE + ep * 0.25::DOUBLE + 0.3::DOUBLE * least(4.0::DOUBLE, length(x) / 40.0::DOUBLE) + CASE WHEN tn >= 4 THEN least(3.0::DOUBLE, tn * 0.2::DOUBLE) ELSE 0 END + least(1.5::DOUBLE, n_context * 0.3::DOUBLE) + (upd > 0)::INT AS lk FROM k4),
k6 AS (SELECT evidence_ref, {_CLAMP('sf')} AS surface, {_CLAMP('ep')} AS endpoint, {_CLAMP('lk')} AS likelihood, {_CLAMP("sf - contains(x, '?')::INT - least(3.0::DOUBLE, said)")} AS direction,
  {_CLAMP("CASE WHEN cl > 1 THEN least(5.0::DOUBLE, (cl - 1) * 1.5::DOUBLE) ELSE 0 END + least(3.0::DOUBLE, linked * 1.5::DOUBLE) + least(2.0::DOUBLE, n_context * 0.5::DOUBLE) + 0.5::DOUBLE * (input_kind = 'proposal_outcome')::INT + 2 * neighbour::INT")} AS context,
  {_CLAMP("3 * (status = 'inferred')::INT + least(4.0::DOUBLE, said * 2.0::DOUBLE) + 1.5::DOUBLE * (subject_role <> 'target')::INT")} AS attribution, {_CLAMP("(4 + 2 * has_source::INT + 3 * has_source::INT + (x <> '')::INT)::DOUBLE")} AS evidence, {_CLAMP('lo')} AS low_value,
  {_CLAMP("lk * 0.4::DOUBLE + ep * 0.3::DOUBLE + CASE WHEN tn >= 4 THEN least(2.0::DOUBLE, tn * 0.15::DOUBLE) ELSE 0 END + least(1.0::DOUBLE, n_context * 0.25::DOUBLE) + 1.5::DOUBLE * (input_kind <> 'source_span')::INT + 2 * (upd > 0)::INT")} AS utility,
  {_CLAMP(f"(2 * (nn = 1)::INT + regexp_matches(t, {_RX(routing.TITLED)})::INT + 2 * (ep < 3 AND nn > 0)::INT)::DOUBLE")} AS merge FROM k5)"""


@oracle(EV.rstrip() + f""", {_PACKAGE} SELECT *, CASE WHEN evidence < {_P['evidence_min']} THEN 'repair_or_review' WHEN low_value >= {_P['low_skip_floor']} AND likelihood < {_P['low_skip_relation_ceiling']} THEN 'skip_or_background_only'
  WHEN surface >= {_P['nlp_surface_floor']} AND endpoint >= {_P['nlp_endpoint_floor']} AND direction >= {_P['nlp_direction_floor']} AND attribution < {_P['nlp_attribution_ceiling']} AND context < {_P['nlp_context_ceiling']} THEN 'nlp_openie_candidate'
  WHEN utility >= {_P['strong_utility_floor']} AND (context >= {_P['strong_context_floor']} OR attribution >= {_P['strong_attribution_floor']} OR merge >= {_P['strong_merge_floor']}) THEN 'strong_llm_graph_extraction'
  WHEN likelihood >= {_P['weak_relation_floor']} OR utility >= {_P['weak_utility_floor']} THEN 'weak_llm_graph_extraction' WHEN endpoint >= {_P['entity_endpoint_floor']} AND likelihood < {_P['entity_relation_ceiling']} THEN 'entity_candidate_only'
  ELSE 'skip_or_background_only' END AS route FROM k6""")
def package_route(spark: SparkSession, d: str) -> DataFrame:
    rows = routing.package_features(packages(spark, d)).withColumn("route", routing.package_route())
    return rows.select("evidence_ref", "surface", "endpoint", "likelihood", "direction", "context", "attribution", "evidence", "low_value", "utility", "merge", "route")


def packages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as packets of three kinds; one in four lacks source and raw references."""
    c, t = F.col("conv_id"), F.col("turn")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    there = F.when(t % 4 != 3, 1).otherwise(0)
    return model.evidence(spark, d).withColumns(
        {
            "perspective": F.col("speaker"),
            "attribution_status": pick(("strict", "inferred", ""), c + t),
            "input_kind": pick(("source_span", "proposal_outcome", "normalized_candidate"), c),
            "neighbour_warning": c % 9 == 0,
            "n_refs": F.lit(1),
            "n_sources": there,
            "n_back": there,
            "n_context": F.least(t, F.lit(2)),
        }
    )
