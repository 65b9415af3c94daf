"""Queries of review, publication, proposals, schemas and entity extraction, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import maintain, retrieval, review, spans
from .oracles import FLAT
from .plans import model, store
from .service_queries import oracle

HUMAN = ("approve_recommended", "approve_with_edit", "needs_more_evidence", "reject", "defer", "", "whatever")
ACTIONS = (*review.ACTION_STATUS, "no_such_action")


def _k() -> F.Column:
    return F.col("o_orderkey")


def _pick(values, k) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as review items."""
    rows = model.table(spark, d, "orders")
    allowed = F.when(_k() % 4 == 0, F.array()).when(_k() % 4 == 1, F.array(F.lit("accept_noop"), F.lit("defer"))).when(_k() % 4 == 2, F.array(F.lit("reject_patch"), F.lit("accept_patch"), F.lit("defer"))).otherwise(F.array(*[F.lit(a) for a in ACTIONS]))
    return rows.select(
        _k().alias("review_item_id"),
        _pick(HUMAN, _k()).alias("human_decision"),
        _pick(ACTIONS, _k()).alias("review_action"),
        F.when(_k() % 5 == 0, "accept_patch").otherwise("").alias("default_recommendation"),
        allowed.cast("array<string>").alias("allowed"),
        _pick(("high", "medium", "low", "odd"), _k()).alias("priority"),
        F.when(_k() % 3 == 0, "record_duplicate_noop").otherwise("update_unit").alias("patch_action"),
        F.col("o_orderstatus").alias("stage"),
        F.substring("o_orderpriority", 1, 1).alias("layer"),
    )


_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_CASE = lambda col, table, other: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"
_ITEMS = f"""it0 AS (SELECT o_orderkey AS review_item_id, {_LIST(HUMAN)}[o_orderkey % {len(HUMAN)} + 1] AS h, {_LIST(ACTIONS)}[o_orderkey % {len(ACTIONS)} + 1] AS ra, CASE WHEN o_orderkey % 5 = 0 THEN 'accept_patch' ELSE '' END AS dr,
  CASE o_orderkey % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['accept_noop', 'defer'] WHEN 2 THEN ['reject_patch', 'accept_patch', 'defer'] ELSE {_LIST(ACTIONS)} END AS allowed, ['high', 'medium', 'low', 'odd'][o_orderkey % 4 + 1] AS priority,
  CASE WHEN o_orderkey % 3 = 0 THEN 'record_duplicate_noop' ELSE 'update_unit' END AS patch_action, o_orderstatus AS stage, substr(o_orderpriority, 1, 1) AS layer FROM orders),
it1 AS (SELECT *, CASE WHEN h = '' THEN 'legacy_review_action' ELSE h END AS hd, CASE WHEN dr <> '' THEN dr ELSE coalesce(list_filter(allowed, lambda a: a NOT IN ('reject_patch', 'defer', 'needs_more_evidence'))[1], allowed[1], '') END AS rec FROM it0),
it2 AS (SELECT *, CASE WHEN hd = 'legacy_review_action' THEN ra WHEN hd IN ('approve_recommended', 'approve_with_edit') THEN rec ELSE {_CASE('hd', review.DIRECT_ACTION, "''")} END AS action FROM it1)"""


def _decision_sql(batch: bool) -> str:
    more = """, CASE WHEN action <> '' AND action <> 'accept_noop' THEN 'batch_action_not_safe' END, CASE WHEN priority <> 'low' THEN 'batch_only_low_priority' END,
      CASE WHEN patch_action NOT IN ('record_duplicate_noop', 'record_s2_duplicate_noop') THEN 'batch_only_duplicate_noop_patch' END""" if batch else ""
    return f"""WITH {_ITEMS}, e AS (SELECT *, array_to_string(list_filter([CASE WHEN hd = 'whatever' THEN 'unknown_human_decision' END, CASE WHEN action = '' THEN 'missing_internal_review_action' END,
  CASE WHEN action <> '' AND NOT list_contains(allowed, action) THEN 'review_action_not_allowed_for_item' END, CASE WHEN action = 'no_such_action' THEN 'unknown_review_action' END{more}], lambda x: x IS NOT NULL), ',') AS errors FROM it2)
SELECT review_item_id, action, errors, CASE WHEN errors = '' THEN CASE WHEN hd = 'approve_with_edit' THEN 'approved_with_edit' ELSE {_CASE('action', review.ACTION_STATUS, 'NULL')} END END AS review_status,
  CASE WHEN errors = '' THEN {_CASE('action', review.ACTION_EFFECT, "'unknown_action'")} END AS apply_effect FROM e"""


_OUT = ("review_item_id", "action", "errors", "review_status", "apply_effect")


@oracle(_decision_sql(False))
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    return review.decisions(_items(spark, d)).select(*_OUT)


@oracle(_decision_sql(True))
def batch_decisions(spark: SparkSession, d: str) -> DataFrame:
    return review.decisions(_items(spark, d), batch=True).select(*_OUT)


@oracle(f"SELECT apply_effect, review_status, count(*) AS n FROM ({_decision_sql(False)}) GROUP BY ALL")
def apply_plan_counts(spark: SparkSession, d: str) -> DataFrame:
    return review_decisions(spark, d).groupBy("apply_effect", "review_status").agg(F.count("*").alias("n"))


@oracle(f"""WITH {_ITEMS} SELECT review_item_id, stage, priority, row_number() OVER (PARTITION BY stage ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END, layer, patch_action, review_item_id) AS queue_no
FROM it0 WHERE layer = '1'""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return review.queue(_items(spark, d), layer="1").select("review_item_id", "stage", "priority", "queue_no")


@oracle("""SELECT user_id % 500 AS review_item_id, max_by(event_type, (ts, event_id)) AS decision, max(struct_pack(t := ts, e := event_id)).e AS event_id FROM events GROUP BY 1""")
def latest_decisions(spark: SparkSession, d: str) -> DataFrame:
    log = model.table(spark, d, "events").select((F.col("user_id") % 500).alias("review_item_id"), F.col("event_type").alias("decision"), "ts", "event_id")
    return review.latest_decisions(log, ["ts", "event_id"]).select("review_item_id", "decision", "event_id")


_OVERLAY = """a AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), i AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'), x AS (SELECT -o_custkey AS id FROM orders),
c AS (SELECT DISTINCT CASE WHEN user_id % 5 = 0 THEN -user_id ELSE user_id * 4 + 1 END AS id FROM events), s AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN -user_id ELSE user_id * 4 + 2 END AS id FROM events),
v AS (SELECT id, CASE WHEN id IN (SELECT id FROM s) THEN 'historical_or_stale' ELSE 'active_existing' END AS view_status, CASE WHEN id IN (SELECT id FROM s) THEN 'excluded_by_review_overlay' ELSE 'kept_from_active_s1_input' END AS reason, 'active' AS origin FROM a
  UNION ALL SELECT id, CASE WHEN id IN (SELECT id FROM i) OR id IN (SELECT id FROM a) THEN 'active_after_review' ELSE 'missing' END, CASE WHEN id IN (SELECT id FROM i) OR id IN (SELECT id FROM a) THEN 'accepted_by_review_overlay' ELSE 'missing_current_candidate' END,
    CASE WHEN id IN (SELECT id FROM i) THEN 'incremental' WHEN id IN (SELECT id FROM a) THEN 'active' ELSE 'missing' END FROM c
  UNION ALL SELECT id, CASE WHEN id IN (SELECT id FROM x) THEN 'historical_or_stale' ELSE 'missing' END, CASE WHEN id IN (SELECT id FROM x) THEN 'confirmed_historical_from_existing_excluded_input' ELSE 'missing_stale_candidate' END,
    CASE WHEN id IN (SELECT id FROM x) THEN 'excluded' ELSE 'missing' END FROM s WHERE id NOT IN (SELECT id FROM a))"""


def _overlay(spark: SparkSession, d: str) -> DataFrame:
    orders, u = model.table(spark, d, "orders"), F.col("user_id")
    users = model.table(spark, d, "events").select("user_id").distinct()
    return review.review_overlay(
        orders.where("o_orderstatus <> 'P'").select(_k().alias("id")),
        orders.where("o_orderstatus = 'P'").select(_k().alias("id")),
        orders.select((-F.col("o_custkey")).alias("id")),
        users.select(F.when(u % 5 == 0, -u).otherwise(u * 4 + 1).alias("id")),
        users.select(F.when(u % 3 == 0, -u).otherwise(u * 4 + 2).alias("id")),
    )


@oracle(f"WITH {_OVERLAY} SELECT * FROM v")
def review_overlay(spark: SparkSession, d: str) -> DataFrame:
    return _overlay(spark, d)


@oracle(f"""WITH {_OVERLAY} SELECT current_view_status, participates_in_default_query, count(*) AS n FROM (SELECT view_status NOT IN ('historical_or_stale', 'missing') AS participates_in_default_query,
  CASE view_status WHEN 'active_after_review' THEN 'active_current_review_accepted' WHEN 'active_existing' THEN 'active_current_existing' WHEN 'historical_or_stale' THEN 'historical_or_stale'
  ELSE CASE WHEN contains(reason, 'superseded') THEN 'superseded' WHEN contains(reason, 'stale') THEN 'stale' ELSE view_status END END AS current_view_status FROM v) GROUP BY ALL""")
def current_view_transitions(spark: SparkSession, d: str) -> DataFrame:
    active = ~F.col("view_status").isin("historical_or_stale", "missing")
    rows = _overlay(spark, d).select(review.current_status(active, F.col("view_status"), F.col("reason")).alias("current_view_status"), active.alias("participates_in_default_query"))
    return rows.groupBy("current_view_status", "participates_in_default_query").agg(F.count("*").alias("n"))


KINDS = ("semantic", "reject", "episodic", "model_uncertain", "procedural")


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    """A proposal a turn: half name their turn, the rest can only be found by their text; two in five are refused."""
    c, t = F.col("conv_id"), F.col("turn")
    ref = F.when((c + t) % 2 == 0, F.col("evidence_ref")).otherwise("")
    text = F.when((c + t) % 3 == 0, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")))).when((c + t) % 3 == 1, F.col("text")).otherwise("")
    return store.evidence(spark, d).select(F.concat_ws(":", F.lit("p"), c, t).alias("proposal_id"), "ordinal", ref.alias("primary_ref"), text.alias("text"), _pick(KINDS, c * 3 + t).alias("output_kind"))


_KEY = lambda c: rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"
_PROPOSALS = f"""{store.SQL}, pr AS (SELECT 'p:' || conv_id || ':' || turn AS proposal_id, ordinal, CASE WHEN (conv_id + turn) % 2 = 0 THEN evidence_ref ELSE '' END AS primary_ref,
  CASE (conv_id + turn) % 3 WHEN 0 THEN '  ' || replace(text, ' ', '  ') WHEN 1 THEN text ELSE '' END AS text, {_LIST(KINDS)}[(conv_id * 3 + turn) % 5 + 1] AS output_kind FROM ev),
pk AS (SELECT *, {_KEY('text')} AS k FROM pr), ek AS (SELECT evidence_ref, {_KEY('text')} AS k FROM ev)"""


def _match_sql(source: str) -> str:
    return f"""SELECT e.evidence_ref, coalesce(a.id, b.id) AS proposal_id, CASE WHEN a.id IS NOT NULL THEN 'primary_ref' WHEN b.id IS NOT NULL THEN 'text' END AS matched_by FROM ek e
  LEFT JOIN (SELECT primary_ref, arg_min(proposal_id, (ordinal, proposal_id)) AS id FROM {source} WHERE primary_ref <> '' GROUP BY 1) a ON a.primary_ref = e.evidence_ref
  LEFT JOIN (SELECT k, arg_min(proposal_id, (ordinal, proposal_id)) AS id FROM {source} WHERE k <> '' GROUP BY 1) b ON b.k = e.k"""


@oracle(f"WITH {_PROPOSALS} {_match_sql('pk')}")
def proposal_matches(spark: SparkSession, d: str) -> DataFrame:
    return review.match_proposals(store.evidence(spark, d), _proposals(spark, d))


@oracle(f"""WITH {_PROPOSALS}, bad AS (SELECT * FROM pk WHERE output_kind IN ('reject', 'skipped', 'model_uncertain', 'needs_human_review')), good AS (SELECT * FROM pk WHERE output_kind NOT IN ('reject', 'skipped', 'model_uncertain', 'needs_human_review')),
n AS (SELECT evidence_ref, count(DISTINCT proposal_id) AS n FROM (SELECT evidence_ref, proposal_id FROM ek JOIN bad ON primary_ref = evidence_ref UNION ALL SELECT evidence_ref, proposal_id FROM ek JOIN bad ON bad.k = ek.k AND bad.k <> '') GROUP BY 1),
m AS ({_match_sql('good')})
SELECT evidence_ref, coalesce(n, 0) AS n_vetoes, m.proposal_id IS NOT NULL AS accepted, coalesce(n, 0) > 0 AND m.proposal_id IS NULL AS vetoed FROM m LEFT JOIN n USING (evidence_ref)""")
def proposal_vetoes(spark: SparkSession, d: str) -> DataFrame:
    return review.vetoed(store.evidence(spark, d), _proposals(spark, d))


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Memory units; one in four without a speaker, some of which say that somebody said something."""
    k = F.col("conv_id") + F.col("turn")
    content = F.when(k % 8 == 0, F.concat(F.lit("user said "), "content")).otherwise(F.col("content"))
    return store.memory_units(spark, d).withColumns({"content": content, "speaker": F.when(k % 4 == 0, "").when(k % 7 == 0, "other").otherwise("User"), "s2_policy": F.when(F.col("turn") % 5 == 0, "background_only").otherwise("candidate_allowed")})


_UNITS = f"""{store.SQL}, u AS (SELECT memory_id, status, CASE WHEN (conv_id + turn) % 8 = 0 THEN 'user said ' || content ELSE content END AS content, CASE WHEN (conv_id + turn) % 4 = 0 THEN '' WHEN (conv_id + turn) % 7 = 0 THEN 'other' ELSE 'User' END AS speaker, turn % 5 = 0 AS blocked FROM mem),
sel AS (SELECT * FROM u WHERE status IN ('accepted_for_experiment', 'active') AND NOT blocked AND CASE WHEN speaker <> '' THEN lower(speaker) = 'user' ELSE contains(content, 'user said') OR contains(content, 'user wrote') END)"""


@oracle(f"WITH {_UNITS} SELECT memory_id, speaker FROM sel")
def selectable_units(spark: SparkSession, d: str) -> DataFrame:
    return review.selectable(_units(spark, d), "user").select("memory_id", "speaker")


_TYPE = " ".join(f"WHEN {' OR '.join(f'contains(lower(content), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{kind}'" for kind, words in (("preference", ("prefer", "favorite", "favourite", "love", "enjoy", "stress relief", "go-to")), ("life_stage", ("job", "business", "store", "work", "career", "lost")), ("routine", ("plan", "routine", "usually", "schedule", "practice"))))


@oracle(f"""WITH {_UNITS}, k AS (SELECT *, CASE {_TYPE} ELSE 'observation' END AS candidate_type FROM sel), n AS (SELECT *, candidate_type || ':' || substr(sha256(memory_id), 1, 10) AS node_id FROM k)
SELECT memory_id, candidate_type, node_id, substr(content, 1, 80) AS label, 'user|' || CASE candidate_type WHEN 'observation' THEN 'has_observation' ELSE 'has_' || candidate_type END || '|' || node_id AS edge, 'pending_review' AS status FROM n""")
def portrait_candidates(spark: SparkSession, d: str) -> DataFrame:
    kind = spans.memory_class(F.col("content"), F.lit("episodic"))["type"]
    return review.unit_candidates(review.selectable(_units(spark, d), "user"), "user", kind)


@oracle("""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(q) > 240 THEN 'source_text_quote_too_long' END, CASE WHEN q <> '' AND NOT contains(t, q) THEN 'source_text_quote_not_in_primary_text' END,
  CASE WHEN q <> '' AND NOT contains(t, q) AND NOT contains(c, q) THEN 'source_text_quote_not_exact' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM (SELECT doc_id, coalesce(text, '') AS x, substr(x, 1, length(x) // 2) AS t, substr(x, length(x) // 2 + 1) AS c, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN substr(x, 21, 60) WHEN 2 THEN substr(x, 521, 60) WHEN 3 THEN substr(x, 101, 300) ELSE 'not there' END AS q FROM documents)""")
def quote_guard(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of every document against its first half, with the second half as context."""
    k, x = F.col("doc_id"), F.coalesce("text", F.lit(""))
    half = F.floor(F.length(x) / 2).cast("int")
    first, second = F.substring(x, F.lit(1), half), F.substring(x, half + 1, F.length(x))
    quote = F.when(k % 5 == 0, "").when(k % 5 == 1, F.substring(x, 21, 60)).when(k % 5 == 2, F.substring(x, 521, 60)).when(k % 5 == 3, F.substring(x, 101, 300)).otherwise("not there")
    return model.table(spark, d, "documents").select("doc_id", F.array_join(review.quote_warnings(quote, first, second), ",").alias("warnings"))


_RX = lambda p: p.replace("(?i)", "").replace("'", "''")


@oracle(rf"""WITH t AS (SELECT conv_id, turn, role <> 'user' AS nt, {FLAT} AS x FROM conversations),
f AS (SELECT *, regexp_matches(x, '{_RX(review.SELF_TEXT)}', 'i') AS own, regexp_matches(x, '{_RX(review.RELATION_TEXT)}', 'i') AS rel, regexp_matches(x, '{_RX(review.AMBIGUOUS_TEXT)}', 'i') AS vague, regexp_matches(x, '{_RX(review.LOW_TEXT)}', 'i') AS lo FROM t),
g AS (SELECT *, lo AND NOT own AS low, own AND NOT nt AS selfish FROM f),
h AS (SELECT *, CASE WHEN low THEN 'none' WHEN selfish THEN 'high' WHEN rel THEN 'medium' WHEN x <> '' THEN 'unknown' ELSE 'none' END AS modeling_value,
  CASE WHEN low THEN 'ambient_context' WHEN selfish THEN 'direct_self_report' WHEN rel THEN 'inferred_relation' ELSE 'unknown' END AS directness,
  CASE WHEN low THEN 'unknown' WHEN selfish THEN 'target_subject' WHEN rel THEN CASE WHEN regexp_matches(x, '\blet''?s\b|\bwe should\b|\bwanna\b', 'i') THEN 'relationship' ELSE 'other_person' END ELSE 'unknown' END AS claim_target,
  CASE WHEN low THEN CASE WHEN nt THEN 'medium' ELSE 'low' END WHEN selfish THEN 'low' WHEN rel THEN CASE WHEN nt THEN 'high' ELSE 'medium' END ELSE CASE WHEN nt THEN 'high' ELSE 'unknown' END END AS attribution_risk FROM g)
SELECT conv_id, turn, modeling_value, directness, claim_target, attribution_risk, CASE WHEN low THEN 'local_turn_enough' WHEN vague AND modeling_value IN ('medium', 'high') THEN 'neighbor_turn_needed' WHEN own AND NOT vague THEN 'local_turn_enough'
  WHEN rel THEN 'neighbor_turn_needed' ELSE 'unknown' END AS context_need, CASE WHEN attribution_risk = 'high' OR (nt AND modeling_value IN ('medium', 'high')) THEN 'high' WHEN modeling_value IN ('medium', 'high') THEN 'medium' WHEN modeling_value = 'none' THEN 'low' ELSE 'unknown' END AS promotion_risk FROM h""")
def skip_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = model.table(spark, d, "conversations").select("conv_id", "turn", review.skip_signals(F.col("text"), F.col("role") != "user").alias("s"))
    return rows.select("conv_id", "turn", "s.*")


_TYPES = " ".join(f"WHEN regexp_matches(lower(e), '{'|'.join(words)}') THEN '{kind}'" for kind, words in review.TYPE_WORDS)
_TYPE_SQL = rf"CASE {_TYPES} WHEN regexp_matches(e, '\b(Mr|Mrs|Ms|Dr|Sir)\.?\s+[A-Z][a-z]+') OR regexp_matches(e, '\b[A-Z][a-z]+(\s+[A-Z][a-z]+)+\b') THEN 'person' ELSE 'unknown' END"
CLAUSES = r"""cl AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '\b(Mr|Mrs|Ms|Dr|St|e\.g|i\.e|etc)\.', '\1' || chr(1), 'g'), '[.!?;。！？；]+|,?\s+(?:and|but|then|so)\s+'),
  lambda p: trim(replace(p, chr(1), '.'))), lambda p: p <> '') AS cs FROM conversations),
clause AS (SELECT conv_id, turn, role, unnest(range(0, len(cs))) AS n, unnest(cs) AS clause FROM cl)"""


@oracle(f"WITH {CLAUSES} SELECT conv_id, turn, n, clause FROM clause")
def clause_split(spark: SparkSession, d: str) -> DataFrame:
    rows = model.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.clauses(F.col("text"))).alias("n", "clause"))
    return rows.withColumn("n", F.col("n").cast("long"))


@oracle(rf"""WITH {CLAUSES}, s AS (SELECT conv_id, turn, n AS clause_no, list_concat(CASE WHEN role IN ('', 'unknown') THEN [] ELSE [role] END, regexp_extract_all(regexp_replace(clause, '[\p{{L}}\p{{N}}_]*[\x{{C0}}-\x{{24F}}][\p{{L}}\p{{N}}_]*', '_', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')) AS es FROM clause),
f AS (SELECT conv_id, turn, clause_no, unnest(range(0, len(es))) AS p, unnest(es) AS e FROM s), o AS (SELECT conv_id, turn, clause_no, e, min(p) AS p FROM f GROUP BY ALL)
SELECT conv_id, turn, clause_no::INT AS clause_no, (row_number() OVER (PARTITION BY conv_id, turn, clause_no ORDER BY p) - 1)::INT AS span_no, e AS entity, {_TYPE_SQL} AS entity_type FROM o""")
def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    return review.entity_spans(model.table(spark, d, "conversations"), ["conv_id", "turn"], "role")


@oracle(f"SELECT p_partkey, {_TYPE_SQL} AS entity_type FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Dr. ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) WHEN 1 THEN p_name || ' library' WHEN 2 THEN p_type ELSE p_name END AS e FROM part)")
def entity_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    named = F.concat(F.lit("Dr. "), F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1000))
    text = F.when(k % 4 == 0, named).when(k % 4 == 1, F.concat("p_name", F.lit(" library"))).when(k % 4 == 2, F.col("p_type")).otherwise(F.col("p_name"))
    return model.table(spark, d, "part").select("p_partkey", review.entity_type(text).alias("entity_type"))


def _schema(spark: SparkSession, d: str) -> DataFrame:
    """Part names as relation types, their brands' and types' spellings as aliases, parts as what was counted."""
    p = model.table(spark, d, "part")
    name = F.regexp_replace("p_name", " ", "_")
    return p.groupBy(name.alias("relation_type")).agg(F.array_sort(F.collect_set(F.lower(F.concat(F.col("p_type"), F.lit(" "), F.substring_index("p_name", " ", -1))))).alias("aliases"), F.count("*").alias("source_count"), F.count_distinct("p_type").alias("n_sources"))


def _packets(spark: SparkSession, d: str) -> DataFrame:
    """Parts as packets that speak of two names; every part, its text once."""
    p = model.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("query_id"), F.concat("p_type", F.lit(" "), "p_name", F.lit(" meets "), "p_type", F.lit(" ring, "), "p_brand").alias("text"))


_STOPS = ", ".join(f"'{w}'" for w in T.SCHEMA_STOPWORDS)
_STOK = lambda c: rf"list_filter(list_transform(regexp_extract_all({c}, '[0-9a-zA-Z\x{{4e00}}-\x{{9fff}}]+'), lambda x: lower(x)), lambda w: NOT regexp_full_match(w, '[0-9]+') AND (regexp_matches(w, '[\x{{4e00}}-\x{{9fff}}]') OR length(w) >= 3) AND w NOT IN ({_STOPS}))"
_SCHEMA = rf"""sc AS (SELECT replace(p_name, ' ', '_') AS relation_type, list_sort(list(DISTINCT lower(p_type || ' ' || split_part(p_name, ' ', -1)))) AS aliases, count(*) AS source_count, count(DISTINCT p_type) AS n_sources FROM part GROUP BY 1),
pk AS (SELECT p_partkey AS query_id, p_type || ' ' || p_name || ' meets ' || p_type || ' ring, ' || p_brand AS text FROM part),
dt AS (SELECT relation_type, term, count(*) AS dtf FROM (SELECT relation_type, unnest({_STOK("concat_ws(' ', relation_type, replace(relation_type, '_', ' '), array_to_string(aliases, ' '))")}) AS term FROM sc) GROUP BY ALL),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM sc)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM dt GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_STOK('text')}) AS term FROM pk) GROUP BY ALL),
lx AS (SELECT query_id, relation_type, sum((1 + ln(qtf)) * (1 + ln(dtf)) * idf) AS lexical FROM qt JOIN dt USING (term) JOIN idf USING (term) GROUP BY ALL),
al AS (SELECT DISTINCT relation_type, lower(trim(regexp_replace(replace(a, '_', ' '), '\s+', ' ', 'g'))) AS a FROM (SELECT relation_type, unnest(list_concat([relation_type], aliases)) AS a FROM sc)),
hx AS (SELECT query_id, relation_type, count(DISTINCT a) AS n_alias FROM pk JOIN al ON length(a) >= 3 AND contains(' ' || regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[^0-9a-zA-Z]', ' ', 'g') || ' ', ' ' || a || ' ') GROUP BY ALL),
sx AS (SELECT query_id, relation_type, round(coalesce(lexical, 0), 6) AS lexical, coalesce(n_alias, 0) AS n_alias, source_count, round(coalesce(lexical, 0) + 3.5::DOUBLE * coalesce(n_alias, 0) + least(2.0::DOUBLE, ln(1.0::DOUBLE + source_count) / 5.0::DOUBLE) + CASE WHEN n_sources > 1 THEN 0.4::DOUBLE ELSE 0 END, 6) AS score
  FROM lx FULL JOIN hx USING (query_id, relation_type) JOIN sc USING (relation_type)),
tx AS (SELECT query_id, relation_type, lexical, n_alias, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_count DESC, relation_type) AS rank FROM sx QUALIFY rank <= 8)"""


@oracle(f"WITH {_SCHEMA} SELECT * FROM tx")
def schema_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return review.schema_candidates(_packets(spark, d), _schema(spark, d), 8)


def _by_hash(near: DataFrame) -> DataFrame:
    """A second ranking of every packet's relation types, as an embedding index would give it: by a seeded hash."""
    key = F.md5(F.concat_ws("|", "query_id", "relation_type"))
    return retrieval.top_k(near.select("query_id", "relation_type", (-F.conv(F.substring(key, 1, 8), 16, 10).cast("long")).alias("h")), 8, "h", ["relation_type"]).select("query_id", "relation_type", "rank")


@oracle(f"""WITH {_SCHEMA.replace('QUALIFY rank <= 8', 'QUALIFY rank <= 24')}, l AS (SELECT query_id, relation_type, rank AS l FROM tx WHERE rank <= 8),
e AS (SELECT query_id, relation_type, row_number() OVER (PARTITION BY query_id ORDER BY substr(md5(query_id || '|' || relation_type), 1, 8), relation_type) AS e FROM tx QUALIFY e <= 8),
f AS (SELECT query_id, relation_type, round(CASE WHEN l IS NOT NULL THEN 1.0::DOUBLE / (60 + l) ELSE 0 END + CASE WHEN e IS NOT NULL THEN 1.0::DOUBLE / (60 + e) ELSE 0 END, 8) AS score, (l IS NOT NULL)::INT + (e IS NOT NULL)::INT AS n_sources FROM l FULL JOIN e USING (query_id, relation_type))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_sources DESC, relation_type) AS rank FROM f QUALIFY rank <= 10""")
def schema_fusion(spark: SparkSession, d: str) -> DataFrame:
    near = review.schema_candidates(_packets(spark, d), _schema(spark, d), 24)
    return review.schema_fusion(near.where("rank <= 8"), _by_hash(near), 10)


METRICS = ["n", "n_quantity", "n_returned"]


@oracle("""WITH r AS (SELECT l_partkey AS query_id, l_linestatus || l_returnflag AS mode, count(*) AS n, sum(l_quantity)::BIGINT AS n_quantity, count(*) FILTER (l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY ALL),
b AS (SELECT query_id, arg_min(struct_pack(n := n, q := n_quantity, r := n_returned), (mode <> 'FA', mode)) AS b FROM r GROUP BY query_id)
SELECT query_id, mode, n - b.b.n AS n_delta, n_quantity - b.b.q AS n_quantity_delta, n_returned - b.b.r AS n_returned_delta FROM r JOIN b USING (query_id)""")
def mode_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Order lines by status as modes of a part, compared with mode FA."""
    li = model.table(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_partkey").alias("query_id"), F.concat("l_linestatus", "l_returnflag").alias("mode")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("n_quantity"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    return review.mode_deltas(rows, "FA", METRICS)


@oracle("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 3 = 0 THEN 'removed' WHEN o_orderkey % 11 = 0 AND o_orderstatus <> 'Z' THEN 'changed' ELSE 'same' END AS change FROM orders),
h AS (SELECT c.id, change, 'part:' || l_partkey AS asset FROM c JOIN lineitem ON l_orderkey = c.id WHERE change <> 'same')
SELECT asset, count(DISTINCT id) AS n_changed, CASE WHEN count(*) FILTER (change <> 'added') > 0 THEN 'rebuild' ELSE 'extend' END AS action FROM h GROUP BY asset""")
def stale_assets(spark: SparkSession, d: str) -> DataFrame:
    """Parts as assets that depend on orders, between two versions of the orders."""
    orders = model.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    before, after = orders.where("o_orderkey % 5 <> 0"), orders.where("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(_k() % 11 == 0, "Z").otherwise(F.col("o_orderstatus")))
    changes = maintain.compare_tables(before, after, "o_orderkey", ["o_orderstatus", "o_custkey"]).withColumnRenamed("o_orderkey", "id")
    uses = model.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("part:"), "l_partkey").alias("asset"))
    return review.stale_assets(changes, uses)


@oracle(f"""WITH {store.SQL}, d AS (SELECT evidence_ref AS new_id, evidence_ref AS ref FROM ev WHERE turn < 2), p AS (SELECT DISTINCT 'pk:' || conv_id || ':' || (turn // 3) AS packet_id, evidence_ref AS ref FROM ev),
k AS (SELECT 'pk:' || conv_id || ':' || (turn // 3) AS packet_id, count(*) AS n FROM ev WHERE speaker = 'user' GROUP BY 1)
SELECT new_id, packet_id, count(*) AS n_refs, coalesce(any_value(n), 0) AS n_candidates FROM d JOIN p USING (ref) LEFT JOIN k USING (packet_id) GROUP BY new_id, packet_id""")
def affected_packets(spark: SparkSession, d: str) -> DataFrame:
    """Packets of three turns against changes in first turns; user turns are what was extracted."""
    ev = store.evidence(spark, d).withColumn("packet_id", F.concat(F.lit("pk:"), F.concat_ws(":", "conv_id", F.floor(F.col("turn") / 3))))
    packets = ev.groupBy("packet_id").agg(F.collect_list("evidence_ref").alias("evidence_refs"))
    deltas = ev.where("turn < 2").select(F.col("evidence_ref").alias("new_id"), F.array("evidence_ref").alias("evidence_refs"))
    return review.affected_packets(deltas, packets, ev.where("speaker = 'user'").select(F.col("evidence_ref").alias("candidate_id"), "packet_id"))

