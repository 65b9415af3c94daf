"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

from .functions import text as T
from .operators import consolidate, maintain, retrieval, routing

ORACLES: dict[str, str] = {}


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


TXT = "coalesce(text, '')"
WORDS = f"list_transform(regexp_extract_all({TXT}, '[A-Za-z0-9_]+'), lambda x: lower(x))"
CJK = r"regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]')"


def bag(col: str = TXT) -> str:
    cjk = CJK.format(col)
    return (
        f"list_concat(list_concat(list_transform(regexp_extract_all({col}, '[A-Za-z0-9_]+'), lambda x: lower(x)), {cjk}), "
        f"list_transform(range(1, len({cjk})), lambda i: {cjk}[i] || {cjk}[i + 1]))"
    )


def word_set(col: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(coalesce({col}, ''), '[A-Za-z0-9_]+'), lambda x: lower(x))))"


def delta_tokens(col: str) -> str:
    return rf"list_transform(regexp_extract_all(coalesce({col}, ''), '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x))"


def key(col: str, mark: str, drop: str) -> str:
    flat = rf"lower(trim(regexp_replace({col}, '\s+', ' ', 'g')))"
    flat = f"regexp_replace({flat}, '{drop}', '', 'g')" if drop else flat
    return rf"regexp_replace(regexp_replace({flat}, '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '{mark}', 'g'), '^{mark}+|{mark}+$', '', 'g')"


FLAT = rf"trim(regexp_replace({TXT}, '\s+', ' ', 'g'))"
SENT = f"greatest(len(list_filter(regexp_split_to_array({TXT}, '[.!?。！？]+'), lambda x: trim(x) <> '')), 1)"
ROUGH = f"(len(regexp_extract_all({TXT}, '[A-Za-z0-9_]+')) + len({CJK.format(TXT)}))"

ORACLES["tok_set"] = f"SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {word_set('text')} AS w FROM documents)"
ORACLES["tok_bm25_bag"] = f"SELECT conv_id, turn, len(b)::BIGINT AS n, coalesce(array_to_string(b, ' '), '') AS bag FROM (SELECT conv_id, turn, {bag()} AS b FROM conversations)"


def _tokens(table: str, keys: str, words: str, digest: bool) -> str:
    out = "md5(coalesce(array_to_string(w, ' '), '')) AS words_md5" if digest else "coalesce(array_to_string(w, ' '), '') AS words"
    return f"SELECT {keys}, len(w)::BIGINT AS n, {out} FROM (SELECT {keys}, {words} AS w FROM {table})"


ORACLES["tok_graph"] = _tokens(
    "conversations", "conv_id, turn", rf"list_filter(regexp_extract_all(lower(trim({TXT})), '[a-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]'), lambda x: x NOT IN ({_in(T.GRAPH_STOPWORDS)}))", False
)
ORACLES["tok_schema"] = _tokens(
    "documents",
    "doc_id",
    rf"list_filter(list_transform(regexp_extract_all({TXT}, '[0-9a-zA-Z\x{{4e00}}-\x{{9fff}}]+'), lambda x: lower(x)), lambda x: NOT regexp_full_match(x, '[0-9]+') AND (regexp_matches(x, '[\x{{4e00}}-\x{{9fff}}]') OR length(x) >= 3) AND x NOT IN ({_in(T.SCHEMA_STOPWORDS)}))",
    True,
)
ORACLES["tok_delta"] = _tokens("conversations", "conv_id, turn", delta_tokens("text"), False)
ORACLES["tok_smoke"] = _tokens(
    "conversations", "conv_id, turn", rf"list_filter(regexp_extract_all(lower({TXT}), '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]+'), lambda x: x NOT IN ({_in(T.GRAPH_STOPWORDS)}))", False
)
ORACLES["text_keys"] = f"""
SELECT conv_id, turn, {key(TXT, '-', "[''’]")} AS entity_key, {key(TXT, '_', '')} AS relation_key,
       CASE WHEN length({FLAT}) > 80 THEN rtrim(substr({FLAT}, 1, 77)) || '...' ELSE {FLAT} END AS excerpt,
       'turn:' || substr(sha256(conv_id || '|' || turn), 1, 12) AS id
FROM conversations"""
_hit = " + ".join(f"len(regexp_extract_all(low, '(^| ){t}( |$)'))" for t in ("the", "and", "of"))
ORACLES["text_counts"] = f"""
WITH t AS (SELECT doc_id, text, replace(regexp_replace(lower({TXT}), '[^a-z0-9_]', ' ', 'g'), ' ', '  ') AS low, {ROUGH} AS tokens FROM documents),
h AS (SELECT *, {_hit} AS hits FROM t)
SELECT doc_id, tokens::BIGINT AS tokens, {SENT}::BIGINT AS sentences, hits::BIGINT AS hits,
       CASE WHEN tokens > 0 THEN round(hits / tokens * 100, 4) ELSE 0 END AS hits_per_100,
       regexp_matches(lower(trim({TXT})), '\\?$') OR regexp_matches(lower(trim({TXT})), '^({'|'.join(T.QUESTION)}) ') AS is_question,
       regexp_matches(lower({TXT}), '{'|'.join(w.replace("'", "''") for w in T.COMMITMENT)}') AS is_commitment
FROM h"""
_syl = "greatest(len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1)"
ORACLES["readability"] = f"""
WITH t AS (
  SELECT doc_id, list_transform(regexp_extract_all({TXT}, '[A-Za-z]+'), lambda w: lower(w)) AS ws, {SENT}::DOUBLE AS s FROM documents WHERE lang = 'en'
), c AS (
  SELECT doc_id, s, len(ws)::DOUBLE AS n, coalesce(list_sum(list_transform(ws, lambda w: {_syl})), 0)::DOUBLE AS syl,
         len(list_filter(ws, lambda w: {_syl} >= 3))::DOUBLE AS hard, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::DOUBLE AS let FROM t
)
SELECT doc_id,
  CASE WHEN n > 0 THEN round(206.835 - 1.015 * (n / s) - 84.6 * syl / n + 1e-9::DOUBLE, 4) ELSE 0 END AS flesch,
  CASE WHEN n > 0 THEN round(0.39 * (n / s) + 11.8 * syl / n - 15.59 + 1e-9::DOUBLE, 4) ELSE 0 END AS kincaid,
  CASE WHEN n > 0 THEN round(4.71 * let / n + 0.5 * (n / s) - 21.43 + 1e-9::DOUBLE, 4) ELSE 0 END AS ari,
  CASE WHEN n > 0 THEN round(0.0588 * (let / n * 100) - 0.296 * (s / n * 100) - 15.8 + 1e-9::DOUBLE, 4) ELSE 0 END AS coleman_liau,
  CASE WHEN n > 0 THEN round(0.4 * ((n / s) + 100 * hard / n) + 1e-9::DOUBLE, 4) ELSE 0 END AS fog,
  CASE WHEN n > 0 THEN round(1.043 * sqrt(hard * 30 / s) + 3.1291 + 1e-9::DOUBLE, 4) ELSE 0 END AS smog
FROM c"""
_solid = rf"length(regexp_replace({TXT}, '\s+', '', 'g'))::DOUBLE"
_share = lambda p: f"CASE WHEN {_solid} > 0 THEN round(len(regexp_extract_all({TXT}, '{p}')) / {_solid} * 10, 3) ELSE 0 END"
ORACLES["language_scores"] = rf"SELECT *, zh >= 6 AND latin >= 2 AS mixed FROM (SELECT doc_id, {_share('[\\x{4e00}-\\x{9fff}]')} AS zh, {_share('[A-Za-z]')} AS latin FROM documents)"
ORACLES["capitalized_terms"] = f"SELECT conv_id, turn, coalesce(array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all({TXT}, '[A-Z][a-z]+(?: [A-Z][a-z]+){{0,3}}'))), 1, 20), '|'), '') AS names FROM conversations"

# --- evidence, memory, context

EVIDENCE = """SELECT 'evidence:conv:' || conv_id || ':' || turn AS evidence_ref, 'conv:' || conv_id AS source_id, conv_id, turn, role AS speaker,
  CASE WHEN role = 'user' THEN 'target' ELSE 'other_participant' END AS subject_role,
  CASE WHEN role = 'user' THEN 'low' ELSE 'medium' END AS contamination_risk,
  CASE WHEN role = 'user' THEN 'allowed' ELSE 'context_only' END AS s2_policy, coalesce(text, '') AS text FROM conversations"""
EV = f"WITH ev AS ({EVIDENCE}) "
ORACLES["evidence_rows"] = EV + "SELECT * EXCLUDE (text), sha256(text) AS content_hash FROM ev"
ORACLES["context_envelope"] = EV + """SELECT evidence_ref, coalesce(array_to_string(list(evidence_ref) OVER (PARTITION BY source_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS context_before,
  coalesce(array_to_string(list(evidence_ref) OVER (PARTITION BY source_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS context_after
FROM ev WHERE trim(text) <> ''"""
ORACLES["neighbour_ids"] = EV + """SELECT evidence_ref, lag(evidence_ref) OVER w AS prev_ref, lead(evidence_ref) OVER w AS next_ref, 'S' || lpad(row_number() OVER w || '', 4, '0') AS unit_no
FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY turn)"""

# --- retrieval

BM25 = f"""
bags AS (SELECT conv_id, turn, {bag()} AS b FROM conversations),
stats AS (SELECT count(*) AS n, avg(len(b)) AS avg_len FROM bags),
post AS (SELECT conv_id, turn, len_, term, count(*) AS tf FROM (SELECT conv_id, turn, len(b)::BIGINT AS len_, unnest(b) AS term FROM bags) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, stats),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({bag()}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, conv_id, turn, sum(qtf * idf * tf * {retrieval.K1 + 1} / (tf + {retrieval.K1} * (1 - {retrieval.B} + {retrieval.B} * len_ / avg_len))) AS bm25
       FROM post JOIN idf USING (term) JOIN q USING (term), stats GROUP BY ALL)"""
LEX = f"""
qs AS (SELECT item_id AS query_id, len(w) AS n, unnest(w) AS term FROM (SELECT item_id, {word_set('text')} AS w FROM benchmark)),
ds AS (SELECT conv_id, turn, unnest({word_set('text')}) AS term FROM conversations),
lx AS (SELECT query_id, conv_id, turn, count(*) AS overlap, count(*) + count(*) / any_value(n) AS score FROM ds JOIN qs USING (term) GROUP BY query_id, conv_id, turn)"""


def top(table: str, score: str, k: int, cols: str, keys: str = "conv_id, turn") -> str:
    return f"SELECT {cols}, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, {keys})::INT AS rank FROM {table} QUALIFY rank <= {k}"


ORACLES["bm25_stats"] = f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf"
ORACLES["bm25_postings"] = f"WITH {BM25} SELECT conv_id, turn, len_ AS n_tokens, term, tf FROM post"
ORACLES["bm25_topk"] = f"WITH {BM25}, r AS (SELECT query_id, conv_id, turn, round(bm25, 6) AS bm25 FROM bm) {top('r', 'bm25', 8, '*')}"
ORACLES["lexical_direct_scan"] = f"WITH {LEX}, r AS (SELECT query_id, conv_id, turn, overlap, round(score, 6) AS score FROM lx) {top('r', 'score', 8, '*')}"
ORACLES["cosine_topk"] = """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS cosine FROM embeddings, q WHERE vec_id <> query_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INT AS rank FROM r WHERE cosine > 0 QUALIFY rank <= 10"""
ORACLES["vector_check"] = "SELECT label, count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS bad_dims, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS mean_norm FROM embeddings GROUP BY label"
_num = lambda h, a, n: f"('0x' || substr({h}, {a}, {n}))::BIGINT"
ORACLES["hash_embed_wide"] = f"""WITH t AS (SELECT item_id, unnest(CASE WHEN len({bag()}) > 0 THEN {bag()} ELSE [text] END) AS tok FROM benchmark),
h AS (SELECT item_id, sha256(tok) AS h, unnest(range(16)) AS i FROM t),
b AS (SELECT item_id, {_num('h', 'i * 4 + 1', 4)} % 32 AS dim, sum(CASE WHEN {_num('h', 'i * 4 + 1', 2)} % 2 = 0 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM b GROUP BY item_id),
g AS (SELECT DISTINCT item_id, unnest(range(32)) AS dim FROM t)
SELECT item_id, dim, round(round(coalesce(CASE WHEN norm > 0 THEN v / norm ELSE v END, 0), 8), 6) AS value FROM g LEFT JOIN b USING (item_id, dim) JOIN n USING (item_id)"""
_ws = r"list_filter(string_split(replace(lower(text), chr(10), ' '), ' '), lambda x: x <> '')"
ORACLES["hash_embed_token"] = f"""WITH t AS (SELECT item_id, unnest(CASE WHEN len({_ws}) > 0 THEN {_ws} ELSE [text] END) AS tok FROM benchmark),
b AS (SELECT item_id, {_num('sha256(tok)', 1, 8)} % 32 AS dim, sum(CASE WHEN {_num('sha256(tok)', 9, 2)} % 2 = 0 THEN 1 ELSE -1 END) AS v FROM t GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM b GROUP BY item_id),
g AS (SELECT DISTINCT item_id, unnest(range(32)) AS dim FROM t)
SELECT item_id, dim, round(round(coalesce(CASE WHEN norm > 0 THEN v / norm ELSE v END, 0), 8), 6) AS value FROM g LEFT JOIN b USING (item_id, dim) JOIN n USING (item_id)"""
ORACLES["hybrid_fusion"] = f"""WITH {BM25}, {LEX},
l AS (SELECT query_id, conv_id, turn, bm25 / max(bm25) OVER (PARTITION BY query_id) AS a FROM bm),
r AS (SELECT query_id, conv_id, turn, score / 10 / max(score / 10) OVER (PARTITION BY query_id) AS b FROM lx),
j AS (SELECT query_id, conv_id, turn, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM l FULL JOIN r USING (query_id, conv_id, turn)),
f AS (SELECT query_id, conv_id, turn, round(CASE WHEN query_id % 2 = 0 THEN 0.55 * a + 0.45 * b ELSE 0.25 * a + 0.75 * b END, 6) AS score FROM j),
t AS ({top('f', 'score', 8, '*')})
SELECT *, CASE WHEN score >= 0.55 THEN 'direct' WHEN score >= 0.25 THEN 'supporting' WHEN score >= 0.10 THEN 'weak' ELSE 'excluded' END AS bucket FROM t"""
ORACLES["subject_adjusted"] = f"""WITH {BM25}, s AS (SELECT query_id, conv_id, turn, CASE WHEN role = 'user' THEN 'target' ELSE 'other_participant' END AS subject_role,
  round(bm25 * CASE WHEN role = 'user' THEN 1 WHEN query_id % 2 = 0 THEN 0.25 ELSE 0.55 END, 6) AS score FROM bm JOIN conversations USING (conv_id, turn))
{top('s', 'score', 5, '*')}"""
CLAIMS = f"""ev AS ({EVIDENCE}), f AS (SELECT source_id, min(turn) AS t0, arg_min(text, turn) AS claim FROM ev WHERE subject_role = 'target' GROUP BY source_id),
o AS (SELECT ev.source_id, turn, {word_set('ev.text')} AS ew FROM ev JOIN f USING (source_id) WHERE turn <> t0),
c AS (SELECT source_id, {word_set('claim')} AS cw FROM f),
p AS (SELECT c.source_id, cw, ew, list_intersect(cw, ew) AS both_, ew IS NOT NULL AS has FROM c LEFT JOIN o USING (source_id)),
neg AS (SELECT *, len(both_) > 0 AND list_has_any(ew, [{_in(retrieval.NEGATORS)}]) AND NOT list_has_any(cw, [{_in(retrieval.NEGATORS)}]) AS against FROM p),
a AS (SELECT source_id, any_value(len(cw)) AS n, len(list_distinct(flatten(list(both_) FILTER (has)))) AS covered, coalesce(bool_or(len(both_) > 0), false) AS pos,
      coalesce(bool_or(against), false) AS against, count(*) FILTER (has) AS texts, count(*) FILTER (len(both_) > 0) AS sup FROM neg GROUP BY source_id),
checks AS (SELECT source_id AS claim_id, CASE WHEN against THEN 'contradicts' WHEN pos AND covered >= greatest(2, least(4, n // 2)) THEN 'direct' WHEN pos THEN 'partial'
  WHEN texts > 0 THEN 'weak' ELSE 'unknown' END AS support_strength, (CASE WHEN against THEN 0 ELSE sup END)::BIGINT AS n_supporting, 0::BIGINT AS n_missing FROM a)"""
ORACLES["claim_support"] = f"WITH {CLAIMS} SELECT * FROM checks"
ORACLES["grounding"] = f"""WITH {CLAIMS} SELECT 'g' || right(claim_id, 1) AS grp, count(*) AS n_claims, count(*) FILTER (support_strength IN ('weak', 'unknown')) AS n_unsupported,
  CASE WHEN count(*) FILTER (support_strength = 'contradicts') > 0 THEN 'conflicting' WHEN n_unsupported = 0 THEN 'grounded' WHEN n_unsupported < n_claims THEN 'partially_grounded' ELSE 'ungrounded' END AS grounding
FROM checks GROUP BY grp"""
RRF = f"""{BM25}, {LEX}, b1 AS (SELECT query_id, conv_id, turn, round(bm25, 6) AS s FROM bm), b2 AS (SELECT query_id, conv_id, turn, round(score, 6) AS s FROM lx),
h AS (SELECT query_id, conv_id || ':' || turn AS unit_id, 'bm25' AS branch, rank FROM ({top('b1', 's', 24, 'query_id, conv_id, turn')})
      UNION ALL SELECT query_id, conv_id || ':' || turn, 'direct', rank FROM ({top('b2', 's', 24, 'query_id, conv_id, turn')})),
fused AS (SELECT query_id, unit_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf_score, count(DISTINCT branch) AS branch_count, array_to_string(list_sort(list(DISTINCT branch)), ',') AS branches FROM h GROUP BY ALL)"""
ORACLES["rrf_fuse"] = f"WITH {RRF} SELECT * FROM fused"
ORACLES["dual_branch"] = f"WITH {RRF} SELECT query_id, count(*) FILTER (branches = 'bm25') AS bm25_only, count(*) FILTER (branches = 'direct') AS direct_only, count(*) FILTER (branch_count = 2) AS overlap FROM fused GROUP BY query_id"

# --- property graph

NODES = " UNION ALL ".join(
    f"SELECT '{t}:' || {k} AS node_id, {n} AS label, '{e}' AS entity_type FROM {t}"
    for t, k, n, e in (("region", "r_regionkey", "r_name", "place"), ("nation", "n_nationkey", "n_name", "place"), ("supplier", "s_suppkey", "s_name", "organization"), ("customer", "c_custkey", "c_name", "person"), ("part", "p_partkey", "p_name", "concept"))
)
EDGES = """SELECT *, source || '|' || relation_type || '|' || target AS edge_id FROM (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'part_of' AS relation_type, 1::BIGINT AS evidence_count FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 1 FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 1 FROM customer
  UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', count(*) FROM lineitem GROUP BY l_suppkey, l_partkey)"""
G = f"""nodes AS ({NODES}), edges AS ({EDGES}), ends AS (SELECT source AS node_id, target AS other, 'out' AS dir, relation_type, evidence_count FROM edges
  UNION ALL SELECT target, source, 'in', relation_type, evidence_count FROM edges), near AS (SELECT DISTINCT node_id, other FROM ends WHERE node_id <> other),
deg AS (SELECT node_id, count(dir) AS degree, coalesce(sum(evidence_count) FILTER (dir = 'out'), 0)::BIGINT AS weighted_degree FROM nodes LEFT JOIN ends USING (node_id) GROUP BY node_id)"""
ORACLES["graph_degrees"] = f"WITH {G} SELECT * FROM deg"


ORACLES["graph_projection_stats"] = f"""WITH {G} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM deg WHERE degree = 0) AS isolates, count(*) AS n_edges,
  count(*) FILTER (source = target) AS self_loops, 1 + (SELECT count(*) FROM deg WHERE degree = 0) AS weak_components, round(count(*) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 8) AS density FROM edges"""
ORACLES["graph_review_projection"] = f"WITH {G} SELECT edge_id, source, target, evidence_count FROM edges WHERE evidence_count >= 2 AND source IN (SELECT node_id FROM nodes WHERE entity_type <> 'person') AND target IN (SELECT node_id FROM nodes WHERE entity_type <> 'person')"
_down = "c0 AS (SELECT node_id, node_id AS c FROM nodes)" + "".join(f", c{k} AS (SELECT x.node_id, least(any_value(x.c), coalesce(min(y.c), any_value(x.c))) AS c FROM c{k - 1} x LEFT JOIN near ON near.node_id = x.node_id LEFT JOIN c{k - 1} y ON y.node_id = other GROUP BY x.node_id)" for k in range(1, 15))
ORACLES["graph_components"] = f"WITH {G}, {_down} SELECT node_id, c AS component FROM c14"  # customer, nation, region, nation, supplier, part and back: ten steps
_rank = ""
for _k in range(1, 6):
    _p = f"r{_k - 1}"
    _rank += f""", g{_k} AS (SELECT target AS node_id, sum(p * rank) AS got FROM share JOIN {_p} ON source = node_id GROUP BY target),
r{_k} AS (SELECT node_id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + lost / n) AS rank FROM {_p} LEFT JOIN g{_k} USING (node_id), cnt,
  (SELECT coalesce(sum(rank), 0) AS lost FROM {_p} WHERE node_id NOT IN (SELECT source FROM share)))"""
ORACLES["pagerank_fixed_iters"] = f"""WITH {G}, cnt AS (SELECT count(*)::DOUBLE AS n FROM nodes), wt AS (SELECT source, target, sum(evidence_count)::DOUBLE AS w FROM edges GROUP BY ALL),
share AS (SELECT source, target, w / sum(w) OVER (PARTITION BY source) AS p FROM wt), r0 AS (SELECT node_id, 1 / n AS rank FROM nodes, cnt){_rank}
SELECT node_id, round(rank, 8) AS rank FROM r5"""
ORACLES["ego_1hop"] = f"""WITH {G}, c AS (SELECT node_id AS center FROM deg ORDER BY degree DESC, node_id LIMIT 5),
m AS (SELECT center, other AS member FROM near JOIN c ON node_id = center UNION SELECT center, center FROM c),
e AS (SELECT a.center, count(*) AS n_edges FROM edges JOIN m a ON source = a.member JOIN m b ON target = b.member AND a.center = b.center GROUP BY a.center)
SELECT m.center, count(*) AS n_nodes, coalesce(any_value(n_edges), 0) AS n_edges FROM m LEFT JOIN e USING (center) GROUP BY m.center"""
ORACLES["node_jaccard"] = f"""WITH {G}, c AS (SELECT node_id FROM deg ORDER BY degree DESC, node_id LIMIT 12), s AS (SELECT node_id, other FROM near JOIN c USING (node_id)),
n AS (SELECT node_id, count(*) AS n FROM s GROUP BY node_id), p AS (SELECT x.node_id AS a, y.node_id AS b, count(*) AS common FROM s x JOIN s y ON x.other = y.other AND x.node_id < y.node_id GROUP BY ALL)
SELECT a, b, common, round(common / (na.n + nb.n - common), 6) AS jaccard FROM p JOIN n na ON na.node_id = a JOIN n nb ON nb.node_id = b"""
_layers = "seeds AS (SELECT node_id AS s FROM deg ORDER BY degree DESC, node_id LIMIT 8), p0 AS (SELECT s AS a, s AS pos, [s] AS path FROM seeds), v0 AS (SELECT a, pos FROM p0)" + "".join(
    f", p{k} AS (SELECT a, other AS pos, list_append(min(path), other) AS path FROM p{k - 1} JOIN near ON node_id = pos WHERE (a, other) NOT IN (SELECT (a, pos) FROM v{k - 1}) GROUP BY a, other), v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT a, pos FROM p{k})" for k in range(1, 5)
)
ORACLES["shortest_paths_4hop"] = f"""WITH {G}, {_layers}, r AS ({" UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, 5))})
SELECT a, pos AS b, array_to_string(path, '>') AS path, (len(path) - 1)::BIGINT AS hops FROM r WHERE a < pos AND pos IN (SELECT s FROM seeds)"""
ORACLES["hop_distances"] = f"""WITH {G}, d0 AS (SELECT node_id AS seed, node_id FROM nodes WHERE node_id LIKE 'region:%'),
d1 AS (SELECT DISTINCT seed, other AS node_id FROM d0 JOIN near USING (node_id)), d2 AS (SELECT DISTINCT seed, other AS node_id FROM d1 JOIN near USING (node_id)), d3 AS (SELECT DISTINCT seed, other AS node_id FROM d2 JOIN near USING (node_id)),
u AS (SELECT *, 0 AS h FROM d0 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3)
SELECT seed, node_id, min(h)::BIGINT AS hops FROM u GROUP BY ALL"""
ORACLES["node_profiles"] = f"""WITH {G}, t AS (SELECT node_id, relation_type, count(*) AS n, sum(evidence_count) AS e FROM ends GROUP BY ALL),
c AS (SELECT node_id, sum(n)::BIGINT AS degree, sum(e)::BIGINT AS evidence_count, count(*) AS relation_types, arg_min(relation_type, (-n, relation_type)) AS top_relation FROM t GROUP BY node_id)
SELECT node_id, label, entity_type, coalesce(degree, 0) AS degree, coalesce(evidence_count, 0) AS evidence_count, coalesce(relation_types, 0) AS relation_types, top_relation FROM nodes LEFT JOIN c USING (node_id)"""
ORACLES["relation_profiles"] = f"WITH {G} SELECT relation_type, count(*) AS n_edges, sum(evidence_count)::BIGINT AS evidence_count, arg_min(edge_id, (-evidence_count, edge_id)) AS best_edge, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM edges GROUP BY relation_type"
ORACLES["community_activation"] = f"""WITH {G}, m0 AS (SELECT source AS node_id, target AS community FROM edges WHERE relation_type = 'located_in'), m AS (SELECT * FROM m0 UNION ALL SELECT DISTINCT community, community FROM m0),
i AS (SELECT a.community, relation_type, evidence_count FROM edges JOIN m a ON source = a.node_id JOIN m b ON target = b.node_id WHERE a.community = b.community),
e AS (SELECT community, count(*) AS n_edges, least(sum(evidence_count), 30) AS ev, count(DISTINCT relation_type) AS types FROM i GROUP BY community), n AS (SELECT community, count(*) AS n_nodes FROM m GROUP BY community)
SELECT community, n_nodes, coalesce(n_edges, 0) AS n_edges, round(greatest(1.35::DOUBLE * coalesce(n_edges, 0) + 0.18::DOUBLE * coalesce(ev, 0) + 0.22::DOUBLE * n_nodes + 0.35::DOUBLE * coalesce(types / n_edges, 0), 0.1), 6) AS activation, 'clean_candidate' AS quality FROM n LEFT JOIN e USING (community)"""
_w = lambda c, k="_": f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9{k}]+'), lambda x: x <> '')"
_q = "['red', 'widget', 'supplies', 'nation', '7']"
_hits = lambda c: f"len(list_distinct(list_intersect({_w(c, '')}, {_q})))"

# --- consolidation

ORACLES["entity_groups"] = rf"""WITH c AS (SELECT p_partkey AS id, p_name AS label, CASE WHEN p_size > 45 THEN 'project' WHEN p_size < 3 THEN 'event' ELSE 'concept' END AS entity_type, {key('p_name', '-', "[''’]")} AS k FROM part),
l AS (SELECT k, label, count(*) AS n, min(id) AS f FROM c GROUP BY ALL), t AS (SELECT k, entity_type, count(*) AS n, min(id) AS f FROM c GROUP BY ALL),
g AS (SELECT k AS key, count(*) AS n_candidates, min(id) AS first_candidate, CASE WHEN count(DISTINCT entity_type) > 1 THEN 'review_required' ELSE 'merged' END AS merge_status FROM c WHERE k <> '' GROUP BY k),
x AS (SELECT g.*, (SELECT arg_min(label, (-n, f)) FROM l WHERE l.k = g.key) AS label, (SELECT arg_min(entity_type, (-n, f)) FROM t WHERE t.k = g.key) AS entity_type FROM g)
SELECT *, CASE WHEN merge_status = 'review_required' THEN 'review_required' WHEN entity_type IN ('project', 'event') AND n_candidates >= 2 THEN 'stable'
  WHEN entity_type = 'concept' AND len(regexp_split_to_array(label, '\s+')) >= 3 AND lower(label) = label THEN 'action_phrase' WHEN entity_type = 'concept' AND len(regexp_split_to_array(label, '\s+')) <= 2 THEN 'generic_fragment' ELSE 'candidate' END AS entity_quality_hint FROM x"""
ORACLES["edge_groups"] = "SELECT l_suppkey AS source, l_returnflag AS relation_type, l_partkey AS target, count(DISTINCT l_orderkey) AS evidence_count, count(*) AS n_rows, 1.0::DOUBLE AS weight FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL"
_sw = rf"list_filter(list_transform(regexp_extract_all(coalesce({{0}}, ''), '[0-9a-zA-Z\x{{{{4e00}}}}-\x{{{{9fff}}}}]+'), lambda x: lower(x)), lambda x: NOT regexp_full_match(x, '[0-9]+') AND (regexp_matches(x, '[\x{{{{4e00}}}}-\x{{{{9fff}}}}]') OR length(x) >= 3) AND x NOT IN ({_in(T.SCHEMA_STOPWORDS)}))"
ORACLES["quality_gate"] = f"""WITH {G}, l AS (SELECT count(DISTINCT edge_id) AS unresolved FROM edges WHERE source NOT IN (SELECT node_id FROM nodes) OR target NOT IN (SELECT node_id FROM nodes))
SELECT (SELECT count(*) FROM nodes) AS n_nodes, count(*) AS n_edges, 0::BIGINT AS missing_evidence, 0::BIGINT AS generic, any_value(unresolved) AS unresolved, 0.0::DOUBLE AS generic_ratio, CASE WHEN any_value(unresolved) > 0 THEN 'blocked' ELSE 'pass' END AS status FROM edges, l"""

# --- routing

_clamp = lambda x: f"round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, {x})) + 1e-9::DOUBLE, 3)"
_wb = " || ".join(["' '", "replace(regexp_replace(lower({0}), '[^a-z0-9_]', ' ', 'g'), ' ', '  ')", "' '"])
ORACLES["route_salience"] = rf"""WITH t AS (SELECT conv_id, turn, {TXT} AS x, {ROUGH} AS n, {SENT} AS s, ' ' || replace(regexp_replace(lower({TXT}), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' ', '  ') || ' ' AS low,
  len(list_slice(list_sort(list_distinct(regexp_extract_all({TXT}, '[A-Z][a-z]+(?: [A-Z][a-z]+){{0,3}}'))), 1, 20)) AS names, len(list_distinct(list_filter({WORDS}, lambda w: length(w) >= 8))) AS long_ FROM conversations),
a AS (SELECT conv_id, turn, {_clamp('names * 1.2::DOUBLE')} AS entity, {_clamp('long_ * 0.8::DOUBLE')} AS keyphrase, {_clamp('long_ * 0.4::DOUBLE + names * 0.4::DOUBLE')} AS domain,
  {_clamp("len(regexp_extract_all(x, '!')) * 2.0::DOUBLE")} AS affect, {_clamp("len(regexp_extract_all(low, ' (not|never|no|risk|wrong|stop) ')) * 2.5::DOUBLE")} AS risk, {_clamp('n / 12.0::DOUBLE + s * 0.4::DOUBLE')} AS complexity,
  CASE WHEN n = 0 THEN 10.0 WHEN n <= 2 AND names = 0 THEN 8.0 WHEN n <= 3 AND names = 0 THEN 5.5 ELSE 0.0 END::DOUBLE AS low, {_clamp('long_ * 0.5::DOUBLE + names * 0.3::DOUBLE + least(n / 10.0::DOUBLE, 4.0)')} AS value FROM t),
u AS (SELECT *, 0.944::DOUBLE * value + 1.366::DOUBLE * entity + 1.015::DOUBLE * domain + 0.567::DOUBLE * keyphrase + 0.226::DOUBLE * affect AS useful, 0.766::DOUBLE * risk + 0.558::DOUBLE * complexity AS stress FROM a)
SELECT conv_id, turn, value, entity, keyphrase, risk, complexity, low, CASE WHEN low >= 5.869 AND useful < 2.582 THEN 'skip' WHEN useful < 2.217 AND low >= 3.439 THEN 'skip' WHEN useful >= 7.975 AND (stress >= 6.169 OR risk >= 5.104) THEN 'strong'
  WHEN useful >= 3.417 AND (stress >= 4.856 OR risk >= 3.526) THEN 'weak' WHEN useful >= 3.007 THEN 'script' ELSE 'skip' END AS route FROM u"""
MOCK = f"""CASE WHEN contains(lower({TXT}), 'human review') THEN 'needs_human_review' WHEN regexp_matches(lower({TXT}), 'uncertain|ambiguous') THEN 'model_uncertain'
  WHEN regexp_matches(lower({TXT}), 'hello|thanks|thank you') AND NOT regexp_matches(lower({TXT}), '{routing.VALUE_WORDS}') THEN 'reject' WHEN regexp_matches(lower({TXT}), '{routing.PROCEDURE}') THEN 'procedural'
  WHEN regexp_matches(lower({TXT}), '{routing.VALUE_WORDS}') THEN 'semantic' WHEN regexp_matches(lower({TXT}), '{routing.EPISODE}') THEN 'episodic' ELSE 'reject' END"""
ORACLES["mock_proposals"] = f"SELECT conv_id, turn, {MOCK} AS proposal FROM conversations"
_frac = lambda k, seed: f"({_num(f'sha256({chr(39)}{seed}:{chr(39)} || {k})', 1, 8)})::DOUBLE / 4294967296"
ORACLES["review_pools"] = f"""WITH ev AS ({EVIDENCE}), k AS (SELECT *, {MOCK} AS kind FROM ev),
p AS (SELECT CASE WHEN kind IN ('semantic', 'procedural') THEN CASE WHEN subject_role = 'target' THEN 'fact_promotion_review_queue' ELSE 'uncertain_pool' END WHEN kind = 'episodic' THEN CASE WHEN length(text) > 80 THEN 'hypothesis_pool_candidates' ELSE 'uncertain_pool' END
  WHEN kind IN ('model_uncertain', 'needs_human_review') THEN 'uncertain_pool' WHEN kind = 'reject' THEN CASE WHEN {_frac('evidence_ref', 'audit')} < 0.1 THEN 'reject_audit_sample' ELSE 'rejected' END ELSE 'schema_unknown_pool' END AS pool FROM k)
SELECT pool, count(*) AS n FROM p GROUP BY pool"""
ORACLES["hash_split"] = f"SELECT doc_id, CASE WHEN {_frac('doc_id', 'split')} < 0.8 THEN 'train' ELSE 'held_out' END AS part FROM documents"
_grid = ", ".join(f"({float(a)}::DOUBLE, {float(b)}::DOUBLE)" for a in (1, 2, 4, 8, 16) for b in (2, 4, 8, 16, 32) if a <= b)
ORACLES["policy_grid"] = f"""WITH r AS (SELECT {SENT} AS s, quality AS y FROM documents JOIN labels USING (doc_id)), g(floor, ceiling) AS (VALUES {_grid}),
p AS (SELECT floor, ceiling, y, CASE WHEN s >= ceiling THEN 1 WHEN s < floor THEN 0 ELSE -1 END AS pred FROM r, g)
SELECT floor, ceiling, round(sum((pred = y)::INT) / count(*), 6) AS exact, round(sum(CASE WHEN pred = y THEN 0 WHEN pred = -1 THEN 0.5::DOUBLE ELSE 1 END) / count(*), 6) AS penalty FROM p GROUP BY ALL"""

# --- incremental maintenance

OPS = """ops AS (SELECT event_id, ts, 'op:' || user_id || ':' || event_type AS operation_id, event_type AS operation_type,
  (['planned', 'running', 'completed', 'failed', 'superseded'])[(json_extract(props, '$.k')::INT % 5) + 1] AS status, value FROM events),
last AS (SELECT operation_id, count(*) AS n_rows, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(operation_type, (ts, event_id)) AS operation_type, arg_max(status, (ts, event_id)) AS status FROM ops GROUP BY operation_id)"""
ORACLES["op_status_latest"] = f"WITH {OPS} SELECT * FROM last"
ORACLES["latest_view"] = f"""WITH {OPS}, hit AS (SELECT DISTINCT operation_id FROM ops WHERE value > 90)
SELECT operation_id, CASE WHEN status IN ({_in(maintain.INACTIVE)}) THEN 'excluded' WHEN h.operation_id IS NOT NULL THEN 'stale' ELSE 'active' END AS view_status,
  CASE WHEN status IN ({_in(maintain.INACTIVE)}) THEN 'inactive_status' WHEN h.operation_id IS NOT NULL THEN 'impact:review' ELSE 'current' END AS view_reason FROM last LEFT JOIN hit h USING (operation_id)"""
ORACLES["overlay_merge"] = """SELECT o_orderkey, o_orderstatus, o_totalprice, 'base' AS origin FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, 'F', o_totalprice, 'increment' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 2 = 0"""
ORACLES["change_detect"] = """SELECT o_orderkey, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' WHEN a <> b THEN 'changed' ELSE 'same' END AS change FROM
(SELECT o_orderkey, o_orderstatus || '|' || o_custkey AS b FROM orders WHERE o_orderkey % 5 <> 0) FULL JOIN
(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Z' ELSE o_orderstatus END || '|' || o_custkey AS a FROM orders WHERE o_orderkey % 3 <> 0) USING (o_orderkey)"""
ORACLES["rebuild_compare"] = f"SELECT change, count(*) AS n FROM ({ORACLES['change_detect']}) GROUP BY change"
ORACLES["add_only_batch"] = """WITH b AS (SELECT l_orderkey * 2 AS o_orderkey, l_partkey AS o_custkey, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
m AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders) THEN 'id_already_registered' WHEN n > 1 THEN 'id_repeated_in_batch' END AS reject_reason FROM b)
SELECT * FROM m WHERE reject_reason IS NOT NULL"""
ORACLES["dependency_reverse_index"] = """SELECT dim, ref, count(DISTINCT unit) AS n_units, min(unit) AS first_unit FROM (
  SELECT 'part' AS dim, l_partkey::VARCHAR AS ref, l_orderkey AS unit FROM lineitem UNION ALL SELECT 'supplier', l_suppkey::VARCHAR, l_orderkey FROM lineitem UNION ALL SELECT 'flag', l_returnflag, l_orderkey FROM lineitem) WHERE ref IS NOT NULL GROUP BY ALL"""
ORACLES["impact"] = EV + """, hit AS (SELECT * FROM ev WHERE conv_id % 10 = 3 OR (turn = 0 AND conv_id % 10 = 4))
SELECT 'evidence' AS layer, evidence_ref AS unit_id, 'rebuild' AS action FROM hit UNION ALL SELECT 'memory', 'memory:' || substr(sha256(evidence_ref), 1, 16), 'mark_stale' FROM hit"""
CMP = f"""ev AS ({EVIDENCE}), u AS (SELECT evidence_ref AS id, source_id, turn, text, {delta_tokens('text')} AS w FROM ev WHERE subject_role = 'target'),
tf AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest(w) AS t FROM u) GROUP BY ALL), nm AS (SELECT id, sqrt(sum(c * c)) AS nrm, count(*) AS k FROM tf GROUP BY id),
dots AS (SELECT a.id AS new_id, b.id AS old_id, sum(a.c * b.c) AS dot, count(*) AS common FROM tf a JOIN tf b USING (t) JOIN u ua ON ua.id = a.id JOIN u ub ON ub.id = b.id WHERE ua.turn >= 2 AND ub.turn < 2 GROUP BY ALL),
m AS (SELECT new_id, old_id, common / (x.k + y.k - common) AS jac, dot / (x.nrm * y.nrm) AS cos, ua.text = ub.text AS exact, ua.source_id = ub.source_id AS src FROM dots JOIN nm x ON x.id = new_id JOIN nm y ON y.id = old_id JOIN u ua ON ua.id = new_id JOIN u ub ON ub.id = old_id),
s AS (SELECT *, CASE WHEN exact THEN 1.0 ELSE greatest(jac, cos) END::DOUBLE AS base FROM m),
sc AS (SELECT *, round(CASE WHEN src THEN greatest(base, least(0.9::DOUBLE, base + 0.12::DOUBLE)) ELSE greatest(base, least(0.8::DOUBLE, base + 0.05::DOUBLE)) END, 6) AS score FROM s)"""
ORACLES["s1_matches"] = f"WITH {CMP} SELECT new_id, old_id, round(jac, 6) AS jaccard, round(cos, 6) AS cosine, score FROM sc"
DELTA = f"""{CMP}, b AS (SELECT new_id, arg_min(old_id, (-score, old_id)) AS best_match, max(score) AS score FROM sc GROUP BY new_id),
dl AS (SELECT u.id AS new_id, best_match, b.score, CASE WHEN best_match IS NULL THEN 'new_unit' WHEN b.score >= 0.82 THEN 'duplicate_candidate' WHEN b.score >= 0.55 THEN 'needs_review' ELSE 'new_unit' END AS delta_type, u.source_id FROM u LEFT JOIN b ON b.new_id = u.id WHERE u.turn >= 2)"""
ORACLES["s1_delta"] = f"WITH {DELTA} SELECT new_id, best_match, score, delta_type FROM dl"
ORACLES["s2_affected"] = f"""WITH {DELTA} SELECT DISTINCT dl.new_id, o.id AS unit_id, 'evidence' AS hit, CASE delta_type WHEN 'new_unit' THEN 'updates_profile' WHEN 'duplicate_candidate' THEN 'duplicate_candidate' ELSE 'needs_review' END AS s2_signal,
  CASE delta_type WHEN 'new_unit' THEN 'new_edge_candidate' ELSE 'needs_review' END AS graph_signal FROM dl JOIN u o ON o.source_id = dl.source_id AND o.turn < 2"""
ORACLES["overlap_measures"] = EV + f""", n AS (SELECT evidence_ref, list_distinct({delta_tokens('text')}) AS a, list_distinct({delta_tokens('nxt')}) AS b FROM (SELECT *, lead(text) OVER (PARTITION BY source_id ORDER BY turn) AS nxt FROM ev) WHERE nxt IS NOT NULL)
SELECT evidence_ref, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 6) AS overlap,
  round(CASE WHEN len(a) + len(b) - len(list_intersect(a, b)) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END, 6) AS jaccard FROM n"""
ORACLES["stream_latest_view"] = "SELECT user_id, event_type, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY ALL"
ORACLES["paragraph_units"] = ""
del ORACLES["paragraph_units"]
