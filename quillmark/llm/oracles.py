"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import near_dedup, url_filter

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _term(term: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INT"


def _url_filter() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda pick: " ".join(f"WHEN {fits(*r[:2])} THEN '{pick(r)}'" for r in rules)
    strict = " + ".join(_term(t) for t in url_filter.STRICT)
    soft = " + ".join(_term(t) for t in url_filter.SOFT)
    weight = " + ".join(f"{w} * {_term(t)}" for t, w in {**url_filter.STRICT, **url_filter.SOFT}.items())
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), hits AS (
  SELECT *, {strict} AS s, {soft} AS f, {weight} AS w, CASE {case(lambda r: r[0] + r[1])} END AS rule,
         CASE {case(lambda r: r[2])} END AS ruled
  FROM parts
)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN s > 0 OR f >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       s::BIGINT AS strict_hits, f::BIGINT AS soft_hits, w::DOUBLE AS weight
FROM hits"""


_NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= {near_dedup.PERCENT} * (na + nb - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT walk.doc_id, b FROM walk JOIN both_ways ON seen = a),
c AS (SELECT doc_id, min(seen) AS component_id FROM walk GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM s JOIN c USING (doc_id)"""

#: CRC-32 of a text by its table, which the eight shifts of the polynomial 0xEDB88320 give.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


_COHORT = f"""
WITH crc AS ({_CRC_TABLE}),
h AS (SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props, {_crc("click_id::VARCHAR")} AS h
      FROM clicks, crc WHERE ts IS NOT NULL AND client_id IS NOT NULL),
known AS (SELECT *, arrived_at + CASE WHEN h % 3 = 0 THEN to_days((h % 100)::INT) ELSE to_days(0) END AS arrives FROM h),
states AS (SELECT 0 AS state, * FROM known WHERE arrives < TIMESTAMP '2024-03-01 00:00:00' UNION ALL SELECT 1, * FROM known),
starts AS (SELECT state, client_id, min(ts) AS start FROM states WHERE kind = 'purchase' GROUP BY ALL),
cohorts AS (SELECT *, epoch_us(start) // 86400000000 // 3 AS cohort FROM starts),
both_ways AS (SELECT client_id, min(cohort) <> max(cohort) AS moved FROM cohorts GROUP BY client_id),
users AS (
  SELECT state, client_id, cohort, (epoch_us(ts) - epoch_us(start)) // 259200000000 AS period,
         sum(coalesce(floor(100 * value + 0.5), 0)::BIGINT) AS cents
  FROM states JOIN cohorts USING (state, client_id) WHERE ts >= start GROUP BY ALL)
SELECT state::INT AS state, coalesce(city, '') AS segment, cohort, period, count(*) AS users,
       sum({_crc("client_id::VARCHAR")})::BIGINT AS users_crc32, sum(moved::INT)::BIGINT AS moved, sum(cents)::BIGINT AS cents
FROM users JOIN both_ways USING (client_id) LEFT JOIN clients USING (client_id), crc
GROUP BY ALL"""

_CHAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, replace(replace(role, '\', '\b'), '<', '\l') AS r, replace(replace(text, '\', '\b'), '<', '\l') AS t,
         role IS DISTINCT FROM lag(role) OVER w AS head,
         length(role) + len(regexp_extract_all(role, '[\\<]')) AS role_n, length(text) + len(regexp_extract_all(text, '[\\<]')) AS text_n
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, replace(replace(role, '\', '\b'), '<', '\l'), replace(replace(text, '\', '\b'), '<', '\l'))
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_n + CASE WHEN head THEN role_n + 6 + 6 + 8 ELSE 6 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""

_TERMS = r"regexp_extract_all(translate({text}, '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(text="text")} AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
i AS (SELECT DISTINCT item_id, unnest({_TERMS.format(text="text")}) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term),
scores AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN n USING (r), totals GROUP BY item_id, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50"""

ORACLES = {"op13_lexical_search": _LEXICAL, "op12_chat": _CHAT, "op4_url_filter": _url_filter(), "op5_near_dedup": _NEAR, "op11_retention": _COHORT}
