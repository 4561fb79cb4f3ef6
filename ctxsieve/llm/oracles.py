"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_OP5_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _escaped(text: str) -> str:
    return rf"replace(replace(replace(replace({text}, '\', '\e'), '###', '\h'), '<|next|>', '\n'), '</turn>', '\t')"


ORACLES: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_BLANK.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op2_chat_format": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || E'\n' || text || E'\n', '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped("text")}) + CASE WHEN before = role THEN 8 ELSE 14 + length(replace({_escaped("role")}, ':', '\c')) END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id""",
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, {_OP5_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_OP5_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + 9], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM i),
s AS (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d JOIN lengths ON len(d.w) >= k)),
hit AS (SELECT doc_id, s, s.k, item_id FROM s JOIN i ON s.k = i.k AND s.t = i.t),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK.format(_LOWERED)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s : s + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (h) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS to_ FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.to_),
comp AS (SELECT doc_id, min(to_) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
