"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

from ..config import CACHE_READ, CACHE_WRITE, DROP_MARKER, TIER_KEEP, SelectionConfig, keep_ratio
from ..operators.admission import ADMITTED_TOOLS, KEEPS
from ..operators.sweep import MARKERS

_TOKEN = "[぀-ヿ㐀-䶿一-鿿豈-﫿]|[\\pL\\pN]+"
_PINS = r"(?i)(^|[^\pL\pN_])(must|never|do not|don''t|shall not|prohibited|required|only if|PII|HIPAA|PCI|SSN|password|secret|api[_ ]?key)($|[^\pL\pN_])"
_MARKER = DROP_MARKER.replace("'", "''")
_WHITE = "E' \\n\\t\\r'"


def _sentences(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(trim({text}, {_WHITE}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def _letters(text: str) -> str:
    return f"list_transform(range(26), lambda i: (length(lower({text})) - length(replace(lower({text}), chr((97 + i)::INT), '')))::DOUBLE)"


_DOCUMENT_BLOCKS = """SELECT d.doc_id AS block_id, d.text, b.text AS query FROM documents d
  JOIN benchmark b ON b.item_id = d.doc_id % (SELECT greatest(1, count(*)) FROM benchmark)"""


def _chunked(blocks: str = _DOCUMENT_BLOCKS, least: int = 800, chunks: str = "") -> str:
    """``blk`` of all blocks, ``chn`` of those that pass the gates."""
    return f"""blk AS ({blocks}),
chn AS (SELECT *, len(chunks) AS n FROM (SELECT block_id, text, query, {chunks or _sentences("text")} AS chunks FROM blk WHERE length(text) >= {least}) WHERE len(chunks) >= 4),
rare AS (SELECT block_id, list_filter(list_distinct(list_filter(regexp_extract_all(lower(query), '{_TOKEN}'), lambda t: length(t) >= 4)),
  lambda t: len(list_filter(chunks, lambda c: contains(lower(c), t))) BETWEEN 1 AND 2) AS rare FROM chn)"""


_SCORED = f"""tok AS (SELECT block_id, n, idx, len(toks) AS length, unnest(toks) AS token FROM (
  SELECT block_id, n, idx, regexp_extract_all(lower(chunk), '{_TOKEN}') AS toks FROM (
    SELECT block_id, n, unnest(list_append(chunks, query)) AS chunk, unnest(range(n + 1)) AS idx FROM chn))),
cnt AS (SELECT block_id, n, idx, length, token, count(*) AS c FROM tok GROUP BY ALL),
tw AS (SELECT block_id, n, idx, token, tf, df, tf * ln((n + 2)::DOUBLE / df) AS w FROM (
  SELECT *, c::DOUBLE / length AS tf, count(*) OVER (PARTITION BY block_id, token) AS df FROM cnt)),
q AS (SELECT block_id, token, w AS qw FROM tw WHERE idx = n),
s AS (SELECT t.block_id, t.n, t.idx, sum(t.w * coalesce(q.qw, 0)) AS dot, sum(t.w * t.w) AS norm FROM tw t LEFT JOIN q USING (block_id, token) GROUP BY ALL),
qn AS (SELECT block_id, norm AS q_norm FROM s WHERE idx = n),
sc AS (SELECT s.block_id, s.idx, round(CASE WHEN norm > 0 AND q_norm > 0 THEN dot / (sqrt(norm) * sqrt(q_norm)) ELSE 0 END, 12) AS score
  FROM s LEFT JOIN qn USING (block_id) WHERE idx < n),
sd AS (SELECT c.block_id, c.n, c.idx, c.chunk, coalesce(sc.score, 0) AS score,
  regexp_matches(c.chunk, '{_PINS}') OR len(list_filter(rare.rare, lambda e: contains(lower(c.chunk), e))) > 0 AS pinned
  FROM (SELECT block_id, n, unnest(chunks) AS chunk, unnest(range(n)) AS idx FROM chn) c LEFT JOIN sc USING (block_id, idx) JOIN rare USING (block_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY score DESC, idx) AS rn, max(score) OVER (PARTITION BY block_id) AS top FROM sd)"""


def _budget(keep: str) -> str:
    return f"greatest(1, least(n, round_even(n * ({keep})::DOUBLE, 0)::INT))"


def _decided(keeps: tuple[float, ...] = (0.6,)) -> str:
    """``kp`` with ``keep`` and ``kept``; ``built`` of the blocks that lose a chunk."""
    grid = ", ".join(f"({k}::DOUBLE)" for k in keeps)
    return f"""kp AS (SELECT *, (rn <= {_budget("keep")} OR pinned OR idx IN (0, n - 1)) AND
  (score >= CASE WHEN top > 0 THEN top * 0.35 ELSE 0 END OR pinned OR idx IN (0, n - 1)) AS kept FROM rk CROSS JOIN (VALUES {grid}) g(keep)),
isl AS (SELECT *, sum(kept::INT) OVER (PARTITION BY keep, block_id ORDER BY idx) AS island FROM kp),
run AS (SELECT keep, block_id, island, count(*) AS length, min(idx) AS start FROM isl WHERE NOT kept GROUP BY ALL),
pieces AS (SELECT keep, block_id, idx, chunk AS piece FROM kp WHERE kept
  UNION ALL SELECT keep, block_id, start, replace('{_MARKER}', '{{n}}', length::VARCHAR) FROM run),
texts AS (SELECT keep, block_id, string_agg(piece, E'\\n\\n' ORDER BY idx) AS new_text FROM pieces GROUP BY ALL),
sizes AS (SELECT keep, block_id, n, count(*) FILTER (kept) AS kept FROM kp GROUP BY ALL),
built AS (SELECT * FROM sizes JOIN texts USING (keep, block_id) WHERE kept < n),
done AS (SELECT blk.*, sizes.n, sizes.kept, built.new_text IS NOT NULL AS changed, coalesce(built.new_text, blk.text) AS new_text
  FROM blk LEFT JOIN sizes USING (block_id) LEFT JOIN built USING (block_id))"""


_CHUNKS = f"WITH {_chunked()}"
_SCORES = f"{_CHUNKS}, {_SCORED}"
_DONE = f"{_SCORES}, {_decided()}"

_CONV = """conv AS (SELECT conv_id, turn AS msg_idx, role, text AS content,
  max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last_user_idx FROM conversations),
asked AS (SELECT conv_id, arg_max(content, msg_idx) AS query FROM conv WHERE role = 'user' AND trim(content, E' \\n\\t\\r') <> '' GROUP BY conv_id),
routed AS (SELECT conv.*, query, coalesce(role IN ('user', 'assistant') AND length(content) >= 200 AND msg_idx IS DISTINCT FROM last_user_idx AND query IS NOT NULL, false) AS selectable
  FROM conv LEFT JOIN asked USING (conv_id))"""
_CONV_DONE = f"""WITH {_CONV}, {_chunked("SELECT conv_id || ':' || msg_idx AS block_id, content AS text, query FROM routed WHERE selectable", 200)},
{_SCORED}, {_decided((0.5,))},
trimmed AS (SELECT r.conv_id, r.msg_idx, r.content, coalesce(d.new_text, r.content) AS new_content, coalesce(d.changed, false) AS changed, d.n - d.kept AS dropped
  FROM routed r LEFT JOIN done d ON d.block_id = r.conv_id || ':' || r.msg_idx)"""

_EVENTS = """ev AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id, event_type, (props::JSON->>'$.k')::INT AS k
  FROM events WHERE event_type IN ('view', 'purchase', 'click'))"""


def _less(reason: str) -> str:
    return f"(length(body) // 4 - {len(MARKERS[reason].replace('{path}', 'f0')) // 4})"


_DOCSETS = """ds AS (SELECT d.doc_id // 10 AS set_id, d.doc_id % 10 AS pos, d.text, b.text AS query FROM documents d
  JOIN benchmark b ON b.item_id = (d.doc_id // 10) % (SELECT greatest(1, count(*)) FROM benchmark) WHERE length(d.text) > 0),
sets AS (SELECT set_id AS block_id, string_agg(text, E'\\n\\n' ORDER BY pos) AS text, any_value(query) AS query, list(trim(text, E' \\n\\t\\r') ORDER BY pos) AS parts, list(pos ORDER BY pos) AS places
  FROM ds GROUP BY set_id)"""
_DOCSETS_DONE = f"""WITH {_DOCSETS}, {_chunked("SELECT * FROM sets WHERE len(parts) >= 2", 800, "parts").replace("SELECT block_id, text, query, parts AS chunks", "SELECT block_id, text, query, parts AS chunks, places")},
{_SCORED}, {_decided((0.5,))},
flags AS (SELECT ds.set_id, ds.pos, ds.text, coalesce(f.kept, true) AS kept FROM ds LEFT JOIN (
  SELECT kp.block_id AS set_id, chn.places[kp.idx + 1] AS pos, kp.kept FROM kp JOIN chn USING (block_id)) f USING (set_id, pos))"""

_POOL = "pool AS (SELECT 't' || doc_id AS title, text FROM (SELECT doc_id, text FROM documents WHERE length(text) > 0 ORDER BY doc_id LIMIT 3000))"
_OWN = "own AS (SELECT text AS question, 't' || item_id AS title, text FROM benchmark)"
_PADDED = f"""WITH {_POOL}, {_OWN}, base AS (SELECT question, sum((length(title) + 2 + length(text)) // 4) AS base FROM own GROUP BY question),
ring AS (SELECT title, text, row_number() OVER (ORDER BY title, text) - 1 AS spot, count(*) OVER () AS size FROM pool),
free AS (SELECT base.question, base, ring.title, ring.text, (spot - ('0x' || substr(md5(base.question), 1, 8))::BIGINT % size + size) % size AS far, (length(ring.title) + 2 + length(ring.text)) // 4 AS cost FROM base CROSS JOIN ring
  WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.question = base.question AND own.title = ring.title)),
walk AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY question ORDER BY far ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  row_number() OVER (PARTITION BY question ORDER BY far) AS nth FROM free),
padded AS (SELECT question, 0 AS pos, title, text FROM own UNION ALL SELECT question, nth + 100000, title, text FROM walk WHERE base + used < 4000)"""

_PAIRS = """WITH pairs AS (SELECT l.doc_id, length(d.text) // 4 AS tokens_full, length(d.text) * 3 // 20 AS tokens_selected, 2 AS gold_total, l.quality + 1 AS gold_kept,
  l.quality = 1 AS a, l.toxic = 0 AS b, l.quality = 1 AND l.toxic = 1 AS worse FROM (SELECT DISTINCT ON (doc_id) * FROM labels) l JOIN documents d USING (doc_id))"""

_TOOLS = ", ".join(f"'{t}'" for t in ADMITTED_TOOLS)
_OUTPUTS = """outs AS (SELECT d.doc_id AS block_id, d.doc_id % 9 AS session, CASE WHEN d.doc_id % 5 = 0 THEN 'Write' ELSE 'Read' END AS tool,
  CASE WHEN d.doc_id % 7 = 0 THEN '{' || d.text ELSE d.text END AS text, b.text || E'\\npage' AS query
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT greatest(1, count(*)) FROM benchmark))"""
_FIT = f"tool IN ({_TOOLS}) AND length(text) >= 800 AND substr(ltrim(text, E' \\n\\t\\r'), 1, 1) NOT IN ('{{', '[')"


def _outputs(keeps: tuple[float, ...]) -> str:
    return f"WITH {_OUTPUTS}, {_chunked(f'SELECT block_id, text, query, session FROM outs WHERE {_FIT}')}, {_SCORED}, {_decided(keeps)}"


_REPLAY = f"""{_outputs(KEEPS)},
grid AS (SELECT blk.session, g.keep, blk.text, built.new_text FROM blk CROSS JOIN (VALUES {", ".join(f"({k}::DOUBLE)" for k in KEEPS)}) g(keep) LEFT JOIN built USING (keep, block_id)),
sess AS (SELECT session, keep, sum(length(text) // 4) AS eligible_tokens, count(*) FILTER (length(new_text) < length(text)) AS fired,
  coalesce(sum(CASE WHEN length(new_text) < length(text) THEN greatest(0, length(text) // 4 - length(new_text) // 4) END), 0) AS removed FROM grid GROUP BY ALL)"""

_TIERS = ", ".join(f"('{t}', {k}::DOUBLE)" for t, k in [(t, keep_ratio(SelectionConfig(), t)) for t in (*TIER_KEEP, "unknown")] + [("complexity", keep_ratio(SelectionConfig(), None, 0.9))])

ORACLES: dict[str, str] = {
    "chunk_sentences": f"SELECT doc_id, unnest(c) AS chunk, unnest(range(len(c))) AS idx FROM (SELECT doc_id, {_sentences('text')} AS c FROM documents)",
    "chunk_delimited": "SELECT item_id // 8 AS set_id, (row_number() OVER (PARTITION BY item_id // 8 ORDER BY item_id)) - 1 AS idx, '[' || (item_id % 8 + 1) || '] ' || rtrim(text, E' \\n\\t\\r') AS chunk FROM benchmark",
    "chunk_line_windows": """SELECT doc_id, unnest(range(len(w))) AS idx, unnest(w) AS chunk FROM (SELECT doc_id, list_transform(range(0, len(l), greatest(1, len(l) // 12)),
  lambda i: array_to_string(l[i + 1 : i + greatest(1, len(l) // 12)], E'\\n')) AS w FROM (SELECT doc_id, string_split(text, E'\\n') AS l FROM documents))""",
    "tokenize_counts": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_TOKEN}') AS t FROM documents)",
    "block_idf": f"{_SCORES} SELECT block_id, token, round(tf, 9) AS tf, df, round(w, 9) AS w FROM tw WHERE idx = n",
    "lexical_scores": f"{_SCORES} SELECT block_id, idx, round(score, 9) AS score FROM sc",
    "pinned_chunks": f"""SELECT doc_id, idx FROM (SELECT doc_id, unnest(c) AS chunk, unnest(range(len(c))) AS idx FROM (SELECT doc_id, {_sentences('text')} AS c FROM documents))
WHERE regexp_matches(chunk, '(?i)licen[sc]e') OR regexp_matches(chunk, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+') OR regexp_matches(chunk, '(?i)(token|password|secret)\\s*=')""",
    "pinned_default": f"""SELECT doc_id, idx, regexp_matches(CASE doc_id % 3 WHEN 0 THEN 'You Must not. ' WHEN 1 THEN 'mustard api_key ' ELSE '' END || chunk, '{_PINS}') AS pinned
FROM (SELECT doc_id, unnest(c) AS chunk, unnest(range(len(c))) AS idx FROM (SELECT doc_id, {_sentences('text')} AS c FROM documents))""",
    "rare_entities": f"{_CHUNKS} SELECT block_id, array_to_string(list_sort(rare), ',') AS rare FROM rare",
    "budget_topk": f"{_SCORES} SELECT block_id, idx, rn FROM rk WHERE rn <= {_budget('0.6')}",
    "select_flagship": f"{_DONE} SELECT block_id, n, kept, changed, md5(new_text) AS text_md5 FROM done",
    "dropped_runs": f"{_DONE} SELECT block_id, start, length FROM run",
    "selection_stats": f"""{_DONE} SELECT count(*) AS blocks, sum(n)::BIGINT AS chunks_in, sum(kept)::BIGINT AS chunks_kept, sum(length(text))::BIGINT AS chars_in, sum(length(new_text))::BIGINT AS chars_out,
  sum(length(text) // 4 - length(new_text) // 4)::BIGINT AS tokens_saved FROM done WHERE changed""",
    "tokens_saved": f"{_DONE} SELECT block_id, length(text) // 4 - length(new_text) // 4 AS tokens_saved FROM done",
    "marker_accounting": f"{_DONE} SELECT block_id, sum(length)::BIGINT AS dropped, count(*) AS runs FROM run GROUP BY block_id",
    "keep_sweep": f"""{_SCORES}, {_decided(KEEPS)} SELECT keep, count(*) AS blocks, sum(n)::BIGINT AS chunks_in, sum(kept)::BIGINT AS chunks_kept, round(median(100.0::DOUBLE * (n - kept) / n), 6) AS median_pct
FROM sizes GROUP BY keep""",
    "tier_keep": f"{_CHUNKS} SELECT tier, keep, sum({_budget('keep')})::BIGINT AS chunks_kept FROM chn CROSS JOIN (VALUES {_TIERS}) t(tier, keep) GROUP BY ALL",
    "conv_route": f"WITH {_CONV} SELECT conv_id, msg_idx, last_user_idx, md5(query) AS query_md5, selectable FROM routed",
    "conv_trim": f"{_CONV_DONE} SELECT conv_id, msg_idx, changed, md5(new_content) AS content_md5 FROM trimmed",
    "conv_trim_summary": f"""{_CONV_DONE} SELECT conv_id, sum(length(content) // 4 - length(new_content) // 4)::BIGINT AS tokens_saved,
  coalesce(sum(CASE WHEN changed THEN dropped END), 0)::BIGINT AS chunks_dropped, bool_or(changed) AS changed FROM trimmed GROUP BY conv_id""",
    "freeze_first_sight": "SELECT doc_id AS turn, substr(md5(text), 1, 12) AS block_key, row_number() OVER (PARTITION BY substr(md5(text), 1, 12) ORDER BY doc_id) = 1 AS is_first FROM documents",
    "freeze_decisions": f"""{_DONE} SELECT b.block_id AS turn, f.changed, md5(f.new_text) AS text_md5 FROM blk b JOIN (
  SELECT DISTINCT ON (text) * FROM done ORDER BY text, block_id) f ON f.text = b.text""",
    "duplicate_payloads": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE length(text) >= 400) WHERE rn > 1",
    "sweep_edits": f"""WITH {_EVENTS}, p AS (SELECT conv_id, ord * 2 AS ord, event_type, 'f' || k % 7 AS path, repeat(k % 10 || 'x', (300 + 10 * k) // 2) AS body FROM ev),
w AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ord END) OVER (PARTITION BY conv_id, path) AS written,
  max(CASE WHEN event_type IN ('purchase', 'click') THEN ord END) OVER (PARTITION BY conv_id, path) AS touched,
  row_number() OVER (PARTITION BY conv_id, event_type = 'view' AND length(body) >= 400, body ORDER BY ord) AS copy FROM p),
r AS (SELECT *, CASE WHEN length(body) < 400 THEN NULL WHEN event_type <> 'view' AND written > ord THEN 'superseded' WHEN event_type = 'view' AND copy > 1 THEN 'duplicate'
  WHEN event_type = 'view' AND touched > ord THEN 'stale' END AS reason FROM w)
SELECT conv_id, ord, reason, CASE reason WHEN 'superseded' THEN {_less("superseded")} WHEN 'duplicate' THEN {_less("duplicate")} ELSE {_less("stale")} END AS tokens_saved FROM r WHERE reason IS NOT NULL""",
    "sweep_cut_point": f"""WITH {_EVENTS}, t AS (SELECT conv_id, ord, k + 10 AS tokens, CASE WHEN k % 3 = 0 THEN k ELSE 0 END AS saved FROM ev),
x AS (SELECT *, sum(tokens) OVER w AS t, sum(saved) OVER w AS s FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, round({CACHE_READ * 50}::DOUBLE * t - (t - s) * ({CACHE_WRITE - CACHE_READ}::DOUBLE + {CACHE_READ * 50}::DOUBLE), 6) AS gain FROM x)
SELECT conv_id, ord AS cut, gain FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY gain DESC, ord DESC) AS rn FROM g WHERE saved <> 0 AND gain > 0) WHERE rn = 1""",
    "live_question_asof": """SELECT conv_id AS session, turn AS ord, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS question_md5
FROM conversations""",
    "docset_spans": f"""WITH {_DOCSETS}, a AS (SELECT set_id, pos, length(text) AS l, coalesce(sum(length(text) + 2) OVER (PARTITION BY set_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ds)
SELECT set_id, pos, start, start + l AS stop FROM a""",
    "docset_filter": f"{_DOCSETS_DONE} SELECT set_id, pos, kept FROM flags",
    "docset_compress": f"{_DOCSETS_DONE} SELECT set_id, pos, md5(text) AS text_md5 FROM flags WHERE kept",
    "pad_context": f"{_PADDED} SELECT md5(question) AS question_md5, count(*) AS paragraphs, sum((length(title) + 2 + length(text)) // 4)::BIGINT AS tokens FROM padded GROUP BY question",
    "build_context": f"""{_PADDED}, o AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY md5(title || question), title, pos) AS i FROM padded)
SELECT md5(question) AS question_md5, md5(string_agg('[' || i || '] ' || title || ': ' || text, E'\\n\\n' ORDER BY i)) AS context_md5 FROM o GROUP BY question""",
    "pool_antijoin": f"""WITH {_OWN} SELECT title FROM (SELECT 't' || doc_id AS title FROM documents) WHERE title NOT IN (SELECT title FROM own)""",
    "gold_recall": f"""{_DONE} SELECT block_id, contains(text, query)::INT AS gold_total, (contains(text, query) AND len(list_filter({_sentences("query")}, lambda x: NOT contains(new_text, x))) = 0)::INT AS gold_kept
FROM done""",
    "select_embedded": f"""{_CHUNKS}, sc AS (SELECT block_id, idx, round(CASE WHEN list_sum(a) > 0 AND list_sum(b) > 0 THEN list_cosine_similarity(a, b) ELSE 0 END, 12) AS score FROM (
  SELECT block_id, idx, {_letters("chunk")} AS a, {_letters("query")} AS b FROM (SELECT block_id, query, unnest(chunks) AS chunk, unnest(range(n)) AS idx FROM chn))),
{_SCORED[_SCORED.index("sd AS"):]}, {_decided()} SELECT block_id, n, kept, changed, md5(new_text) AS text_md5 FROM done""",
    "conv_trim_parts": f"""{_CONV_DONE.replace("role IN ('user', 'assistant') AND", "role = 'assistant' AND turn % 2 = 1 AND".replace("turn", "msg_idx"))} SELECT conv_id, msg_idx, changed FROM trimmed""",
    "unblinded_grades": """WITH b AS (SELECT item_id, ('0x' || substr(md5(text), 1, 8))::BIGINT % 2 = 1 AS swap, item_id % 5 <> 0 AS parsed FROM benchmark)
SELECT item_id, parsed, CASE WHEN parsed THEN CASE WHEN swap THEN 'partial' ELSE 'correct' END END AS grade_full, CASE WHEN parsed THEN CASE WHEN swap THEN 'correct' ELSE 'partial' END END AS grade_selected,
  parsed AND NOT swap AS materially_worse, CASE WHEN parsed THEN 'r' || item_id ELSE '' END AS judge_reason FROM b""",
    "reply_rates": """SELECT count(*) AS replies, count(*) FILTER (item_id % 5 <> 0) AS judged, count(*) FILTER (item_id % 5 = 0) AS parse_dropped, count(*) FILTER (item_id % 7 = 0) AS truncated,
  round(100.0::DOUBLE * count(*) FILTER (item_id % 5 = 0) / count(*), 6) AS parse_dropped_pct, round(100.0::DOUBLE * count(*) FILTER (item_id % 7 = 0) / count(*), 6) AS truncated_pct FROM benchmark""",
    "baseline_grades": f"""{_PAIRS} SELECT g.grade, count(p.a) AS n, round(100.0::DOUBLE * count(p.a) / (SELECT count(*) FROM pairs), 6) AS share_pct
FROM (VALUES ('correct', true), ('incorrect', false), ('partial', NULL)) g(grade, v) LEFT JOIN pairs p ON p.a = g.v GROUP BY g.grade""",
    "stream_decided": f"""WITH {_chunked("SELECT DISTINCT ON (text) doc_id AS block_id, text, 'the question of all' AS query FROM documents ORDER BY text, doc_id")}, {_SCORED}, {_decided()}
SELECT d.doc_id AS turn, done.block_id AS first_turn, done.changed, md5(done.new_text) AS text_md5 FROM documents d JOIN done USING (text)""",
    "ab_metrics": f"""{_PAIRS} SELECT count(*) AS judged, round(100.0::DOUBLE * (sum(tokens_full) - sum(tokens_selected)) / sum(tokens_full), 6) AS tokens_saved_pct, round(100.0::DOUBLE * sum(gold_kept) / sum(gold_total), 6) AS gold_recall_pct,
  round(100.0::DOUBLE * count(*) FILTER (a) / count(*), 6) AS control_pct, round(100.0::DOUBLE * count(*) FILTER (b) / count(*), 6) AS treatment_pct, round(100.0::DOUBLE * count(*) FILTER (a AND NOT b) / count(*), 6) AS regression_pct,
  round(100.0::DOUBLE * count(*) FILTER (b AND NOT a) / count(*), 6) AS improvement_pct, round(100.0::DOUBLE * count(*) FILTER (worse) / count(*), 6) AS worse_pct FROM pairs""",
    "grade_hist": f"{_PAIRS} SELECT CASE WHEN a THEN 'correct' ELSE 'incorrect' END AS grade_full, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM pairs), 6) AS share_pct FROM pairs GROUP BY a",
    "pair_order": "SELECT item_id, ('0x' || substr(md5(text), 1, 8))::BIGINT % 2 = 1 AS swapped FROM benchmark",
    "last_json": """SELECT event_id, '{"grade": "correct", "n": ' || event_id || '}' AS reply FROM events""",
    "dense_scores": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings",
    "dense_topk": f"""WITH e AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings),
r AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM e) SELECT label, vec_id, rn FROM r WHERE rn <= {_budget('0.3')}""",
    "admit_tool_output": f"""{_outputs((0.8,))} SELECT outs.block_id, md5(CASE WHEN done.changed AND length(done.new_text) < length(outs.text) THEN done.new_text END) AS updated_md5,
  coalesce(done.changed AND length(done.new_text) < length(outs.text), false) AS sent FROM outs LEFT JOIN done USING (block_id)""",
    "admission_eligible": f"WITH {_OUTPUTS} SELECT block_id, {_FIT} AS eligible FROM outs",
    "replay_sessions": f"{_REPLAY} SELECT session, keep, eligible_tokens::BIGINT AS eligible_tokens, fired, removed::BIGINT AS removed FROM sess",
    "replay_report": f"""{_REPLAY} SELECT keep, sum(fired)::BIGINT AS fired, sum(removed)::BIGINT AS removed, round(100.0::DOUBLE * sum(removed) / sum(eligible_tokens), 6) AS removed_pct,
  round(median(100.0::DOUBLE * removed / eligible_tokens), 6) AS median_pct FROM sess GROUP BY keep""",
    "dataset_page": "SELECT item_id, md5(text) AS text_md5 FROM benchmark ORDER BY item_id LIMIT 10 OFFSET 5",
    "stream_freeze": "SELECT doc_id AS turn, substr(md5(text), 1, 12) AS block_key, min(doc_id) OVER (PARTITION BY substr(md5(text), 1, 12)) AS first_turn FROM documents",
    "stream_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "stream_live_question": """SELECT conv_id AS session, turn AS ord, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS question_md5
FROM conversations""",
    "stream_admit": f"""{_outputs((0.8,))} SELECT outs.block_id, md5(CASE WHEN done.changed AND length(done.new_text) < length(outs.text) THEN done.new_text END) AS updated_md5,
  coalesce(done.changed AND length(done.new_text) < length(outs.text), false) AS sent FROM outs LEFT JOIN done USING (block_id)""",
    "transcript_outputs": """WITH c AS (SELECT *, last_value(CASE WHEN role = 'user' AND trim(text, E' \\n\\t\\r') <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question FROM conversations)
SELECT conv_id || ':' || (turn * 2 + 1) || ':0' AS block_id, 'Read' AS tool, 'Read f' || turn AS arguments, md5(text || '!') AS text_md5, md5(question) AS question_md5 FROM c WHERE role <> 'user'""",
    "transcript_question": """SELECT conv_id::VARCHAR AS file, md5(arg_max(text, turn) FILTER (role = 'user' AND trim(text, E' \\n\\t\\r') <> '')) AS question_md5 FROM conversations GROUP BY conv_id""",
    "sweep_message_parts": f"""WITH {_EVENTS}, p AS (SELECT conv_id, ord * 2 AS ord, event_type, 'f' || k % 7 AS path, repeat(k % 10 || 'x', (300 + 10 * k) // 2) AS body FROM ev),
w AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ord END) OVER (PARTITION BY conv_id, path) AS written,
  max(CASE WHEN event_type IN ('purchase', 'click') THEN ord END) OVER (PARTITION BY conv_id, path) AS touched,
  row_number() OVER (PARTITION BY conv_id, event_type = 'view' AND length(body) >= 400, body ORDER BY ord) AS copy FROM p),
r AS (SELECT *, CASE WHEN length(body) < 400 THEN NULL WHEN event_type <> 'view' AND written > ord THEN 'superseded' WHEN event_type = 'view' AND copy > 1 THEN 'duplicate'
  WHEN event_type = 'view' AND touched > ord THEN 'stale' END AS reason FROM w),
m AS (SELECT *, replace(CASE reason WHEN 'superseded' THEN '{MARKERS["superseded"]}' WHEN 'duplicate' THEN '{MARKERS["duplicate"]}' ELSE '{MARKERS["stale"]}' END, '{{path}}', path) AS marker FROM r WHERE reason IS NOT NULL)
SELECT conv_id, ord AS msg_idx, md5(marker) AS marker_md5, CASE WHEN event_type = 'view' THEN length(body) // 4 - length(marker) // 4
  ELSE (length(body) + 33 + length(path)) // 4 - (length(marker) + 33 + length(path)) // 4 END AS tokens_saved FROM m""",
    "strip_texts": "SELECT item_id, md5(trim(text, E' \\n\\t\\r')) AS text_md5 FROM benchmark",
}
