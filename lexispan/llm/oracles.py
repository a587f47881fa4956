"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import CLASSES, _words

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_WORD = r"[^\x20\x09-\x0D]+"
_COUNT = ", ".join("length(t) - length(regexp_replace(t, '{}', '', 'g'))".format(c.replace("\\'", "''").replace("'\\\"", "''\"").replace('\\"', '"')) for c in CLASSES)
_COMMON = "[" + ", ".join(f"'{w}'" for w in _words()) + "]"


def _distance(p: str, q: str) -> str:
    share = lambda a: f"list_transform({a}, lambda x: x::DOUBLE / nullif(list_sum({a}), 0)::DOUBLE)"
    part = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ({m})) ELSE 0 END"
    x, y = f"({share(p)})[i]", f"({share(q)})[i]"
    m = f"({x} + {y}) / 2"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(x, m)} + {part(y, m)})) / 2, 0))"


QUALITY = rf"""WITH b AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM b),
 pos AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
 win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM pos),
 twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
 cov AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 8) z(k) GROUP BY r),
 m AS (SELECT w.r, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, [{_COUNT}] AS c,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  list_transform({_COMMON}, lambda x: len(list_filter(w, lambda y: lower(y) = x))) AS k FROM w LEFT JOIN cov ON w.r = cov.r),
 h AS (SELECT *, c[4] AS n_symbols, list_concat(c, [word_chars - list_sum(c)]) AS hc, list_concat(k, [n_words - list_sum(k)]) AS hw FROM m),
 ref AS (SELECT lang AS g, list(s ORDER BY i) FILTER (kind = 'c') AS rc, list(s ORDER BY i) FILTER (kind = 'w') AS rw FROM (
  SELECT lang, kind, i, sum(v) AS s FROM (SELECT lang, 'c' AS kind, unnest(range(1, len(hc) + 1)) AS i, unnest(hc) AS v FROM h UNION ALL SELECT lang, 'w', unnest(range(1, len(hw) + 1)), unnest(hw) FROM h) GROUP BY ALL) GROUP BY lang),
 d AS (SELECT h.*, {_distance("hc", "rc")} AS dc, {_distance("hw", "rw")} AS dw FROM h JOIN ref ON h.lang IS NOT DISTINCT FROM ref.g)
 SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (word_chars >= 200 AND coalesce(dc, 0) > 0.30) AND NOT (n_words >= 60 AND coalesce(dw, 0) > 0.50) AS kept FROM d"""

NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
 reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
 c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
 SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

_HEX = "list_transform(range(0, 8), lambda k: list_reduce(list_transform(range(1, 6), lambda j: (instr('0123456789abcdef', substr(h, 5 * k + j, 1)) - 1)::BIGINT), lambda x, y: 16 * x + y))"
_KEY = r"""CASE WHEN url IS NULL THEN '' WHEN regexp_extract(url, p, 1) = '' THEN lower(url)
 ELSE array_to_string(list_reverse(string_split(lower(regexp_extract(url, p, 1)), '.')), ',') || ')' || lower(regexp_extract(url, p, 2)) END"""
WARC = rf"""WITH r AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, '(?i)^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?(?:www\.)?([^/:?#]*)(?::\d+)?([^#]*)' AS p FROM pages),
 v AS (SELECT *, {_HEX} AS v, min(page_id) OVER (PARTITION BY h) AS one FROM r)
 SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('{ALPHABET}', 1 + ((v[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31), 1)), '') AS payload_digest,
 CASE WHEN one = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN one <> page_id THEN one END AS refers_to,
 {_KEY} AS url_key, strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM v"""

CHAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(0, 2) z(k)),
 e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS n FROM t)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(4 + length(role) + 1 + n + 9)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""

ORACLE = {"op2_quality_rules": QUALITY, "op3_near_duplicates": NEAR, "op9_warc_archives": WARC, "op10_chat_formatting": CHAT}
