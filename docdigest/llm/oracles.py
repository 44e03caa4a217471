"""SQL for DuckDB that gives the rows of the queries whose results it can express, computed plainly: all pairs, all windows, all hops."""

from __future__ import annotations

from docdigest.llm.chat_format import END, MIDDLE, START
from docdigest.llm.conversation_trie import FAMILY, TAKEN
from docdigest.llm.decontaminate import WINDOW
from docdigest.llm.divergence import ADDED, MIN_DOCS, SCALE, TOP
from docdigest.llm.line_dedup import MIN_CHARS
from docdigest.llm.near_vectors import THRESHOLD
from docdigest.llm.url_filter import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')".format(_LOWER.format("coalesce(text, '')"))
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))


def _components(edges: str) -> str:
    """Of edges (a, b), CTEs that end in ``comp(node, c)``: the smallest node that each reaches."""
    return f"link AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})), reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a), comp AS (SELECT a AS node, least(a, min(b)) AS c FROM reach GROUP BY a)"


_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
 {_components("SELECT a, b FROM e")}
 SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = doc_id"""

_CONTAMINATION = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_ALNUM} AS w FROM benchmark),
 t AS (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS j FROM b WHERE len(w) > 0),
 x AS (SELECT item, j, n, array_to_string(w[j:j + n - 1], ' ') AS g FROM t),
 o AS (SELECT doc_id, m.n, unnest(range(1, len(w) - m.n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM x) m WHERE len(w) >= m.n),
 h AS (SELECT doc_id, i, x.item, x.j, x.n FROM o JOIN x ON x.n = o.n AND x.g = array_to_string(o.w[o.i:o.i + o.n - 1], ' ')),
 k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
 i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
 l AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS c FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, n, i - j ORDER BY i) AS run FROM (SELECT DISTINCT * FROM h)) GROUP BY doc_id, item, n, i - j, run) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest FROM d LEFT JOIN k USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN l USING (doc_id)"""

_NEAR = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS z FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
 p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_inner_product(x.e, y.e) / (x.z * y.z) >= {THRESHOLD}),
 n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a),
 {_components("SELECT a, b FROM p")}
 SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN comp ON node = vec_id"""


def _rules() -> str:
    """The rules as rows; of the pages that the driver gives none has a canonical link or a redirect, so the rest is allowed."""
    return ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in RULES)


_URLS = f"""WITH r(verdict, h, p) AS (VALUES {_rules()}),
 u AS (SELECT page_id, row_number() OVER () AS k, {_LOWER.format("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 m AS (SELECT k, h || p AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, verdict) AS n FROM u, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
 SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (k)"""

_MORE = lambda c: rf"length({c}) + len(regexp_extract_all({c}, '<\\*\|'))"
_CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_MORE("role")} + {_MORE("text")} + {len(START + MIDDLE + END) + 1}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

_TERMS = r"regexp_extract_all({}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))
_P = lambda n, total, v: f"1 + (CAST({SCALE} AS HUGEINT) * ({n} + {ADDED})) // ({total} + {ADDED} * {v})"
_DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
 o AS (SELECT i, lang, source, unnest(w) AS term FROM d),
 k AS (SELECT lang, term FROM (SELECT DISTINCT lang, i, term FROM o) GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
 c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
 g AS (SELECT DISTINCT lang, source FROM d),
 f AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 p AS (SELECT lang, source, term, n, {_P("n", "sum(n) OVER s", "count(*) OVER s")} AS p FROM f WINDOW s AS (PARTITION BY lang, source)),
 q AS (SELECT lang, term, {_P("n", "sum(n) OVER s", "count(*) OVER s")} AS q FROM (SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term) WINDOW s AS (PARTITION BY lang)),
 x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM y) WHERE part = 'pair' OR r <= {TOP}"""

_TRIM = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LINES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
 l AS (SELECT r, doc_id, unnest(range(len(w))) AS i, unnest(w) AS line FROM d),
 k AS (SELECT r, doc_id, i, line, {_LOWER.format(_TRIM)} AS key FROM l),
 f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
 g AS (SELECT k.*, first IS NOT NULL AND doc_id <> first AS gone FROM k LEFT JOIN f USING (key))
 SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r"""

_BIT = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
_CRC = lambda s: f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({s}, ''), lambda t: ascii(t)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: {_BIT})), 4294967295)"
_TRIE = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i,
   md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
 k AS (SELECT c, c - c % {FAMILY} AS b, {_CRC("CAST(c AS VARCHAR)")} % {TAKEN} AS h FROM (SELECT DISTINCT c FROM t)),
 r AS (SELECT k.c, i, g, words FROM k JOIN t ON t.c = b WHERE i < h UNION ALL SELECT k.c, i, g, words FROM k JOIN t ON t.c = k.c WHERE i >= h),
 s AS (SELECT k.c, coalesce(list(g ORDER BY i) FILTER (g IS NOT NULL), []) AS gs, coalesce(list(words ORDER BY i) FILTER (g IS NOT NULL), []) AS ws FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
 p AS (SELECT c, unnest(range(len(gs) + 1)) AS d, gs, ws FROM s),
 m AS (SELECT c, d, md5(d || array_to_string(gs[1:d], ' ')) AS node, CASE WHEN d > 0 THEN md5((d - 1) || array_to_string(gs[1:d - 1], ' ')) END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, len(gs) = d AS ends FROM p),
 n AS (SELECT node, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node),
 q AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
 e AS (SELECT a.node, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (NOT EXISTS (SELECT 1 FROM q WHERE q.up = n.node)) AS leaves FROM n JOIN m a ON a.c = n.conv AND a.d <= n.depth GROUP BY a.node)
 SELECT n.conv AS conv_id, CAST(n.depth AS BIGINT) AS depth, v.conv AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
 FROM n JOIN e ON e.node = n.node LEFT JOIN q ON q.up = n.node LEFT JOIN n v ON v.node = n.up"""

ORACLES = {"op3_jaccard_join": _JACCARD, "op5_decontaminate": _CONTAMINATION, "op6_near_vectors": _NEAR, "op7_url_filter": _URLS, "op8_chat_format": _CHAT, "op11_source_divergence": _DIVERGENCE, "op12_line_dedup": _LINES, "op13_conversation_trie": _TRIE}
