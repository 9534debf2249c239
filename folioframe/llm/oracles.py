"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_rp_forest"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id"""

ORACLES["op2_decontaminate"] = f"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, w[s:s + 9] AS p FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
sizes AS (SELECT DISTINCT len(p) AS n FROM p),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, w[s:s + n - 1] AS x FROM spots) JOIN p ON p.p = x),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM g"""

ORACLES["op7_url_filter"] = """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r(rule_host, rule_path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, rule_host || rule_path AS rule, v FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM f GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN b USING (page_id)"""

ORACLES["op9_chat"] = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS joined FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
n AS (SELECT *, len(text) + len(regexp_extract_all(text, '[\[<]\\*(/?INST|/?s>|\+\])')) + CASE WHEN joined THEN 3 ELSE 14 + len(role) END AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       (sum(chars) + 7)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""

ORACLES["op10_substring"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, hash(x) AS k, x FROM (SELECT doc_id, s, w[s:s + 12] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13))),
m AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM s JOIN m USING (x) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS t
         FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(({0})::VARCHAR))::VARCHAR || ':' || ({0})::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
#: Level by level: a node's leaf-to-node path is kept as (leaf, node), so each level joins runs and adds the sibling to the leaves below.
ORACLES["op12_merkle"] = f"""
WITH RECURSIVE crc AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
d AS (SELECT doc_id, lang, {_LEAF} AS leaf, sha256({" || ".join(_FIELD.format("n_chars + 1" if c == "n_chars" else c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS changed,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents),
l AS (SELECT d.*, CASE WHEN xor(c, 4294967295) % 7 = 0 THEN changed ELSE leaf END AS told, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM d LEFT JOIN crc USING (doc_id)),
up(g, pos, n, digest) AS (
  SELECT g, pos, n, leaf FROM l
  UNION ALL SELECT g, pos // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, pos // 2),
sub AS (SELECT g, digest, count(*) OVER () AS n FROM up WHERE n = 1),
top(pos, n, digest) AS (
  SELECT g, n, digest FROM sub
  UNION ALL SELECT pos // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 2),
path(doc_id, g, pos, n, proof, cur) AS (
  SELECT doc_id, g, pos, n, '', told FROM l
  UNION ALL SELECT p.doc_id, p.g, p.pos // 2, (p.n + 1) // 2, p.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN p.pos % 2 = 1 THEN s.digest || p.cur ELSE p.cur || coalesce(s.digest, '') END)
  FROM path p LEFT JOIN up s ON s.g = p.g AND s.n = p.n AND s.pos = xor(p.pos, 1) WHERE p.n > 1),
whole(doc_id, g, pos, n, proof, cur) AS (
  SELECT p.doc_id, p.g, p.g, sub.n, p.proof, p.cur FROM path p JOIN sub USING (g) WHERE p.n = 1
  UNION ALL SELECT p.doc_id, p.g, p.pos // 2, (p.n + 1) // 2, p.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN p.pos % 2 = 1 THEN s.digest || p.cur ELSE p.cur || coalesce(s.digest, '') END)
  FROM whole p LEFT JOIN top s ON s.n = p.n AND s.pos = xor(p.pos, 1) WHERE p.n > 1)
SELECT l.doc_id, l.leaf, sub.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.cur AS folded_root, w.cur = r.digest AS verified
FROM l JOIN whole w ON w.doc_id IS NOT DISTINCT FROM l.doc_id AND w.n = 1 JOIN sub ON sub.g = l.g CROSS JOIN (SELECT digest FROM top WHERE n = 1) r"""

ORACLES["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e::DOUBLE[], b.e::DOUBLE[])::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY a, p ORDER BY score DESC, b)::INT AS rank, b AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps
QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY score DESC, b) <= 10"""


def _pii_sql() -> str:
    """Places of the matches of one kind come from the pieces between them; validators and scores are conditions on each match."""
    from folioframe.llm import pii

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
                r"\+[0-9][\x20().0-9-]+[0-9]", pii.IBAN_HEAD, pii.SSN, pii.TEL]
    raw = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, t, unnest(regexp_extract_all(t, '{p}')) AS x, unnest(regexp_split_to_array(t, '{p}')) AS b,"
                             f" unnest(range(len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d" for k, (kind, p) in enumerate(zip(pii.KINDS, patterns)))
    lengths = ", ".join(f"'{c}': {n}" for c, n in pii.IBAN_LENGTHS.items())
    words = " ".join(f"WHEN '{kind}' THEN regexp_matches(context, '(^|[^a-z])({w})([^a-z]|$)')" for kind, w in pii.WORDS.items())
    scores = " ".join(f"WHEN '{kind}' THEN {n}" for kind, n in pii.SCORES.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({raw}),
m0 AS (SELECT doc_id, k, kind, t, x, (sum(len(b)) OVER w + coalesce(sum(len(x)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS s
      FROM raw WINDOW w AS (PARTITION BY doc_id, k ORDER BY i ROWS UNBOUNDED PRECEDING)),
m AS (SELECT * REPLACE (CASE WHEN kind = 'iban' THEN regexp_extract(substr(t, s + 1, 70), '^{pii.IBAN}') ELSE x END AS x) FROM m0 WHERE x IS NOT NULL),
cut AS (SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS digits,
          CASE WHEN kind = 'iban' THEN list_filter(range(1, len(x) + 1), lambda i: substr(x, i, 1) <> ' ')[MAP {{{lengths}}}[x[1:2]]] ELSE len(x) END AS size FROM m WHERE x <> ''),
e AS (SELECT *, (s + size)::INT AS stop, CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END || substr(t, s + size::INT + 1, 1) AS sides,
             {lower.format('substr(t, greatest(s - 40, 0) + 1, least(s, 40))')} AS context, replace(x[1:size], ' ', '') AS y FROM cut WHERE size IS NOT NULL),
ok AS (SELECT doc_id, k, kind, s, stop, greatest(0, least(10, CASE kind {scores} END + 2 * (CASE kind {words} END)::INT
          - 3 * regexp_matches(context, '(^|[^a-z])({pii.OTHER_NUMBERS})([^a-z]|$)')::INT)) AS score FROM e WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda p: CASE WHEN len(ltrim(p, '0')) > 3 THEN true ELSE ('0' || ltrim(p, '0'))::INT > 255 END)) = 0
  WHEN 'card' THEN len(digits) BETWEEN 14 AND 19 AND list_sum([CASE WHEN (len(digits) - i) % 2 = 0 THEN substr(digits, i, 1)::INT
       ELSE 2 * substr(digits, i, 1)::INT - CASE WHEN substr(digits, i, 1) > '4' THEN 9 ELSE 0 END END FOR i IN range(1, len(digits) + 1)]) % 10 = 0
  WHEN 'phone' THEN len(digits) BETWEEN 10 AND 15
  WHEN 'iban' THEN NOT regexp_matches(sides, '[A-Za-z0-9]') AND list_reduce(list_prepend(0, [CASE WHEN c <= '9' THEN c::INT ELSE ascii(c) - 55 END FOR c IN string_split(y[5:] || y[1:4], '')]),
       lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1
  WHEN 'ssn' THEN NOT regexp_matches(sides, '[A-Za-z0-9-]') AND x[1:3] NOT IN ('000', '666') AND x[1:3] < '900' AND x[5:6] <> '00' AND x[8:] <> '0000'
  ELSE NOT regexp_matches(sides, '[A-Za-z0-9+./(-]') AND len(digits) BETWEEN 9 AND 11 END),
f AS (SELECT * FROM ok a WHERE k < {pii.BASE} OR score >= {pii.LEAST} AND NOT EXISTS (FROM ok b WHERE b.k < {pii.BASE} AND b.doc_id = a.doc_id AND b.s <= a.s AND b.stop >= a.stop)),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in pii.KINDS[:pii.BASE])},
        string_agg(kind || ':' || s || ':' || stop, ',' ORDER BY s, k) FILTER (WHERE k < {pii.BASE}) AS base, string_agg(kind || ':' || s || ':' || stop, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in pii.KINDS[:pii.BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


ORACLES["op11_pii"] = _pii_sql()
