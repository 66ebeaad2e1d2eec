"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# kind, pattern, pattern of the part that must have a least length, least length
_KEYWORDS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token"))
_ASSIGN = f"(?:{_KEYWORDS}|{_any_case('api')}_?{_any_case('key')})[\"'']?\\x20*[:=]\\x20*[\"'']?"
_RULES = [
    ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", _ASSIGN + "([A-Za-z0-9+/_.=-]+)", 8),
    ("access", "AKIA[A-Z0-9]+", "(AKIA[A-Z0-9]+)", 16),
    ("hex", "[0-9a-f]+", "([0-9a-f]+)", 32),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "(gh[pousr]_[A-Za-z0-9]{36,})", 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "(xox[abprs]-[A-Za-z0-9-]{10,})", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
     r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 0),
]


def _op1() -> str:
    parts = "\n  UNION ALL ".join(
        f"SELECT doc_id, {i} AS o, '{kind}' AS kind, list_sum(list_transform(b[1:k], lambda x: len(x)))"
        f" + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: len(x))), 0) AS s, m[k] AS t"
        f" FROM (SELECT doc_id, m, b, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(x, '{p}') AS m,"
        f" string_split_regex(x, '{p}') AS b FROM t)) WHERE len(regexp_extract(m[k], '{part}', 1)) >= {least}"
        for i, (kind, p, part, least) in enumerate(_RULES))
    return f"""
WITH t AS (SELECT DISTINCT doc_id, coalesce(text, '') AS x FROM documents),
spans AS (
  {parts}),
listed AS (SELECT doc_id, o, kind, s, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':'
    || CAST(CAST(s AS BIGINT) + len(t) AS VARCHAR) AS x FROM spans),
sums AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access,
    count(*) FILTER (o = 2) AS n_hex, coalesce(string_agg(x, ',' ORDER BY s, o) FILTER (o < 3), '') AS base,
    string_agg(x, ',' ORDER BY s, o) AS spans FROM listed GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN sums USING (doc_id)"""


_OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((16 * (strpos('0123456789abcdef', substr(h, CAST(5 * k // 4 + 1 AS BIGINT), 1)) - 1)
       + strpos('0123456789abcdef', substr(h, CAST(5 * k // 4 + 2 AS BIGINT), 1)) - 1) >> CAST(3 - 5 * k % 4 AS INTEGER)) & 31) + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f"""

_OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN counts USING (vec_id) JOIN least USING (vec_id)"""

_OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)"""

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_folded('text')}, '{_WORD}') AS w FROM benchmark),
b1 AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b1)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM win) x ON len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP10 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p
  FROM win JOIN first USING (s) WHERE first < doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  ANTI JOIN (SELECT doc_id, unnest(gone) AS p FROM gone) y ON x.doc_id = y.doc_id AND x.p = y.p GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_LEN = "CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR)"


def _field(value: str) -> str:
    return f"coalesce({_LEN.format(value)}, '-')"


#: Whether 2 divides the CRC-32 of a number's decimal digits, bit by bit.
_EVEN_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), 256, 256, 256, 256, 256, 256, 256, 256]))),
    lambda r, x: CASE WHEN x < 256 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END) % 2 = 1"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_OP11 = f"""
WITH RECURSIVE t AS (SELECT *, CASE WHEN {_EVEN_CRC} THEN replace(text, chr(10), '') ELSE text END AS x FROM documents),
leaf AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf('text')} AS h, {_leaf('x')} AS o FROM t),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, o) - 1 AS i,
  count(*) OVER (PARTITION BY tree) AS n FROM leaf),
low(tree, l, i, n, h) AS (SELECT tree, 0, i, n, h FROM placed UNION ALL
  SELECT tree, any_value(l) + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, i // 3),
subs AS (SELECT tree, h AS subroot FROM low WHERE n = 1),
ends AS (SELECT tree, subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM subs),
high(l, i, n, h) AS (SELECT 0, i, n, subroot FROM ends UNION ALL
  SELECT any_value(l) + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY i // 3),
nodes AS (SELECT tree, l, i, h FROM low WHERE n > 1 UNION ALL
  SELECT e.tree, x.l + m.l, x.i, h FROM ends e JOIN (SELECT tree, max(l) AS l FROM low GROUP BY tree) m USING (tree) CROSS JOIN high x WHERE x.n > 1),
steps AS (SELECT p.doc_id, p.tree, p.i AS leaf_i, x.l, x.i, x.h, CASE WHEN x.l < m.l THEN p.i // CAST(3 ** x.l AS BIGINT)
    ELSE e.i // CAST(3 ** (x.l - m.l) AS BIGINT) END AS own
  FROM placed p JOIN ends e USING (tree) JOIN (SELECT tree, max(l) AS l FROM low GROUP BY tree) m USING (tree) JOIN nodes x USING (tree)),
runs AS (SELECT tree, leaf_i, l, any_value(own) AS own, list(h ORDER BY i) AS hs, list(i ORDER BY i) AS ix
  FROM steps WHERE i // 3 = own // 3 GROUP BY tree, leaf_i, l),
proofs AS (SELECT tree, leaf_i AS i, sha256(string_agg(array_to_string(list_filter(hs, lambda x, k: ix[k] <> own), ''), '' ORDER BY l)) AS proof_sha256,
  count(*) AS depth FROM runs GROUP BY tree, leaf_i),
fold(tree, i, l, h) AS (SELECT tree, i, 0, o FROM placed UNION ALL
  SELECT f.tree, f.i, f.l + 1, sha256(array_to_string(list_transform(hs, lambda x, k: CASE WHEN ix[k] = own THEN f.h ELSE x END), ''))
  FROM fold f JOIN runs r ON f.tree = r.tree AND f.i = r.leaf_i AND f.l = r.l)
SELECT doc_id, p.h AS leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  f.h AS folded_root, f.h = (SELECT h FROM high WHERE n = 1) AS verified
FROM placed p JOIN subs USING (tree) LEFT JOIN proofs q ON p.tree = q.tree AND p.i = q.i
  JOIN fold f ON f.tree = p.tree AND f.i = p.i AND f.l = coalesce(q.depth, 0)"""


def _op13(k: int = 8, rounds: int = 10) -> str:
    near = ("SELECT r, min(CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) * 8 + c) AS near"
            " FROM kept CROSS JOIN c{0} GROUP BY r")
    parts = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v AS m FROM kept
  QUALIFY c < {k})"""]
    for i in range(rounds):
        parts.append(f"""
a{i} AS MATERIALIZED ({near.format(i)}),
s{i} AS (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT CAST(near % 8 AS BIGINT) AS c, unnest(v) AS x, unnest(range(64)) AS p FROM a{i} JOIN kept USING (r))
  GROUP BY c, p),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(x, m) AS m FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS x
  FROM s{i} GROUP BY c) USING (c))""")
    return f"""WITH {','.join(parts)},
a AS ({near.format(rounds)}),
d AS (SELECT vec_id, CAST(near % 8 AS INTEGER) AS cluster, CAST(near // 8 AS BIGINT) AS distance FROM a JOIN kept USING (r))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM d JOIN c{rounds} ON c = cluster"""


ORACLE_SQL: dict[str, str] = {
    "op1_secrets": _op1(),
    "op4_warc": _OP4,
    "op7_vector_join": _OP7,
    "op8_ngram_join": _OP8,
    "op9_decontaminate": _OP9,
    "op10_substrings": _OP10,
    "op11_manifest": _OP11,
    "op13_centroids": _op13(),
}
