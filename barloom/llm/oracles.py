"""DuckDB SQL for the results of the registered queries that SQL can express.

Stated from the contracts: patterns, thresholds and formulas stand here as literals. Only the licence tables, which are
data, are shared with the operator.
"""

from __future__ import annotations

from barloom.llm.licenses import KEYS, RULES, SENTENCES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WS = r"\x20\x09-\x0D"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _matches(kinds: list[tuple[str, str, str]]) -> str:
    """CTEs d (doc_id, t) and m (doc_id, k, kind, s, e, v): matches with positions, and a condition on each match v."""
    hits = "\nUNION ALL\n".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, t, regexp_extract_all(t, {_quoted(pattern)}) AS hits, string_split_regex(t, {_quoted(pattern)}) AS gaps FROM d"
        for k, (kind, pattern, _) in enumerate(kinds)
    )
    keep = " ".join(f"WHEN kind = '{kind}' THEN {condition}" for kind, _, condition in kinds)
    return f"""d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS ({hits}),
u AS (SELECT doc_id, k, kind, unnest(hits) AS v, unnest(list_transform(gaps[1:len(hits)], lambda x: length(x))) AS gap, unnest(range(len(hits))) AS i FROM h WHERE len(hits) > 0),
p AS (SELECT *, sum(gap + length(v)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM u),
m AS (SELECT doc_id, k, kind, CAST(e - length(v) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, v FROM p WHERE CASE {keep} END)"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""(length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length({_DIGITS})), lambda i:
  CASE WHEN i % 2 = 0 THEN CAST(substring(reverse({_DIGITS}), i + 1, 1) AS INT)
       WHEN CAST(substring(reverse({_DIGITS}), i + 1, 1) AS INT) > 4 THEN 2 * CAST(substring(reverse({_DIGITS}), i + 1, 1) AS INT) - 9
       ELSE 2 * CAST(substring(reverse({_DIGITS}), i + 1, 1) AS INT) END)) % 10 = 0)"""
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: TRY_CAST(x AS HUGEINT) IS NULL OR TRY_CAST(x AS HUGEINT) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
]
_EDGE = ".,;:!?()\"'"
_SPLIT = f"[{_WS}{_EDGE}]"
_LISTED = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '')"

_OP1 = f"""WITH {_matches(_PII)},
edges AS (SELECT m.*, greatest(0, s - 80) AS first, t, CASE kind WHEN 'email' THEN 'email:' || lower(v) WHEN 'ip' THEN 'ip:' || v ELSE kind || ':' || {_DIGITS} END AS entity FROM m JOIN d USING (doc_id)),
sides AS (SELECT doc_id, entity,
  regexp_replace(CASE WHEN first > 0 THEN regexp_replace(substring(t, first + 1, s - first), '^[^{_WS}]+', '') ELSE substring(t, first + 1, s - first) END, '[^{_WS}]+$', '') AS l,
  regexp_replace(CASE WHEN e + 80 < length(t) THEN regexp_replace(substring(t, e + 1, 80), '[^{_WS}]+$', '') ELSE substring(t, e + 1, 80) END, '^[^{_WS}]+', '') AS r FROM edges),
near AS (SELECT DISTINCT doc_id, entity, l || ' ' || r AS ctx, trim(unnest(string_split_regex({_low("l || ' ' || r")}, '[{_WS}]+')), {_quoted(_EDGE)}) AS term FROM sides),
pairs AS (SELECT entity, term, count(DISTINCT doc_id) AS together FROM near WHERE regexp_full_match(term, '\\p{{L}}{{4,}}') GROUP BY entity, term HAVING count(DISTINCT ctx) >= 3),
wordsof AS (SELECT DISTINCT doc_id, trim(w, {_quoted(_EDGE)}) AS term FROM (SELECT doc_id, unnest(string_split_regex({_low('t')}, '[{_WS}]+')) AS w FROM d)),
dft AS (SELECT term, count(*) AS td FROM wordsof WHERE term IN (SELECT term FROM pairs) GROUP BY term),
dfe AS (SELECT entity, count(DISTINCT doc_id) AS ed FROM sides GROUP BY entity),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
strong AS (SELECT entity, term FROM pairs JOIN dft USING (term) JOIN dfe USING (entity), n WHERE n > ed AND log2(n * together / (td * ed)) / log2(n / ed) * 1.5 >= 1),
seen AS (SELECT DISTINCT doc_id, term FROM sides JOIN strong USING (entity)),
tok AS (SELECT doc_id, unnest(list) AS w, unnest(range(len(list))) AS i FROM (SELECT doc_id, string_split_regex({_low('t')}, {_quoted(_SPLIT)}) AS list FROM d WHERE doc_id IN (SELECT doc_id FROM seen))),
places AS (SELECT *, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS e FROM tok),
terms AS (SELECT doc_id, 4 AS k, 'term' AS kind, e - length(w) AS s, e FROM places a WHERE EXISTS (SELECT 1 FROM seen x WHERE x.doc_id = a.doc_id AND x.term = a.w)
  AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = a.doc_id AND m.s < a.e AND a.e - length(a.w) < m.e)),
spans AS (SELECT doc_id, k, kind, s, e FROM m UNION ALL SELECT doc_id, k, kind, s, e FROM terms),
base AS (SELECT doc_id, {_LISTED} AS base, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in _PII)} FROM m GROUP BY doc_id),
full_ AS (SELECT doc_id, {_LISTED} AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k, _, _ in _PII)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN full_ USING (doc_id)"""

_OP2 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
k AS (SELECT hex, max(page_id) AS keeper FROM h GROUP BY hex),
bits AS (SELECT hex, list_aggregate(list_transform(range(1, 41), lambda i: right('0000' || bin(instr('0123456789abcdef', substring(hex, i, 1)) - 1), 4)), 'string_agg', '') AS bits FROM k),
b32 AS (SELECT hex, list_aggregate(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substring(bits, i * 5 + j + 1, 1) AS INT) << (4 - j)))::INT, 1)), 'string_agg', '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM h JOIN k USING (hex) JOIN b32 USING (hex)"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
_SECRETS = [
    ("assign", _ASSIGN, f"length(regexp_extract(v, {_quoted(_VALUE)}, 1)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(v) >= 20"),
    ("hex", "[0-9a-f]+", "length(v) >= 24"),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    ("github", "gh[opsur]_[A-Za-z0-9]+", "length(v) >= 40"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", "length(v) >= 15"),
    ("google", "AIza[A-Za-z0-9_-]+", "length(v) >= 39"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "true"),
]
_OP4 = f"""WITH {_matches(_SECRETS)},
full_ AS (SELECT doc_id, {_LISTED} AS spans FROM m GROUP BY doc_id),
base AS (SELECT doc_id, {_LISTED} AS base, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('assign', 'access', 'hex'))} FROM m WHERE k < 3 GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in ('assign', 'access', 'hex'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN full_ USING (doc_id)"""

_OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_low("coalesce(text, '')")}, '[{_WS}]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.m) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = w.doc_id GROUP BY 1, 2"""

_OP6 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[{_WS}]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, range(8) AS x(k) GROUP BY doc_id),
q AS (SELECT doc_id, source, len(ws) AS n_words, coalesce(CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM w LEFT JOIN v USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q),
bad AS (SELECT source, r, count(*) AS n, count(*) FILTER (failed) AS bad
  FROM (SELECT source, unnest([1, 2, 3]) AS r, unnest([base_failed, n_symbols * 10 > n_words, n_dup_lines * 10 > n_words]) AS failed FROM f) GROUP BY source, r),
mv AS (SELECT r, avg(bad / n) AS m, var_pop(bad / n) AS v FROM bad GROUP BY r),
prior AS (SELECT r, m, CASE WHEN v > 0 THEN least(1e6, greatest(2.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM mv),
verdict AS (SELECT source, max((bad + m * s) / (n + s)) >= 0.8 AS refused FROM bad JOIN prior USING (r) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT refused AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source"""


def _op8() -> str:
    known = "MAP {" + ", ".join(f"{_quoted(s)}: {_quoted(i)}" for s, i in SENTENCES.items()) + "}"
    some = " OR ".join(f"contains(lower(t), '{k}')" for k in KEYS)
    normal = f"trim(regexp_replace({_low('x')}, '[^a-z0-9]+', ' ', 'g'))"

    def ids(text: str) -> str:
        found = f"list_filter(list_transform(string_split({text}, chr(30)), lambda x: {known}[{normal}]), lambda x: x IS NOT NULL)"
        return f"CASE WHEN {some} THEN coalesce(array_to_string(list_transform({found}, lambda x: '<' || x || '>'), ''), '') ELSE '' END"

    def names(column: str) -> str:
        for sequence, name in RULES:
            column = f"replace({column}, '{''.join(f'<{i}>' for i in sequence)}', '<={name}>')"
        return f"regexp_extract_all({column}, '<=([^>]+)>', 1)"

    end = f"'([.!?;])[{_WS}]+', '\\1' || chr(30), 'g'"
    lines = f"replace(regexp_replace(t, {end}), chr(10), chr(30))"
    flow = f"regexp_replace(regexp_replace(t, '\\n[\\x20\\t\\x0B-\\r]*\\n', chr(30), 'g'), {end})"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
i AS (SELECT doc_id, {ids(lines)} AS a, {ids(flow)} AS b FROM d)
SELECT doc_id, CASE WHEN a = '' AND b = '' THEN '' ELSE a || '/' || b END AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_concat({names('a')}, {names('b')}))), ','), '') AS licenses FROM i"""


def _op11() -> str:
    """Ten rounds written out: nearest centroid of each vector, then floors of the means."""
    squares = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT)"
    nearest = f"SELECT vec_id, any_value(v) AS v, min({{'d': {squares}, 'cluster': cluster}}) AS m FROM kept, k{{r}} GROUP BY vec_id"
    rounds = []
    for r in range(10):
        rounds.append(f"""a{r} AS MATERIALIZED ({nearest.replace('{r}', str(r))}),
s{r} AS (SELECT m.cluster AS cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 65) AS x(i) GROUP BY 1, 2),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY cluster),
k{r + 1} AS MATERIALIZED (SELECT k.cluster, coalesce(m.c, k.c) AS c FROM k{r} k LEFT JOIN m{r} m USING (cluster))""")
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
k0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS cluster, v AS c FROM (SELECT v, sha256('3:' || vec_id) AS h FROM kept ORDER BY h LIMIT 8)),
{','.join(rounds)},
a AS ({nearest.replace('{r}', '10')})
SELECT vec_id, m.cluster AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(k10.c, ',')) AS centroid_sha256 FROM a JOIN k10 ON k10.cluster = a.m.cluster"""


# crc32 of the decimal digits, bit by bit
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, x: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), y >> 1) ELSE y >> 1 END, xor(c, x)), CAST(4294967295 AS BIGINT)))"""

_OP12 = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS lender, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.lender AND i <= h UNION ALL SELECT c.conv_id, i + 1000000, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, md5(length(role) || ':' || role || text) AS turn,
  len(list_filter(string_split_regex(text, '[{_WS}]+'), lambda x: x <> '')) AS w FROM r),
p AS (SELECT conv_id, d, w, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM o UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w FROM p GROUP BY path, d),
k AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS children FROM n WHERE d > 0 GROUP BY 1),
e AS (SELECT p.path, string_agg(conv_id, ',' ORDER BY conv_id) AS ends FROM p JOIN (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id) USING (conv_id, d) GROUP BY p.path),
x AS (SELECT n.path, n.d, n.conv_id, n.n, n.w, coalesce(k.children, 0) AS children FROM n LEFT JOIN k USING (path)),
u AS (SELECT left(path, 32 * a) AS path, sum((n - 1) * w) AS saved, count(*) FILTER (children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM x) GROUP BY 1)
SELECT x.conv_id, x.d AS depth, m.conv_id AS parent_conv_id, x.n AS n_convs, x.children AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM x JOIN u USING (path) LEFT JOIN e USING (path) LEFT JOIN n m ON x.d > 0 AND m.path = left(x.path, 32 * (x.d - 1))"""


SQL: dict[str, str] = {
    "op1_pii": _OP1,
    "op2_warc": _OP2,
    "op4_secrets": _OP4,
    "op5_ngram_join": _OP5,
    "op6_quality_rules": _OP6,
    "op8_license_scans": _op8(),
    "op11_centroids": _op11(),
    "op12_prefix_trie": _OP12,
}
