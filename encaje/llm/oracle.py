"""Check SQL of the operators that SQL can express."""

from __future__ import annotations

from encaje.llm.licenses import LEAST, TEMPLATES, bigrams, fewest_shared, words_of
from encaje.llm.sharding import SHARDS

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"
_FOLD = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         "'abcdefghijklmnopqrstuvwxyz')")


def _sharding() -> str:
    uniform = ("(('0x' || substr(md5({k}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0")
    draw = "-1.0 / ln(" + uniform.format(k="key || '|' || s") + ")"
    # CRC-32 of the UTF-8 bytes by its table of 256 entries
    return f"""
WITH table_ AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b:
    CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
  FROM range(256) AS r(i))),
docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, chr(0) || 'null') AS key
  FROM documents),
texts AS (SELECT DISTINCT text FROM docs),
bytes AS (SELECT text, list(('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT ORDER BY i) AS b
  FROM (SELECT text, hex(encode(text)) AS h, unnest(range(octet_length(encode(text)))) AS i FROM texts)
  GROUP BY text),
sums AS (SELECT text, xor(list_reduce(list_prepend(4294967295, b), lambda c, x:
    xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS crc FROM bytes, table_),
draws AS (SELECT doc_id, text, key, s, {draw} AS d
  FROM docs, range({SHARDS + 1}) AS r(s)),
owned AS (SELECT doc_id, text, key,
    arg_max(s, (d, -s)) FILTER (s < {SHARDS}) AS shard, arg_max(s, (d, -s)) AS grown
  FROM draws GROUP BY ALL),
sized AS (SELECT o.*, octet_length(encode(o.text)) + 1 AS size,
    coalesce(crc, 0) AS text_crc32, {uniform.format(k="key")} AS u
  FROM owned o LEFT JOIN sums USING (text))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY u, doc_id, size, text_crc32) - 1 AS slot,
  grown::INT AS grown_shard
FROM sized"""


def _licenses() -> str:
    rows = ", ".join("('{}', ['{}'], {}, {})".format(
        n, "', '".join(bigrams(t)), len(words_of(t)) - 1, fewest_shared(len(bigrams(t)), LEAST))
        for n, t in TEMPLATES)
    return f"""
WITH templates AS (SELECT row_number() OVER () AS t, * FROM (VALUES {rows}) AS v(license, grams, length, need)),
texts AS (SELECT row_number() OVER () AS x, text FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
units AS (SELECT x, false AS whole, unnest(list_concat(string_split_regex(text, '\\n[ \\t\\r]*\\n'),
    string_split(text, chr(10)))) AS unit FROM texts
  UNION ALL SELECT x, true, text FROM texts),
worded AS (SELECT x, whole, list_filter(string_split_regex(translate(unit,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '') AS w
  FROM units),
paired AS (SELECT x, whole, list_transform(range(1, len(w)::BIGINT), lambda i: w[i] || ' ' || w[i + 1]) AS p
  FROM worded WHERE len(w) >= 2),
placed AS (SELECT x, unnest(p) AS gram, unnest(range(len(p)::BIGINT)) AS i FROM paired WHERE whole),
hits AS (SELECT x, t, i, length, lead(i, need - 1) OVER (PARTITION BY x, t ORDER BY i) AS till
  FROM placed JOIN (SELECT t, length, need, unnest(grams) AS gram FROM templates) USING (gram)),
moved AS (SELECT h.x, h.t, i, h.length, p[i + 1:i + h.length] AS p,
    len(list_intersect(p[i + 1:i + h.length], m.grams)) AS n, need
  FROM hits h JOIN paired q ON q.x = h.x AND whole JOIN templates m ON m.t = h.t WHERE till - i < h.length),
dense AS (SELECT * FROM moved WHERE n >= need),
grams AS (SELECT x, p FROM paired
  UNION ALL SELECT x, p FROM dense c WHERE NOT EXISTS (SELECT 1 FROM dense q WHERE q.x = c.x AND q.t = c.t
    AND abs(q.i - c.i) < c.length AND (q.n > c.n OR q.n = c.n AND q.i < c.i))),
listed AS (SELECT DISTINCT x, list_filter(p, lambda g, k: list_position(p, g) = k) AS g FROM grams
  WHERE len(p) <= 400),
long_ AS (SELECT DISTINCT x, list_distinct(p) AS g FROM grams WHERE len(p) > 400),
found AS (SELECT x, row_number() OVER () AS u, g FROM (SELECT * FROM listed UNION ALL SELECT * FROM long_)),
scored AS (SELECT x, u, g, 2.0::DOUBLE * len(list_intersect(g, t.grams)) / (len(g) + len(t.grams))::DOUBLE AS dice,
    license FROM found, templates t WHERE len(g) BETWEEN len(t.grams) * 0.5 AND len(t.grams) * 2.0),
named AS (SELECT x, u, any_value(g) AS g, max(dice) AS dice, arg_max(license, (dice, license)) AS license
  FROM scored GROUP BY x, u HAVING max(dice) >= {LEAST}::DOUBLE),
kept AS (SELECT * FROM named m WHERE NOT EXISTS (SELECT 1 FROM named o WHERE o.x = m.x AND o.dice > m.dice
  AND o.license <> m.license AND len(list_intersect(m.g, o.g)) = len(m.g))),
best AS (SELECT text, count(*) AS n_matches, list_sort(list_distinct(list(license))) AS l,
    arg_max(license, (dice, license)) AS best, max(dice) AS dice FROM kept JOIN texts USING (x) GROUP BY text)
SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches,
  coalesce(array_to_string(l, ','), '') AS licenses, best, dice
FROM documents d LEFT JOIN best ON coalesce(d.text, '') = best.text"""


def _decontamination() -> str:
    return f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_FOLD}, '{_WORD}') AS w
  FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(
    range(1, (greatest(len(w) - 10, 0) + 2)::BIGINT), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
  FROM items WHERE len(w) > 0),
texts AS (SELECT row_number() OVER () AS r, w FROM (
  SELECT regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM (SELECT DISTINCT text FROM documents))),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM texts, sizes
  WHERE len(w) >= n),
hits AS (SELECT DISTINCT p.r, p.n, p.i, item FROM (
    SELECT p.r, p.n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM places p JOIN texts USING (r)) p
  JOIN windows v ON v.g = p.g AND v.n = p.n),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (
  SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
done AS (SELECT w, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(l, '') AS l
  FROM texts LEFT JOIN covered USING (r) LEFT JOIN named USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, n_hit::BIGINT AS n_hit, n_items::BIGINT AS n_items,
  sha256(l) AS items_sha256, n_hit > 0 AS contaminated
FROM (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents) JOIN done USING (w)"""


def _minhash() -> str:
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_SPACED}') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(list_transform(
    range(1, (greatest(len(w) - 5, 0) + 2)::BIGINT), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) > 0),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g
    AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT x AS doc_id, x AS seen FROM (SELECT DISTINCT x FROM pairs)
  UNION SELECT r.doc_id, p.y FROM reach r JOIN pairs p ON p.x = r.seen),
least_ AS (SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id,
  coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN least_ USING (doc_id)"""


def _suffixes() -> str:
    def whole(piece: str) -> str:  # without the rests of parted characters at both ends
        return (f"regexp_replace(regexp_replace({piece}, '^([89AB][0-9A-F])+', ''), '([CD][0-9A-F]|"
                "E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){0,2})$', '')")

    return f"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, i, md5(array_slice(b, i, i + 399)) AS h FROM (
  SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM docs WHERE octet_length(b) >= 400)),
twice AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
marked AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM starts JOIN twice USING (h)),
runs AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked),
spans AS (SELECT doc_id, r, min(i) AS a, max(i) + 400 AS z FROM runs GROUP BY doc_id, r),
kept AS (SELECT doc_id, a, z, lag(z, 1, 1::BIGINT) OVER (PARTITION BY doc_id ORDER BY a) AS f FROM spans),
cut AS (SELECT doc_id, sum(z - a) AS n, count(*) AS c, max(z) AS last,
    string_agg(hex(array_slice(b, f, a - 1)), '' ORDER BY a) AS parts,
    string_agg({whole("hex(array_slice(b, f, a - 1))")}, '' ORDER BY a) AS chars,
    string_agg((a - 1)::VARCHAR || ':' || (z - 1)::VARCHAR, ',' ORDER BY a) AS spans
  FROM kept JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed,
  coalesce(c, 0)::BIGINT AS n_spans, sha256(CASE WHEN c IS NULL THEN b
    ELSE unhex(parts || hex(array_slice(b, last, octet_length(b)))) END) AS kept_sha256,
  coalesce(spans, '') AS spans, decode(CASE WHEN c IS NULL THEN b
    ELSE unhex(chars || {whole("hex(array_slice(b, last, octet_length(b)))")}) END) AS text
FROM docs LEFT JOIN cut USING (doc_id)"""


def _trie() -> str:
    return """
WITH table_ AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b:
    CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
  FROM range(256) AS r(i))),
src AS (SELECT conv_id AS c, turn, coalesce(text, '') AS x,
    sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, x, g, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) - 1 AS pos FROM src),
sizes AS (SELECT c, count(*) AS n FROM own GROUP BY c),
hashed AS (SELECT c, n, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(
    range(1, (length(c::VARCHAR) + 1)::BIGINT), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % 6 AS h FROM sizes, table_),
convs AS (SELECT a.c, a.h, a.base, least(a.h, coalesce(b.n, 0)) AS lead FROM hashed a LEFT JOIN sizes b
  ON b.c = a.base),
seq AS (SELECT v.c, o.pos, o.x, o.g FROM convs v JOIN own o ON o.c = v.base AND o.pos < v.h
  UNION ALL SELECT o.c, o.pos - h + lead, o.x, o.g FROM own o JOIN convs USING (c) WHERE o.pos >= h),
pre AS (SELECT c, pos + 1 AS d, length(x) AS len, string_agg(g, ',') OVER (PARTITION BY c ORDER BY pos) AS key
  FROM seq UNION ALL SELECT c, 0, 0, '' FROM convs),
node AS (SELECT d, key, min(c) AS conv, count(*) AS n, any_value(len) AS len FROM pre GROUP BY d, key),
total AS (SELECT c, max(d) AS d FROM pre GROUP BY c),
ends AS (SELECT d, key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e
  FROM pre JOIN total USING (c, d) GROUP BY d, key),
linked AS (SELECT n.*, q.key AS pkey FROM node n LEFT JOIN pre q ON q.c = n.conv AND q.d = n.d - 1),
kids AS (SELECT d - 1 AS d, pkey AS key, count(*) AS k FROM linked WHERE d > 0 GROUP BY ALL),
sums AS (SELECT a.d, a.key, sum((u.n - 1) * u.len) AS saved, count(*) FILTER (k IS NULL) AS leaves
  FROM linked u LEFT JOIN kids ON kids.d = u.d AND kids.key = u.key
  JOIN pre a ON a.c = u.conv AND a.d <= u.d GROUP BY a.d, a.key)
SELECT l.conv AS conv_id, l.d::BIGINT AS depth, p.conv AS parent_conv_id, l.n AS n_convs,
  coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  coalesce(e, sha256('')) AS ends_sha256
FROM linked l JOIN sums s ON s.d = l.d AND s.key = l.key LEFT JOIN kids c ON c.d = l.d AND c.key = l.key
LEFT JOIN ends z ON z.d = l.d AND z.key = l.key LEFT JOIN node p ON p.d = l.d - 1 AND p.key = l.pkey"""


def _codes() -> str:
    assigned = """
near{i} AS (SELECT rid, part, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
    SELECT rid, p.part, e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))
      ::BIGINT AS dist FROM parts p JOIN book{i} b ON p.part = b.part) GROUP BY rid, part)"""
    moved = """
book{j} AS (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN (
    SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
      SELECT part, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{i} JOIN parts USING (rid, part),
        range(1, (SELECT max(len(x)) + 1 FROM parts)) AS r(i) GROUP BY part, e, i) GROUP BY part, e) m
  ON m.part = b.part AND m.e = b.e)"""
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, vec_id, part, q[part * (len(q) // 16) + 1:(part + 1) * (len(q) // 16)] AS x
  FROM kept, range(16) AS r(part)),
book0 AS (SELECT part, rid - 1 AS e, x FROM parts WHERE rid <= 64),{assigned.format(i=0)},{moved.format(i=0, j=1)},
{assigned.format(i=1)},{moved.format(i=1, j=2)},{assigned.format(i=2)},
coded AS (SELECT rid, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code,
    sum(dist)::BIGINT AS error FROM near2 GROUP BY rid),
all_ AS (SELECT string_agg(array_to_string(x, ','), ',' ORDER BY part, e) AS b FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  sha256(b) AS codebooks_sha256
FROM kept JOIN coded USING (rid), all_"""


ORACLE = {
    "op6_sharding": _sharding(),
    "op7_decontamination": _decontamination(),
    "op8_minhash": _minhash(),
    "op9_licenses": _licenses(),
    "op10_suffixes": _suffixes(),
    "op11_trie": _trie(),
    "op12_codes": _codes(),
}
