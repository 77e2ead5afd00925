"""DuckDB SQL for the queries that SQL can express: the plain way to their rows, over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[ \t\n\x0b\f\r]+"

QUALITY = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8) x),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) x WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) x GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) x WHERE regexp_matches(l, '[^ \\t\\n\\x0b\\f\\r]') GROUP BY doc_id),
common AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS x FROM w) y GROUP BY 1, 2) z GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n - lines.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(lines.n, 0) AS n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_lettered, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks, coalesce(common.n, 0) AS n_common
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN common USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND 10 * n_dup_lines <= 3 * n_lines AND 2 * n_words <= word_chars AND word_chars <= 25 * n_words
    AND 10 * n_lettered >= 7 * n_words AND 2 * n_marks <= n_words AND 10 * n_common <= 3 * n_words AS kept
FROM b
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n_shingles + q.n_shingles - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""

#: crc32 of the UTF-8 bytes of {0}, as an expression over a table t with the column tab.
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(hex(encode({0}))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))), "
    "lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295)"
)
_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

IMPORTANCE = f"""
WITH t AS ({_CRC_TABLE}),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) x GROUP BY r, w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) x GROUP BY w),
buckets AS (SELECT w, {_CRC.format("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw) x, t),
s AS (SELECT b, CAST(sum(n) AS DOUBLE) AS s FROM dw JOIN buckets USING (w) GROUP BY b),
u AS (SELECT b, CAST(sum(n) AS DOUBLE) AS t FROM bw JOIN buckets USING (w) GROUP BY b),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS ss, coalesce((SELECT sum(t) FROM u), 0) AS tt),
gain AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN u ON u.b = s.b, total),
sums AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS g, CAST(sum(n) AS BIGINT) AS n FROM dw JOIN buckets USING (w) JOIN gain USING (b) GROUP BY r),
f AS (SELECT d.r, doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight, CAST(('0x' || substr(sha256('2024:' || doc_id), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN sums USING (r)),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM f),
ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN rank <= (10 * (SELECT count(*) FROM ranks)) // 100 THEN rank END AS rank
FROM e LEFT JOIN ranks USING (r)
"""

TRIE = f"""
WITH t AS ({_CRC_TABLE}),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o) x, t),
r AS (SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN o ON o.conv_id = c.base AND place <= h UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN o USING (conv_id) WHERE place > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, sha256(length(role) || ':' || role || text) AS k,
  len(list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '')) AS words FROM r),
l AS (SELECT c.conv_id, coalesce(list(k ORDER BY depth) FILTER (k IS NOT NULL), []) AS ks FROM c LEFT JOIN s USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, d AS depth, array_to_string(ks[1:d], '') AS path, len(ks) = d AS ends FROM (SELECT conv_id, ks, unnest(range(0, len(ks) + 1)) AS d FROM l) x),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM p GROUP BY path, depth),
v AS (SELECT n.*, q.conv_id AS parent_conv_id, CASE WHEN n.depth > 0 THEN (n_convs - 1) * s.words ELSE 0 END AS saving,
    NOT EXISTS (SELECT 1 FROM n k WHERE k.depth = n.depth + 1 AND substr(k.path, 1, 64 * n.depth) = n.path) AS leaf, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND substr(k.path, 1, 64 * n.depth) = n.path) AS n_children
  FROM n LEFT JOIN (SELECT path, depth, conv_id FROM n) q ON q.depth = n.depth - 1 AND q.path = substr(n.path, 1, 64 * (n.depth - 1)) LEFT JOIN s ON s.conv_id = n.conv_id AND s.depth = n.depth),
up AS (SELECT d AS depth, substr(path, 1, 64 * d) AS path, count(*) FILTER (leaf) AS n_leaves, sum(saving) AS saved FROM (SELECT path, leaf, saving, unnest(range(0, depth + 1)) AS d FROM v) x GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM v JOIN up USING (depth, path)
"""

SUBSTRINGS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS k FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM d WHERE length(x) >= 800) y),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM p) y WHERE n > 1),
new AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM hit),
num AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM new),
spans AS (SELECT r, span, min(i) AS a, max(i) + 400 AS b FROM num GROUP BY r, span),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r),
rest AS (SELECT r, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, length(x) // 2) - a)), '' ORDER BY a) AS x FROM gaps JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY r)
SELECT doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(rest.x, d.x))) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN rest USING (r)
"""
