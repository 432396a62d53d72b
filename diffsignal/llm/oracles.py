"""DuckDB SQL of the operators that SQL can express, written from their contracts alone."""

_SEP = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '{_SEP}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS t FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, 10 * n_symbols > n_words AS symbols_failed, 100 * n_dup_lines > 30 * n_lines AS lines_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS a, count(*) FILTER (symbols_failed) AS b, count(*) FILTER (lines_failed) AS c FROM f GROUP BY host),
mo AS (SELECT avg(a / n) AS ma, var_pop(a / n) AS va, avg(b / n) AS mb, var_pop(b / n) AS vb, avg(c / n) AS mc, var_pop(c / n) AS vc FROM h),
k AS (SELECT *, CASE WHEN va > 0 THEN least(greatest(ma * (1 - ma) / va - 1, 1), 1e6) ELSE 1e6 END AS ka,
             CASE WHEN vb > 0 THEN least(greatest(mb * (1 - mb) / vb - 1, 1), 1e6) ELSE 1e6 END AS kb,
             CASE WHEN vc > 0 THEN least(greatest(mc * (1 - mc) / vc - 1, 1), 1e6) ELSE 1e6 END AS kc FROM mo),
v AS (SELECT host, greatest((a + ma * ka) / (n + ka), (b + mb * kb) / (n + kb), (c + mc * kc) / (n + kc)) > 0.5 AS host_rejected FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT host_rejected) AS kept, host_rejected
FROM f JOIN v USING (host)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SEP}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS t FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.c AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) g ON g.x = w.doc_id
"""

LEAKS = r"""
WITH b AS (SELECT DISTINCT item_id, words FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark) WHERE len(words) >= 1),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
bw AS (SELECT item_id, len(words) AS n, i, words[i] AS word FROM (SELECT *, unnest(generate_series(1, len(words))) AS i FROM b)),
dw AS (SELECT doc_id, i, words[i] AS word FROM (SELECT *, unnest(generate_series(1, len(words))) AS i FROM d)),
b4 AS (SELECT item_id, i, array_to_string(words[i:i + 3], ' ') AS t FROM (SELECT *, unnest(generate_series(1, len(words) - 3)) AS i FROM b WHERE len(words) >= 4)),
d4 AS (SELECT doc_id, i, array_to_string(words[i:i + 3], ' ') AS t FROM (SELECT *, unnest(generate_series(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 4)),
c AS (SELECT DISTINCT doc_id, item_id, d4.i - b4.i AS shift FROM d4 JOIN b4 USING (t)
      UNION SELECT doc_id, item_id, dw.i - 1 FROM b JOIN dw ON dw.word = b.words[1] WHERE len(b.words) < 4),
e AS (SELECT c.*, bw.n, bw.i, (CASE WHEN dw.word = bw.word THEN 1 ELSE 0 END) AS equal FROM c JOIN bw USING (item_id) LEFT JOIN dw ON dw.doc_id = c.doc_id AND dw.i = bw.i + c.shift),
s AS (SELECT *, sum(equal) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS got, sum(equal) OVER (PARTITION BY doc_id, item_id, shift) AS total FROM e),
f AS (SELECT doc_id, item_id, shift, n, total FROM s WHERE (n >= 12 AND got >= 10) OR (n < 12 AND total = n) GROUP BY ALL)
SELECT doc_id, item_id, total::BIGINT AS n_equal, n::BIGINT AS item_words, shift::BIGINT AS first_word
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY total DESC, shift) AS k FROM f) WHERE k = 1
"""

RESAMPLING = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
df AS (SELECT doc_id, unnest(w) AS f FROM d UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d)),
gf AS (SELECT unnest(w) AS f FROM g UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM g)),
dc AS (SELECT doc_id, f, count(*) AS n FROM df GROUP BY ALL),
fs AS (SELECT DISTINCT f FROM dc UNION SELECT DISTINCT f FROM gf),
k AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
h AS (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(generate_series(1, octet_length(encode(f))), lambda j: ('0x' || hex(encode(f))[2 * j - 1:2 * j])::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS b FROM fs, k),
s AS (SELECT b, sum(n) AS n FROM dc JOIN h USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM gf JOIN h USING (f) GROUP BY b),
u AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s, (SELECT coalesce(sum(n), 0) FROM t) AS t),
ga AS (SELECT b.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (u.s + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (u.t + 10000)::DOUBLE)))::BIGINT AS gain
       FROM (SELECT b::BIGINT AS b FROM range(10000) r(b)) b LEFT JOIN s ON s.b = b.b LEFT JOIN t ON t.b = b.b, u),
w AS (SELECT doc_id, sum(n * gain) AS total, sum(n) AS m FROM dc JOIN h USING (f) JOIN ga USING (b) GROUP BY doc_id),
x AS (SELECT d.doc_id, len(d.w) AS words, coalesce(w.m, 0)::BIGINT AS n_features, CASE WHEN w.m > 0 THEN ((w.total - (((w.total % w.m) + w.m) % w.m)) // w.m)::BIGINT ELSE 0 END AS weight, ('0x' || sha256('7:' || d.doc_id)[1:8])::UBIGINT::DOUBLE AS h FROM d LEFT JOIN w ON d.doc_id = w.doc_id),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS k, count(*) FILTER (words >= 20) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank FROM r
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""
