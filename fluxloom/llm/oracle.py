"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
#: Starts of the windows of n entries of the list w, from 1.
_STARTS = "range(1, len(w) - {n} + 2)"

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[k:k+3] END AS shingle FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [1] ELSE {_STARTS.format(n=4)} END) AS k FROM d))),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100*c >= 85*(x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, source, text, i, line, regexp_extract_all(line, {_SPACED}) AS lw FROM (SELECT doc_id, source, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)),
y AS (SELECT *, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm FROM x WHERE len(lw) > 0),
often AS (SELECT source, norm FROM y GROUP BY 1, 2 HAVING count(DISTINCT text) > 50),
z AS (SELECT y.doc_id, y.i, y.lw, o.norm IS NOT NULL AS hit FROM y LEFT JOIN often o ON o.norm = y.norm AND o.source IS NOT DISTINCT FROM y.source),
gone AS (SELECT doc_id, sum(len(lw)) FILTER (hit) AS n, flatten(coalesce(list(lw ORDER BY i) FILTER (NOT hit), [])) AS w FROM z GROUP BY 1 HAVING bool_or(hit)),
k2 AS (SELECT doc_id, k, array_to_string(w[k:k+7], ' ') AS win FROM (SELECT doc_id, unnest({_STARTS.format(n=8)}) AS k, w FROM gone)),
h2 AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k2), range(0, 8) t(j) WHERE c > 1 GROUP BY 1),
left_ AS (SELECT doc_id, len(w) < 20 OR 100*coalesce(h2.n, 0) > 30*len(w) AS bad FROM gone LEFT JOIN h2 USING (doc_id)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM y GROUP BY 1),
k AS (SELECT doc_id, k, array_to_string(w[k:k+7], ' ') AS win FROM (SELECT doc_id, unnest({_STARTS.format(n=8)}) AS k, w FROM d)),
g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k),
h AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM (SELECT doc_id, k FROM g WHERE c > 1), range(0, 8) t(j) GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda t: length(t))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d)
SELECT m.doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words,
  n_words < 20 OR 100*coalesce(h.n, 0) > 30*n_words AS base_failed, NOT (n_words < 20 OR 100*coalesce(h.n, 0) > 30*n_words) AND n_words - coalesce(gone.n, 0) >= 0.75*n_words AND NOT coalesce(left_.bad, false) AS kept
FROM m LEFT JOIN dup ON dup.doc_id = m.doc_id LEFT JOIN h ON h.doc_id = m.doc_id LEFT JOIN gone ON gone.doc_id = m.doc_id LEFT JOIN left_ ON left_.doc_id = m.doc_id
"""

OP4 = """
WITH p AS (SELECT page_id, nullif(url, '') AS url, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, url FROM q
"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_PLAIN}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, {_PLAIN}) AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, w[k:k+9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
c AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM v)),
o AS (SELECT doc_id, k, c.size, item_id FROM c JOIN v ON v.size = c.size AND v.win = w[k:k+c.size-1]),
h AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
k AS (SELECT doc_id, unnest({_STARTS.format(n=50)}) AS k, w FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS first FROM (SELECT doc_id, k, sha256(array_to_string(w[k:k+49], ' ')) AS s FROM k)),
r AS (SELECT doc_id, k FROM g WHERE first < doc_id),
b AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
c AS (SELECT b.doc_id, pos, word, coalesce(pos - max(r.k) OVER (PARTITION BY b.doc_id ORDER BY pos) < 50, false) AS gone FROM b LEFT JOIN r ON r.doc_id = b.doc_id AND r.k = b.pos),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS gone, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

#: The crc of a gram's bytes: eight shifts make a table of 256 entries, each byte is one look-up.
OP12 = f"""
WITH table_ AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END) AS v FROM range(256) r(i))),
d AS (SELECT 0 AS kind, doc_id, regexp_extract_all({_LOW}, {_PLAIN}) AS w FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all({_LOW}, {_PLAIN}) FROM benchmark),
f AS (SELECT kind, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM d),
c AS (SELECT kind, doc_id, gram, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT gram, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(gram))), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::BIGINT)), lambda x, y: xor(t[xor(x % 256, y) + 1], x // 256))) % 10000 AS bucket FROM (SELECT DISTINCT gram FROM c), table_),
b AS (SELECT kind, doc_id, bucket, sum(n) AS n FROM c JOIN g USING (gram) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM b GROUP BY 1),
v AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000)))) AS gain FROM s),
m AS (SELECT doc_id, sum(n)::BIGINT AS n, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM b JOIN v USING (bucket) WHERE kind = 0 GROUP BY 1),
x AS (SELECT d.doc_id, len(w) AS n_words, coalesce(m.n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id) WHERE kind = 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS many FROM x WHERE n_words >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN k <= 25 * many // 100 THEN k END AS rank FROM x LEFT JOIN r USING (doc_id)
"""

OP13 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS size, sha256('13:' || doc_id)[1:16] AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY 1),
o AS (SELECT *, 3 * source_size AS cap, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM s WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) AS first FROM o WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN first IS NULL OR k < first THEN cap::DOUBLE ELSE (SELECT level FROM o, f WHERE k = first) * weight END AS target FROM o, f),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM t),
c AS (SELECT doc_id, size, source_size, target, whole, quota - whole * source_size - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, free)))::BIGINT AS taken FROM c
"""
