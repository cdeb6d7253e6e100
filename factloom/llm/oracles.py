"""SQL for the queries of this package whose rows it can give on whole tables; texts are read as the contract words it."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def near_duplicates(words: int, percent: int) -> str:
    return f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {words} + 2, 2))) AS i FROM texts WHERE len(ws) > 0),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {words - 1}], ' ') AS s FROM places),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * met >= {percent} * (x.n + y.n - met)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
component AS (SELECT a, min(b) AS least FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id, coalesce(least, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN component c ON d.doc_id = c.a
"""


def repeated_bytes(size: int) -> str:
    return f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
parts AS (SELECT r, k, substr(h, 1000 * k + 1, 1000 + {2 * size}) AS part, n FROM (SELECT *, unnest(range(0, n // 500 + 1)) AS k FROM texts WHERE n >= {size})),
windows AS MATERIALIZED (SELECT r, 500 * k + j AS i, md5(substr(part, 2 * j + 1, {2 * size})) AS w FROM (SELECT *, unnest(range(0, least(500, n - {size} + 1 - 500 * k))) AS j FROM parts)),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM windows SEMI JOIN twice USING (w)),
runs AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + {size} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hits),
spans AS MATERIALIZED (SELECT r, k, min(i) AS x, max(i) + {size} AS y FROM runs GROUP BY r, k),
edges AS (SELECT r, x, y, lag(y, 1, 0) OVER (PARTITION BY r ORDER BY x) AS z FROM spans UNION ALL SELECT r, n, n, coalesce((SELECT max(y) FROM spans s WHERE s.r = texts.r), 0) FROM texts),
kept AS (SELECT e.r, string_agg(substr(h, 2 * z + 1, 2 * (x - z)), '' ORDER BY z) AS h FROM edges e JOIN texts t ON e.r = t.r GROUP BY e.r),
removed AS (SELECT r, CAST(sum(y - x) AS BIGINT) AS n, count(*) AS k FROM spans GROUP BY r)
SELECT doc_id, t.n AS n_bytes, coalesce(m.n, 0) AS n_removed, coalesce(m.k, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM texts t JOIN kept ON t.r = kept.r LEFT JOIN removed m ON t.r = m.r
"""


def copied_words(size: int) -> str:
    return f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
windows AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(ws[i:i + {size - 1}], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - {size} + 2)) AS i FROM texts WHERE len(ws) >= {size})),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
hit AS (SELECT DISTINCT r, unnest(range(i, i + {size})) AS p FROM windows JOIN firsts USING (w) WHERE doc_id > first),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM texts),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS t FROM words ANTI JOIN hit USING (r, p) GROUP BY r),
removed AS (SELECT r, count(*) AS n FROM hit GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r) LEFT JOIN removed USING (r)
"""


#: The columns of op8 that no learned verdict decides.
STATISTICS = f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
windows AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - 6)) AS i FROM texts WHERE len(ws) >= 8)),
twice AS (SELECT r, w FROM windows GROUP BY r, w HAVING count(*) > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM windows JOIN twice USING (r, w)) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, {_WORD}) GROUP BY r),
counts AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM texts LEFT JOIN lines l USING (r) LEFT JOIN repeats p USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
"""


def contaminated(window: int) -> str:
    return f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
searched AS (SELECT item, least({window}, len(ws)) AS n, ws, unnest(range(1, greatest(len(ws) - {window} + 2, 2))) AS i FROM items WHERE len(ws) > 0),
wanted AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM searched),
places AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM texts CROSS JOIN (SELECT DISTINCT n FROM wanted) WHERE len(ws) >= n),
found AS MATERIALIZED (SELECT r, i, n, item FROM (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM places) JOIN wanted USING (n, w)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM texts LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""


def _crc_table() -> list[int]:
    """The 256 entries of CRC-32 by its rule: eight shifts, each followed by the reversed polynomial where a one falls out."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 * (c & 1))
        table.append(c)
    return table


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string expression's UTF-8 bytes."""
    digit = lambda k: f"strpos('0123456789ABCDEF', x[{k}]) - 1"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ({digit(1)}) * 16 + {digit(2)})"
    return f"xor(list_reduce({data}, lambda c, x: xor(({_crc_table()})[1 + (xor(c, x) & 255)], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295)"


def importance(buckets: int, percent: int, least: int, seed: int) -> str:
    return f"""
WITH texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, {_LOWER} AS text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, {_LOWER} FROM benchmark),
cut AS MATERIALIZED (SELECT side, r, doc_id, regexp_extract_all(text, {_ALNUM}) AS ws FROM texts),
runs AS MATERIALIZED (SELECT side, r, array_to_string(ws[i:i + k - 1], ' ') AS f FROM (SELECT side, r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS k FROM cut) WHERE len(ws) >= k)),
hashed AS MATERIALIZED (SELECT f, {crc32("f")} % {buckets} AS bucket FROM (SELECT DISTINCT f FROM runs)),
marks AS MATERIALIZED (SELECT side, r, bucket, count(*) AS n FROM runs JOIN hashed USING (f) GROUP BY ALL),
sizes AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) AS t FROM marks GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sizes) + {buckets}) / ((s + 1) * ((SELECT sum(t) FROM sizes) + {buckets})))) AS gain FROM sizes),
weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM marks JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
noise AS (SELECT r, doc_id, len(ws) AS n_words, CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM cut WHERE side = 0),
scores AS (SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM noise LEFT JOIN weights USING (r)),
placed AS (SELECT *, CASE WHEN n_words >= {least} THEN row_number() OVER (PARTITION BY n_words >= {least} ORDER BY score DESC, doc_id NULLS FIRST, weight DESC) END AS place FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {percent} * count(*) // 100 FROM scores WHERE n_words >= {least}) THEN place END AS rank, n_words FROM placed
"""


def spelling(length: int, count: int, ratio: int, rare: int) -> str:
    return f"""
WITH RECURSIVE runs AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= {length} GROUP BY doc_id, w),
hashed AS (SELECT w, n, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM runs),
written AS (SELECT CASE WHEN h % {rare} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM written WHERE length(word) >= {length} GROUP BY word HAVING sum(n) >= {count}),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
inserted AS (SELECT DISTINCT c.word AS x, c.n AS nx, w.word AS y, w.n AS ny FROM cut c JOIN words w ON c.rest = w.word),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION ALL SELECT x, y, ny FROM inserted UNION ALL SELECT y, x, nx FROM inserted),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {ratio} * w.n THEN form END AS form, CASE WHEN form_n >= {ratio} * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
follow AS (SELECT word, word AS here, 0 AS depth FROM formed UNION ALL SELECT f.word, g.form, depth + 1 FROM follow f JOIN formed g ON f.here = g.word WHERE g.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, depth) AS root FROM follow GROUP BY word)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN roots ON formed.word = roots.word
"""


_MARKS = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
CHAT = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{_MARKS}'), (-1, 1, 'assistant', '{_MARKS}')),
turns AS (SELECT *, '<|im_start|>' || {_ESCAPED.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")} || chr(10) || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10) AS formatted FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
