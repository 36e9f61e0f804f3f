"""DuckDB SQL for the queries that SQL can express."""

# Base32 from the hex digest: the 40 digits as one bit string, five bits at a time.
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + b, 1), '' ORDER BY k) AS digest
  FROM (
    SELECT hex, 4 * c + j AS k, ((CAST('0x' || substr(hex, 1 + 5 * c, 5) AS BIGINT) >> (15 - 5 * j)) & 31)::INT AS b
    FROM (SELECT DISTINCT hex FROM p), (SELECT unnest(range(8)) AS c), (SELECT unnest(range(4)) AS j))
  GROUP BY hex),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id > first THEN first END AS refers_to
FROM f JOIN d USING (hex)
"""

SUBSTRINGS = r"""
WITH lists AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
grams AS (
  SELECT doc_id, i, string_agg(w, ' ') OVER win AS g, count(*) OVER win AS c
  FROM words WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
again AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM grams WHERE c = 20) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, (SELECT unnest(range(20)) AS k)),
kept AS (
  SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(w, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM lists LEFT JOIN kept USING (doc_id)
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         CAST(source_size AS DOUBLE) * 2 AS cap
  FROM s),
r AS (
  SELECT *, cap / weight AS ratio,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / CAST(sum(weight) OVER ()
           - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, ratio) FROM r WHERE ratio > level), cap)) AS target FROM r),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
keys AS (
  SELECT d.source, k, sum(size) AS key_size, any_value(target - whole * source_size) AS missing
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source GROUP BY d.source, k),
picked AS (
  SELECT source, k, sum(key_size) OVER (PARTITION BY source ORDER BY k) - key_size / 2 <= missing AND missing > 0 AS more FROM keys)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.whole + CASE WHEN picked.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN picked ON d.source IS NOT DISTINCT FROM picked.source AND d.k = picked.k
"""

_RATES = ("word_length", "symbols", "dup_lines", "repeats")

QUALITY = r"""
WITH base AS (
  SELECT row_number() OVER () AS i, doc_id, lang, source, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT i, unnest(range(len(w) - 2)) AS p, w FROM base WHERE len(w) >= 3),
gram_text AS (SELECT i, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS g FROM grams),
often AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY i, g) AS n FROM gram_text) WHERE n >= 2),
gaps AS (SELECT i, least(3, coalesce(lead(p) OVER (PARTITION BY i ORDER BY p) - p, 3)) AS gap FROM often),
reps AS (SELECT i, CAST(sum(gap) AS BIGINT) AS n_repeat_words FROM gaps GROUP BY i),
counts AS (
  SELECT base.i, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS word_chars0,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM base LEFT JOIN reps USING (i)),
rated AS (
  SELECT * REPLACE (coalesce(word_chars0, 0) AS word_chars0),
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * coalesce(word_chars0, 0) // greatest(n_words, 1) AS word_length,
         1000 * n_symbols // greatest(coalesce(word_chars0, 0), 1) AS symbols,
         1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
         1000 * n_repeat_words // greatest(n_words, 1) AS repeats
  FROM counts),
long AS (
  SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 10, 0)) << greatest(length(bin(v)) - 10, 0) AS b
  FROM (""" + " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {r} AS v FROM rated WHERE NOT base_failed" for r in _RATES) + r""")),
every AS (
  SELECT 2 AS level, lang, source, rate, b FROM long UNION ALL
  SELECT 1, lang, NULL, rate, b FROM long UNION ALL
  SELECT 0, NULL, NULL, rate, b FROM long),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY level, lang, source, rate) AS docs,
         count(*) OVER (PARTITION BY level, lang, source, rate ORDER BY b) AS upto
  FROM every),
quart AS (
  SELECT level, lang, source, rate, any_value(docs) AS docs, min(CASE WHEN 4 * upto >= docs THEN b END) AS q1, min(CASE WHEN 4 * upto >= 3 * docs THEN b END) AS q3
  FROM ranked GROUP BY ALL),
fence AS (
  SELECT *, 6 * (q3 - q1) + CASE rate WHEN 'word_length' THEN 60 WHEN 'symbols' THEN 20 WHEN 'dup_lines' THEN 340 ELSE 450 END AS reach FROM quart),
groups AS (
  SELECT g.lang, g.source, g.rate,
         CASE WHEN g.docs >= 40 THEN g.q1 - g.reach WHEN m.docs >= 40 THEN m.q1 - m.reach ELSE o.q1 - o.reach END AS low,
         CASE WHEN g.docs >= 40 THEN g.q3 + g.reach WHEN m.docs >= 40 THEN m.q3 + m.reach ELSE o.q3 + o.reach END AS high
  FROM fence g JOIN fence m ON m.level = 1 AND m.lang IS NOT DISTINCT FROM g.lang AND m.rate = g.rate
  JOIN fence o ON o.level = 0 AND o.rate = g.rate WHERE g.level = 2),
wide AS (
  SELECT lang, source, max(CASE WHEN rate = 'word_length' THEN low END) AS low_wl, """ + ", ".join(
    f"max(CASE WHEN rate = '{r}' THEN high END) AS high_{r}" for r in _RATES
) + r""" FROM groups GROUP BY lang, source)
SELECT doc_id, n_words, word_chars0 AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_length >= low_wl AND """ + " AND ".join(f"{r} <= high_{r}" for r in _RATES) + r""", false) AS kept
FROM rated LEFT JOIN wide ON rated.lang IS NOT DISTINCT FROM wide.lang AND rated.source IS NOT DISTINCT FROM wide.source
"""

# CRC-32 byte by byte with the usual table; a pair of words is near if deleting one code point makes them equal, at the same place if equally long.
VARIANTS = r"""
WITH slots AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counts AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY doc_id, run),
bytes AS (
  SELECT *, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)) AS b
  FROM counts),
hashed AS (
  SELECT run, c, length(run) AS size, xor(list_reduce(b, lambda h, x: xor(h >> 8, t[1 + (xor(h, x) & 255)]), 4294967295), 4294967295) AS h
  FROM bytes, slots),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % size AS INT)) || substr(run, CAST(h % size AS INT) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
  SELECT c.word, c.at AS root FROM c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
"""

SEARCH = r"""
WITH terms AS (
  SELECT doc_id, row_number() OVER () AS i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
tf AS (SELECT i, t, count(*) AS tf FROM (SELECT i, unnest(ts) AS t FROM terms) GROUP BY i, t),
totals AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS every FROM terms WHERE len(ts) > 0),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), totals),
sizes AS (SELECT i, doc_id, 50 + (50 * CAST(len(ts) AS BIGINT) * docs) // every AS m FROM terms, totals WHERE len(ts) > 0),
scores AS (
  SELECT item_id, doc_id, i, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (t) JOIN tf USING (t) JOIN sizes USING (i) GROUP BY item_id, doc_id, i),
ranks AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranks WHERE rank <= 50
"""

# All pairs of equal labels, then everything that links reach.
VECTORS = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.i AS a, b.i AS b FROM usable a JOIN usable b ON a.label = b.label AND a.i <> b.i AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 93e-2),
reach AS (
  SELECT i AS a, i AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
groups AS (SELECT r.a, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.i = r.b GROUP BY r.a)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE links.a = v.i) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN groups ON groups.a = v.i
"""

# All pairs of documents that share a shingle, then everything that links reach.
NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS i, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
grams AS (
  SELECT DISTINCT i, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(len(ws) - 2), lambda k: ws[k + 1] || ' ' || ws[k + 2] || ' ' || ws[k + 3])
                                 WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w),
sizes AS (SELECT i, count(*) AS n FROM grams GROUP BY i),
pairs AS (SELECT a.i AS a, b.i AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.i <> b.i GROUP BY a.i, b.i),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.i = a JOIN sizes y ON y.i = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (
  SELECT i AS a, i AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
groups AS (SELECT r.a, min(w.doc_id) AS component_id FROM reach r JOIN w ON w.i = r.b GROUP BY r.a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM w LEFT JOIN sizes ON sizes.i = w.i JOIN groups ON groups.a = w.i
"""
