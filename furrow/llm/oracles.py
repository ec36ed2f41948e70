"""DuckDB twins of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM benchmark),
pat AS (
  SELECT item_id, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w
  FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM pat),
lens AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m),
hit AS (SELECT doc_id, i, pos.m, item_id FROM pos
        JOIN win ON win.m = pos.m AND win.t = array_to_string(pos.w[i:i + pos.m - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{_SPACED}')] AS lines
  FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS t FROM pos),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r
        FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (CAST(failed AS INTEGER) & 3) <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS INTEGER) AS failed
FROM f
"""

OP7 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id
                    GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * k >= 75 * (p.n + q.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, r) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON e.a = reach.r),
least_of AS (SELECT a, min(r) AS r FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(r, d.doc_id)) AS component_id, d.doc_id <= coalesce(r, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON least_of.a = d.doc_id
"""

# crc32 of an ASCII string, bit by bit; list_reduce starts with the first element of its list.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split(k, ''), lambda x: CAST(unicode(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, crc_table.t[CAST(xor(c, b) & 255 AS INT) + 1])))"""

OP13 = rf"""
WITH RECURSIVE
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, z:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
          FROM conversations),
drawn AS (SELECT *, {_CRC32} % 20 AS d FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS r,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
t AS MATERIALIZED (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM marked),
-- states: 0 nothing, 1 after s, 2 after u, 3 after a
moves(p, r, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins(p, q, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (3, 2, 1), (2, 3, 1), (0, 3, 2), (1, 3, 2)),
convs AS (SELECT DISTINCT conv_id, coalesce(conv_id, -1) AS c FROM conversations),
edits AS MATERIALIZED (
  SELECT coalesce(conv_id, -1) AS c, i, moves.p, moves.q, 0 + CAST(fault = 'truncated' AS INT) AS cost, 'K' AS e
  FROM t JOIN moves ON moves.r = t.r WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT coalesce(conv_id, -1), i, moves.p, moves.q, 2 + CAST(fault = 'truncated' AS INT), 'R'
  FROM t JOIN moves ON moves.r IN ('u', 'a') AND moves.r <> t.r WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT coalesce(conv_id, -1), i, p, p, 3, 'D' FROM t, (VALUES (0), (1), (2), (3)) AS s(p)),
best(c, i, q, w) AS (
  SELECT c, 0::BIGINT, ins.q, {{'cost': CAST(2 * n AS BIGINT), 'audit': repeat('I', n)}} FROM convs, ins WHERE ins.p = 0
  UNION ALL
  SELECT b.c, b.i + 1, ins.q, min({{'cost': b.w.cost + e.cost + 2 * n, 'audit': b.w.audit || e.e || repeat('I', n)}})
  FROM best b JOIN edits e ON e.c = b.c AND e.i = b.i + 1 AND e.p = b.q JOIN ins ON ins.p = e.q
  GROUP BY b.c, b.i + 1, ins.q),
last AS (SELECT c, max(i) AS i FROM best GROUP BY c),
chosen AS MATERIALIZED (SELECT c, min(w) AS w FROM best JOIN last USING (c, i) WHERE q IN (0, 3) GROUP BY c),
letters AS (SELECT c, unnest(string_split(w.audit, '')) AS e, unnest(range(1, length(w.audit) + 1)) AS j FROM chosen WHERE w.audit <> ''),
numbered AS (
  SELECT *, sum(CAST(e <> 'I' AS INT)) OVER (PARTITION BY c ORDER BY j) AS i,
         sum(CAST(e <> 'D' AS INT)) OVER (PARTITION BY c ORDER BY j) AS o FROM letters),
lines AS (
  SELECT n.c, n.j, n.e, n.o, t.role, t.text, t.r FROM numbered n LEFT JOIN t ON coalesce(t.conv_id, -1) = n.c AND t.i = n.i
  WHERE n.e <> 'D'),
system AS (SELECT c, max(CAST(o = 1 AND e = 'K' AND r = 's' AS INT)) AS s FROM lines GROUP BY c),
written AS (
  SELECT c, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END
                              || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha
  FROM lines JOIN system USING (c) GROUP BY c),
tally AS (
  SELECT coalesce(conv_id, -1) AS c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM t GROUP BY 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(w.cost AS BIGINT) AS cost, w.audit AS audit,
       coalesce(sha, sha256('')) AS repaired_sha256
FROM convs LEFT JOIN tally USING (c) LEFT JOIN chosen USING (c) LEFT JOIN written USING (c)
"""

OP12 = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
sizes AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS p
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY lang, k, p HAVING count(*) >= 100),
inside AS (
  SELECT lang, p[i:i + m - 1] AS p, max(a) AS a
  FROM (SELECT lang, p, a, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS m) WHERE m < k)
  GROUP BY 1, 2),
cuts AS (
  SELECT f.lang, f.p, f.a, f.j, l.a AS l, r.a AS r, n, (1000::HUGEINT * f.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) f
  JOIN f l ON l.lang = f.lang AND l.p = f.p[1:f.j] JOIN f r ON r.lang = f.lang AND r.p = f.p[f.j + 1:f.k]
  JOIN sizes ON sizes.lang = f.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
ranked AS (
  SELECT best.lang, array_to_string(best.p, ' ') AS phrase, best.a, l, r, n, score,
         row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, array_to_string(best.p, ' ')) AS rank
  FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.p = best.p AND 100 * inside.a >= 100 * best.a
  WHERE inside.a IS NULL)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

ORACLES = {"op3_decontamination": OP3, "op4_quality_rules": OP4, "op7_minhash_near_dedup": OP7,
           "op12_collocations": OP12, "op13_conversation_repair": OP13}
