"""Registered queries in SQL, where it can express them."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op7_url_verdicts"] = """
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

ORACLES["op2_contamination"] = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_LETTERED}') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_LETTERED}') AS w FROM benchmark
), item_places AS (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS p FROM i WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM item_places
), doc_places AS (
  SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS p
  FROM d, (SELECT DISTINCT n FROM item_windows) AS sizes WHERE len(w) >= n
), doc_windows AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM doc_places
), hits AS (
  SELECT doc_id, p, n, item FROM doc_windows JOIN item_windows USING (n, s)
), words_hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) AS x GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) AS y GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit ON d.doc_id = words_hit.doc_id LEFT JOIN items_hit ON d.doc_id = items_hit.doc_id
"""

ORACLES["op6_substrings"] = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, CAST(len(w) - 33 AS BIGINT))) AS p FROM d WHERE len(w) >= 35
), windows AS (
  SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS s FROM places
), again AS (
  SELECT s FROM windows GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM windows JOIN again USING (s)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS q FROM d
), kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.q) AS text
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.q = gone.q WHERE gone.q IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

# A line's documents are its host's distinct texts; the limits are those of the quality module.
ORACLES["op5_line_rules"] = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents
), lines AS (
  SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d
), worded AS (
  SELECT doc_id, source, t, line, {_LOWER.replace('text', 'line')} AS lowered, len(regexp_extract_all(line, '{_SPACED}')) AS n FROM lines
), held AS (
  SELECT doc_id, source, t, line, array_to_string(regexp_extract_all(lowered, '{_SPACED}'), ' ') AS norm, n FROM worded WHERE n > 0
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM held GROUP BY doc_id
), hosts AS (
  SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source
), frequent AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT t) AS docs FROM held GROUP BY source, norm) AS f
  JOIN hosts USING (source) WHERE docs > 50 OR (docs >= 5 AND 2 * docs > texts)
), lost AS (
  SELECT doc_id, sum(n) AS lost FROM held JOIN frequent USING (source, norm) GROUP BY doc_id
), threes AS (
  SELECT doc_id, w, unnest(range(1, CAST(len(w) - 1 AS BIGINT))) AS p FROM d WHERE len(w) >= 3
), named AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 2), ' ') AS s FROM threes
), twice AS (
  SELECT doc_id, s FROM named GROUP BY doc_id, s HAVING count(*) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT named.doc_id, unnest(range(p, p + 3)) AS q FROM named JOIN twice ON named.doc_id = twice.doc_id AND named.s = twice.s
  ) AS r GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lost, 0) AS lost
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN repeated ON d.doc_id = repeated.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words - lost < 0.3 * n_words) AS kept
FROM judged
"""

# Phrases of one to three words of each piece, counted; a phrase's parts are phrases too.
ORACLES["op11_collocations"] = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS g FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, CAST(len(w) AS BIGINT)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, CAST(len(w) - 1 AS BIGINT)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p
), f AS (
  SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g
), n AS (
  SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, g, a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), inside AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS g, a FROM candidates WHERE k = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3
), longer AS (
  SELECT lang, g, max(a) AS longer FROM inside GROUP BY lang, g
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, g) WHERE c.k = 3 OR longer IS NULL OR 100 * longer < 50 * c.a
), cuts AS (
  SELECT lang, k, g, a, 1 AS cut, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM kept
  UNION ALL SELECT lang, k, g, a, 2, array_to_string(w[1:2], ' '), w[3] FROM kept WHERE k = 3
), scored AS (
  SELECT c.lang, c.g, c.a, c.cut, l.a AS l, r.a AS r,
         CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.first JOIN f r ON r.lang = c.lang AND r.g = c.rest
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS nth FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM best WHERE nth = 1
)
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

# Every filter's place in every order; a document is removed by the first filter of the order that it fails.
ORACLES["op12_filter_audit"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first FROM d GROUP BY t
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 10 * length(d.t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts ON d.t = firsts.t LEFT JOIN marks ON d.doc_id = marks.doc_id
), cells AS (
  SELECT part, fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, CAST(step AS BIGINT), 1) AS x, substr(filter_order, 1, CAST(step - 1 AS BIGINT)) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) AS s
), judged AS (
  SELECT part, filter_order, step, x, docs, good, toxic, fails,
         contains(fails, x) AS here, len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 AND before <> '' AND fails <> '' AS gone
  FROM steps, cells
), counted AS (
  SELECT part, filter_order, step, x,
         sum(CASE WHEN NOT gone AND NOT here THEN docs ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND here THEN docs ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND here THEN docs ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN docs ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND here THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND here THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
"""
