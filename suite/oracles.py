"""The registered queries in SQL (DuckDB dialect), stated independently of the DataFrame versions."""

from __future__ import annotations

from mentionmill.functions.wordlists import DAMPENERS, IDIOMS, INTENSIFIERS, NEGATIONS

from .inputs import ARCHIVE_TAGS, CLASSED_TAGS, EMOJI_BASE, EMOJI_WORDS, FIXED_VALENCES, ISSUE_TAGS, MARKED_WORDS

# inputs


def _replaced(column: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        column = f"replace({column}, '{old}', '{new}')"
    return column


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


MENTIONS = """mentions AS (
  SELECT '/doc/' || CAST(CAST(floor(value * 2) AS BIGINT) AS VARCHAR) AS url,
         CAST(floor(epoch(ts)) AS BIGINT) AS tstamp,
         CASE WHEN value < 2 THEN NULL ELSE event_type END AS section,
         event_type AS label,
         CASE WHEN value < 2 OR value >= 4 THEN 'Q' || CAST(user_id AS VARCHAR) END AS wd_id,
         value / 500 AS score, event_id AS ingest_id
  FROM events)"""

ORDER_MENTIONS = """order_mentions AS (
  SELECT '/order/' || CAST(o_orderkey AS VARCHAR) AS url, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS tstamp,
         'Q' || CAST(o_custkey AS VARCHAR) AS wd_id, o_orderstatus AS label
  FROM orders)"""

CATALOG = """catalog AS (
  SELECT 'Q' || CAST(s_suppkey AS VARCHAR) AS wd_id, s_name AS wd_label, n_name AS wd_description
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

FIRST_MENTIONS = """first_mentions AS (
  SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY url, wd_id ORDER BY ingest_id) = 1)"""

GOLD = """gold AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS gold
  FROM labels)"""

ARTICLES = f"articles AS (SELECT doc_id, {_replaced('text', MARKED_WORDS)} AS shorttext, text AS fulltext FROM documents)"

LEXICON = f"""lexicon AS (
  SELECT word, CAST(((length(word) * 7 + unicode(word)) % 9 - 4) AS DOUBLE) * CAST(0.475 AS DOUBLE) AS valence
  FROM (SELECT DISTINCT translate(item, '.,', '') AS word
        FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS item FROM benchmark))
  WHERE length(word) >= 5 AND word NOT IN {_list(FIXED_VALENCES)}
  UNION ALL
  SELECT * FROM (VALUES {", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in FIXED_VALENCES.items())}) AS t(word, valence))"""

WORDS_OF_NAMES = (
    "list_filter(list_transform(string_split_regex({0}, '\\s+'), "
    "lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), lambda w: w <> '')"
)

ALIASES = f"""alias_words AS (
  SELECT 'B' || CAST(item_id AS VARCHAR) AS wd_id, {WORDS_OF_NAMES.format("text")} AS words FROM benchmark),
aliases AS (
  SELECT unnest(words) AS name, 'WORD' AS label, wd_id, CAST(0.3 AS DOUBLE) AS score FROM alias_words
  UNION ALL
  SELECT array_to_string(words[1:n], ' '), 'PHRASE' || CAST(n AS VARCHAR), wd_id, CAST(1 AS DOUBLE) / n
  FROM alias_words, (VALUES (2), (3), (4), (5), (8)) AS sizes(n)),
names AS (
  SELECT name, label, wd_id, score FROM aliases
  WHERE name <> '' AND (label <> 'WORD' OR length(name) >= 8)
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, wd_id, label) = 1)"""

BERLIN = "timezone('Europe/Berlin', to_timestamp(tstamp))"
DAY = f"CAST({BERLIN} AS DATE)"
WEEK = f"CAST(date_trunc('week', {BERLIN}) + INTERVAL 6 DAY AS DATE)"
COUNT = "CAST(count(*) AS BIGINT) AS count"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# sentiment over a source ``src(k, t)``

_MARK = "(?:!\\?!\\?|\\?!\\?!|\\?!\\?|!\\?!|!!!|\\?\\?\\?|!!|\\?\\?|[.!?,;:''\"-])"
_PLAIN = "[^\\s[:punct:]]{2,}"
_CLEAN = (
    f"CASE WHEN regexp_full_match(w, '{_PLAIN}{_MARK}') THEN regexp_extract(w, '^({_PLAIN})', 1) "
    f"WHEN regexp_full_match(w, '{_MARK}{_PLAIN}') THEN regexp_extract(w, '({_PLAIN})$', 1) ELSE w END"
)
TOKENS = f"""tokens AS (
  SELECT k, t, unnest(words) AS w, unnest(range(len(words))) AS pos
  FROM (SELECT k, t, list_transform(list_filter(string_split_regex(t, '\\s+'), lambda w: length(w) > 1),
                                    lambda w: {_CLEAN}) AS words FROM src))"""


def _upper(w: str) -> str:
    return f"(regexp_matches({w}, '\\p{{Lu}}') AND NOT regexp_matches({w}, '[\\p{{Ll}}\\p{{Lt}}]'))"


def _double(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


EMPHASIS = (
    "(least(length({0}) - length(replace({0}, '!', '')), 4) * CAST(0.292 AS DOUBLE) + "
    "CASE WHEN length({0}) - length(replace({0}, '?', '')) > 3 THEN CAST(0.96 AS DOUBLE) "
    "WHEN length({0}) - length(replace({0}, '?', '')) > 1 "
    "THEN (length({0}) - length(replace({0}, '?', ''))) * CAST(0.18 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
)


def _rounded(x: str, digits: int) -> str:
    """Correct rounding of the binary value: the error of the scaled product settles near-ties."""
    scale = _double(10.0**digits)
    split = _double(134217729)
    high = f"({x} * {split} - ({x} * {split} - {x}))"
    product = f"({x} * {scale})"
    error = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    side = f"({product} - floor({product}) - {_double(0.5)})"
    return (
        f"CASE WHEN {side} > 0 OR ({side} = 0 AND ({error} > 0 OR ({error} = 0 AND "
        f"CAST(floor({product}) AS BIGINT) % 2 <> 0))) THEN floor({product}) + 1 ELSE floor({product}) END / {scale}"
    )


def _step(k: int, weight: float) -> str:
    """Value after the word ``k`` before, from value ``v{k-1}``."""
    v = f"v{k - 1}"
    push = (
        f"(CASE WHEN d{k} = 0 THEN {_double(0)} ELSE "
        f"(CASE WHEN {v} < 0 THEN -d{k} ELSE d{k} END + CASE WHEN NOT u{k} THEN {_double(0)} WHEN {v} > 0 "
        f"THEN {_double(0.733)} ELSE {_double(-0.733)} END) * {_double(weight)} END)"
    )
    negated = f"l{k} IN {_list(NEGATIONS)} OR contains(l{k}, 'n''t')"
    rules = {
        1: "",
        2: f"WHEN l2 = 'never' AND l1 IN ('so', 'this') THEN {_double(1.25)} "
        f"WHEN l2 = 'without' AND l1 = 'doubt' THEN {_double(1)} ",
        3: f"WHEN (l3 = 'never' AND l2 IN ('so', 'this')) OR l1 IN ('so', 'this') THEN {_double(1.25)} "
        f"WHEN l3 = 'without' AND (l2 = 'doubt' OR l1 = 'doubt') THEN {_double(1)} ",
    }[k]
    factor = f"(CASE {rules}WHEN {negated} THEN {_double(-0.74)} ELSE {_double(1)} END)"
    changed = f"({v} + {push}) * {factor}"
    if k == 3:
        idioms = "CASE " + " ".join("WHEN {0} = '%s' THEN %s" % (i, _double(x)) for i, x in IDIOMS.items()) + " END"
        grams = ["l0||' '||n1||' '||n2", "l0||' '||n1", "l1||' '||l0", "l2||' '||l1||' '||l0", "l2||' '||l1",
                 "l3||' '||l2||' '||l1", "l3||' '||l2"]
        changed = "coalesce(" + ", ".join(idioms.format(f"({g})") for g in grams) + f", {changed})"
    return f"CASE WHEN pos >= {k} AND NOT k{k} THEN {changed} ELSE {v} END AS v{k}"


def _degree(w: str) -> str:
    return (
        f"CASE WHEN {w} IN {_list(INTENSIFIERS)} THEN {_double(0.293)} "
        f"WHEN {w} IN {_list(DAMPENERS)} THEN {_double(-0.293)} ELSE {_double(0)} END"
    )


# The rule for the word "but" is left out: the marked texts do not hold it.
SCORES = f"""{TOKENS},
around AS (
  SELECT k, pos, w, lower(w) AS l0,
         lag(w, 1) OVER words AS w1, lag(w, 2) OVER words AS w2, lag(w, 3) OVER words AS w3,
         lower(lead(w, 1) OVER words) AS n1, lower(lead(w, 2) OVER words) AS n2,
         count(*) FILTER ({_upper("w")}) OVER (PARTITION BY k) AS n_upper, count(*) OVER (PARTITION BY k) AS n
  FROM tokens WINDOW words AS (PARTITION BY k ORDER BY pos)),
looked_up AS (
  SELECT a.*, coalesce(x.valence, lo.valence, ca.valence) AS valence, n_upper > 0 AND n_upper < n AS mixed
  FROM around a LEFT JOIN lexicon x ON x.word = a.w LEFT JOIN lexicon lo ON lo.word = a.l0
  LEFT JOIN lexicon ca ON ca.word = upper(left(a.w, 1)) || lower(substr(a.w, 2))),
hits AS (
  SELECT h.*, lower(w1) AS l1, lower(w2) AS l2, lower(w3) AS l3,
         CASE WHEN mixed AND {_upper("w")} THEN valence + CASE WHEN valence > 0 THEN {_double(0.733)} ELSE {_double(-0.733)} END
              ELSE valence END AS v0,
         {_degree("lower(w1)")} AS d1, {_degree("lower(w2)")} AS d2, {_degree("lower(w3)")} AS d3,
         mixed AND coalesce({_upper("w1")}, false) AS u1, mixed AND coalesce({_upper("w2")}, false) AS u2,
         mixed AND coalesce({_upper("w3")}, false) AS u3,
         coalesce(lower(w1) IN (SELECT word FROM lexicon), false) AS k1,
         coalesce(lower(w2) IN (SELECT word FROM lexicon), false) AS k2,
         coalesce(lower(w3) IN (SELECT word FROM lexicon), false) AS k3
  FROM looked_up h WHERE valence IS NOT NULL),
s1 AS (SELECT *, {_step(1, 1.0)} FROM hits),
s2 AS (SELECT *, {_step(2, 0.95)} FROM s1),
s3 AS (SELECT *, {_step(3, 0.9)} FROM s2),
valued AS (
  SELECT k, pos, w,
         CASE WHEN l0 IN {_list([*INTENSIFIERS, *DAMPENERS])} OR (l0 = 'kind' AND coalesce(n1 = 'of', false)) THEN {_double(0)}
              WHEN pos >= 1 AND NOT k1 AND l1 = 'least' AND (pos = 1 OR l2 NOT IN ('at', 'very')) THEN v3 * {_double(-0.74)}
              ELSE v3 END AS own
  FROM s3),
resolved AS (SELECT k, pos, first_value(own) OVER (PARTITION BY k, w ORDER BY pos) AS v FROM valued),
lists AS (SELECT k, list(v ORDER BY pos) AS vs FROM resolved WHERE v <> 0 GROUP BY k),
counted AS (SELECT k, count(*) AS n FROM tokens GROUP BY k),
sums AS (
  SELECT src.k, coalesce(n, 0) AS n, {EMPHASIS.format("src.t")} AS emphasis,
         list_reduce(coalesce(vs, []), lambda a, x: a + x, {_double(0)}) AS raw,
         list_reduce(list_transform(list_filter(coalesce(vs, []), lambda x: x > 0), lambda x: x + 1), lambda a, x: a + x, {_double(0)}) AS up,
         list_reduce(list_transform(list_filter(coalesce(vs, []), lambda x: x < 0), lambda x: 1 - x), lambda a, x: a + x, {_double(0)}) AS down,
         CAST(coalesce(n, 0) - coalesce(len(vs), 0) AS DOUBLE) AS neutral
  FROM src LEFT JOIN counted USING (k) LEFT JOIN lists USING (k)),
strengths AS (
  SELECT k, n, neutral, CASE WHEN raw > 0 THEN raw + emphasis WHEN raw < 0 THEN raw - emphasis ELSE raw END AS s,
         CASE WHEN up > down THEN up + emphasis ELSE up END AS p, CASE WHEN up < down THEN down + emphasis ELSE down END AS g
  FROM sums),
shares AS (
  SELECT k, n, s / sqrt(s * s + 15) AS c, p / greatest(p + g + neutral, {_double(1)}) AS p,
         g / greatest(p + g + neutral, {_double(1)}) AS g, neutral / greatest(p + g + neutral, {_double(1)}) AS u
  FROM strengths),
scores AS (
  SELECT k, CASE WHEN n > 0 THEN {_rounded("g", 3)} ELSE {_double(0)} END AS neg,
         CASE WHEN n > 0 THEN {_rounded("u", 3)} ELSE {_double(0)} END AS neu,
         CASE WHEN n > 0 THEN {_rounded("p", 3)} ELSE {_double(0)} END AS pos,
         CASE WHEN n > 0 THEN {_rounded("c", 4)} ELSE {_double(0)} END AS compound
  FROM shares)"""

ARTICLE_SCORES = (ARTICLES, LEXICON, "src AS (SELECT doc_id AS k, shorttext AS t FROM articles)", SCORES)


def _class(c: str, bound: float = 0.05) -> str:
    return f"CASE WHEN {c} >= {_double(bound)} THEN 'positive' WHEN {c} <= {_double(-bound)} THEN 'negative' ELSE 'neutral' END"


EVALUATED = f"evaluated AS (SELECT k AS doc_id, gold, compound, {_class('compound')} AS predicted FROM scores LEFT JOIN gold ON k = doc_id)"

# html


def _stripped(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def _unescaped(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def _href(x: str) -> str:
    return f"nullif(regexp_extract(regexp_extract({x}, '<a\\b[^>]*>'), 'href=\"([^\"]*)\"', 1), '')"


PARAGRAPHS = """bodies AS (
  SELECT page_id, url, html, array_to_string(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
         '(?s)<article\\b[^>]*>(.*?)(?:</article>|$)', 1), '') AS body FROM pages),
paragraphs AS (
  SELECT page_id, list_transform(string_split_regex(body, '<p(?:\\s[^>]*)?>')[2:],
         lambda p: CASE WHEN contains(p, '</p>') THEN left(p, strpos(p, '</p>') - 1) ELSE p END) AS ps FROM bodies)"""
_NODES = "list_filter(string_split_regex({0}, '<[^>]*>'), lambda n: n <> '')"
_CLEAN_NODES = f"list_transform({_NODES}, lambda n: {_stripped(_unescaped('n'))})"
ALL_NODES = f"array_to_string(list_transform(flatten(list_transform(ps, lambda p: {_NODES.format('p')})), lambda n: {_stripped(_unescaped('n'))}), ' ')"
FILLED_NODES = f"array_to_string(list_transform(ps, lambda p: array_to_string(list_filter({_CLEAN_NODES.format('p')}, lambda n: n <> ''), ' ')), ' ')"
WHOLE_PARAGRAPHS = "array_to_string(list_transform(ps, lambda p: {0}), ' ')".format(
    _stripped(_unescaped("regexp_replace(p, '<[^>]*>', '', 'g')"))
)

LINKED = f"""{ALIASES},
words AS (
  SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w
  FROM (SELECT doc_id, {WORDS_OF_NAMES.format("fulltext")} AS ws FROM articles)),
runs AS (
  SELECT doc_id, pos, n, array_to_string(ws[pos + 1:pos + n], ' ') AS name
  FROM (SELECT doc_id, pos, ws, unnest(range(1, least(9, len(ws) - pos + 1))) AS n
        FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, {WORDS_OF_NAMES.format("fulltext")} AS ws FROM articles)))),
longest AS (
  SELECT doc_id, pos, n, name, label, wd_id, score, pos + n AS free
  FROM runs JOIN names USING (name) QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC) = 1),
following AS (
  SELECT a.*, b.pos AS next_pos FROM longest a ASOF LEFT JOIN longest b ON a.doc_id = b.doc_id AND a.free <= b.pos),
taken AS (
  SELECT * FROM (SELECT * FROM following QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1)
  UNION ALL
  SELECT f.* FROM taken t JOIN following f ON f.doc_id = t.doc_id AND f.pos = t.next_pos),
links AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS position, CAST(pos AS BIGINT) AS word_at,
         name AS ner_text, label, wd_id, 'https://www.wikidata.org/wiki/' || wd_id AS wd_url, score FROM taken)"""

ENRICHED = """SELECT {period} AS {name}, wd_id, label, wd_label, wd_description, CAST(count(*) AS BIGINT) AS count
FROM first_mentions JOIN catalog USING (wd_id) GROUP BY ALL"""

ORACLES: dict[str, str] = {
    "mentions_per_week": _with(MENTIONS)
    + f"SELECT {WEEK} AS week_end, wd_id, {COUNT} FROM mentions WHERE wd_id IS NOT NULL GROUP BY ALL",
    "mentions_per_week_years": _with(ORDER_MENTIONS)
    + f"""SELECT strftime(timezone('UTC', timezone('Europe/Berlin', CAST({WEEK} AS TIMESTAMP))), '%Y-%m-%dT%H:%M:%S.000Z') AS tstamp,
       wd_id, {COUNT} FROM order_mentions GROUP BY ALL""",
    "mentions_per_section_per_week": _with(MENTIONS)
    + f"""SELECT {WEEK} AS week_end, section, wd_id, {COUNT} FROM mentions
WHERE wd_id IS NOT NULL AND section IS NOT NULL GROUP BY ALL""",
    "mentions_per_section_per_sentiment_per_week": _with(MENTIONS, *ARTICLE_SCORES)
    + f"""SELECT {WEEK} AS week_end, section, {_class("compound")} AS sentiment, wd_id, {COUNT}
FROM mentions JOIN scores ON url = '/doc/' || CAST(k AS VARCHAR)
WHERE wd_id IS NOT NULL AND section IS NOT NULL GROUP BY ALL""",
    "mentions_per_day": _with(MENTIONS, FIRST_MENTIONS)
    + f"SELECT {DAY} AS day, wd_id, label, {COUNT} FROM first_mentions WHERE wd_id IS NOT NULL GROUP BY ALL",
    "mentions_per_day_enriched": _with(MENTIONS, FIRST_MENTIONS, CATALOG) + ENRICHED.format(period=DAY, name="day"),
    "mentions_per_week_labelled": _with(MENTIONS, FIRST_MENTIONS)
    + f"SELECT {WEEK} AS week_end, wd_id, label, {COUNT} FROM first_mentions WHERE wd_id IS NOT NULL GROUP BY ALL",
    "mentions_per_week_enriched": _with(MENTIONS, FIRST_MENTIONS, CATALOG) + ENRICHED.format(period=WEEK, name="week_end"),
    "article_count": _with(MENTIONS) + "SELECT CAST(count(DISTINCT url) AS BIGINT) AS articles FROM mentions",
    "clean_mentions_count": _with(MENTIONS)
    + """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(7 AS BIGINT) AS n_columns FROM mentions
WHERE wd_id IS NOT NULL AND score >= CAST(0.1 AS DOUBLE)""",
    "catalog_ids": _with(MENTIONS, ORDER_MENTIONS)
    + "SELECT wd_id FROM mentions UNION SELECT wd_id FROM order_mentions",
    "catalog_ids_array": _with(
        MENTIONS, ORDER_MENTIONS, "ids AS (SELECT wd_id FROM mentions UNION SELECT wd_id FROM order_mentions)"
    )
    + """SELECT CASE WHEN row_number() OVER (ORDER BY wd_id) = 1 THEN '[' ELSE ',' END || '"' || wd_id || '"' ||
       CASE WHEN row_number() OVER (ORDER BY wd_id DESC) = 1 THEN ']' ELSE '' END AS value
FROM ids WHERE wd_id IS NOT NULL""",
    "drop_front_page": _with(MENTIONS)
    + "SELECT ingest_id, section FROM mentions WHERE NOT score < CAST(0.02 AS DOUBLE)",
    "first_section": _with(MENTIONS) + "SELECT ingest_id, section FROM mentions",
    "epoch_berlin": f"""SELECT o_orderkey, CAST(tstamp AS VARCHAR) AS tstamp, strftime({BERLIN}, '%Y-%m-%d %H:%M:%S') AS berlin,
       {WEEK} AS week_end
FROM (SELECT o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) - 7200 AS tstamp FROM orders)""",
    "clean_mentions": _with(MENTIONS)
    + """SELECT url, tstamp, label, wd_id, score, ingest_id FROM mentions
WHERE wd_id IS NOT NULL AND score >= CAST(0.1 AS DOUBLE)""",
    "classify": f"""SELECT event_id, {_class("c")} AS narrow, {_class("c", 0.1)} AS wide
FROM (SELECT event_id, (value - 60) / CAST(500 AS DOUBLE) AS c FROM events)""",
    "dedupe_mentions": _with(MENTIONS, FIRST_MENTIONS)
    + "SELECT url, tstamp, label, wd_id, score, ingest_id FROM first_mentions",
    "union_sources": _with(MENTIONS, ORDER_MENTIONS)
    + """SELECT url, tstamp, label, wd_id, score, section FROM mentions
UNION ALL SELECT url, tstamp, label, wd_id, CAST(NULL AS DOUBLE), NULL FROM order_mentions""",
    "ad_url_filter": "SELECT page_id, url FROM pages WHERE strpos(url, 'blog.') = 0",
    "merge_facts": _with(MENTIONS, CATALOG)
    + "SELECT ingest_id, wd_id, wd_label, wd_description FROM mentions LEFT JOIN catalog USING (wd_id)",
    "merge_facts_counts": _with(MENTIONS, CATALOG)
    + f"""SELECT week_end, section, wd_id, count, wd_label, wd_description FROM (
  SELECT {WEEK} AS week_end, section, wd_id, {COUNT} FROM mentions
  WHERE wd_id IS NOT NULL AND section IS NOT NULL GROUP BY ALL) LEFT JOIN catalog USING (wd_id)""",
    "merge_sentiment": _with(
        MENTIONS, GOLD, "doubled AS (SELECT * FROM gold UNION ALL SELECT * FROM gold WHERE gold <> 'positive')"
    )
    + """SELECT ingest_id, url, gold AS shorttext_sentiment, CASE WHEN gold IS NOT NULL THEN 'empty' END AS fulltext_sentiment
FROM mentions LEFT JOIN doubled ON url = '/doc/' || CAST(doc_id AS VARCHAR)""",
    "many_to_one": _with(MENTIONS)
    + """SELECT ingest_id, mentions.url, n_chars FROM mentions
LEFT JOIN documents ON mentions.url = '/doc/' || CAST(doc_id AS VARCHAR)""",
    "attach_by_text": _with(
        GOLD, "scored AS (SELECT text, arg_min(gold, doc_id) AS sentiment FROM documents JOIN gold USING (doc_id) GROUP BY text)"
    )
    + "SELECT doc_id, sentiment FROM documents LEFT JOIN scored USING (text)",
    "membership_count": _with(GOLD)
    + """SELECT CAST(count(*) AS BIGINT) AS matching FROM documents
WHERE text IN (SELECT text FROM documents JOIN gold USING (doc_id))""",
    "catalog_todo": _with(MENTIONS, CATALOG)
    + "SELECT DISTINCT wd_id FROM mentions WHERE wd_id IS NOT NULL AND wd_id NOT IN (SELECT wd_id FROM catalog)",
    "page_links": f"""SELECT url AS page_url, position, nullif({_stripped(_unescaped("regexp_extract(item, '<a\\b[^>]*>([^<]*)', 1)"))}, '') AS title,
       {_href("item")} AS url
FROM (SELECT url, unnest(items[2:]) AS item, unnest(range(1, len(items))) AS position
      FROM (SELECT url, string_split(html, '<li>') AS items FROM pages))""",
    "url_sections": """SELECT page_id, array_to_string(parts, ',') AS sections, CAST(len(parts) AS BIGINT) AS depth
FROM (SELECT page_id, string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')[2:-2] AS parts FROM pages)""",
    "page_text": _with(PARAGRAPHS)
    + f"""SELECT page_id, {ALL_NODES} AS all_nodes, {FILLED_NODES} AS filled_nodes, {WHOLE_PARAGRAPHS} AS paragraphs
FROM paragraphs""",
    "section_carry": _with(
        f"issues AS (SELECT url, {_replaced('html', ISSUE_TAGS)} AS html FROM pages)",
        """split_up AS (SELECT url, string_split(replace(replace(replace(html, '<h2>', chr(1) || '<h2>'), '<article>', chr(1) || '<article>'),
         '<article ', chr(1) || '<article '), chr(1)) AS parts FROM issues)""",
        "pieces AS (SELECT url AS page_url, unnest(range(1, len(parts))) AS pos, unnest(parts[2:]) AS piece FROM split_up)",
        """marked AS (SELECT page_url, pos, piece, starts_with(piece, '<h2') AS header,
         CASE WHEN starts_with(piece, '<h2') THEN coalesce(nullif(regexp_extract(piece, '^<h2>([^<]*)</h2>', 1), ''), chr(2)) END AS said
         FROM pieces)""",
        """carried AS (SELECT *, last_value(said IGNORE NULLS) OVER w AS section, count(*) FILTER (NOT header) OVER w AS position
         FROM marked WINDOW w AS (PARTITION BY page_url ORDER BY pos ROWS UNBOUNDED PRECEDING))""",
        """bodies AS (SELECT page_url, position, string_agg(piece, '' ORDER BY pos) AS body, first(section ORDER BY pos) AS section
         FROM carried WHERE position > 0 GROUP BY ALL)""",
    )
    + f"""SELECT page_url, CAST(position AS BIGINT) AS position, {_href("string_split(body, '</article>')[1]")} AS url,
       {_unescaped("nullif(section, chr(2))")} AS section
FROM bodies WHERE section IS NULL OR section <> 'Ressorts'""",
    "full_view": _recursive(
        """placed AS (SELECT *, (row_number() OVER (PARTITION BY host ORDER BY url, page_id) - 1) // 10 AS chain
         FROM (SELECT *, string_split(url, '/')[3] AS host FROM pages))""",
        """linked AS (SELECT page_id, url, html, coalesce(lead(url) OVER w,
         CASE WHEN (length(host) + chain) % 3 = 0 THEN first_value(url) OVER w END) AS target
         FROM placed WINDOW w AS (PARTITION BY host, chain ORDER BY url, page_id))""",
        """bodies AS (SELECT page_id, url, target, html || coalesce('<a data-ct-label="all" href="' || target || '">all</a>', '') AS html
         FROM linked)""",
        """walk AS (SELECT page_id, url AS page_url, url, html, target, 0 AS hops FROM bodies
         UNION ALL SELECT w.page_id, w.page_url, b.url, b.html, b.target, hops + 1 FROM walk w JOIN bodies b ON b.url = w.target WHERE hops < 12)""",
    )
    + """SELECT b.url AS page_url, coalesce(w.url, b.url) AS url, md5(coalesce(w.html, b.html)) AS body
FROM bodies b LEFT JOIN (SELECT * FROM walk WHERE target IS NULL) AS w ON w.page_id = b.page_id""",
    "article_shape": _with(PARAGRAPHS)
    + f"""SELECT CASE WHEN strpos(url, '?') = 0 THEN url END AS url, CAST(page_id AS VARCHAR) AS tstamp,
       nullif({_stripped(_unescaped("regexp_extract(html, '<h1>([^<]*)', 1)"))}, '') AS title,
       nullif({_stripped(_unescaped("regexp_extract(html, '<a\\b[^>]*>([^<]*)', 1)"))}, '') AS shorttext,
       CASE WHEN strpos(url, '?') = 0 THEN md5({ALL_NODES}) END AS fulltext,
       CASE WHEN strpos(url, '?') = 0
            THEN array_to_string(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')[2:-2], ',') ELSE '' END AS sections
FROM paragraphs JOIN pages USING (page_id)""",
    "kb_flatten": """SELECT 'https://kb.example/' || asked AS wd_url, asked AS wd_id, CASE WHEN s_acctbal < 0 THEN true_id END AS wd_redirect,
       CASE WHEN s_acctbal > 6000 THEN s_name WHEN s_acctbal > 2000 THEN upper(s_name) ELSE true_id END AS wd_label,
       CASE WHEN s_nationkey > 10 THEN 'nation ' || CAST(s_nationkey AS VARCHAR) ELSE true_id END AS wd_description
FROM (SELECT *, 'Q' || CAST(s_suppkey AS VARCHAR) AS asked,
             CASE WHEN s_acctbal < 0 THEN 'R' ELSE 'Q' END || CAST(s_suppkey AS VARCHAR) AS true_id FROM supplier)""",
    "date_spine": """SELECT event_type, CAST(unnest(generate_series(first_day + INTERVAL 1 DAY, last_day, INTERVAL 1 DAY)) AS DATE) AS day
FROM (SELECT event_type, CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) AS first_day, CAST(CAST(max(ts) AS DATE) AS TIMESTAMP) AS last_day
      FROM events GROUP BY event_type)""",
    "issue_spine": """SELECT o_orderpriority, CAST(y AS BIGINT) AS year, CAST(i AS BIGINT) AS issue,
       'https://www.zeit.de/' || CAST(y AS VARCHAR) || '/' || lpad(CAST(i AS VARCHAR), 2, '0') || '/index' AS url
FROM (SELECT o_orderpriority, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY ALL),
     range(1990, 2030) AS years(y), range(1, 56) AS issues(i)
WHERE (y, i) >= (year(a), month(a) + 43) AND (y, i) <= (year(b), month(b))""",
    "lexicon_hits": _with(ARTICLES, LEXICON, "src AS (SELECT doc_id AS k, shorttext AS t FROM articles)", TOKENS)
    + """SELECT k AS doc_id, CAST(pos AS BIGINT) AS pos, w AS token, coalesce(x.valence, lo.valence, ca.valence) AS valence
FROM tokens LEFT JOIN lexicon x ON x.word = w LEFT JOIN lexicon lo ON lo.word = lower(w)
LEFT JOIN lexicon ca ON ca.word = upper(left(w, 1)) || lower(substr(w, 2))
WHERE coalesce(x.valence, lo.valence, ca.valence) IS NOT NULL""",
    "token_context": _with(ARTICLES, "src AS (SELECT doc_id AS k, shorttext AS t FROM articles)", TOKENS)
    + """SELECT k AS doc_id, CAST(pos AS BIGINT) AS pos, w AS token, lag(w, 1) OVER p AS prev1, lag(w, 2) OVER p AS prev2,
       lag(w, 3) OVER p AS prev3, lead(w, 1) OVER p AS next1, lead(w, 2) OVER p AS next2
FROM tokens WINDOW p AS (PARTITION BY k ORDER BY pos)""",
    "punct_emphasis": _with(ARTICLES) + f"SELECT doc_id, {EMPHASIS.format('shorttext')} AS emphasis FROM articles",
    "sentiment_compound": _with(*ARTICLE_SCORES) + "SELECT k AS doc_id, neg, neu, pos, compound FROM scores",
    "sentiment_class": _with(*ARTICLE_SCORES)
    + f"""SELECT '/doc/' || CAST(k AS VARCHAR) AS url, {_class("compound")} AS shorttext_sentiment, 'empty' AS fulltext_sentiment
FROM scores""",
    "class_tallies": _with(*ARTICLE_SCORES, GOLD, EVALUATED)
    + "SELECT CAST(count(*) AS BIGINT) AS total, "
    + ", ".join(f"count(*) FILTER (predicted = '{c}') AS predicted_{c}, count(*) FILTER (gold = '{c}') AS gold_{c}"
                for c in ("positive", "neutral", "negative"))
    + ", count(*) FILTER (gold IS NULL) AS gold_unknown FROM evaluated",
    "evaluation": _with(*ARTICLE_SCORES, GOLD, EVALUATED)
    + """SELECT gold, count(*) AS total, count(*) FILTER (gold = predicted) AS correct,
       count(*) FILTER ((gold, predicted) IN (('positive', 'negative'), ('negative', 'positive'))) AS wrong,
       count(*) FILTER (gold <> 'neutral' AND predicted = 'neutral') AS wrong_neutral,
       count(*) FILTER (gold = 'neutral' AND predicted = 'positive') AS wrong_positive,
       count(*) FILTER (gold = 'neutral' AND predicted = 'negative') AS wrong_negative
FROM evaluated WHERE gold IS NOT NULL GROUP BY gold""",
    "evaluation_splits": _with(*ARTICLE_SCORES, GOLD, EVALUATED, "judged AS (SELECT *, coalesce(gold, '') AS g FROM evaluated)")
    + f"""SELECT doc_id, gold, compound, 'all' AS split, CASE WHEN g = predicted THEN 'right' ELSE 'wrong' END ||
       CASE WHEN g = 'neutral' THEN '_neutral' ELSE '' END AS outcome FROM judged
UNION ALL SELECT doc_id, gold, compound, 'polar', CASE WHEN g = predicted THEN 'right' ELSE 'wrong' END FROM judged WHERE g <> 'neutral'
UNION ALL SELECT doc_id, gold, compound, 'polar_wide', CASE WHEN g = {_class("compound", 0.1)} THEN 'right' ELSE 'wrong' END
FROM judged WHERE g <> 'neutral'
UNION ALL SELECT doc_id, gold, compound, unnest(CASE WHEN g = 'positive' THEN ['no_neutral'] ELSE ['no_neutral', 'negative_only'] END),
       CASE WHEN g = predicted THEN 'right' WHEN predicted = 'neutral' THEN 'wrong_neutral' ELSE 'wrong' END
FROM judged WHERE g <> 'neutral'""",
    "mean_sentence_score": _with(
        ARTICLES,
        LEXICON,
        """sentences AS (SELECT doc_id, unnest(string_split(regexp_replace(shorttext, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS t
         FROM articles)""",
        """src AS (SELECT {'doc_id': doc_id, 'i': i} AS k, t
         FROM (SELECT *, row_number() OVER (PARTITION BY doc_id) AS i FROM sentences WHERE t <> ''))""",
        SCORES,
        """means AS (SELECT k.doc_id AS doc_id, count(*) AS sentences,
         CAST(sum(CAST(round(compound * 10000) AS BIGINT)) AS DOUBLE) / CAST(10000 AS DOUBLE) / CAST(count(*) AS DOUBLE) AS m
         FROM scores GROUP BY ALL)""",
    )
    + f"SELECT doc_id, coalesce(sentences, 0) AS sentences, {_rounded('m', 4)} AS mean_compound FROM articles LEFT JOIN means USING (doc_id)",
    "link_entities": _recursive(ARTICLES, LINKED)
    + "SELECT doc_id, position, word_at, ner_text, label, wd_id, wd_url, score FROM links",
    "linked_mentions_per_week": _recursive(ARTICLES, LINKED)
    + f"""SELECT {WEEK} AS week_end, wd_id, label, CAST(length(text) AS VARCHAR) AS wd_label, 'item' AS wd_description, {COUNT}
FROM (SELECT *, 1704067200 + doc_id * 3600 AS tstamp FROM links) JOIN benchmark ON wd_id = 'B' || CAST(item_id AS VARCHAR)
GROUP BY ALL""",
    "batch_score": _with(ARTICLES)
    + "SELECT doc_id, '/doc/' || CAST(doc_id AS VARCHAR) AS url, 1704067200 + doc_id * 3600 AS tstamp, "
    + ", ".join(
        f"""CASE WHEN length({c}) - length(replace({c}, 'e', '')) > 2 * (length({c}) - length(replace({c}, 'a', ''))) THEN 'positive'
       WHEN contains({c}, '!') THEN 'negative' ELSE 'neutral' END AS {c}_sentiment"""
        for c in ("shorttext", "fulltext")
    )
    + " FROM articles",
    "scoring_input": _with(ARTICLES)
    + """SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS row_id, 'unknown' AS label, shorttext FROM articles""",
}


TOPIC_ARTICLES = "articles AS (SELECT '/doc/' || CAST(doc_id AS VARCHAR) AS url, text AS fulltext FROM documents)"


def _topic_passes(passes: int = 3, k: int = 6) -> list[str]:
    ctes = [
        """tw AS (SELECT url AS id, word, count(*) AS n
         FROM (SELECT url, unnest(regexp_extract_all(lower(fulltext), '\\p{L}+')) AS word FROM articles) AS x GROUP BY ALL)""",
        "tn AS (SELECT word, sum(n) AS word_n FROM tw GROUP BY word)",
        f"""a0 AS (SELECT id, CAST(('0x' || substr(md5(id), 1, 8)) AS BIGINT) % {k} AS topic
         FROM (SELECT DISTINCT id FROM tw) AS ids)""",
    ]
    for i in range(passes):
        ctes += [
            f"u{i} AS (SELECT word, topic, sum(n) AS used FROM tw JOIN a{i} USING (id) GROUP BY ALL)",
            f"z{i} AS (SELECT topic, sum(used) AS size FROM u{i} GROUP BY topic)",
            f"""l{i} AS (SELECT word, u{i}.topic AS t, used, word_n, (SELECT sum(size) FROM z{i}) * CAST(1.0 AS DOUBLE) / size AS rarity
             FROM u{i} JOIN tn USING (word) JOIN z{i} ON z{i}.topic = u{i}.topic)""",
            f"""s{i} AS (SELECT id, t AS topic, CAST(sum(n * CASE WHEN word_n > n THEN CAST(floor(
             (used - CASE WHEN a{i}.topic = t THEN n ELSE 0 END) * CAST(1000.0 AS DOUBLE) / (word_n - n) * rarity) AS BIGINT) ELSE 0 END) AS BIGINT) AS score
             FROM tw JOIN a{i} USING (id) JOIN l{i} USING (word) GROUP BY id, t)""",
            f"""b{i} AS (SELECT id, topic, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) AS r FROM s{i}) AS y WHERE r = 1)""",
            f"""a{i + 1} AS (SELECT a{i}.id, CASE WHEN b{i}.score > 0 THEN b{i}.topic ELSE a{i}.topic END AS topic
             FROM a{i} LEFT JOIN b{i} ON a{i}.id = b{i}.id)""",
        ]
    last = f"s{passes - 1}"
    ctes += [
        f"named AS (SELECT DISTINCT url, a{passes}.topic AS own FROM articles LEFT JOIN a{passes} ON a{passes}.id = url)",
        f"totals AS (SELECT id, sum(score) AS total FROM {last} GROUP BY id)",
        f"""each AS (SELECT url, own, unnest(CASE WHEN own IS NULL THEN [CAST(NULL AS BIGINT)] ELSE range(0, {k}) END) AS topic FROM named)""",
        f"""weights AS (SELECT url, own, CAST(each.topic AS INTEGER) AS topic, CASE WHEN each.topic IS NULL THEN NULL
         WHEN coalesce(total, 0) > 0 THEN floor(coalesce(score, 0) * CAST(1e9 AS DOUBLE) / total) / CAST(1e9 AS DOUBLE)
         WHEN own = each.topic THEN 1.0 ELSE 0.0 END AS weight
         FROM each LEFT JOIN {last} ON {last}.id = url AND {last}.topic = each.topic LEFT JOIN totals ON totals.id = url)""",
        f"fu AS (SELECT word, topic, sum(n) AS used FROM tw JOIN a{passes} USING (id) GROUP BY ALL)",
        "fz AS (SELECT topic, sum(used) AS size FROM fu GROUP BY topic)",
        """excess AS (SELECT fu.topic, word, used - CAST(floor(word_n * CAST(1.0 AS DOUBLE) * size / (SELECT sum(size) FROM fz)) AS BIGINT) AS e
         FROM fu JOIN tn USING (word) JOIN fz ON fz.topic = fu.topic)""",
        """terms AS (SELECT topic, string_agg(word, ' ' ORDER BY r) AS top_terms FROM (
         SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY e DESC, encode(word) DESC) AS r FROM excess) AS t WHERE r <= 10 GROUP BY topic)""",
    ]
    return ctes


ORACLES["topics"] = _with(TOPIC_ARTICLES, *_topic_passes()) + "SELECT url, topic, weight FROM weights"
ORACLES["topic_summary"] = (
    _with(TOPIC_ARTICLES, *_topic_passes())
    + """SELECT m.topic, coalesce(n_articles, 0) AS n_articles, mean_weight, top_terms
FROM (SELECT topic, CAST(sum(CAST(round(weight * 1e9) AS BIGINT)) AS DOUBLE) / count(weight) / CAST(1e9 AS DOUBLE) AS mean_weight
      FROM weights GROUP BY topic) AS m
LEFT JOIN (SELECT own AS topic, count(*) AS n_articles FROM named GROUP BY own) AS c ON c.topic IS NOT DISTINCT FROM m.topic
LEFT JOIN terms ON terms.topic = m.topic"""
)

ORACLES["jsonl_round_trip"] = (
    _with(ARTICLES)
    + """SELECT '/doc/' || CAST(doc_id AS VARCHAR) AS url, doc_id * 3600 + 1704067200 AS tstamp, md5(shorttext) AS short, md5(fulltext) AS body,
       source AS section FROM articles JOIN (SELECT doc_id, source FROM documents) AS d USING (doc_id)"""
)
ORACLES["partitioned_round_trip"] = (
    _with(ARTICLES)
    + """SELECT '/doc/' || CAST(doc_id AS VARCHAR) AS url, CAST(length(shorttext) AS BIGINT) AS n, 'source=' || source AS folder
FROM articles JOIN (SELECT doc_id, source FROM documents) AS d USING (doc_id)"""
)
ORACLES["csv_round_trip"] = """SELECT md5('"' || replace(text, ' ', '",') || chr(10)) AS text, 'unknown' AS gold, CAST(doc_id AS DOUBLE) / CAST(8 AS DOUBLE) AS compound,
       '{''neg'': 0.0}' AS scores, 'neutral' AS sentiment FROM documents"""
ORACLES["tsv_round_trip"] = """SELECT row_number() OVER (ORDER BY doc_id) AS row_id, 'unknown' AS label, md5(text) AS text FROM documents"""
ORACLES["merge_facts_null_safe"] = (
    _with(MENTIONS, CATALOG, "facts AS (SELECT * FROM catalog UNION ALL SELECT NULL, 'none', 'no entity')")
    + """SELECT ingest_id, mentions.wd_id, wd_label, wd_description FROM mentions LEFT JOIN facts ON facts.wd_id IS NOT DISTINCT FROM mentions.wd_id"""
)
ORACLES["products_per_section"] = (
    _with(MENTIONS, CATALOG)
    + f"""SELECT week_end, section, wd_id, count, wd_label, wd_description FROM (
SELECT {WEEK} AS week_end, section, wd_id, {COUNT} FROM mentions WHERE wd_id IS NOT NULL AND section IS NOT NULL GROUP BY ALL) AS x
LEFT JOIN catalog USING (wd_id)"""
)
ORACLES["mean_tag_score"] = _with(
    ARTICLES,
    LEXICON,
    "tags AS (SELECT doc_id, unnest(string_split(shorttext, '.')) AS t FROM articles)",
    "src AS (SELECT {'doc_id': doc_id, 'i': i} AS k, t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id) AS i FROM tags))",
    SCORES,
    """means AS (SELECT k.doc_id AS doc_id, count(*) AS sentences,
     CAST(sum(CAST(round(compound * 10000) AS BIGINT)) AS DOUBLE) / CAST(10000 AS DOUBLE) / CAST(count(*) AS DOUBLE) AS m
     FROM scores GROUP BY ALL)""",
) + f"SELECT doc_id, sentences, {_rounded('m', 4)} AS mean_compound FROM means"

_QUOTED = "md5('\"' || replace(text, ' ', '\"' || chr(9)) || chr(10) || '.') AS text"
ORACLES["scored_dir_round_trip"] = (
    _with(GOLD)
    + f"""SELECT {_QUOTED}, gold, CAST(doc_id AS DOUBLE) / CAST(8 AS DOUBLE) AS compound, '{{''neg'': 0.0}}' AS scores, gold AS sentiment
FROM documents JOIN gold USING (doc_id)"""
)
ORACLES["splits_round_trip"] = (
    _with(
        GOLD,
        f"""judged AS (SELECT {_QUOTED}, gold AS g, compound, {_class("compound")} AS predicted FROM (
         SELECT text, gold, CAST(doc_id % 9 - 4 AS DOUBLE) / CAST(8 AS DOUBLE) AS compound FROM documents JOIN gold USING (doc_id)) AS x)""",
        f"""split AS (
SELECT *, 'all' AS split, CASE WHEN g = predicted THEN 'right' ELSE 'wrong' END || CASE WHEN g = 'neutral' THEN '_neutral' ELSE '' END AS outcome FROM judged
UNION ALL SELECT *, 'polar', CASE WHEN g = predicted THEN 'right' ELSE 'wrong' END FROM judged WHERE g <> 'neutral'
UNION ALL SELECT *, 'polar_wide', CASE WHEN g = {_class("compound", 0.1)} THEN 'right' ELSE 'wrong' END FROM judged WHERE g <> 'neutral'
UNION ALL SELECT *, unnest(CASE WHEN g = 'positive' THEN ['no_neutral'] ELSE ['no_neutral', 'negative_only'] END),
       CASE WHEN g = predicted THEN 'right' WHEN predicted = 'neutral' THEN 'wrong_neutral' ELSE 'wrong' END
FROM judged WHERE g <> 'neutral')""",
    )
    + "SELECT text, g AS gold, compound, '{''neg'': 0.0}' AS scores, split, outcome FROM split"
)

EMOJI = f"""emoji AS (
  SELECT CASE WHEN n_nationkey < 20 THEN chr(CAST({EMOJI_BASE} + n_nationkey AS INTEGER)) ELSE ':-' || CAST(n_nationkey AS VARCHAR) END AS emoji,
         lower(n_name) || ' super' AS description FROM nation),
emoji_items AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos
  FROM (SELECT doc_id, list_filter(string_split_regex({_replaced("text", EMOJI_WORDS)}, '\\s+'), lambda w: w <> '') AS ws FROM documents)),
described AS (
  SELECT doc_id, string_agg(coalesce(description, w), ' ' ORDER BY pos) AS text
  FROM emoji_items LEFT JOIN emoji ON w = emoji GROUP BY doc_id)"""
ORACLES["emoji_description"] = _with(EMOJI) + "SELECT doc_id, md5(coalesce(described.text, '')) AS text FROM documents LEFT JOIN described USING (doc_id)"
ORACLES["sentiment_emoji"] = (
    _with(EMOJI, LEXICON, "src AS (SELECT doc_id AS k, coalesce(described.text, '') AS t FROM documents LEFT JOIN described USING (doc_id))", SCORES)
    + "SELECT k AS doc_id, neg, neu, pos, compound FROM scores"
)

ORACLES["link_entities_unlinked"] = (
    _recursive(
        ARTICLES,
        LINKED,
        """covered AS (SELECT doc_id, unnest(range(pos, pos + n)) AS pos FROM taken)""",
        """bare AS (
  SELECT words.doc_id, words.pos, w, words.pos - row_number() OVER (PARTITION BY words.doc_id ORDER BY words.pos) AS island
  FROM words LEFT JOIN covered ON covered.doc_id = words.doc_id AND covered.pos = words.pos
  WHERE covered.pos IS NULL AND left(w, 1) <> lower(left(w, 1)))""",
        """mentioned AS (
  SELECT doc_id, pos, name, label, wd_id, score FROM taken
  UNION ALL SELECT doc_id, min(pos), string_agg(w, ' ' ORDER BY pos), NULL, NULL, NULL FROM bare GROUP BY doc_id, island)""",
    )
    + """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS position, CAST(pos AS BIGINT) AS word_at,
       name AS ner_text, label, wd_id, score FROM mentioned"""
)

_ARCHIVE = f"archive AS (SELECT url, {_replaced('html', ARCHIVE_TAGS)} AS html FROM pages)"
ORACLES["archive_teasers"] = (
    _with(
        _ARCHIVE,
        """blocks AS (SELECT url AS page_url, string_split(html, '<div data-teaserdate')[2:] AS bs FROM archive)""",
        """each AS (SELECT page_url, unnest(bs) AS b, unnest(range(1, CAST(len(bs) + 1 AS BIGINT))) AS position FROM blocks)""",
    )
    + f"""SELECT page_url, position, '1687000000' AS tstamp, 'Kopf' AS title, '2023' AS date, 'Kurz & gut' AS shorttext,
       nullif({_unescaped("regexp_extract(b, '<a class=.teaser-right__link. href=.([^\"]*).', 1)")}, '') AS url FROM each"""
)
ORACLES["archive_next_page"] = (
    _with(_ARCHIVE) + "SELECT url, CASE WHEN contains(html, '<li class=\"next\">') THEN '/archiv/2' END AS next_url FROM archive"
)
ORACLES["classed_page_text"] = (
    f"WITH classed AS (SELECT page_id, {_replaced('html', CLASSED_TAGS)} AS html FROM pages),\n"
    + """paragraphs AS (
  SELECT page_id, list_transform(string_split(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<p class="x paragraph article__item">')[2:],
         lambda p: regexp_extract(p, '(?s)^(.*?)(?:</p>|</?(?:div|article|section|footer|ul|form|nav|aside|main|h[1-6])\\b|$)', 1)) AS ps FROM classed)
"""
    + f"SELECT page_id, {FILLED_NODES} AS text FROM paragraphs"
)
