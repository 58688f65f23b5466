"""SQL that returns the rows of registered queries, written from the definitions alone."""

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}

#: Lines of a text in lower case, words joined by one blank.
_LINES = r"[trim(regexp_replace(l, '[\x20\x09\x0B-\x0D]+', ' ', 'g')) for l in string_split(lower(t), chr(10))]"

SQL["op1_line_quality"] = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, text, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS place, source, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), win AS (SELECT r, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) AS g, unnest(range(1, len(w) - 3)) AS i FROM d),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(least(5, coalesce(following - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM twice) GROUP BY r),
l AS (SELECT r, source, text, place, unnest({_LINES}) AS line FROM d),
total AS (SELECT source, count(DISTINCT coalesce('t' || text, 'n')) AS texts FROM d GROUP BY source),
often AS (
  SELECT l.source, line, min(place) AS first FROM l JOIN total ON l.source IS NOT DISTINCT FROM total.source WHERE line <> ''
  GROUP BY l.source, line, texts HAVING count(DISTINCT text) >= 10 AND (count(DISTINCT text) >= 0.05 * texts OR count(DISTINCT text) >= 10000)
), gone AS (
  SELECT r, count(*) AS lines, sum(len(string_split(l.line, ' '))) AS words FROM l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line AND l.place <> o.first GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len([x for x in string_split(t, chr(10)) if regexp_matches(x, '{WORD}')]) - len(list_distinct([x for x in string_split(t, chr(10)) if regexp_matches(x, '{WORD}')])) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.lines, 0) AS BIGINT) AS removed_lines, CAST(coalesce(gone.words, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, removed_lines, removed_words,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (removed_words > 0.6 * n_words) AS kept FROM m
"""

SQL["op6_minhash_near_copies"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS grams FROM d
), g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

SQL["op7_zstandard_archives"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS least FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN least <> page_id THEN least END AS refers_to FROM g
"""

SQL["op8_source_mix"] = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'none')) AS place FROM documents),
per AS (
  SELECT source, source_size, 2 * source_size AS lim, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), sorted AS (
  SELECT *, sum(lim) OVER w AS lims, sum(weight) OVER w AS weights, sum(source_size) OVER () AS whole, sum(weight) OVER () AS all_weights FROM per
  WINDOW w AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT min_by((1.5 * whole - coalesce(lims, 0)) / (all_weights - coalesce(weights, 0)), lim / weight) AS v FROM sorted
  WHERE (1.5 * whole - coalesce(lims, 0)) / (all_weights - coalesce(weights, 0)) * weight <= lim
), t AS (
  SELECT source, source_size, least(CAST(lim AS DOUBLE), CAST(v AS DOUBLE) * weight) AS target FROM per, level
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS n FROM t
), g AS (
  SELECT d.source, d.place, d.size, count(*) AS k, CAST(floor(e.target) AS BIGINT) - e.n * e.source_size AS extra FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source GROUP BY ALL
), c AS (
  SELECT *, sum(size * k) OVER (PARTITION BY source ORDER BY place, size) - size * k AS before FROM g
)
SELECT doc_id, d.size, e.source_size, e.target,
  CAST(e.n * d.size + CASE WHEN c.before + c.size * c.k <= c.extra THEN d.size WHEN c.before < c.extra THEN floor((c.extra - c.before) / c.k) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.place = c.place AND d.size = c.size
"""

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _part(n: str, total: str) -> str:
    return f"(1 + CAST((1000000000 * (CAST({n} AS HUGEINT) + 5)) // greatest({total} + 5 * v, 1) AS BIGINT))"


SQL["op11_source_divergence"] = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents
), e AS (SELECT lang, source, r, unnest(t) AS term FROM d),
kept AS (SELECT lang, term FROM e GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (
  SELECT s.lang, s.source, coalesce(v, 0) AS v, CAST(coalesce(total, 0) AS HUGEINT) AS total
  FROM s LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) x USING (lang, source) LEFT JOIN v USING (lang)
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, {_part("coalesce(n, 0)", "total")} AS p FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), l AS (
  SELECT lang, term, {_part("n", "total")} AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f
QUALIFY part = 'pair' OR rank <= 50
"""

_POLYNOMIAL = 0xEDB88320
#: CRC-32 of distinct features, a byte at a time; the table is made from the polynomial.
SQL["op12_importance_resampling"] = rf"""
WITH crc AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([CAST(b AS BIGINT)] || [CAST(k AS BIGINT) for k in range(8)], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END) AS c FROM range(256) x(b))
), a AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM a
), f AS (
  SELECT side, r, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS f FROM w
), n AS (SELECT side, r, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM n GROUP BY f),
b AS (
  SELECT f, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(('0x' || substr(x, 2 * i - 1, 2)) AS BIGINT) for i in range(1, len(x) // 2 + 1)],
    lambda c, y: xor(t[1 + xor(c, y) % 256], c >> 8)), 4294967295) % 10000 AS bucket FROM h, crc
), m AS (SELECT side, r, bucket, sum(n) AS n FROM n JOIN b USING (f) GROUP BY ALL),
s AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) AS t FROM m GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM s
), scored AS (
  SELECT w.doc_id, len(w) AS words, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, CAST(coalesce(x.weight, 0) AS BIGINT) AS weight,
    CAST(('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS u
  FROM w LEFT JOIN (SELECT side, r, sum(n * gain) AS weight FROM m JOIN gain USING (bucket) GROUP BY ALL) x USING (side, r) WHERE side = 0
), z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, sum(CAST(words >= 20 AS BIGINT)) OVER () AS whole FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= (5 * whole) // 100 THEN k END AS rank FROM o
"""

#: Backslashes are doubled by the template in every control string of a text.
_CONTROL = r"([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|AS\])"


def _escaped(text: str) -> str:
    return f"regexp_replace({text}, '{_CONTROL}', '\\1\\\\\\2\\3', 'g')"


SQL["op13_reply_tree_chats"] = rf"""
WITH a AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, length({_escaped("text")}) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE length({_escaped("coalesce(role, '')")}) + 21 END AS n FROM a
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
