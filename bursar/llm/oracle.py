"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from bursar.llm.quality import DIGITS, FENCE, MAX_REPEAT_PERCENT, MIN_GROUP, MIN_WORDS, SLACK

_WORD = r"[^\x20\x09-\x0D]"
_SAME = "{a}.lang IS NOT DISTINCT FROM {b}.lang"
_SAME_GROUP = _SAME + " AND {a}.source IS NOT DISTINCT FROM {b}.source"


def _quartiles(name: str, keys: str) -> str:
    by = f"{keys}, metric" if keys else "metric"
    return f"""{name}_walk AS (
  SELECT {by}, cell, sum(sum(n)) OVER (PARTITION BY {by} ORDER BY cell) AS upto, sum(sum(n)) OVER (PARTITION BY {by}) AS total
  FROM sketch GROUP BY {by}, cell),
{name} AS (
  SELECT {by}, max(total) AS total, min(cell) FILTER (upto * 4 >= total) AS q1, min(cell) FILTER (upto * 4 >= total * 3) AS q3
  FROM {name}_walk GROUP BY {by})"""


QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}+') AS words,
             [x for x in string_split(text, chr(10)) if regexp_matches(x, '{_WORD}')] AS lines FROM d),
p AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
g AS (SELECT rid, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram
      FROM p WINDOW o AS (PARTITION BY rid ORDER BY pos)),
often AS (SELECT rid, pos FROM g WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
repeated AS (SELECT rid, count(DISTINCT pos + k) AS n FROM often, range(3) AS r(k) GROUP BY rid),
f AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words,
             COALESCE(list_sum([length(x) for x in words]), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, COALESCE(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN repeated r ON r.rid = w.rid),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             n_symbols * 1000 // greatest(n_words, 1) AS symbol_rate, n_dup_lines * 1000 // greatest(n_words, 1) AS dup_line_rate,
             n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, word_chars * 1000 // greatest(n_words, 1) AS word_length
      FROM f),
v AS (SELECT lang, source, unnest([{', '.join(f"'{k}'" for k in SLACK)}]) AS metric, unnest([{', '.join(SLACK)}]) AS value
      FROM m WHERE NOT base_failed),
sketch AS (SELECT lang, source, metric, value - value % (1::BIGINT << greatest(length(bin(value)) - {DIGITS}, 0)) AS cell, count(*) AS n
           FROM v GROUP BY ALL),
{_quartiles("own", "lang, source")},
{_quartiles("of_lang", "lang")},
{_quartiles("of_all", "")},
picked AS (
  SELECT own.lang, own.source, own.metric,
         CASE WHEN own.total >= {MIN_GROUP} THEN own.q1 WHEN l.total >= {MIN_GROUP} THEN l.q1 ELSE a.q1 END AS lo,
         CASE WHEN own.total >= {MIN_GROUP} THEN own.q3 WHEN l.total >= {MIN_GROUP} THEN l.q3 ELSE a.q3 END AS hi
  FROM own JOIN of_lang l ON {_SAME.format(a="own", b="l")} AND own.metric = l.metric JOIN of_all a ON a.metric = own.metric),
reach AS (SELECT *, greatest((hi - lo) * {FENCE}, CASE metric {' '.join(f"WHEN '{k}' THEN {n}" for k, n in SLACK.items())} END) AS far
          FROM picked),
outside AS (SELECT m.rid FROM m JOIN reach r ON {_SAME_GROUP.format(a="m", b="r")}
            WHERE CASE r.metric {' '.join(f"WHEN '{k}' THEN {k}" for k in SLACK)} END > hi + far
               OR (r.metric = 'word_length' AND word_length < lo - far))
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       {', '.join(SLACK)}, NOT base_failed AND rid NOT IN (SELECT rid FROM outside) AS kept
FROM m"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASE_COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({_LOWER.format('text')}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, w[i:i + k - 1] AS p
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words) CROSS JOIN (SELECT unnest(range(1, 6)) AS k)
  WHERE i + k - 1 <= len(w)),
often AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY lang, p HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, h.f AS l, t.f AS r, n,
         ((1000::HUGEINT * c.f * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM often WHERE len(p) > 1) c
  JOIN often h ON h.lang = c.lang AND h.p = c.p[1:k]
  JOIN often t ON t.lang = c.lang AND t.p = c.p[k + 1:]
  JOIN totals n ON n.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
shorter AS (
  SELECT DISTINCT q.lang, q.p[i:i + m - 1] AS p
  FROM (SELECT *, unnest(range(1, len(p))) AS i FROM often WHERE len(p) > 2) q, (SELECT unnest(range(2, 5)) AS m) s, often o
  WHERE m < len(q.p) AND i + m - 1 <= len(q.p) AND o.lang = q.lang AND o.p = q.p[i:i + m - 1] AND 100 * q.f >= 100 * o.f),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM best WHERE NOT EXISTS (SELECT 1 FROM shorter s WHERE s.lang = best.lang AND s.p = best.p))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

PREFIX_TRIE = """
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (  -- CRC-32 bit by bit over the decimal digits
  SELECT conv_id, own, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           flatten([[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(conv_id::VARCHAR, '')])),
           lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))) % 9 AS h
  FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:h], []), c.own[h + 1:]) AS p
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
nodes AS (
  SELECT p[1:d] AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(p) = d), '')) AS ends_sha256
  FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM rebuilt) GROUP BY p[1:d], d),
facts AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(p[depth].text) END AS saved FROM nodes),
children AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT x.p[1:x.d] AS p, sum(saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM facts) x LEFT JOIN children c ON c.p = x.p GROUP BY x.p[1:x.d])
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs, coalesce(c.n, 0) AS n_children,
       b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM facts f JOIN below b ON b.p = f.p LEFT JOIN children c ON c.p = f.p
LEFT JOIN nodes q ON f.depth > 0 AND q.p = f.p[1:f.depth - 1]
"""
