"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from tesserae.llm.divergence import MIN_DOCS, PRIOR, SHARE, TOP_TERMS
from tesserae.llm.quality import BUCKETS, FIRST, MIN_WORDS, REPEAT_PERCENT, SCORE, SECOND, SYMBOLS, WEIGHT

_WORD = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}+') AS words FROM d),
n AS (SELECT r, doc_id, t, words, array_to_string(words, ' ') AS flat, len(words) AS n_words FROM w),
spots AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM n WHERE n_words >= 3),
three AS (SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS k FROM spots WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM three WHERE k IS NOT NULL) WHERE c >= 2),
again AS (SELECT r, count(DISTINCT i + s) AS n_repeat FROM twice, (SELECT unnest(range(3)) AS s) GROUP BY r),
letters AS (SELECT r, unnest(regexp_extract_all(flat, '(?s).')) AS c, unnest(range(length(flat))) AS i FROM n WHERE length(flat) >= 3),
grams AS (
  SELECT r, (unicode(c)::BIGINT * {FIRST} + unicode(lead(c) OVER o)::BIGINT * {SECOND} + unicode(lead(c, 2) OVER o)::BIGINT) % {BUCKETS} AS b
  FROM letters WINDOW o AS (PARTITION BY r ORDER BY i)),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT n.r, k.good FROM n JOIN known k USING (doc_id)),
raw AS (SELECT b, count(*) AS n FROM grams WHERE b IS NOT NULL GROUP BY b),
own AS (SELECT b, count(*) AS n FROM grams JOIN labelled USING (r) WHERE b IS NOT NULL AND good GROUP BY b),
sizes AS (SELECT (SELECT sum(n) FROM raw)::DOUBLE + {BUCKETS} AS raw_n, (SELECT sum(n) FROM own)::DOUBLE + {BUCKETS} AS own_n),
weights AS (
  SELECT raw.b, CASE WHEN own_n IS NULL THEN 0 ELSE floor((ln((coalesce(own.n, 0) + 1.0::DOUBLE) / own_n) - ln((raw.n + 1.0::DOUBLE) / raw_n)) * {WEIGHT} + 0.5)::BIGINT END AS v
  FROM raw LEFT JOIN own USING (b), sizes),
scores AS (
  SELECT r, floor(sum(v)::DOUBLE / (count(*) * {WEIGHT // SCORE})::DOUBLE)::BIGINT AS s FROM grams JOIN weights USING (b) GROUP BY r),
judged AS (SELECT l.r, l.good, coalesce(s, 0) AS s FROM labelled l LEFT JOIN scores USING (r)),
hist AS (SELECT s, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM judged GROUP BY s),
both_sides AS (SELECT sum(g) AS tg, sum(b) AS tb, min(s) FILTER (g > 0) AS least FROM hist),
ends AS (SELECT s, g, b FROM hist UNION ALL SELECT max(s) + 1, 0, 0 FROM hist),
steps AS (
  SELECT s, lag(s) OVER (ORDER BY s) AS before, coalesce(sum(g) OVER p, 0) * tb + (tb - coalesce(sum(b) OVER p, 0)) * tg AS error
  FROM ends, both_sides WINDOW p AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT CASE WHEN before IS NULL THEN s ELSE before + (s - before + 1) // 2 END AS edge FROM steps ORDER BY error, s DESC LIMIT 1),
cut AS (SELECT CASE WHEN coalesce(tg, 0) = 0 THEN -4611686018427387904 WHEN tb = 0 THEN least ELSE (SELECT edge FROM chosen) END AS edge FROM both_sides),
base AS (
  SELECT r, doc_id, n_words::BIGINT AS n_words, (length(flat) - greatest(n_words - 1, 0))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM n LEFT JOIN again USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, coalesce(s, 0) AS quality_score,
  NOT failed AND coalesce(s, 0) >= edge AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS failed FROM base) LEFT JOIN scores USING (r), cut
"""

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN kinds USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM found GROUP BY lang, source) USING (lang, source)),
langs AS (SELECT lang, any_value(v) AS v, sum(total) AS total FROM groups GROUP BY lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, 1 + ({SHARE}::HUGEINT * (coalesce(f.n, 0) + {PRIOR})) // (g.total + {PRIOR} * g.v)::HUGEINT AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
usual AS (
  SELECT k.lang, k.term, 1 + ({SHARE}::HUGEINT * (sum(f.n)::HUGEINT + {PRIOR})) // (any_value(l.total) + {PRIOR} * any_value(l.v))::HUGEINT AS q
  FROM kept k JOIN found f USING (lang, term) JOIN langs l USING (lang) GROUP BY k.lang, k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS sx, y.source AS sy, sum(abs(x.p - y.p)) AS f FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.sx = a.source AND s.sy = b.source),
excess AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN usual USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS k FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS k FROM excess)
SELECT lang, source, part, item, value::BIGINT AS value, k::INTEGER AS rank FROM ranked WHERE part = 'pair' OR k <= {TOP_TERMS}
"""
