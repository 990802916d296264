"""SQL for the queries that SQL can express, written from their definitions alone."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


def _words(column: str, pattern: str = WORD) -> str:
    return f"regexp_extract_all(coalesce({column}, ''), '{pattern}')"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words(_lower("text"), ALNUM)} AS ws FROM documents),
b AS (SELECT item_id, {_words(_lower("text"), ALNUM)} AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[p : p + n - 1], ' ') AS s
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n,
               unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
doc_windows AS (
  SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p
        FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, item_id, p, n FROM doc_windows JOIN item_windows USING (n, s)),
words AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS i FROM hits),
n_hits AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
run_starts AS (
  SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM words),
runs AS (
  SELECT doc_id, max(n) AS longest
  FROM (SELECT doc_id, run, count(*) AS n FROM run_starts GROUP BY doc_id, run) GROUP BY doc_id),
item_places AS (
  SELECT item_id, n, q, array_to_string(ws[q : q + n - 1], ' ') AS s
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n,
               unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS q
        FROM b WHERE len(ws) > 0)),
aligned AS (
  SELECT doc_id, item_id, n, p - q AS shift, p,
         p - row_number() OVER (PARTITION BY doc_id, item_id, n, p - q ORDER BY p) AS stretch
  FROM doc_windows JOIN item_places USING (n, s)),
matches AS (
  SELECT doc_id, n + count(*) - 1 AS words, min(p) - 1 AS start
  FROM aligned GROUP BY doc_id, item_id, n, shift, stretch),
longest AS (
  SELECT doc_id, words, start FROM matches
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, start) = 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
       coalesce(longest, 0) AS longest_run,
       coalesce(words, 0) AS longest_match, start AS match_start
FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN runs USING (doc_id)
     LEFT JOIN longest USING (doc_id)
"""

MIX = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_words("text")}) AS BIGINT) AS size,
         substr(md5('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS turn
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE turn % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sources),
ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, turn) AS place
  FROM weighted),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            AS level
  FROM ordered),
level AS (SELECT arg_min(level, place) AS level FROM levels WHERE cap >= weight * level),
goals AS (
  SELECT source, source_size, least(cap, weight * level.level) AS target FROM levels, level),
budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM goals),
placed AS (
  SELECT doc_id, source, size,
         sum(size) OVER (PARTITION BY source ORDER BY key, CAST(doc_id AS VARCHAR)
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM sized)
SELECT p.doc_id, p.size, b.source_size, b.target,
       CAST(CASE WHEN b.source_size = 0 THEN 0 ELSE p.size * (b.budget // b.source_size)
            + greatest(0, least(p.size, b.budget % b.source_size - p.before)) END AS BIGINT) AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS ws FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(ws[p : p + 34], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM d WHERE len(ws) >= 35)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM windows JOIN twice USING (s)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _repeated_ngrams(n: int) -> str:
    return f"""
grams_{n} AS (
  SELECT doc_id, p, array_to_string(ws[p : p + {n - 1}], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n} + 2)) AS p FROM d WHERE len(ws) >= {n})),
in_{n} AS (
  SELECT doc_id, count(*) AS words_{n}, sum(length(word)) AS chars_{n}
  FROM words JOIN (
    SELECT DISTINCT doc_id, unnest(range(p, p + {n})) AS i
    FROM grams_{n} JOIN (SELECT doc_id, s FROM grams_{n} GROUP BY ALL HAVING count(*) > 1)
    USING (doc_id, s)) USING (doc_id, i) GROUP BY doc_id)"""


_LENGTHS = {5: 0.40, 6: 0.38, 8: 0.36, 10: 0.34}
QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_words("text")} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
totals AS (SELECT doc_id, sum(length(word)) AS chars FROM words GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)
  WHERE regexp_matches(line, '{WORD}')),
line_totals AS (
  SELECT doc_id, count(*) AS n_dup,
         sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars_again
  FROM lines WHERE again GROUP BY doc_id),
{",".join(_repeated_ngrams(n) for n in _LENGTHS)},
figures AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(words_8, 0)::BIGINT AS n_repeat_words,
         coalesce(chars_again, 0) <= 0.4::DOUBLE * coalesce(chars, 0)
         AND {" AND ".join(f"coalesce(chars_{n}, 0) <= {x}::DOUBLE * coalesce(chars, 0)"
                           for n, x in _LENGTHS.items())} AS varied
  FROM d LEFT JOIN totals USING (doc_id) LEFT JOIN line_totals USING (doc_id)
  {" ".join(f"LEFT JOIN in_{n} USING (doc_id)" for n in _LENGTHS)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND varied AND n_symbols <= 0.1::DOUBLE * n_words AS kept
FROM figures
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_lower("text"))} AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(ws[p : p + 3], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p
          FROM d WHERE len(ws) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes sx ON x = sx.doc_id JOIN sizes sy ON y = sy.doc_id
  WHERE 100 * k >= 85 * (sx.n + sy.n - k)),
reached AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
component AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM component LEFT JOIN sizes USING (doc_id)
"""

LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, i, line, {_lower(f"regexp_replace(line, '{EDGE}', '', 'g')")} AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d)),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, i, line, keeper IS NOT NULL AND doc_id <> keeper AS gone
  FROM lines LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SEARCH = f"""
WITH d AS (
  SELECT doc_id, ws FROM (SELECT doc_id, {_words(_lower("text"), ALNUM)} AS ws FROM documents)
  WHERE len(ws) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d),
item_terms AS (
  SELECT DISTINCT item_id, unnest({_words(_lower("text"), ALNUM)}) AS term FROM benchmark),
held AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, totals GROUP BY term, n_docs),
parts AS (
  SELECT doc_id, term,
         w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))) AS part
  FROM held JOIN weights USING (term), totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score
  FROM item_terms JOIN parts USING (term) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place
  FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
"""
