"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import COMMON_CHARS, COMMON_SHARE, COMMON_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_COMMON

_TERM = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
_JS = _TERM.format(x="p", p="p", q="q") + " + " + _TERM.format(x="q", p="p", q="q")

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines,
    [length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^ \t-\r]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')),
     length(regexp_replace(t, '[^0-9]', '', 'g')), length(regexp_replace(t, '[^!-/:-@\[-`{{-~]', '', 'g'))] AS five
  FROM d),
c AS (SELECT *, list_append(five, length(t) - list_sum(five)) AS cls, len(words) AS n FROM w),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), chr(1)) AS x FROM (SELECT doc_id, words, unnest(range(1, n - 6)) AS i FROM c WHERE n >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS k FROM win) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat FROM (SELECT doc_id, i, unnest(range(0, 8)) AS j FROM again) GROUP BY 1),
flat AS (SELECT doc_id, lang, unnest(words) AS word FROM c),
short AS (SELECT lang, word, count(*) AS n FROM flat WHERE length(word) <= {COMMON_CHARS} GROUP BY 1, 2),
common AS (SELECT lang, word, n FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM short) WHERE n >= total * {COMMON_SHARE}),
top AS (SELECT lang, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM common) WHERE r <= {COMMON_WORDS}),
ref AS (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS q FROM top),
cref AS (SELECT lang, [sum(cls[1]), sum(cls[2]), sum(cls[3]), sum(cls[4]), sum(cls[5]), sum(cls[6])] AS s FROM c GROUP BY 1),
cpq AS (SELECT doc_id, CAST(cls[i] AS DOUBLE) / length(t) AS p, CAST(s[i] AS DOUBLE) / list_sum(s) AS q FROM (SELECT doc_id, t, cls, s, unnest(range(1, 7)) AS i FROM c JOIN cref USING (lang) WHERE length(t) >= {MIN_CHARS})),
cd AS (SELECT doc_id, sqrt(greatest(0, sum({_JS}) / 2)) AS char_distance FROM cpq GROUP BY 1),
counted AS (SELECT doc_id, word, count(*) AS k FROM flat GROUP BY 1, 2),
pq AS (SELECT c.doc_id, q, coalesce(k, 0) AS k, sum(coalesce(k, 0)) OVER (PARTITION BY c.doc_id) AS total FROM c JOIN ref USING (lang) LEFT JOIN counted ON counted.doc_id = c.doc_id AND counted.word = ref.word),
wd AS (SELECT doc_id, sqrt(greatest(0, sum({_JS}) / 2)) AS word_distance FROM (SELECT doc_id, q, k / total AS p FROM pq WHERE total >= {MIN_COMMON}) GROUP BY 1),
base AS (
  SELECT c.doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(t) - cls[2] AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, n < 20 OR 100 * coalesce(n_repeat, 0) > 30 * n AS base_failed
  FROM c LEFT JOIN rep USING (doc_id))
SELECT base.*, NOT base_failed AND coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS kept, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM base LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)
"""
