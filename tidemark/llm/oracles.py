"""DuckDB SQL that queries of this package must equal."""

from __future__ import annotations


def quality_sql(source: str = "documents") -> str:
    """Counts, sketches, fences and verdict of the quality rules, over the rows of ``source``."""
    bucket = "(x >> greatest(len(bin(x)) - 5, 0)) << greatest(len(bin(x)) - 5, 0)"
    return rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM {source}
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
), r AS (
  SELECT lang, source, 'symbols' AS ratio, n_symbols * 1000 // word_chars AS x FROM c WHERE n_words > 0
  UNION ALL SELECT lang, source, 'length', word_chars * 10 // n_words FROM c WHERE n_words > 0
  UNION ALL SELECT lang, source, 'lines', n_dup_lines * 1000 // n_lines FROM c WHERE n_words > 0
  UNION ALL SELECT lang, source, 'repeats', n_repeat_words * 1000 // n_words FROM c WHERE n_words > 0
), b AS (
  SELECT 0 AS level, lang, source, ratio, {bucket} AS bucket FROM r
  UNION ALL SELECT 1, lang, NULL, ratio, {bucket} FROM r
  UNION ALL SELECT 2, NULL, NULL, ratio, {bucket} FROM r
), h AS (
  SELECT level, lang, source, ratio, bucket, count(*) AS n FROM b GROUP BY ALL
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total,
         sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS upto FROM h
), q AS (
  SELECT level, lang, source, ratio, max(total) AS total,
         min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1,
         min(CASE WHEN upto * 4 >= 3 * total THEN bucket END) AS q3
  FROM u GROUP BY ALL
), f AS (
  SELECT g.lang, g.source, g.ratio, arg_min(q.q1, q.level) AS q1, arg_min(q.q3, q.level) AS q3
  FROM (SELECT DISTINCT lang, source, ratio FROM r) g
  JOIN q ON q.ratio = g.ratio AND (
       (q.level = 0 AND q.lang IS NOT DISTINCT FROM g.lang AND q.source IS NOT DISTINCT FROM g.source)
    OR (q.level = 1 AND q.lang IS NOT DISTINCT FROM g.lang) OR q.level = 2)
  WHERE q.level = 2 OR q.total >= 50
  GROUP BY ALL
), k AS (
  SELECT lang, source,
         max(CASE WHEN ratio = 'symbols' THEN q3 + 4 * greatest(q3 - q1, 40) END) AS s_high,
         max(CASE WHEN ratio = 'length' THEN q1 - 4 * greatest(q3 - q1, 10) END) AS w_low,
         max(CASE WHEN ratio = 'length' THEN q3 + 4 * greatest(q3 - q1, 10) END) AS w_high,
         max(CASE WHEN ratio = 'lines' THEN q3 + 4 * greatest(q3 - q1, 75) END) AS l_high,
         max(CASE WHEN ratio = 'repeats' THEN q3 + 4 * greatest(q3 - q1, 100) END) AS r_high
  FROM f GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND n_symbols * 1000 // word_chars <= s_high AND word_chars * 10 // n_words BETWEEN w_low AND w_high
       AND n_dup_lines * 1000 // n_lines <= l_high AND n_repeat_words * 1000 // n_words <= r_high AS kept
FROM c LEFT JOIN k ON k.lang IS NOT DISTINCT FROM c.lang AND k.source IS NOT DISTINCT FROM c.source
"""


OP10 = quality_sql()
