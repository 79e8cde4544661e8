"""SQL of those pN_ queries that SQL can express over whole tables (run by DuckDB)."""

from __future__ import annotations

_LINES = r"""
lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE source IS NOT NULL AND text IS NOT NULL
), keyed AS (
  SELECT doc_id, source, line_no, line, regexp_replace(lower(replace(replace(line, 'ß', 'ss'), 'ẞ', 'ss')), '[^\p{L}\p{N}]+', '', 'g') AS k FROM lines
), frequent AS (
  SELECT source, k FROM (SELECT source, k, count(DISTINCT doc_id) AS n FROM keyed WHERE k <> '' GROUP BY ALL)
  JOIN (SELECT source, count(DISTINCT doc_id) AS docs FROM documents WHERE source IS NOT NULL GROUP BY source) USING (source)
  WHERE n >= 5 AND n >= 0.05 * docs
)"""

_TUPLES = r"""
raw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '\r?\n|\r'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS r,
         replace(replace(text, 'ß', 'ss'), 'ẞ', 'ss') AS t FROM documents WHERE text IS NOT NULL
), flagged AS (
  SELECT doc_id, r, t, len(r) >= 3 AND (
    len(list_filter(r, lambda x: NOT regexp_matches(x, '^[^\p{L}\p{N}]*\p{L}+([^\p{L}\p{N}:]+\p{L}+){0,2}\s*:'))) = 0
    OR len(list_filter(r[2:], lambda x: NOT regexp_matches(x, '^[^\p{L}\p{N}]*(\p{L}+[^\p{L}\p{N}]+){1,4}\p{N}+([^\p{L}\p{N}]+[\p{L}\p{N}]+){0,8}[^\p{L}\p{N}]*$'))) = 0) AS record FROM raw
), tuples AS (
  SELECT doc_id, CASE WHEN record THEN list_sort(list_transform(r, lambda x: trim(regexp_replace(lower(replace(replace(x, 'ß', 'ss'), 'ẞ', 'ss')), '[^\p{L}\p{N}]+', ' ', 'g'))))
    ELSE [trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g'))] END AS v FROM flagged
)"""



def oracle_sql() -> dict[str, str]:
    def grams(name: str, table: str, key: str) -> str:
        return rf"""{name}_w AS (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM {table} WHERE text IS NOT NULL),
{name} AS (SELECT DISTINCT {key}, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM {name}_w WHERE len(ws) >= 13)"""

    return {
        "p3_found": f"WITH {_LINES} SELECT DISTINCT doc_id, CAST(line_no AS BIGINT) AS line_no FROM keyed JOIN frequent USING (source, k)",
        "p3_cleaned": f"""WITH {_LINES}, kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone) AS clean_text, CAST(count(*) FILTER (gone) AS INT) AS removed
  FROM (SELECT keyed.*, f.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent f ON keyed.source = f.source AND keyed.k = f.k) GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(removed, 0) = 0 THEN text ELSE coalesce(clean_text, '') END AS clean_text, coalesce(removed, 0) AS removed FROM documents LEFT JOIN kept USING (doc_id)""",
        "p5_found": f"WITH {_TUPLES}, g AS (SELECT v, min(doc_id) AS doc_id_a FROM tuples GROUP BY v) SELECT DISTINCT doc_id_a, doc_id AS doc_id_b FROM tuples JOIN g USING (v) WHERE doc_id > doc_id_a",
        "p5_collapsed": f"WITH {_TUPLES} SELECT min(doc_id) AS rep_id, count(DISTINCT doc_id) AS n_copies FROM tuples GROUP BY v",
        "p9_found": f"WITH {grams('dg', 'documents', 'doc_id')}, {grams('ig', 'evalitems', 'item_id')} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    }
