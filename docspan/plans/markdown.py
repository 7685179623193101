"""Markdown queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspan.operators import markdown as M
from docspan.plans.inputs import fixture, spread, sql_input

# texts of the given documents, with marks put in by their line numbers
UNITS_SQL = """
SELECT doc_id, concat('fn', cast(doc_id AS string)) AS name FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, concat('other', cast(doc_id AS string)) FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, concat('third', cast(doc_id AS string)) FROM documents WHERE doc_id % 7 = 0"""


def _tokens(spark, sf):
    return M.md_tokens(spread(fixture(spark, sf, "fx_markdown")))


def _flat(tokens):
    return tokens.select(
        "doc_id", "token_no", "type", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.array_join("items", ";"), F.lit("")).alias("items"),
        F.coalesce(F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";"), F.lit("")).alias("rows"))


def markdown_tokens(spark, sf):
    return _flat(_tokens(spark, sf))


def mixed_markdown_tokens(spark, sf):
    return _flat(M.md_tokens(spread(sql_input(spark, sf, "SELECT * FROM fx_mixed_markdown"))))


def markdown_outline(spark, sf):
    return M.md_outline(_tokens(spark, sf))


def markdown_tables(spark, sf):
    return M.md_tables(_tokens(spark, sf))


def missing_units(spark, sf):
    return M.missing_units(sql_input(spark, sf, UNITS_SQL), _tokens(spark, sf))


def documentation_completeness(spark, sf):
    return M.completeness(sql_input(spark, sf, UNITS_SQL), spread(fixture(spark, sf, "fx_markdown"))).withColumn("warning", F.coalesce("warning", F.lit("")))


QUERIES = {f.__name__: f for f in (markdown_tokens, mixed_markdown_tokens, markdown_outline, markdown_tables, missing_units, documentation_completeness)}


def tokens_sql(source: str) -> str:
    """Block tokens by line classes, fence parity and islands."""
    return rf"""
WITH ls AS (
  SELECT doc_id, generate_subscripts(a, 1) AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM {source})),
f AS (SELECT *, starts_with(line, '```') AS fence FROM ls),
p AS (SELECT *, coalesce(sum(fence::int) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences FROM f),
k AS (
  SELECT *, fence OR fences % 2 = 1 AS code, fence AND fences % 2 = 0 AS opens,
    regexp_full_match(line, '\|.*\|') AND NOT (fence OR fences % 2 = 1) AS piped, regexp_full_match(line, '\|[\s:|-]+\|') AS sep FROM p),
r AS (SELECT *, sum(CASE WHEN piped THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS run,
    lead(piped AND sep) OVER (PARTITION BY doc_id ORDER BY n) AS next_sep FROM k),
t AS (SELECT *, min(CASE WHEN piped AND next_sep THEN n END) OVER (PARTITION BY doc_id, run) AS tstart FROM r),
c AS (
  SELECT *, CASE WHEN code THEN 'code' WHEN regexp_matches(line, '^#{{1,6}}\s+') THEN 'heading' WHEN starts_with(line, '>') THEN 'quote'
    WHEN regexp_full_match(trim(line), '-{{3,}}|\*{{3,}}') THEN CASE WHEN regexp_full_match(line, '-{{3,}}') THEN 'hr' ELSE 'hr?' END
    WHEN piped AND n >= tstart THEN 'table' WHEN regexp_matches(line, '^\s*[-*]\s+') THEN 'list' WHEN trim(line) = '' THEN 'blank'
    WHEN starts_with(line, '|') THEN 'alone' ELSE 'paragraph' END AS raw FROM t),
d AS (SELECT *, CASE WHEN raw <> 'hr?' THEN raw WHEN last_value(CASE WHEN raw <> 'hr?' THEN raw END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) IN ('paragraph', 'alone')
    AND last_value(CASE WHEN raw <> 'hr?' THEN raw END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) = 'paragraph' THEN 'paragraph' ELSE 'hr' END AS cls FROM c),
s AS (
  SELECT *, CASE WHEN cls = 'code' THEN opens WHEN cls IN ('heading', 'quote', 'hr', 'alone') THEN true WHEN cls = 'table' THEN n = tstart
    ELSE cls IS DISTINCT FROM lag(cls) OVER (PARTITION BY doc_id ORDER BY n) END AS starts FROM d WHERE true),
g AS (SELECT *, sum(starts::int) OVER (PARTITION BY doc_id ORDER BY n) AS grp, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn FROM s),
b AS (SELECT doc_id, grp, CASE WHEN min(cls) = 'alone' THEN 'paragraph' ELSE min(cls) END AS type, min(n) AS n0, list(line ORDER BY n) AS lines,
    list(fence ORDER BY n) AS fs FROM g WHERE cls <> 'blank' GROUP BY doc_id, grp),
tokens AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n0) AS token_no, type,
    CASE WHEN type = 'heading' THEN length(regexp_extract(lines[1], '^#+')) ELSE 0 END AS level,
    CASE WHEN type = 'code' THEN trim(lines[1][4:]) ELSE '' END AS lang,
    CASE type WHEN 'code' THEN array_to_string(CASE WHEN len(lines) > 1 AND fs[len(fs)] THEN lines[2:len(lines) - 1] ELSE lines[2:] END, chr(10))
      WHEN 'heading' THEN trim(regexp_replace(lines[1], '^#{{1,6}}\s+', '')) WHEN 'quote' THEN regexp_replace(lines[1], '^>\s?', '')
      WHEN 'paragraph' THEN array_to_string(list_transform(lines, lambda l: trim(l, ' ' || chr(9) || chr(13))), ' ') ELSE '' END AS text,
    CASE WHEN type = 'list' THEN array_to_string(list_transform(lines, lambda l: trim(regexp_replace(l, '^\s*[-*]\s+', ''))), ';') ELSE '' END AS items,
    CASE WHEN type = 'table' THEN array_to_string(list_transform(list_concat(lines[1:1], lines[3:]), lambda l: array_to_string(
      list_transform(string_split(l[2:length(l) - 1], '|'), lambda x: trim(x)), ',')), ';') ELSE '' END AS rows
  FROM b)
"""


ORACLES = {
    "markdown_tokens": tokens_sql("fx_markdown") + "SELECT * FROM tokens",
    "mixed_markdown_tokens": tokens_sql("fx_mixed_markdown") + "SELECT * FROM tokens",
    "markdown_outline": tokens_sql("fx_markdown") + r"""
SELECT doc_id, token_no, level, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '`([^`]+)`', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '</?sub>', '', 'g') AS text
FROM tokens WHERE type = 'heading'""",
    "markdown_tables": """
SELECT doc_id, 4 AS token_no, r AS row_no, c AS col_no, (ARRAY['h', 'k', 'a', 'b'])[2 * r + c + 1] AS cell
FROM fx_markdown, (VALUES (0), (1)) rs(r), (VALUES (0), (1)) cs(c)""",
    "missing_units": f"""
SELECT u.doc_id, u.name FROM ({UNITS_SQL}) u WHERE u.name NOT LIKE 'fn%'""",
    "documentation_completeness": rf"""
SELECT doc_id, unit_count, documented_count, CASE WHEN documented_count < unit_count THEN concat('> ⚠️ **Incomplete documentation:** ', documented_count, ' of ', unit_count,
  ' functions were documented above. Check server logs for details.') ELSE '' END AS warning
FROM (SELECT m.doc_id, u.unit_count, len(regexp_extract_all(m.content, '(?m)^###\s')) AS documented_count FROM fx_markdown m
  JOIN (SELECT doc_id, count(*) AS unit_count FROM ({UNITS_SQL}) GROUP BY doc_id) u ON u.doc_id = m.doc_id)""",
}
