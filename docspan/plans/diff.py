"""Diff queries over document versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspan.operators import diff as D
from docspan.operators import versions as V
from docspan.plans.inputs import fixture, spread, sql_input

ASKED_SQL = """
SELECT doc_id, 1 AS from_version, 2 AS to_version FROM documents UNION ALL SELECT doc_id, 2, 3 FROM documents
UNION ALL SELECT doc_id, 1, 3 FROM documents"""
NEWEST_SQL = "SELECT doc_id, 2 AS from_version, 3 AS to_version FROM documents"


def _pairs(spark, sf, asked):
    return V.version_pairs(spread(sql_input(spark, sf, asked)), fixture(spark, sf, "fx_versions_text")).filter("error IS NULL").drop("error")


def diff_statistics(spark, sf):
    return D.diff_stats(_pairs(spark, sf, ASKED_SQL))


def diff_edit_lines(spark, sf):
    return D.diff_lines(_pairs(spark, sf, NEWEST_SQL)).select(
        "doc_id", "line_no", "op", "text", F.coalesce("old_line", F.lit(0)).alias("old_line"), F.coalesce("new_line", F.lit(0)).alias("new_line"))


def line_multiset_delta(spark, sf):
    return D.line_delta(_pairs(spark, sf, ASKED_SQL))


_PAIR = "doc_id, from_version, to_version"


def _same(a: str, b: str) -> str:
    return f"{a}.doc_id = {b}.doc_id AND {a}.from_version = {b}.from_version AND {a}.to_version = {b}.to_version"


def _table_sql(asked: str) -> str:
    """Common lines of the rests of both texts from old line i and new line j on, row by row from the last old line: the longest
    common sequence of a row is that of the row below or starts with a match at j or behind it."""
    return f"""
WITH RECURSIVE asked AS ({asked}),
texts AS (SELECT doc_id, version_no, string_split(content, chr(10)) AS ls FROM fx_versions_text),
pairs AS MATERIALIZED (SELECT a.*, x.ls AS olds, y.ls AS news, len(x.ls) AS n, len(y.ls) AS m FROM asked a
  JOIN texts x ON x.doc_id = a.doc_id AND x.version_no = a.from_version JOIN texts y ON y.doc_id = a.doc_id AND y.version_no = a.to_version),
news AS MATERIALIZED (SELECT {_PAIR}, unnest(range(m + 1)) AS j, unnest(list_append(news, NULL)) AS line FROM pairs),
olds AS MATERIALIZED (SELECT {_PAIR}, unnest(range(n)) AS i, unnest(olds) AS line FROM pairs),
cells AS (
  SELECT {_PAIR}, n AS i, unnest(range(m + 1)) AS j, 0 AS common FROM pairs
  UNION ALL
  SELECT {_PAIR}, i, j, greatest(common, max(hit) OVER (PARTITION BY {_PAIR} ORDER BY j DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS common
  FROM (SELECT c.doc_id, c.from_version, c.to_version, c.i - 1 AS i, c.j, c.common,
      CASE WHEN o.line = b.line THEN 1 + lead(c.common) OVER (PARTITION BY c.doc_id, c.from_version, c.to_version ORDER BY c.j) ELSE 0 END AS hit
    FROM cells c JOIN olds o ON {_same("o", "c")} AND o.i = c.i - 1 JOIN news b ON {_same("b", "c")} AND b.j = c.j))
"""


QUERIES = {"diff_statistics": diff_statistics, "diff_edit_lines": diff_edit_lines, "line_multiset_delta": line_multiset_delta}
ORACLES = {
    "diff_statistics": _table_sql(ASKED_SQL) + f"SELECT {_PAIR}, cast(m - common AS int) AS additions, cast(n - common AS int) AS deletions FROM pairs JOIN cells USING ({_PAIR}) WHERE i = 0 AND j = 0",
    "diff_edit_lines": _table_sql(NEWEST_SQL) + f""",
stored AS MATERIALIZED (SELECT * FROM cells),
walk AS (
  SELECT {_PAIR}, 0 AS i, 0 AS j, 0 AS line_no, '' AS op FROM pairs
  UNION ALL
  SELECT {_PAIR}, i + (op <> 'add')::int, j + (op <> 'del')::int, line_no + 1, op FROM (
    SELECT w.doc_id, w.from_version, w.to_version, w.i, w.j, w.line_no, CASE WHEN w.j = p.m THEN 'del' WHEN w.i = p.n THEN 'add'
      WHEN p.olds[w.i + 1] = p.news[w.j + 1] THEN 'context' WHEN d.common >= r.common THEN 'del' ELSE 'add' END AS op
    FROM walk w JOIN pairs p ON {_same("p", "w")} AND (w.i < p.n OR w.j < p.m)
    LEFT JOIN stored d ON {_same("d", "w")} AND d.i = w.i + 1 AND d.j = w.j LEFT JOIN stored r ON {_same("r", "w")} AND r.i = w.i AND r.j = w.j + 1))
SELECT w.doc_id, cast(line_no AS int) AS line_no, op, CASE WHEN op = 'add' THEN p.news[w.j] ELSE p.olds[w.i] END AS text,
  CASE WHEN op = 'add' THEN 0 ELSE cast(w.i AS int) END AS old_line, CASE WHEN op = 'del' THEN 0 ELSE cast(w.j AS int) END AS new_line
FROM walk w JOIN pairs p ON {_same("p", "w")} WHERE line_no > 0""",
    "line_multiset_delta": f"""
WITH asked AS ({ASKED_SQL}),
sides AS (
  SELECT a.*, unnest(string_split(v.content, chr(10))) AS line, -1 AS side FROM asked a JOIN fx_versions_text v ON v.doc_id = a.doc_id AND v.version_no = a.from_version
  UNION ALL
  SELECT a.*, unnest(string_split(v.content, chr(10))), 1 FROM asked a JOIN fx_versions_text v ON v.doc_id = a.doc_id AND v.version_no = a.to_version),
surplus AS (SELECT doc_id, from_version, to_version, line, sum(side) AS d FROM sides GROUP BY ALL)
SELECT doc_id, from_version, to_version, sum(greatest(d, 0)) AS additions, sum(greatest(-d, 0)) AS deletions FROM surplus GROUP BY ALL""",
}
