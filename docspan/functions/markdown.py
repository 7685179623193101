"""Markdown block tokens of one text, as a native expression.

The block rules read a text line by line and never look back, so one ordered alternation of patterns, matched
from left to right, takes exactly the same steps: no line table, no window, no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspan.functions.source import bind, extract_all
from docspan.functions.text import WS, WS_INLINE, js_trim

END = r"(?=\n|\z)"
START = r"(?<![^\n])"
# JavaScript's dot stops at these too
DOT = r"[^\n\r\x{2028}\x{2029}]"
CODE = r"```[^\n]*(?:\n(?!```)[^\n]*)*+(?:\n```[^\n]*)?"
HEADING = rf"#{{1,6}}{WS_INLINE}+{DOT}*+{END}"
QUOTE = r">[^\n]*"
RULE = rf"{WS_INLINE}*(?:-{{3,}}|\*{{3,}}){WS_INLINE}*{END}"
ROW = rf"\|{DOT}*\|{END}"
SEPARATOR = rf"\|(?:[:|-]|{WS_INLINE})+\|{END}"
TABLE = rf"{ROW}\n{SEPARATOR}(?:\n{ROW})*+"
ITEM = rf"{WS_INLINE}*[-*]{WS_INLINE}+[^\n]*"
LIST = rf"{ITEM}(?:\n{ITEM})*+"
BLANK = rf"{WS_INLINE}*{END}"
BREAKS = rf"{BLANK}|#{{1,6}}{WS_INLINE}|```|>|{WS_INLINE}*[-*]{WS_INLINE}+|\||-{{3,}}{END}"
PARAGRAPH = rf"(?!{BLANK})[^\n]+(?:\n(?!{BREAKS})[^\n]+)*+"
# a line no rule takes and no paragraph may hold ("| a", a heading with a lone CR) stands alone
ALONE = r"(?:\||#{1,6}\s)[^\n]*"
BLOCK = rf"{START}(?:{CODE}|{HEADING}|{QUOTE}|{RULE}|{TABLE}|{LIST}|{ALONE}|{PARAGRAPH})"

KINDS = (("code", rf"\A```"), ("heading", rf"\A{HEADING}\z"), ("quote", r"\A>"), ("hr", rf"\A{RULE}\z"), ("table", rf"\A{TABLE}\z"), ("list", rf"\A{ITEM}"))


def _lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def _token(b: Column) -> Column:
    kind = F
    for name, pattern in KINDS:
        kind = kind.when(b.rlike(pattern), name)

    def build(x: Column) -> Column:
        block, kind = x["b"], x["kind"]
        lines = _lines(block)
        first = F.get(lines, F.lit(0))
        closed = F.get(lines, F.size(lines) - 1).startswith("```") & (F.size(lines) > 1)
        inside = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1 - closed.cast("int"), F.lit(0))), "\n")
        text = (F.when(kind == "code", inside)
                .when(kind == "heading", js_trim(F.regexp_replace(block, rf"\A#{{1,6}}{WS}+", "")))
                .when(kind == "quote", F.regexp_replace(block, rf"\A>{WS}?", ""))
                .when(kind == "paragraph", F.array_join(F.transform(lines, js_trim), " ")))
        items = F.when(kind == "list", F.transform(lines, lambda i: js_trim(F.regexp_replace(i, rf"\A{WS}*[-*]{WS}+", ""))))
        cells = lambda r: F.transform(F.split(F.substr(r, F.lit(2), F.length(r) - 2), r"\|", -1), js_trim)
        rows = F.when(kind == "table", F.transform(F.filter(lines, lambda _, i: i != 1), cells))
        return F.struct(
            kind.alias("type"), F.when(kind == "heading", F.length(F.regexp_extract(block, r"\A#+", 0))).alias("level"),
            F.when(kind == "code", js_trim(F.substr(first, F.lit(4)))).alias("lang"), text.alias("text"), items.alias("items"), rows.alias("rows"))

    return bind(F.struct(b.alias("b"), kind.otherwise("paragraph").alias("kind")), build)


def md_tokens(content: Column) -> Column:
    """ARRAY<STRUCT<type, level, lang, text, items, rows>>."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n", "\n")
    return F.transform(extract_all(text, BLOCK), _token)
