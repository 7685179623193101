"""Documentation comments: description and tags of one raw comment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspan.functions.source import bind, extract_all, missing, trim

TAG = r"(?:(?<=\n)|\A)[ \t]*@(?:(?!\n[ \t]*@)[\s\S])*+"


def _text(raw: Column) -> Column:
    """The comment's text, one trimmed line per line, or NULL where it is not a documentation comment."""
    inner = F.regexp_replace(raw, r"\A/\*\*+|\*+/\z", "")
    block = F.transform(F.split(inner, "\n"), lambda x: F.regexp_replace(x, r"\A\s*\*?[ \t]?|\s+\z", ""))
    line = F.filter(F.transform(F.split(raw, "\n"), lambda x: trim(F.regexp_replace(x, r"\A\s*//\s?", ""))), lambda x: x != "")
    return F.when(raw.startswith("/**"), trim(F.array_join(block, "\n"))).when(raw.startswith("//"), missing(F.array_join(line, "\n")))


def _tag(t: Column) -> Column:
    """STRUCT<tag, type, name, description>: type in braces, then one word on the tag's line, then the rest."""
    rest = F.regexp_replace(t, r"\A\s*@\S+[ \t]*(?:\{[^}]*\}[ \t]*)?", "")
    name = F.regexp_extract(rest, r"\A(\[[^\]\n]*\]|\S+)", 1)
    return F.struct(
        F.regexp_extract(t, r"\A\s*@(\S+)", 1).alias("tag"), F.regexp_extract(t, r"\A\s*@\S+[ \t]*\{([^}]*)\}", 1).alias("type"),
        F.when(rest.startswith("\n"), "").otherwise(name).alias("name"),
        trim(F.when(rest.startswith("\n"), rest).otherwise(F.substr(rest, F.length(name) + 1))).alias("description"))


def _joined(*parts: Column) -> Column:
    return missing(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " "))


def doc_tags(raw: Column) -> Column:
    """STRUCT<description, params, returns, examples, deprecated, route, access, tags>, NULL when nothing is there."""
    def of_text(text: Column) -> Column:
        lead = trim(F.regexp_replace(text, r"(?:\A|\n)[ \t]*@[\s\S]*\z", ""))
        return bind(F.struct(lead.alias("lead"), F.transform(extract_all(text, TAG), _tag).alias("tags")), build)

    def build(x: Column) -> Column:
        tags = x["tags"]

        def of(*names: str) -> Column:
            return F.filter(tags, lambda t: t["tag"].isin(*names))

        def last(values: Column) -> Column:
            return F.get(F.reverse(values), F.lit(0))

        described = F.get(F.filter(F.transform(of("desc"), lambda t: _joined(t["name"], t["description"])), lambda d: d.isNotNull()), F.lit(0))

        def param(t: Column) -> Column:
            optional = t["name"].rlike(r"\A\[.*\]\z")
            bare = F.regexp_replace(F.regexp_replace(t["name"], r"\A\[|\]\z", ""), r"=.*\z", "")
            return F.struct(F.when(optional, bare).otherwise(t["name"]).alias("name"), missing(t["type"]).alias("type"),
                            t["description"].alias("description"), optional.alias("optional"))

        typed = lambda t: F.when(t["type"] != "", F.concat(F.lit("{"), t["type"], F.lit("}"))).otherwise("")
        route = F.filter(of("route"), lambda t: (t["name"] != "") & (t["description"] != ""))
        out = F.struct(
            F.coalesce(missing(x["lead"]), described, F.lit("")).alias("description"),
            F.transform(of("param", "arg", "argument"), param).alias("params"),
            last(F.transform(of("returns", "return"), lambda t: _joined(typed(t), t["description"]))).alias("returns"),
            F.transform(of("example"), lambda t: t["description"]).alias("examples"),
            last(F.transform(of("deprecated"), lambda t: F.coalesce(missing(t["description"]), missing(t["name"]), F.lit("Deprecated")))).alias("deprecated"),
            last(F.transform(route, lambda t: F.struct(F.upper(t["name"]).alias("method"), t["description"].alias("path")))).alias("route"),
            last(F.transform(of("access"), lambda t: _joined(t["name"], t["description"]))).alias("access"),
            F.transform(F.filter(tags, lambda t: ~t["tag"].isin(
                "param", "arg", "argument", "returns", "return", "example", "deprecated", "desc", "route", "access")),
                lambda t: F.struct(t["tag"].alias("tag"), t["name"].alias("name"), t["description"].alias("description"))).alias("tags"))
        return bind(out, lambda o: F.when(
            (o["description"] != "") | (F.size(o["params"]) > 0) | o["returns"].isNotNull() | (F.size(o["examples"]) > 0)
            | o["deprecated"].isNotNull() | o["route"].isNotNull() | o["access"].isNotNull() | (F.size(o["tags"]) > 0), o))

    return bind(_text(trim(raw)), lambda t: F.when(t.isNotNull(), of_text(t)))


def comment_description(raw: Column) -> Column:
    """Plain description of a comment without documentation tags."""
    inner = F.regexp_replace(raw, r"\A/\*+|\*+/\z", "")
    lines = F.transform(F.split(inner, "\n"), lambda x: trim(F.regexp_replace(x, r"\A\s*//\s?", "")))
    return missing(trim(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("@")), " ")))
