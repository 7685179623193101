"""Type annotations in the short form signatures use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspan.functions.source import ANGLE, CURLY, NAME, ROUND, SQUARE, bind, json_string, missing, piece, extract_all, trim

# What forms other than names, unions and literals are called.
FORMS = (
    (rf"\A(?:{ANGLE}\s*)?{ROUND}\s*=>", "function"),
    (r"\A(?:abstract\s+)?new\s*\(", "constructortype"),
    (rf"\A{CURLY}\z", "{ … }"),
    (r"\A(?:asserts\s+)?[\w$]+\s+is\s", "typepredicate"),
    (r"\A(?:keyof|unique|readonly)\s", "typeoperator"),
    (r"\Atypeof\s", "typequery"),
    (r"\A[^?]+\sextends\s[^?]+\?", "conditionaltype"),
    (rf"\A{ROUND}\z", "parenthesizedtype"),
    (rf"\A{SQUARE}\z", "tupletype"),
    (r"\Athis\z", "thistype"),
    (r"\A[\s\S]*\[[^\]]+\]\z", "indexedaccesstype"),
    (r"\A[\w$]+\s*\.", "ref"),
)


def _atom(t: Column) -> Column:
    """One member of a union or intersection, without array suffixes."""
    out = None
    for pattern, label in FORMS:
        out = F.when(t.rlike(pattern), label) if out is None else out.when(t.rlike(pattern), label)
    return (out.when(t.rlike(r"""\A["']"""), json_string(t))
            .when(t.rlike(r"\A-?[0-9]"), t)
            .otherwise(F.regexp_extract(t, rf"\A{NAME}", 0)))


def _member(t: Column) -> Column:
    whole = F.regexp_replace(t, r"(?:\s*\[\s*\])+\z", "")
    suffix = F.repeat(F.lit("[]"), F.size(extract_all(F.regexp_extract(t, r"(?:\[\s*\]\s*)+\z", 0), r"\[")))
    operator = t.rlike(r"\A(?:keyof|unique|readonly|typeof)\s")
    return F.when(operator, _atom(t)).otherwise(F.concat(_atom(whole), suffix))


def type_name(raw: Column) -> Column:
    """Short form of a type text, NULL for none. Generic arguments are dropped."""
    def split(t: Column, sep: str) -> Column:
        return F.filter(F.transform(extract_all(t, piece(sep)), trim), lambda p: p != "")

    def short(t: Column) -> Column:
        union = F.transform(split(t, "|"), lambda m: F.array_join(F.transform(split(m, "&"), _member), " & "))
        return F.when(t.rlike(FORMS[0][0]), "function").otherwise(F.array_join(union, " | "))

    return bind(missing(trim(raw)), lambda t: F.when(t.isNotNull(), short(t)))
