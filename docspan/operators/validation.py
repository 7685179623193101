"""Record validation: each record keeps the first message per field, and bad records are set aside."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.functions.text import js_trim


@dataclass(frozen=True)
class Check:
    field: str
    fails: Callable[[Column], Column]
    message: str


def _length(c: Column) -> Column:
    return F.length(js_trim(c))


def at_least(n: int) -> Callable[[Column], Column]:
    return lambda c: F.coalesce(_length(c), F.lit(0)) < n


def at_most(n: int) -> Callable[[Column], Column]:
    return lambda c: F.coalesce(_length(c), F.lit(0)) > n


def untrimmed_at_most(n: int) -> Callable[[Column], Column]:
    return lambda c: F.coalesce(F.length(c), F.lit(0)) > n


def below(n: int) -> Callable[[Column], Column]:
    return lambda c: c < n


def above(n: int) -> Callable[[Column], Column]:
    return lambda c: c > n


# Fixed value: the form of an e-mail address.
EMAIL = r"(?i)\A(?!\.)(?!.*\.\.)([A-Z0-9_'+\-.]*)[A-Z0-9_+-]@([A-Z0-9][A-Z0-9-]*\.)+[A-Z]{2,}\z"


def not_email(c: Column) -> Column:
    return ~F.coalesce(js_trim(c).rlike(EMAIL), F.lit(False))


# Limits and messages.
RULESETS: dict[str, tuple[Check, ...]] = {
    "users": (
        Check("full_name", at_least(2), "Enter your full name"),
        Check("full_name", at_most(120), "String must contain at most 120 character(s)"),
        Check("email", not_email, "Enter a valid email address"),
    ),
    "projects": (
        Check("project_name", at_least(1), "Project name is required"),
        Check("project_name", at_most(140), "String must contain at most 140 character(s)"),
        Check("description", at_most(1000), "String must contain at most 1000 character(s)"),
    ),
    "versions": (Check("message", untrimmed_at_most(280), "String must contain at most 280 character(s)"),),
    "documents": (Check("title", at_most(200), "String must contain at most 200 character(s)"),),
    "feedback": (
        Check("rating", lambda c: c.isNull(), "Required"),
        Check("rating", below(1), "Number must be greater than or equal to 1"),
        Check("rating", above(5), "Number must be less than or equal to 5"),
        Check("comment", untrimmed_at_most(500), "String must contain at most 500 character(s)"),
    ),
    "commits": (
        Check("branch", lambda c: F.coalesce(F.length(c), F.lit(0)) < 1, "String must contain at least 1 character(s)"),
        Check("message", lambda c: F.coalesce(F.length(c), F.lit(0)) < 1, "String must contain at least 1 character(s)"),
        Check("message", untrimmed_at_most(280), "String must contain at most 280 character(s)"),
    ),
}


def errors_of(checks: tuple[Check, ...]) -> Column:
    """ARRAY<STRUCT<field, message>>: the first failing check of each field."""
    fields = list(dict.fromkeys(c.field for c in checks))
    found = []
    for f in fields:
        message = F.coalesce(*[F.when(c.fails(F.col(f)), F.lit(c.message)) for c in checks if c.field == f])
        found.append(F.when(message.isNotNull(), F.struct(F.lit(f).alias("field"), message.alias("message"))))
    return F.array_compact(F.array(*found))


def validate(df: DataFrame, checks: tuple[Check, ...]) -> tuple[DataFrame, DataFrame]:
    """(good records, bad records with an ``errors`` column)."""
    judged = df.withColumn("errors", errors_of(checks))
    return judged.filter(F.size("errors") == 0).drop("errors"), judged.filter(F.size("errors") > 0)


def generatable(requests: DataFrame) -> DataFrame:
    """Requests with notes or at least one file."""
    return requests.filter((F.coalesce(js_trim(F.col("notes")), F.lit("")) != "") | (F.coalesce("files", F.lit(0)) > 0))
