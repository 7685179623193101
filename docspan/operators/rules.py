"""Note classification under a table of rules: an inverted dictionary instead of a test per rule and line.

Words, phrases and patterns of all rules become small keyed tables. A line is looked up in them by its words, by the characters
around its spaces, and by the three-character pieces that a pattern cannot match without; so a line meets the few rules that
can hit it, and thousands of rules cost one pass over its text. Patterns that need no fixed piece of text at all are tested on every
line; their number is limited.

The rules are read to the driver, where their size is checked, before the keyed tables are sent to all tasks."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.functions.notes import CODE_CONFIDENCE, CODE_SECTION, FULL_CONFIDENCE_SCORE, PATTERN_FACTOR, words_of
from docspan.functions.text import ascii_edges
from docspan.operators.rows import elements

#: rule_id, title, rule_order, weight, keywords and patterns, as a table of rules has them.
SCHEMA = ("rule_id string, title string, rule_order int, weight decimal(18,6), keywords array<string>, "
          "patterns array<struct<pattern:string,ignore_case:boolean>>")
#: Words, phrases and patterns of a rules table that may be sent to all tasks.
MOST_ENTRIES = 200_000
#: Patterns without a fixed piece of text.
MOST_LOOSE = 200
_POINTS = "decimal(28,8)"
_GRAM = 3
#: Kinds of entries.
WORD, PHRASE, PATTERN, LOOSE = range(4)


def required_text(pattern: str, ignore_case: bool) -> str:
    """The longest text that every match of a pattern holds, '' if that cannot be told. Alternatives, optional parts and character
    classes give nothing; a part that is repeated at least once gives its own text."""
    try:
        tree = re._parser.parse(pattern, re.IGNORECASE if ignore_case else 0)
    except (re.error, OverflowError, RecursionError):  # a pattern of Java's that Python does not know
        return ""
    best, run = "", ""

    def walk(items) -> None:
        nonlocal best, run
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(value)
            elif name == "AT":
                continue  # a position between characters ends no run
            elif name == "SUBPATTERN":
                if value[1] or value[2]:  # flags of its own
                    run = ""
                else:
                    walk(value[3])
            else:
                best, run = max(best, run, key=len), ""
                if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                    walk(value[2])
                    best, run = max(best, run, key=len), ""
    walk(tree)
    found = max(best, run, key=len)
    # other letters may have several spellings without regard to case
    return found if found.isascii() and not tree.state.flags & re.VERBOSE else ""


@dataclass(frozen=True)
class RuleTables:
    """Keyed tables of a rules table; points are exact decimals."""

    rules: DataFrame
    #: kind, key, test, rule_id and points of all keywords, phrases and patterns.
    entries: DataFrame
    has_words: bool
    phrase_keys: tuple[str, ...]
    pattern_keys: tuple[str, ...]
    loose: tuple[str, ...]
    fallback: str
    code: str


def _java(pattern: str, ignore_case: bool) -> str:
    return ("(?i)" if ignore_case else "") + ascii_edges(pattern)


def _around_space(phrase: str) -> str | None:
    """A space of the phrase with the character before and after it."""
    return next((phrase[k - 1:k + 2] for k in range(1, len(phrase) - 1) if phrase[k] == " "), None)


def prepared(rules: DataFrame) -> RuleTables:
    """Checks and keys a table of rules (``SCHEMA``). Keywords are looked up in the lower-cased line; one with a space is a phrase. Repeated
    keywords and patterns of a rule count once each; null keywords, patterns and weights count nothing."""
    spark = rules.sparkSession
    sizes = rules.agg(F.count("*").alias("rules"), F.sum(F.coalesce(F.size("keywords"), F.lit(0)) + F.coalesce(F.size("patterns"), F.lit(0))).alias("entries")).first()
    if not sizes.rules:
        raise ValueError("a table of rules needs at least one rule")
    if sizes.rules + sizes.entries > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} rules, keywords and patterns")
    rows = rules.select("rule_id", "title", "rule_order", "weight", "keywords", "patterns").collect()
    if len({r.rule_id for r in rows}) < len(rows):
        raise ValueError("rule_id is not unique")
    words, phrases, patterns, loose = [], [], [], []
    for r in rows:
        weight = r.weight or Decimal(0)
        for keyword in {k for k in r.keywords or [] if k}:
            key = _around_space(keyword)
            if " " not in keyword:
                words.append((keyword, r.rule_id, weight))
            elif key:
                phrases.append((key, keyword, r.rule_id, weight))
            else:  # nothing but a space at an end: lines are trimmed, but the text is tested like any other
                loose.append((re.escape(keyword), r.rule_id, weight))
        for p in {(p.pattern, bool(p.ignore_case)) for p in r.patterns or [] if p and p.pattern is not None}:
            needed, points = required_text(*p), weight * PATTERN_FACTOR
            if len(needed) >= _GRAM:
                patterns.append((needed[:_GRAM].lower(), _java(*p), r.rule_id, points))
            else:
                loose.append((_java(*p), r.rule_id, points))
    if len(loose) > MOST_LOOSE:
        raise ValueError(f"more than {MOST_LOOSE} patterns that need no fixed text of {_GRAM} characters")
    first = min(rows, key=lambda r: (r.rule_order, r.rule_id)).rule_id
    code = CODE_SECTION if any(r.rule_id == CODE_SECTION for r in rows) else first
    table = lambda data, ddl: spark.createDataFrame(data, ddl)
    entries = [(WORD, word, None, rule, points) for word, rule, points in words]
    entries += [(PHRASE, *row) for row in phrases] + [(PATTERN, *row) for row in patterns]
    entries += [(LOOSE, str(n), None, rule, points) for n, (_, rule, points) in enumerate(loose)]
    return RuleTables(
        table([(r.rule_id, r.title, r.rule_order) for r in rows], "rule_id string, title string, rule_order int"),
        table(entries, f"kind int, key string, test string, rule_id string, points {_POINTS}"), bool(words), tuple(sorted({r[0] for r in phrases})),
        tuple(sorted({r[0] for r in patterns})), tuple(p for p, _, _ in loose), first, code,
    )


def any_of(keys: tuple[str, ...]) -> str:
    """A pattern whose first group is the key that begins at a place, where one does; keys have equal lengths. It takes no text, so
    keys may overlap."""
    def sign(c: str) -> str:
        return f"\\x{{{ord(c):x}}}"

    def branches(tails: set[str]) -> str:
        heads = sorted({t[0] for t in tails})
        if all(len(t) == 1 for t in tails):
            return f"[{''.join(map(sign, heads))}]"
        return "(?:" + "|".join(sign(h) + branches({t[1:] for t in tails if t[0] == h}) for h in heads) + ")"

    return f"(?=[{''.join(map(sign, sorted({k[0] for k in keys})))}])(?=({branches(set(keys))}))"


def _candidates(lines: DataFrame, tables: RuleTables) -> Column | None:
    """What a line (text, lower) is looked up by: kind, key and the text that a phrase or pattern is tested on."""
    def kind(number: int, keys: Column, text: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(number).alias("kind"), k.alias("key"), text.cast("string").alias("tested")))

    def met(keys: tuple[str, ...]) -> Column:
        return F.array_distinct(F.regexp_extract_all("lower", F.lit(any_of(keys)), F.lit(1)))

    found = []
    if tables.has_words:
        found.append(kind(WORD, F.array_distinct(words_of(F.col("lower"))), F.lit(None)))
    if tables.phrase_keys:
        found.append(kind(PHRASE, met(tables.phrase_keys), F.col("lower")))
    if tables.pattern_keys:
        found.append(kind(PATTERN, met(tables.pattern_keys), F.col("text")))
    if tables.loose:
        hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(str(n))) for n, p in enumerate(tables.loose)]))
        found.append(kind(LOOSE, hits, F.lit(None)))
    return F.concat(*found) if found else None


def rule_scores(blocks: DataFrame, tables: RuleTables) -> DataFrame:
    """note_id, block_no, rule_id and score (exact) of the rules that hit a block which is no code."""
    keys = ["note_id", "block_no"]
    lines = blocks.filter("NOT is_code").select(*keys, "text", F.lower("text").alias("lower"))
    candidates = _candidates(lines, tables)
    if candidates is None:
        return lines.select(*keys, F.lit("").alias("rule_id"), F.lit(0).cast("decimal(38,8)").alias("score")).limit(0)
    # the text goes with phrases and patterns only; lines are read once for all kinds
    met = elements(lines, keys, candidates, "c").select(*keys, "c.*").join(F.broadcast(tables.entries), ["kind", "key"])
    holds = F.when(F.col("kind") == PHRASE, F.contains("tested", "test")).when(F.col("kind") == PATTERN, F.expr("tested RLIKE test")).otherwise(True)
    return met.filter(holds).groupBy(*keys, "rule_id").agg(F.sum("points").alias("score"))


def classify_by_rules(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """``blocks`` (note_id, block_no, text, is_code) with section_id, section_title, section_order and confidence under a table of
    rules: the highest score, the earliest rule on ties; the earliest rule with confidence 0 where nothing hits; code blocks go
    to the rule ``usage`` or, without one, to the earliest. Texts are not exchanged for scoring; scores come back to them by key."""
    tables = prepared(rules)
    keys = ["note_id", "block_no"]
    ordered = rule_scores(blocks, tables).filter("score > 0").join(F.broadcast(tables.rules.select("rule_id", "rule_order")), "rule_id")
    best = ordered.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("rule_order")).alias("early"), "rule_id")).alias("best"))
    confidence = F.least(F.col("best.score").cast("double") / FULL_CONFIDENCE_SCORE, F.lit(1.0))
    chosen = blocks.join(best, keys, "left").select(
        *blocks.columns,
        F.when(F.col("is_code"), tables.code).otherwise(F.coalesce("best.rule_id", F.lit(tables.fallback))).alias("section_id"),
        F.when(F.col("is_code"), CODE_CONFIDENCE).otherwise(F.when(F.col("best").isNull(), 0.0).otherwise(confidence)).alias("confidence"),
    )
    titles = tables.rules.select(F.col("rule_id").alias("section_id"), F.col("title").alias("section_title"), F.col("rule_order").alias("section_order"))
    return chosen.join(F.broadcast(titles), "section_id").select(*blocks.columns, "section_id", "section_title", "section_order", "confidence")


def as_table(spark: SparkSession, rules) -> DataFrame:
    """The fixed rules as a table."""
    return spark.createDataFrame([(r.rule_id, r.title, r.order, Decimal(r.weight), list(r.keywords), [tuple(p) for p in r.patterns]) for r in rules], SCHEMA)
