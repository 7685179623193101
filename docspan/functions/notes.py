"""Note lines: segmentation into blocks and scoring against weighted section rules."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspan.functions.text import WS, WS_INLINE, ascii_edges, js_trim


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    order: int
    weight: str
    keywords: tuple[str, ...]
    # (pattern, ignore case)
    patterns: tuple[tuple[str, bool], ...]


# Section rules — ids, titles, order, weights, keywords and patterns.
RULES = (
    Rule("overview", "Overview", 1, "1",
         ("overview", "summary", "purpose", "about", "introduction", "intro", "goal", "what is", "this module", "this service"),
         ((r"\bthis (module|service|library|package|app|project)\b", True), (r"\bprovides?\b", True))),
    Rule("installation", "Installation", 2, "1.2",
         ("install", "installation", "setup", "set up", "requirement", "requirements", "prerequisite", "dependency", "dependencies"),
         ((r"\bnpm (install|i)\b", True), (r"\byarn add\b", True), (r"\bpnpm add\b", True), (r"\bdocker\b", True))),
    Rule("usage", "Usage", 3, "1",
         ("usage", "use", "using", "example", "examples", "how to", "call", "invoke", "run"),
         ((r"\bfor example\b", True), (r"\be\.g\.?\b", True), (r"\bto (use|run|call)\b", True))),
    Rule("configuration", "Configuration", 4, "1.1",
         ("config", "configure", "configuration", "option", "options", "env", "environment", "setting", "settings", "flag"),
         ((r"\b[A-Z][A-Z0-9_]{3,}\b", False), (r"\.env\b", True))),
    Rule("api", "API", 5, "1.1",
         ("api", "endpoint", "endpoints", "route", "routes", "parameter", "parameters", "param", "returns", "response",
          "request", "method", "function", "payload"),
         ((r"\b(GET|POST|PUT|PATCH|DELETE)\b", False), (r"\/[a-z0-9/_:-]+", True), (r"\breturns?\b", True),
          (r"\baccepts?\b", True), (r"\(\s*\)", False))),
    Rule("caveats", "Notes & Caveats", 6, "1.2",
         ("note", "caveat", "warning", "warn", "gotcha", "limitation", "deprecated", "known issue", "careful", "cannot",
          "doesn't", "not supported"),
         ((r"\bnote:?\b", True), (r"\bwarning:?\b", True), (r"\bdeprecated\b", True), (r"\bdoes not\b", True),
          (r"\bonly supports?\b", True))),
    Rule("todo", "TODO", 7, "1.4",
         ("todo", "fixme", "tbd", "later", "wip"),
         ((r"\bTODO\b", False), (r"\bFIXME\b", False), (r"\bTBD\b", False))),
)
WORD = "[a-zA-Z][a-zA-Z0-9'-]*"
PATTERN_FACTOR = Decimal("1.5")
CODE_SECTION = "usage"
CODE_CONFIDENCE = 0.6
FULL_CONFIDENCE_SCORE = 3

# Scores are integers in units of 1/UNIT, so that equal scores are equal and the earlier rule wins ties.
UNIT = 200

# One match per block, read left to right: a fenced run (up to the closing fence or the end), or one line.
FENCE = rf"{WS_INLINE}*```[^\n]*"
BLOCK = rf"(?<![^\n]){FENCE}(?:\n(?!{WS_INLINE}*```)[^\n]*)*+(?:\n{FENCE})?|[^\n]+"
BULLET = rf"\A{WS}*(?:[-*•]|[0-9]+[.)]){WS}+"


def note_blocks(content: Column) -> Column:
    """ARRAY<STRUCT<text, is_code>> in input order: fenced blocks kept whole, bullets stripped, blank lines dropped."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n", "\n")
    raw = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))

    def block(b: Column) -> Column:
        is_code = b.rlike(rf"\A{WS_INLINE}*```")
        line = js_trim(F.regexp_replace(b, BULLET, ""))
        return F.struct(F.when(is_code, b).otherwise(line).alias("text"), is_code.alias("is_code"))

    return F.filter(F.transform(raw, block), lambda b: b["text"] != "")


def required_literal(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern must contain ('' if none is evident). Written for the
    fixed rules, whose patterns have no alternatives, nested groups or counted repetitions."""
    outside = re.sub(r"\[[^\]]*\](\{[^}]*\}|[*+?])?|\([^)]*\)[*+?]?", "\n", pattern.replace(r"\(", "\x01").replace(r"\)", "\x02"))
    outside = re.sub(r".[?*]", "\n", re.sub(r"\\[bs][*+?]?", "\n", outside))
    runs = re.sub(r"[+^$|]", "\n", outside.replace("\\", "")).split("\n")
    return max(runs, key=len).replace("\x01", "(").replace("\x02", ")")


LITERALS = {pattern: required_literal(pattern) for rule in RULES for pattern, _ in rule.patterns}


def pattern_hit(line: Column, lower: Column, pattern: str, ignore_case: bool) -> Column:
    """Pattern test behind cheaper tests, which most lines fail at a fraction of the cost."""
    def test(p: str) -> Column:
        return line.rlike(("(?i)" if ignore_case else "") + ascii_edges(p))

    hit, literal = test(pattern), LITERALS.get(pattern)
    if literal is None:  # rules of a user's own have no such test
        return hit
    if r"\b" in pattern and (not literal or "|" in pattern):  # the pattern without its edges matches wherever it does
        hit = test(pattern.replace(r"\b", "")) & hit
    if not literal:
        return hit
    return F.contains(lower if ignore_case else line, F.lit(literal.lower() if ignore_case else literal)) & hit


def rule_score(line: Column, lower: Column, words: Column, rule: Rule) -> Column:
    """Score of one line under one rule, in 1/UNIT."""
    weight = Decimal(rule.weight) * UNIT
    single = [k for k in rule.keywords if " " not in k]
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(k) for k in single]))) if single else F.lit(0)
    for phrase in (k for k in rule.keywords if " " in k):
        hits = hits + F.contains(lower, F.lit(phrase)).cast("int")
    matches = F.lit(0)
    for pattern, ignore_case in rule.patterns:
        matches = matches + pattern_hit(line, lower, pattern, ignore_case).cast("int")
    return hits * int(weight) + matches * int(weight * PATTERN_FACTOR)


def words_of(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def keywords_in(lower: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The words of a line that are a keyword of some rule, so that each rule looks at a few words and not at the whole line."""
    single = sorted({k for r in rules for k in r.keywords if " " not in k})
    return F.array_intersect(words_of(lower), F.array(*[F.lit(k) for k in single])) if single else F.array().cast("array<string>")


def best_rule(text: Column, lower: Column, words: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """STRUCT<score, neg_order, rule_id, title>: the highest score, the earliest rule on ties."""
    return F.array_max(F.array(*[
        F.struct(rule_score(text, lower, words, r).alias("score"), F.lit(-r.order).alias("neg_order"),
                 F.lit(r.rule_id).alias("rule_id"), F.lit(r.title).alias("title"))
        for r in rules
    ]))


def section_of(is_code: Column, best: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """STRUCT<section_id, section_title, section_order, confidence> of one block, given its best rule."""
    fallback = min(rules, key=lambda r: r.order)
    code = next((r for r in rules if r.rule_id == CODE_SECTION), fallback)
    hit = best["score"] > 0

    def choose(if_code, if_hit: Column, otherwise) -> Column:
        return F.when(is_code, F.lit(if_code)).when(hit, if_hit).otherwise(F.lit(otherwise))

    confidence = F.least(best["score"] / F.lit(float(UNIT * FULL_CONFIDENCE_SCORE)), F.lit(1.0))
    return F.struct(
        choose(code.rule_id, best["rule_id"], fallback.rule_id).alias("section_id"),
        choose(code.title, best["title"], fallback.title).alias("section_title"),
        choose(code.order, -best["neg_order"], fallback.order).alias("section_order"),
        choose(CODE_CONFIDENCE, confidence, 0.0).alias("confidence"),
    )
