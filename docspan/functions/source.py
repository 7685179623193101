"""Lexical views of JavaScript and TypeScript files, as native regular expressions over one row's text.

Everything here is an inventory by pattern, not a grammar. Blocks in braces are found at any depth: ``leveled`` writes the
height of a block beside both of its braces, so a block ends at the next closing brace of its own height.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"[A-Za-z_$][\w$]*"
#: For a name that no word character may follow: shorter names are not tried.
WHOLE_NAME = rf"{NAME}+"
EDGE = r"(?<![\w$.])"
STRING = r"""(?:"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|`(?:\\[\s\S]|[^`\\])*+`)"""
COMMENT = r"(?://[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)"
#: A slash begins a pattern where a value may stand: after an operator, an opening bracket, a comma, or one of these words. After a
#: name, a number or a closing bracket it divides; after an angle bracket it belongs to a tag.
BEFORE_VALUE = r"(?<=(?:\A|[=(\[{,;:!?&|+*%~^-]|=>|(?<![\w$.])(?:return|typeof|case|in|of|do|else|void|delete|throw|yield|await))\s{0,40})"
#: Only a slash is worth the look back.
PATTERN = rf"(?:(?=/){BEFORE_VALUE}/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\[\n])++/[A-Za-z]*+)"
TOKEN = rf"""[^"'`/]++|{STRING}|{COMMENT}|{PATTERN}|[\s\S]"""
#: Brackets outside strings, comments and patterns are its group; all else is matched without one.
BRACKET = rf"""([(){{}}\[\]]++)|(?:[^"'`/(){{}}\[\]]++|{STRING}|{COMMENT}|{PATTERN}|["'`/])++"""
MARK, CUT, HEAD_END = "\x02", "\x01", "\x07"
OPEN, OPENED, SHUT, CLOSED = "\x03", "\x04", "\x05", "\x06"
#: Stand for braces that do not count: those in strings, and those below the levels that ``shallow`` keeps.
QUIET = "\x0e\x0f"
#: Stands before a further name of a list of declarations whose value is a function.
ALSO = "\x10"
#: Signs that mean something outside a pattern, and what stands for them inside one.
SIGNS = "(){}[]<>\"'`,;=/"
UNSAID = "".join(chr(0xE000 + k) for k in range(len(SIGNS)))
#: Levels of brackets of one kind inside a pair, for the kinds that patterns have to balance.
LEVELS = 12


def nested(open_: str, close: str, depth: int = LEVELS) -> str:
    """Inside of a bracket pair: anything, with pairs of the same kind balanced to ``depth`` levels. Brackets in
    strings do not count."""
    free = rf"""[^{open_}{close}"'`]++|{STRING}|["'`]"""
    inner = rf"(?:{free})*+"
    for _ in range(depth):
        inner = rf"(?:{free}|{open_}{inner}{close})*+"
    return inner


ROUND = rf"\({nested(r'\(', r'\)')}\)"
CURLY = rf"\{{{nested(r'\{', r'\}')}\}}"
SQUARE = rf"\[{nested(r'\[', r'\]')}\]"
ANGLE = rf"<{nested('<', '>')}>"


def run(but: str) -> str:
    """Characters that begin neither a string nor an arrow nor a bracket, nor are among ``but``: they are taken at once."""
    return rf"""[^{but}(){{}}\[\]<>"'`=]++"""


def piece(separators: str) -> str:
    """A run up to a separator outside brackets and strings."""
    return rf"(?:{run(separators)}|=>|{STRING}|{ROUND}|{CURLY}|{SQUARE}|{ANGLE}|[^{separators}(){{}}\[\]<>])++"


def block(group: int) -> str:
    """A block of leveled text; ``group`` is the number of the group that takes its height."""
    return rf"{OPEN}(\d+){OPENED}[\s\S]*?{SHUT}\{group}{CLOSED}"


def leveled_piece(separators: str) -> str:
    """``piece`` for leveled text; its first group is taken."""
    return rf"(?:{run(separators + OPEN + SHUT)}|=>|{STRING}|{ROUND}|{block(1)}|{SQUARE}|{ANGLE}|[^{separators}(){{}}\[\]<>{OPEN}{SHUT}])++"


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def having(text: Column, *words: str) -> Column:
    """The text if it holds one of the words, else the empty string: costly patterns then run only where they can
    match at all."""
    test = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        test = test | F.contains(text, F.lit(w))
    return F.when(test, text).otherwise("")


def bind(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces(text: Column, separators: str = ",") -> Column:
    trimmed = F.transform(extract_all(text, piece(separators)), trim)
    return F.filter(trimmed, lambda p: p != "")


def leveled(text: Column) -> Column:
    """The text with heights at its braces: a block without blocks in it has height 1. Each step writes the heights of all
    blocks whose inner blocks have theirs, so there are as many steps as levels. Braces without a partner stay plain."""
    strings = extract_all(text, rf"""[^"'`]++|{STRING}|["'`]""")
    quiet = F.array_join(F.transform(strings, lambda t: F.when(t.rlike(r"""\A["'`]"""), F.translate(t, "{}", QUIET)).otherwise(t)), "")

    def deepest(t: Column) -> Column:
        return F.aggregate(
            F.split(F.regexp_replace(t, r"[^{}]++", ""), ""), F.struct(F.lit(0).alias("depth"), F.lit(1).alias("most")),
            lambda s, c: F.struct(
                (s["depth"] + F.when(c == "{", 1).when((c == "}") & (s["depth"] > 0), -1).otherwise(0)).alias("depth"),
                F.greatest(s["most"], s["depth"] + (c == "{").cast("int")).alias("most")),
            lambda s: s["most"])

    def step(t: Column, height: Column) -> Column:
        h = height.cast("string")
        return F.regexp_replace(t, r"\{([^{}]*+)\}", F.concat(F.lit(OPEN), h, F.lit(f"{OPENED}$1{SHUT}"), h, F.lit(CLOSED)))

    return bind(quiet, lambda t: F.aggregate(F.sequence(F.lit(1), deepest(t)), t, step))


def plain(text: Column) -> Column:
    """Leveled or shallow text as it was."""
    shown = F.translate(text, QUIET + HEAD_END + CUT + ALSO, "{}")
    return F.regexp_replace(F.regexp_replace(shown, rf"{OPEN}\d+{OPENED}", "{"), rf"{SHUT}\d+{CLOSED}", "}")


def inside(block_text: Column) -> Column:
    """A leveled block without its own braces."""
    return F.regexp_replace(block_text, rf"\A{OPEN}\d+{OPENED}|{SHUT}\d+{CLOSED}\z", "")


def shallow(text: Column, levels: int = 3) -> Column:
    """Leveled text with plain braces in its outer levels and quiet ones below, for patterns that look at the outer levels
    only. Nothing is lost: ``plain`` gives all of it back."""
    if levels == 0:
        return F.regexp_replace(F.regexp_replace(text, rf"{OPEN}\d+{OPENED}", QUIET[0]), rf"{SHUT}\d+{CLOSED}", QUIET[1])
    return F.array_join(F.transform(extract_all(text, rf"[^{OPEN}]++|{block(1)}"), lambda t: F.when(
        t.startswith(OPEN), F.concat(F.lit("{"), shallow(inside(t), levels - 1), F.lit("}"))).otherwise(t)), "")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def missing(c: Column) -> Column:
    """NULL for the empty string a pattern without a match gives."""
    return F.nullif(c, F.lit(""))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def said(text: Column) -> Column:
    """Text as it was, with the signs inside patterns."""
    return F.translate(text, UNSAID, SIGNS)


def tokens(content: Column) -> Column:
    """Strings, comments, patterns and the text between them, in order."""
    return extract_all(F.replace(F.coalesce(content, F.lit("")), F.lit("\r\n"), F.lit("\n")), TOKEN)


def is_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("/*")


def is_pattern(token: Column) -> Column:
    """A slash that divides is a token of its own; a pattern has at least three characters."""
    return token.startswith("/") & (F.length(token) > 1) & ~is_comment(token)


def marked_code(toks: Column) -> Column:
    """The text with each comment replaced by a numbered mark and the line ends it held, and without signs in patterns."""
    def one(t: Column, i: Column) -> Column:
        mark = F.concat(F.lit(MARK), i.cast("string"), F.lit(MARK), F.regexp_replace(t, r"[^\n]", ""))
        return F.when(is_comment(t), mark).when(is_pattern(t), F.translate(t, SIGNS, UNSAID)).otherwise(t)

    return F.array_join(F.transform(toks, one), "")


def clean_code(marked: Column) -> Column:
    """The text without comments; line numbers are kept."""
    return F.regexp_replace(marked, f"{MARK}[0-9]+{MARK}", "")


def brackets(content: Column) -> Column:
    """The brackets of a text outside comments, patterns and strings, in order: one pass, without an array of tokens."""
    return F.regexp_replace(F.replace(F.coalesce(content, F.lit("")), F.lit("\r\n"), F.lit("\n")), BRACKET, "$1")


def comment_value(raw: Column) -> Column:
    return F.when(raw.startswith("//"), F.substr(raw, F.lit(3))).otherwise(F.regexp_replace(raw, r"\A/\*|\*/\z", ""))


def cleaned_comment(raw: Column) -> Column:
    """One line of text: star prefixes stripped, lines joined by a space."""
    lines = F.split(F.regexp_replace(comment_value(raw), r"\A\*", ""), "\n")
    kept = F.filter(F.transform(lines, lambda x: trim(F.regexp_replace(x, r"\A\s*\*?\s?", ""))), lambda x: x != "")
    return F.array_join(kept, " ")


def comments(toks: Column) -> Column:
    return F.filter(F.transform(F.filter(toks, is_comment), cleaned_comment), lambda c: c != "")


def leading_comment(before: Column, toks: Column) -> Column:
    """Raw comment above a declaration, given the marked text before it: the closest block comment alone, or all
    the line comments joined. NULL when there is none."""
    run = F.regexp_extract(before, rf"(?:{MARK}[0-9]+{MARK}\s*)+\z", 0)
    raws = F.transform(extract_all(run, rf"{MARK}([0-9]+){MARK}", 1), lambda n: F.get(toks, n.cast("int")))
    last = F.element_at(raws, F.greatest(F.size(raws), F.lit(1)))
    joined = missing(F.array_join(F.filter(raws, lambda r: r.startswith("//")), "\n"))
    return F.when(run != "", F.when(last.startswith("/*"), last).otherwise(joined))


def env_vars(code: Column) -> Column:
    found = extract_all(code, rf"{EDGE}process\s*\.\s*env\s*(?:\.\s*|\[\s*)({NAME})", 1)
    return F.array_sort(F.array_distinct(found))


def directives(code: Column) -> Column:
    """Contents of the string statements a file opens with."""
    head = F.regexp_extract(code, r"""\A(?:\s*(?:"[^"\n]*"|'[^'\n]*')\s*(?:;|\n|\z))+""", 0)
    return extract_all(head, r"""["']([^"'\n]*)["']""", 1)


def json_string(literal: Column) -> Column:
    """A quoted JavaScript string as a JSON string."""
    inner = F.substr(literal, F.lit(2), F.length(literal) - 2)
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(inner, r"\\'", "'"), r'(?<!\\)"', r'\\"'), F.lit('"'))


def balanced(marks: Column) -> Column:
    """Every bracket kind of a text of brackets closes as often as it opens, and never before. Each kind is looked at by itself;
    pairs of a few levels are taken out first, which changes neither, and only what is left is counted."""
    def pairs(text: Column, others: str, opening: str, closing: str) -> Column:
        o, c = f"\\{opening}", f"\\{closing}"
        paired = rf"{o}(?:{o}(?:{o}(?:{o}{c})*+{c})*+{c})*+{c}"
        left = F.regexp_replace(F.translate(text, others, ""), paired, "")

        def depths(own: Column) -> Column:
            return F.aggregate(
                F.split(own, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
                lambda s, x: F.struct(
                    (s["depth"] + F.when(x == opening, 1).when(x == closing, -1).otherwise(0)).alias("depth"),
                    F.least(s["least"], s["depth"] - (x == closing).cast("int")).alias("least"),
                ),
                lambda s: (s["depth"] == 0) & (s["least"] == 0),
            )
        return bind(left, lambda own: (own == "") | depths(own))

    return bind(marks, lambda text: pairs(text, "[]{}", "(", ")") & pairs(text, "(){}", "[", "]") & pairs(text, "()[]", "{", "}"))
