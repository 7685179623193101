"""Functions, classes, interfaces, exports and imports of one file, as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspan.functions.source import (ALSO, ANGLE, CLOSED, CURLY, CUT, EDGE, HEAD_END, MARK, NAME, OPEN, OPENED, ROUND, SHUT, SQUARE, STRING, WHOLE_NAME, bind, block,
                                      extract_all, having, inside, json_string, leading_comment, leveled, leveled_piece, missing, newlines,
                                      pieces, plain, run, said, shallow, trim)
from docspan.functions.types import type_name

RETURNS = rf"(?:\s*:\s*((?:[^{{}}<>=;\n]|{ANGLE}|{CURLY})+?))?"
PLAIN_RETURNS = RETURNS.replace(":\\s*((?:", ":\\s*(?:(?:")
GENERIC = rf"(?:{ANGLE}\s*)?"
_FUNCTION = rf"function\s*\*?\s*(?:{NAME}\s*)?{GENERIC}{ROUND}{PLAIN_RETURNS}\s*\{{"
_ARROW = rf"(?:{GENERIC}{ROUND}{PLAIN_RETURNS}|{NAME})\s*=>"
_VALUE = rf"(?:async\s+)?(?:{_FUNCTION}|{_ARROW})"
_WRAPPED = rf"(?:[\w$.]+\(\s*(?:[^()]*?,\s*)?)?{_VALUE}"
#: The first characters are looked at before all else: few places pass.
HEAD = (
    rf"(?=[acdeflmv{ALSO}]){EDGE}(?:(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{NAME}\s*{GENERIC}{ROUND}{PLAIN_RETURNS}\s*\{{"
    rf"|(?:(?:export\s+)?(?:const|let|var)\s+|{ALSO}){NAME}(?:\s*:\s*[^=;\n]+?)?\s*=\s*{_VALUE}"
    rf"|(?<![^\n])(?:module\.)?exports\.{NAME}\s*=\s*{_WRAPPED})"
)
_NAMED_FUNCTION = rf"{NAME}(?:\s*:\s*[^=;\n]+?)?\s*=\s*{_VALUE}"
#: A name and value of a list of declarations, up to the comma; it goes on where the last one ended.
LISTED = rf"((?:\G(?<=,)|{EDGE}(?:const|let|var)\s)(?:{run(',;')}|=>|{STRING}|{ROUND}|{CURLY}|{SQUARE}|{ANGLE}|[^,;(){{}}\[\]<>])*+,)"
HEAD_NAME = rf"\A{ALSO}?(?:export\s+)?(?:default\s+)?(?:(?:const|let|var)\s+|(?:module\.)?exports\.|(?:async\s+)?function\s*\*?\s*)?({NAME})"
PARAM_TAIL = rf"({ROUND}){RETURNS}\s*(?:\{{|=>)\z"

# A function inside another one, in leveled text: an arrow, or a name (or "function") with parameters, and a block.
NESTED = (rf"(?:=>[\s{HEAD_END}]*|{EDGE}(?!(?:if|for|while|switch|catch|with|await)\b){WHOLE_NAME}\s*\*?\s*{GENERIC}{ROUND}"
          rf"(?:\s*:[^{OPEN};=\n]+)?[\s{HEAD_END}]*){block(1)}")

EMPTY_PROPERTIES = "array<struct<name:string,type:string,optional:boolean>>"


def _members(type_text: Column) -> Column:
    """Named members of an object type text: ARRAY<STRUCT<name, type, optional>>."""
    parts = pieces(F.regexp_replace(type_text, r"\A\{|\}\z", ""), r";,\n")
    named = F.filter(parts, lambda m: m.rlike(rf"\A(?:readonly\s+)?{NAME}\??\s*:"))
    return F.transform(named, _property)


def _property(m: Column) -> Column:
    return F.struct(
        F.regexp_extract(m, rf"\A(?:readonly\s+)?({NAME})", 1).alias("name"),
        type_name(F.regexp_extract(m, rf"\A(?:readonly\s+)?{NAME}\??\s*:([\s\S]*)", 1)).alias("type"),
        m.rlike(rf"\A(?:readonly\s+)?{NAME}\?").alias("optional"))


def _object_properties(body: Column, type_text: Column) -> Column:
    def prop(p: Column, members: Column) -> Column:
        name = F.regexp_extract(p, rf"\A(\.\.\.{NAME}|{NAME})", 1)
        known = F.get(F.filter(members, lambda m: m["name"] == name), F.lit(0))
        return F.struct(name.alias("name"), known["type"].alias("type"), F.coalesce(known["optional"], F.lit(False)).alias("optional"))

    members = F.when(F.startswith(trim(type_text), F.lit("{")), _members(trim(type_text))).otherwise(F.array().cast(EMPTY_PROPERTIES))
    keyed = F.filter(pieces(body), lambda p: p.rlike(rf"\A(?:\.\.\.)?{NAME}"))
    return bind(members, lambda ms: F.transform(keyed, lambda p: prop(p, ms)))


def param(p: Column) -> Column:
    """STRUCT<name, type, optional, properties> of one parameter text."""
    is_object, is_array, is_rest = p.startswith("{"), p.startswith("["), p.startswith("...")
    after_pattern = rf"\A(?:{CURLY}|\[[^\]]*\])\s*"
    default = F.when(is_object | is_array, p.rlike(after_pattern + r"(?::(?:[^=]|=>)+)?=(?!>)")).otherwise(
        p.rlike(rf"\A{NAME}\s*\??\s*(?::(?:[^=]|=>)+)?=(?!>)"))
    type_text = F.when(is_object | is_array, F.regexp_extract(p, after_pattern + r":((?:[^=]|=>)+)", 1)).otherwise(
        F.regexp_extract(p, rf"\A(?:\.\.\.)?{NAME}\s*\??\s*:((?:[^=]|=>)+)", 1))
    name = F.regexp_extract(p, rf"\A{NAME}", 0)
    modifier = p.rlike(rf"\A(?:public|private|protected|readonly)\s+{NAME}")

    def build(props: Column) -> Column:
        label = (F.when(is_object, F.concat(F.lit("{ "), F.array_join(F.transform(props, lambda x: x["name"]), ", "), F.lit(" }")))
                 .when(is_array, F.when(default, "param").otherwise("[…]"))
                 .when(is_rest, F.concat(F.lit("..."), F.coalesce(missing(F.regexp_extract(p, rf"\A\.\.\.({NAME})", 1)), F.lit("args"))))
                 .when(modifier, "param").otherwise(name))
        optional = F.when(modifier | is_rest, F.lit(False)).when(is_object | is_array, default).otherwise(default | p.rlike(rf"\A{NAME}\s*\?"))
        return F.struct(label.alias("name"), F.when(~modifier, type_name(type_text)).alias("type"), optional.alias("optional"),
                        F.when(is_object, props).alias("properties"))

    body = F.regexp_replace(F.regexp_extract(p, rf"\A{CURLY}", 0), r"\A\{|\}\z", "")
    props = F.when(is_object, _object_properties(body, type_text)).otherwise(F.array().cast(EMPTY_PROPERTIES))
    return bind(props, build)


def params(text: Column) -> Column:
    """Parameters from the text between the parentheses."""
    return F.transform(pieces(text), param)


def throws(body: Column) -> Column:
    """Distinct sorted labels of the throw statements in a text."""
    def label(t: Column) -> Column:
        callee = F.regexp_extract(t, rf"\Anew\s+(?:{NAME}\s*\.\s*)*({NAME})", 1)
        literal = F.regexp_extract(t, rf"""\Anew\s+[\w$.]+\s*\(\s*("(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+')\s*[,)]""", 1)
        return (F.when((callee != "") & (literal != ""), F.concat(F.lit("new "), callee, F.lit("("), json_string(literal), F.lit(")")))
                .when(t.rlike(r"\Anew\s"), F.concat(F.lit("new "), F.coalesce(missing(callee), F.lit("Error")), F.lit("(…)")))
                .when(t.rlike(rf"\A{NAME}\s*\("), F.concat(F.regexp_extract(t, rf"\A{NAME}", 0), F.lit("(…)")))
                .when(t.rlike(rf"\A{NAME}\s*(?:[;}}\n]|\z)"), F.regexp_extract(t, rf"\A{NAME}", 0))
                .otherwise("unknown"))

    found = extract_all(body, rf"{EDGE}throw\s+((?:{STRING}|[^;\n])+)", 1)
    return F.array_sort(F.array_distinct(F.transform(found, label)))


def own_throws(text: Column) -> Column:
    """Labels of the throw statements of a leveled function text, without those of functions inside it."""
    # a mark may stand for a comment inside the word
    return throws(_unmarked(plain(F.regexp_replace(having(text, "throw", MARK), NESTED, " "))))


def spans(marked: Column) -> Column:
    """The marked text, leveled and cut before every function head: the text before the first, then one span per head."""
    return F.split(leveled(F.regexp_replace(also_named(marked), rf"({HEAD})", rf"{CUT}$1{HEAD_END}")), CUT, -1)


def also_named(marked: Column) -> Column:
    """The text with a sign before the second and later names of a list of declarations whose values are functions."""
    listed = marked.rlike(rf",(?:\s|{MARK}[0-9]+{MARK})*+{NAME}(?:\s*:[^=;\n]+?)?\s*=\s*(?:async\s+)?(?:function\b|[<(]|{NAME}\s*=>)")
    return F.when(listed, _signed(marked)).otherwise(marked)


def _signed(marked: Column) -> Column:
    commas = F.regexp_replace(marked, LISTED, f"$1{ALSO}")
    at_names = F.regexp_replace(commas, rf"{ALSO}((?:\s|{MARK}[0-9]+{MARK})*+)(?={_NAMED_FUNCTION})", f"$1{ALSO}")
    return F.regexp_replace(at_names, rf"{ALSO}(?!{_NAMED_FUNCTION})", "")


def span_lines(parts: Column) -> Column:
    """1-based line on which each span begins."""
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(1).alias("line"))
    step = lambda acc, s: F.struct(F.array_append(acc["at"], acc["line"]).alias("at"), (acc["line"] + newlines(s)).alias("line"))
    return F.aggregate(parts, start, step, lambda acc: acc["at"])


#: Fields of a function, and those of them that are read from its text rather than from its head.
FUNCTION_FIELDS = ("name", "kind", "is_async", "exported", "line", "params", "return_type", "throws", "raw_doc", "body", "inner_comments")
TEXT_FIELDS = ("throws", "body", "inner_comments")


def _chosen(fields: dict, wanted: tuple[str, ...]) -> Column:
    """The wanted fields, in the order of ``fields``; the others are not built."""
    return F.struct(*[build().alias(n) for n, build in fields.items() if n in wanted])


def _of_span(x: Column, toks: Column, wanted: tuple[str, ...], with_params: Column | None = None) -> Column:
    head = plain(x["head"])
    if not set(TEXT_FIELDS) & set(wanted):
        return bind(head, lambda h: _function(x, h, F.lit(""), toks, wanted, with_params))
    after = x["after"]
    opened = F.regexp_extract(x["head"], rf"{OPEN}\d+{OPENED}\z", 0)
    # from the brace of the body on, where there is one; the body ends at the next closing brace of its height

    def ended(y: Column) -> Column:
        start, height = y["start"], y["height"]
        end = F.concat(F.lit(SHUT), height, F.lit(CLOSED))
        return (F.when(height != "", F.concat(F.call_function("substring_index", start, end, F.lit(1)), end))
                .when(y["head"].endswith("{"), after)
                .otherwise(F.coalesce(missing(F.regexp_extract(after, rf"\A{leveled_piece(f';,{ALSO}')}", 0)), after)))

    begun = bind(F.concat(opened, after), lambda s: F.struct(
        head.alias("head"), s.alias("start"), F.regexp_extract(s, rf"\A\s*{OPEN}(\d+){OPENED}", 1).alias("height")))
    return bind(bind(begun, lambda y: F.struct(y["head"].alias("head"), ended(y).alias("text"))),
                lambda y: _function(x, y["head"], y["text"], toks, wanted, with_params))


def _function(x: Column, head: Column, text: Column, toks: Column, wanted: tuple[str, ...], with_params: Column | None = None) -> Column:
    def between() -> Column:
        return bind(F.regexp_extract(head, PARAM_TAIL, 1), lambda tail: F.when(
            tail != "", F.regexp_replace(tail, r"\A\(|\)\z", "")).otherwise(F.regexp_extract(head, rf"({NAME})\s*=>\z", 1)))

    return _chosen({
        "name": lambda: F.regexp_extract(head, HEAD_NAME, 1),
        "kind": lambda: F.when(head.endswith("=>"), "arrow").otherwise("function"),
        "is_async": lambda: head.rlike(r"(?:\A|[\s=(:,])async[\s(]"),
        "exported": lambda: head.startswith("export") | head.startswith("module.") | x["in_object"],
        "line": lambda: x["line"],
        "params": lambda: params(between()) if with_params is None else F.when(with_params, params(between())),
        "return_type": lambda: type_name(F.regexp_extract(head, PARAM_TAIL, 2)),
        "throws": lambda: own_throws(text),
        # a comment above "export default" belongs to the export, not to what is exported
        "raw_doc": lambda: F.when(~head.rlike(r"\Aexport\s+default\b"), leading_comment(x["before"], toks)),
        "body": lambda: _unmarked(plain(text)),
        "inner_comments": lambda: _marked_comments(F.regexp_replace(text, rf"(?:{MARK}[0-9]+{MARK}\s*)+\z", ""), toks),
    }, wanted)


def _cut_span(span: Column) -> tuple[Column, Column]:
    """Head and the rest of a span."""
    head = F.substring_index(span, HEAD_END, 1)
    return head, F.substr(span, F.length(head) + 2)


def _span_rows(parts: Column, with_text: bool, with_line: bool, asked=None) -> Column:
    def row(s: Column, i: Column, at: Column | None) -> Column:
        head, rest = _cut_span(s)
        later = F.array_join(F.slice(parts, i + 3, F.greatest(F.size(parts) - i - 2, F.lit(0))), "")
        after = F.concat(rest, later) if with_text else F.lit("")
        return F.struct(head.alias("head"), (F.when(asked(head), after) if asked else after).alias("after"),
                        (F.get(at, i + 1) if with_line else F.lit(None).cast("int")).alias("line"), F.get(parts, i).alias("before"), F.lit(False).alias("in_object"))

    def rows(at: Column | None) -> Column:
        return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s, i: row(s, i, at))

    return bind(span_lines(parts), rows) if with_line else rows(None)


def _object_rows(code: Column, asked=None) -> Column:
    """Functions written inside ``module.exports = {…}``; their lines are not known."""
    def row(p: Column) -> Column:
        head, rest = _cut_span(p)
        return F.struct(head.alias("head"), rest.alias("after"), F.lit(None).cast("int").alias("line"), F.lit("").alias("before"),
                        F.lit(True).alias("in_object"))

    items = F.filter(cjs_items(code), asked) if asked else cjs_items(code)
    listed = F.filter(items, lambda p: p.rlike(rf"\A{NAME}\s*:\s*{_WRAPPED}"))
    cut = F.transform(listed, lambda p: leveled(F.regexp_replace(p, rf"\A({NAME}\s*:\s*{_WRAPPED})", rf"$1{HEAD_END}")))
    return F.transform(cut, row)


def cjs_items(code: Column) -> Column:
    """Entries of the object that is assigned to ``module.exports``."""
    body = F.regexp_extract(leveled(having(code, "module.exports")), rf"(?<![^\n])module\.exports\s*=\s*({block(2)})", 1)
    return F.transform(pieces(shallow(inside(body))), plain)


def function_list(parts: Column, code: Column, toks: Column, wanted: tuple[str, ...] = FUNCTION_FIELDS, asked=None, with_params: Column | None = None) -> Column:
    """ARRAY<STRUCT<name, kind, is_async, exported, line, params, return_type, throws, raw_doc, body, inner_comments>>
    in line order, of which the ``wanted`` fields are built. ``exported`` is the keyword or CommonJS form only; export lists are
    applied by the caller. With ``asked``, a test of a text, only functions whose head passes are built; where ``with_params`` is
    not true, params are null."""
    rows = F.concat(_span_rows(parts, bool(set(TEXT_FIELDS) & set(wanted)), "line" in wanted, asked), _object_rows(code, asked))
    rows = F.filter(rows, lambda x: asked(x["head"])) if asked else rows
    return F.transform(rows, lambda x: _of_span(x, toks, wanted, with_params))


# ---- imports and exports -------------------------------------------------------------------------------

IMPORT = rf"""(?<![^\n;])[ \t]*import\s+(?:type\s+)?(?:([\w$\s{{}},*]+?)\s+from\s+)?["']([^"'\n]+)["']"""


def imports(code: Column) -> Column:
    """ARRAY<STRUCT<source, default_name, namespace, named>>; ``named`` holds the imported names."""
    text = having(code, "import")
    clauses, sources = extract_all(text, IMPORT, 1), extract_all(text, IMPORT, 2)

    def one(clause: Column, source: Column) -> Column:
        inside = F.regexp_extract(clause, r"\{([^}]*)\}", 1)
        named = F.transform(pieces(inside), lambda p: F.regexp_extract(p, rf"\A(?:type\s+(?!as\b))?({NAME})", 1))
        return F.struct(source.alias("source"), missing(F.regexp_extract(clause, rf"\A\s*({NAME})", 1)).alias("default_name"),
                        missing(F.regexp_extract(clause, rf"\*\s*as\s+({NAME})", 1)).alias("namespace"), named.alias("named"))

    return F.zip_with(clauses, sources, one)


CJS_ONE = rf"(?<![^\n])(?:module\.)?exports\.{NAME}\s*=(?!=)\s*{_WRAPPED}"
CJS_OBJECT = rf"(?<![^\n])module\.exports\s*=\s*{CURLY}"
EXPORT = (
    rf"(?=export|module)(?:{EDGE}export\s+default\s+(?:(?:async\s+)?function\s*\*?\s*[\w$]*|(?:abstract\s+)?class\b\s*[\w$]*|[^\n]*)"
    rf"|{EDGE}export\s+(?:declare\s+|abstract\s+|async\s+)*(?:function\s*\*?\s*|class\s+|interface\s+|type\s+|enum\s+){NAME}"
    rf"|{EDGE}export\s+(?:const|let|var)\s+(?:{run(',;\\n')}|,\s*+|=>|{STRING}|{ROUND}|{CURLY}|{SQUARE}|{ANGLE}|[^;\n(){{}}\[\]<>]|[<>])*+"
    rf"|{EDGE}export\s*(?:type\s*)?\{{[^}}]*\}}"
    rf"|{CJS_ONE}|{CJS_OBJECT})"
)
# Node names under which default exports are listed.
DEFAULT_KINDS = (
    (r"\A(?:async\s+)?function\b", "FunctionDeclaration"),
    (r"\A(?:abstract\s+)?class\b", "ClassDeclaration"),
    (rf"\A(?:async\s*)?(?:{ROUND}[^\n]*?|{NAME}\s*)=>", "ArrowFunctionExpression"),
    (rf"\A{NAME}\s*;?\s*\z", "Identifier"),
    (r"\A\{", "ObjectExpression"),
    (r"\A\[", "ArrayExpression"),
    (rf"\A[\w$.]+\s*\(", "CallExpression"),
)
_EXPORT_TYPE = "array<struct<name:string,kind:string,is_default:boolean>>"


def _item(name: Column, kind: Column, is_default: bool = False) -> Column:
    return F.struct(name.alias("name"), kind.alias("kind"), F.lit(is_default).alias("is_default"))


def _exports_of(s: Column) -> Column:
    """The exports one statement makes."""
    word = F.regexp_extract(s, rf"\Aexport\s+(?:declare\s+|abstract\s+|async\s+)*(function|class|interface|type)\b", 1)
    name = F.regexp_extract(s, rf"({NAME})\z", 1)

    def default(value: Column) -> Column:
        kind = None
        for pattern, label in DEFAULT_KINDS:
            kind = F.when(value.rlike(pattern), label) if kind is None else kind.when(value.rlike(pattern), label)
        default_name = F.coalesce(missing(F.regexp_extract(
            value, rf"\A(?:(?:async\s+)?function\s*\*?\s*|(?:abstract\s+)?class\s+)({NAME})\z|\A({NAME})\s*;?\s*\z", 1)),
            missing(F.regexp_extract(value, rf"\A(?!function\b|class\b|async\b)({NAME})\s*;?\s*\z", 1)), F.lit("default"))
        return F.array(_item(default_name, kind.otherwise("Expression"), True))

    declared = F.transform(
        F.filter(pieces(F.regexp_replace(s, r"\Aexport\s+(?:const|let|var)\s+", "")), lambda p: p.rlike(rf"\A{NAME}\s*(?::[^=]+)?=(?![=>])")),
        lambda p: _item(F.regexp_extract(p, rf"\A({NAME})", 1), F.lit("variable")))
    listed = F.transform(pieces(F.regexp_extract(s, r"\{([\s\S]*)\}", 1)),
                         lambda p: _item(F.regexp_extract(p, rf"""["']?({NAME})["']?\s*\z""", 1), F.lit("reference")))
    cjs_items = F.transform(
        F.filter(pieces(F.regexp_extract(s, r"\{([\s\S]*)\}\z", 1)), lambda p: p.rlike(rf"\A{NAME}\s*(?:\z|:\s*(?:{NAME}\s*\z|{_WRAPPED}))")),
        lambda p: _item(F.regexp_extract(p, rf"\A({NAME})", 1), F.when(p.rlike(rf"\A{NAME}\s*(?:\z|:\s*{NAME}\s*\z)"), "reference").otherwise("variable")))
    return (F.when(s.rlike(r"\Aexport\s+default\s"), bind(F.regexp_replace(s, r"\Aexport\s+default\s+", ""), default))
            .when(s.rlike(r"\Aexport\s+(?:const|let|var)\s"), declared)
            .when(s.rlike(r"\Aexport\s*(?:type\s*)?\{"), listed)
            .when(word != "", F.array(_item(name, word)))
            .when(s.rlike(r"\A(?:module\.)?exports\."), F.array(_item(F.regexp_extract(s, rf"exports\.({NAME})", 1), F.lit("variable"))))
            .when(s.startswith("module.exports"), cjs_items)
            .otherwise(F.array().cast(_EXPORT_TYPE)))


def exports(code: Column) -> Column:
    """ARRAY<STRUCT<name, kind, is_default>> in source order. A CommonJS export of a name listed before is dropped."""
    # an object's functions may be as deep as they like: only its outer levels matter here
    outer = F.when(F.contains(code, F.lit("module.exports")), shallow(leveled(code))).otherwise(having(code, "export"))
    statements = extract_all(outer, EXPORT)
    listed = F.flatten(F.transform(statements, lambda s: F.transform(_exports_of(s), lambda e: F.struct(
        e["name"].alias("name"), e["kind"].alias("kind"), e["is_default"].alias("is_default"), (~s.startswith("export")).alias("cjs")))))

    def first(xs: Column) -> Column:
        kept = F.filter(xs, lambda e, i: ~e["cjs"] | ~F.exists(F.slice(xs, 1, i), lambda o: o["name"] == e["name"]))
        return F.transform(kept, lambda e: F.struct(e["name"].alias("name"), e["kind"].alias("kind"), e["is_default"].alias("is_default")))

    return bind(listed, first)


def marking_names(exported: Column) -> Column:
    """Names whose functions count as exported: all but defaults, interfaces and types."""
    kept = F.filter(exported, lambda e: ~e["is_default"] & ~e["kind"].isin("interface", "type"))
    return F.transform(kept, lambda e: e["name"])


# ---- classes and interfaces ----------------------------------------------------------------------------

MARKS = rf"(?:{MARK}[0-9]+{MARK}\s*)*"
#: The first character of a declaration is looked at before all else.
CLASS = (rf"(?=[{MARK}acde])({MARKS}){EDGE}((?:export\s+)?(?:default\s+)?)(?:abstract\s+)?class\s+({NAME})\s*{GENERIC}"
         rf"(?:extends\s+([\w$.]+)\s*{GENERIC}(?:{ROUND}\s*)?)?(?:implements\s+[^{OPEN}]+)?({block(6)})")
_MODIFIERS = r"(?:(?:public|private|protected|static|async|override|abstract|readonly|declare|get|set)\s+)*"
METHOD_HEAD = rf"{_MODIFIERS}\*?\s*{WHOLE_NAME}\s*{GENERIC}{ROUND}{PLAIN_RETURNS}\s*\{{"
METHOD = rf"{_MODIFIERS}\*?\s*{WHOLE_NAME}\s*{GENERIC}{ROUND}{PLAIN_RETURNS}\s*{CURLY}"
FIELD = rf"{_MODIFIERS}{WHOLE_NAME}\s*[?!]?\s*(?::\s*(?:[^=;\n{{}}]|=>|{CURLY})+)?(?:=\s*(?:{run(';\\n')}|{CURLY}|{ROUND}|{STRING}|[^;\n])*+)?(?:;|\n|\z)"


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(text, f"{MARK}[0-9]+{MARK}", "")


def _marked_comments(text: Column, toks: Column) -> Column:
    return F.transform(extract_all(text, rf"{MARK}([0-9]+){MARK}", 1), lambda n: F.get(toks, n.cast("int")))


CLASS_FIELDS = ("name", "super_class", "raw_doc", "methods", "properties")


def class_list(marked: Column, toks: Column, wanted: tuple[str, ...] = CLASS_FIELDS, of_methods: tuple[str, ...] = FUNCTION_FIELDS) -> Column:
    """ARRAY<STRUCT<name, super_class, raw_doc, methods, properties>>, of which the ``wanted`` fields are built; methods have the
    shape of ``function_list``."""
    def method(m: Column) -> Column:
        return bind(F.regexp_replace(m, rf"\A{MARKS}", ""), lambda text: bind(F.regexp_extract(text, rf"\A{METHOD_HEAD}", 0), lambda shown: bind(
            plain(shown), lambda head: parted(m, text, shown, head))))

    def parted(m: Column, text: Column, shown: Column, head: Column) -> Column:
        return _chosen({
            "name": lambda: F.regexp_extract(head, rf"\A{_MODIFIERS}\*?\s*({NAME})", 1),
            "kind": lambda: F.lit("method"),
            "is_async": lambda: head.rlike(r"\A(?:\w+\s+)*?async\s"),
            "exported": lambda: F.lit(False),
            "line": lambda: F.lit(None).cast("int"),
            "params": lambda: params(F.regexp_replace(F.regexp_extract(head, PARAM_TAIL, 1), r"\A\(|\)\z", "")),
            "return_type": lambda: type_name(F.regexp_extract(head, PARAM_TAIL, 2)),
            "throws": lambda: own_throws(leveled(plain(F.substr(text, F.length(shown))))),
            "raw_doc": lambda: leading_comment(F.regexp_extract(m, rf"\A{MARKS}", 0), toks),
            "body": lambda: plain(_unmarked(text)),
            "inner_comments": lambda: _marked_comments(text, toks),
        }, of_methods)

    def field(f: Column) -> Column:
        return F.struct(
            F.regexp_extract(f, rf"\A{_MODIFIERS}({NAME})", 1).alias("name"),
            type_name(F.regexp_extract(f, rf"\A{_MODIFIERS}{NAME}\s*[?!]?\s*:((?:[^=;\n]|=>)+)", 1)).alias("type"),
            f.rlike(r"\A(?:\w+\s+)*?static\s").alias("static"))

    with_members = bool({"methods", "properties"} & set(wanted))

    def one(r: Column) -> Column:
        is_method = lambda m: m.rlike(rf"\A{MARKS}{METHOD}\z")
        fields = lambda ms: F.transform(F.filter(ms, lambda m: ~is_method(m)), lambda m: plain(trim(_unmarked(m))))

        def built(ms: Column | None) -> Column:
            return _chosen({
                "name": lambda: r["n"],
                "super_class": lambda: F.when(r["p"].rlike(rf"\A{NAME}\z"), r["p"]),
                "raw_doc": lambda: F.when(~F.contains(r["e"], F.lit("default")), leading_comment(r["c"], toks)),
                "methods": lambda: F.transform(F.filter(ms, is_method), method),
                "properties": lambda: F.transform(F.filter(fields(ms), lambda f: f.rlike(rf"\A{FIELD}\z")), field),
            }, wanted)

        if not with_members:
            return built(None)
        members = extract_all(shallow(inside(r["b"])), rf"(?<![\w$.#@]){MARKS}(?:{METHOD}|{FIELD})")
        return bind(F.transform(members, trim), built)

    read = {n for w, names in (("name", "n"), ("super_class", "p"), ("raw_doc", "ce")) if w in wanted for n in names} | ({"b"} if with_members else set())

    def groups(text: Column) -> Column:
        return F.struct(*[F.regexp_extract(text, CLASS, g).alias(n) for g, n in ((1, "c"), (2, "e"), (3, "n"), (4, "p"), (5, "b")) if n in read])

    return F.transform(F.transform(extract_all(leveled(having(marked, "class")), CLASS), groups), one)


INTERFACE = rf"{EDGE}interface\s+{NAME}\s*{GENERIC}(?:extends\s+[^{OPEN}]+)?{block(3)}|{EDGE}type\s+{NAME}\s*{GENERIC}="
DOCUMENTED_INTERFACE = rf"(?=[{MARK}deit])({MARKS})(?:export\s+)?(?:default\s+)?(?:declare\s+)?({INTERFACE})"


INTERFACE_FIELDS = ("name", "kind", "members", "raw_doc")


def interface_list(marked: Column, toks: Column, wanted: tuple[str, ...] = INTERFACE_FIELDS) -> Column:
    """ARRAY<STRUCT<name, kind, members, raw_doc>>, of which the ``wanted`` fields are built; type aliases have no members, members other than plain
    properties are called ``member``."""
    def member(m: Column) -> Column:
        named = m.rlike(rf"\A(?:readonly\s+)?{NAME}\??\s*(?::|\z)")
        p = _property(m)
        return F.struct(F.when(named, p["name"]).otherwise("member").alias("name"), F.when(named, plain(p["type"])).alias("type"),
                        (named & p["optional"]).alias("optional"))

    def one(r: Column) -> Column:
        s = r["s"]

        def members() -> Column:
            body = F.regexp_extract(s, rf"({block(2)})\z", 1)
            return F.when(s.startswith("interface"), F.transform(pieces(shallow(inside(body)), r";,\n"), member)).otherwise(F.array().cast(EMPTY_PROPERTIES))

        return _chosen({
            "name": lambda: F.regexp_extract(s, rf"\A(?:interface|type)\s+({NAME})", 1),
            "kind": lambda: F.when(s.startswith("interface"), "interface").otherwise("type"),
            "members": members,
            "raw_doc": lambda: leading_comment(r["c"], toks),
        }, wanted)

    def groups(text: Column) -> Column:
        shown = [F.regexp_extract(text, DOCUMENTED_INTERFACE, 1).alias("c")] if "raw_doc" in wanted else []
        return F.struct(*shown, _unmarked(F.regexp_extract(text, DOCUMENTED_INTERFACE, 2)).alias("s"))

    return F.transform(F.transform(extract_all(leveled(having(marked, "interface", "type")), DOCUMENTED_INTERFACE), groups), one)


# ---- UI facts ------------------------------------------------------------------------------------------

HOOK = rf"(?=use){EDGE}(?<!function\s{{1,4}})(use[A-Z][\w$]*)\s*(?:{ANGLE}\s*)?(?=({ROUND}))"
ELEMENT = r"(?=<)(?<![\w$)\]])<((?:[A-Za-z_$][\w$-]*)(?:[.:][\w$-]+)*)(?=[\s/>])(?!>\s*\()"
HANDLER = rf"(?=on)(?<![\w$.])(on[A-Z][\w$]*)=(?=({block(3)}))"
ARG_CAP = 60
_KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new")


def hooks(code: Column) -> Column:
    """ARRAY<STRUCT<name, args>>, each argument cut at 60 characters."""
    def one(name: Column, args: Column) -> Column:
        parts = pieces(F.regexp_replace(args, r"\A\(|\)\z", ""))
        return F.struct(name.alias("name"), F.transform(parts, lambda a: F.when(
            F.length(a) > ARG_CAP, F.concat(F.left(said(a), F.lit(ARG_CAP)), F.lit("…"))).otherwise(said(a))).alias("args"))

    text = having(code, "use")
    return F.zip_with(extract_all(text, HOOK, 1), extract_all(text, HOOK, 2), one)


def jsx_elements(code: Column) -> Column:
    return F.array_distinct(extract_all(code, ELEMENT, 1))


def event_handlers(code: Column) -> Column:
    """ARRAY<STRUCT<event, calls>>."""
    def call(c: Column) -> Column:
        parts = F.split(c, r"\.")
        return (F.when((F.size(parts) == 2) & ~c.startswith("this."), c).otherwise(F.element_at(parts, -1)))

    def one(event: Column, braces: Column) -> Column:
        expr = trim(plain(inside(braces)))
        found = F.filter(extract_all(expr, r"(?<![\w$.])((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*)\s*\(", 1), lambda c: ~c.isin(*_KEYWORDS))
        return F.struct(event.alias("event"), F.when(expr.rlike(rf"\A{NAME}\z"), F.array(expr)).otherwise(
            F.array_distinct(F.transform(found, call))).alias("calls"))

    text = leveled(having(code, "={"))
    return F.zip_with(extract_all(text, HANDLER, 1), extract_all(text, HANDLER, 2), one)


# ---- request handlers ----------------------------------------------------------------------------------

SHAPE_CAP = 120


def is_handler(ps: Column) -> Column:
    def name(i: int) -> Column:
        return F.lower(F.get(ps, F.lit(i))["name"])

    return ((name(0) == "req") & (name(1) == "res") & ((F.size(ps) == 2) | ((F.size(ps) == 3) & (name(2) == "next"))))


def may_handle(text: Column) -> Column:
    """Whether a text may hold the head of a handler: the names of its parameters are in it, in either case. The signs that
    ``plain`` takes out may stand between their letters."""
    between = f"[{CUT}{HEAD_END}{ALSO}]*+"
    return text.rlike("(?i)" + between.join("req")) & text.rlike("(?i)" + between.join("res"))


def request_fields(body: Column, part: str) -> Column:
    """Fields of ``req.<part>``, destructured or read directly, in order of appearance."""
    found = extract_all(body, rf"(?:const|let|var)\s*\{{[^{{}}]*\}}\s*=\s*req\.{part}(?![\w$.\[(]|\s*(?:\|\||\?\?))|{EDGE}req\.{part}\.{NAME}")

    def names(f: Column) -> Column:
        inside = F.filter(pieces(F.regexp_extract(f, r"\{([^{}]*)\}", 1)), lambda p: p.rlike(rf"\A{NAME}"))
        return F.when(f.rlike(r"\A(?:const|let|var)\b"), F.transform(inside, lambda p: F.regexp_extract(p, rf"\A{NAME}", 0))).otherwise(
            F.array(F.regexp_extract(f, rf"({NAME})\z", 1)))

    return F.array_distinct(F.flatten(F.transform(found, names)))


RESPONSE = rf"{EDGE}res(?:\.status\(\s*([^()]*)\s*\))?\.json(?=({ROUND}))"


def responses(body: Column) -> Column:
    """ARRAY<STRUCT<status, shape>> by status; the first shape seen for a status counts."""
    def one(status: Column, args: Column) -> Column:
        first = F.get(pieces(F.regexp_replace(args, r"\A\(|\)\z", "")), F.lit(0))
        return F.struct(F.coalesce(F.when(status.rlike(r"\A[0-9]+\s*\z"), trim(status)).try_cast("int"), F.lit(200)).alias("status"),
                        F.left(F.regexp_replace(said(F.coalesce(first, F.lit(""))), r"\s+", " "), F.lit(SHAPE_CAP)).alias("shape"))

    found = F.zip_with(extract_all(body, RESPONSE, 1), extract_all(body, RESPONSE, 2), one)
    return bind(found, lambda rs: F.array_sort(F.filter(
        rs, lambda r, i: ~F.exists(F.slice(rs, 1, i), lambda o: o["status"] == r["status"]))))
