"""Code inventory of a source-file table.

``code_facts`` turns each file row into one row of fact arrays without any exchange; the catalogues below are
projections of it, and only counts and cross-file questions shuffle. Columns nobody asks for are never computed.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.functions import declarations as D
from docspan.functions import source as S
from docspan.functions.doctags import comment_description, doc_tags
from docspan.functions.text import language
from docspan.operators.rows import elements, inlined, with_position
from docspan.operators.signatures import hash_of

# Request methods whose exported names make a file an endpoint.
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def code_texts(files: DataFrame) -> DataFrame:
    """file_id, file_name, content plus tokens, marked (comments as marks) and code (comments removed)."""
    return (files.select("file_id", "file_name", "content").withColumn("tokens", S.tokens(F.col("content")))
            .withColumn("marked", S.marked_code(F.col("tokens"))).withColumn("code", S.clean_code(F.col("marked"))))


#: Fields of a finished function and what each is made from.
FIELD_SOURCES = {
    "name": ("name",), "kind": ("kind",), "is_async": ("is_async",), "exported": ("exported", "name"), "line": ("line",), "params": ("params",),
    "return_type": ("return_type",), "throws": ("throws",), "tags": ("raw_doc",), "doc": ("raw_doc",), "notes": ("raw_doc", "inner_comments"),
    "api": ("params", "body"),
}
FIELDS = tuple(FIELD_SOURCES)
CLASS_FIELDS = ("name", "super_class", "methods", "properties", "doc")
INTERFACE_FIELDS = ("name", "kind", "members", "doc")
SIGNATURE_FIELDS, SIGNATURE_CLASS_FIELDS, SIGNATURE_INTERFACE_FIELDS = ("name", "exported", "params", "return_type"), ("name", "methods"), ("name", "kind", "members")
ROLE_FIELDS, COUNTED = ("name", "exported", "params"), ("name",)


def _sources(fields: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(s for s in D.FUNCTION_FIELDS if any(s in FIELD_SOURCES[f] for f in fields))


def _finished(fn: Column, names: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """A function with exports applied, its documentation parsed and its request surface read, as far as ``fields`` asks for them."""
    def notes() -> Column:
        inner = F.filter(fn["inner_comments"], lambda c: ~F.coalesce(F.contains(fn["raw_doc"], S.trim(S.comment_value(c))), F.lit(False)))
        return F.filter(F.transform(inner, S.cleaned_comment), lambda c: c != "")

    def api() -> Column:
        return F.when(D.is_handler(fn["params"]), F.struct(
            D.request_fields(fn["body"], "body").alias("body_fields"), D.request_fields(fn["body"], "params").alias("route_params"),
            D.request_fields(fn["body"], "query").alias("query_params"), D.responses(fn["body"]).alias("responses")))

    def built(doc: Column | None) -> Column:
        made = {
            "exported": lambda: fn["exported"] | F.array_contains(names, fn["name"]), "tags": lambda: doc,
            "doc": lambda: F.coalesce(doc["description"], comment_description(fn["raw_doc"])), "notes": notes, "api": api,
        }
        return F.struct(*[made.get(f, lambda f=f: fn[f])().alias(f) for f in FIELDS if f in fields])

    return S.bind(doc_tags(fn["raw_doc"]), built) if {"tags", "doc"} & set(fields) else built(None)


def _description(raw: Column) -> Column:
    return F.coalesce(doc_tags(raw)["description"], comment_description(raw))


def _classes(fields: tuple[str, ...], of_methods: tuple[str, ...]) -> Column:
    none = F.array().cast("array<string>")
    raw = tuple("raw_doc" if f == "doc" else f for f in fields)

    def finished(c: Column) -> Column:
        made = {"methods": lambda: F.transform(c["methods"], lambda m: _finished(m, none, of_methods)), "doc": lambda: _description(c["raw_doc"])}
        return F.struct(*[made.get(f, lambda f=f: c[f])().alias(f) for f in CLASS_FIELDS if f in fields])

    return F.transform(D.class_list(F.col("marked"), F.col("tokens"), raw, _sources(of_methods)), finished)


def _functions(fields: tuple[str, ...]) -> Column:
    def finished(names: Column) -> Column:
        return F.transform("raw_functions", lambda f: _finished(f, names, fields))

    # bound, or the optimiser would move the export list into the lambda and read it once per function
    return S.bind(D.marking_names(F.col("exports")), finished) if "exported" in fields else finished(F.array().cast("array<string>"))


def _interfaces(fields: tuple[str, ...]) -> Column:
    raw = tuple("raw_doc" if f == "doc" else f for f in fields)

    def finished(i: Column) -> Column:
        return F.struct(*[(_description(i["raw_doc"]) if f == "doc" else i[f]).alias(f) for f in INTERFACE_FIELDS if f in fields])

    return F.transform(D.interface_list(F.col("marked"), F.col("tokens"), raw), finished)


# How each fact column follows from the text columns. The expressions are large and do not depend on the
# table, so each is built once per Spark context and choice of fields and used again.
_EXPRESSIONS = {
    "language": lambda: language(F.col("file_name"), F.col("content")),
    "directives": lambda: S.directives(F.col("code")),
    "imports": lambda: D.imports(F.col("code")),
    "exports": lambda: D.exports(F.col("code")),
    "raw_functions": lambda fields: D.function_list(F.col("parts"), F.col("code"), F.col("tokens"), _sources(fields)),
    "raw_functions_for_roles": lambda fields: D.function_list(
        F.col("parts"), F.col("code"), F.col("tokens"), _sources(fields), with_params=_file_named(_base_name(), "error")),
    "raw_handlers": lambda fields: D.function_list(F.col("parts"), F.col("code"), F.col("tokens"), _sources(fields), D.may_handle),
    "functions": lambda fields: _functions(fields),
    "classes": lambda fields, class_fields: _classes(class_fields, fields),
    "interfaces": lambda fields: _interfaces(fields),
    "comments": lambda: S.comments(F.col("tokens")),
    "hooks": lambda: D.hooks(F.col("code")),
    "jsx_elements": lambda: D.jsx_elements(F.col("code")),
    "event_handlers": lambda: D.event_handlers(F.col("code")),
    "env_vars": lambda: S.env_vars(F.col("code")),
    "entries": lambda: signature_entries(),
}
FACTS = ("language", "directives", "imports", "exports", "functions", "classes", "interfaces", "comments", "hooks", "jsx_elements",
         "event_handlers", "env_vars")
ROLE_FACTS = ("directives", "exports", "functions", "classes", "interfaces", "hooks", "jsx_elements")
SIGNATURE_FACTS = ("exports", "functions", "classes", "interfaces")


@lru_cache(maxsize=None)
def _built(name: str, context_id: str, *fields: tuple[str, ...]) -> Column:
    return _EXPRESSIONS[name](*fields)


def code_facts(files: DataFrame, wanted: tuple[str, ...] = FACTS, fields: tuple[str, ...] = FIELDS, class_fields: tuple[str, ...] = CLASS_FIELDS,
               interface_fields: tuple[str, ...] = INTERFACE_FIELDS, role_params: bool = False) -> DataFrame:
    """One row per file with the wanted fact arrays, beside file_id, file_name and content.

    ``fields`` are those of a function or method, ``class_fields`` those of a class and ``interface_fields`` those of an interface that
    the caller reads: the optimiser cannot leave a field out of a struct that is built inside an array. Exports are only read
    where somebody asks for them or for the ``exported`` field. With ``role_params`` only ``file_roles`` reads the parameters: those of
    files whose role cannot depend on them are null."""
    context_id = files.sparkSession.sparkContext.applicationId
    df = code_texts(files)
    if "exports" in wanted or ("functions" in wanted and "exported" in fields):
        df = df.withColumn("exports", _built("exports", context_id))
    if "functions" in wanted:
        raw = _built("raw_functions_for_roles" if role_params else "raw_functions", context_id, fields)
        df = df.withColumn("parts", D.spans(F.col("marked"))).withColumn("raw_functions", raw)
    own = {"functions": (fields,), "classes": (fields, class_fields), "interfaces": (interface_fields,)}
    return df.select("file_id", "file_name", "content", *[
        F.col("exports") if w == "exports" else _built(w, context_id, *own.get(w, ())).alias(w) for w in wanted])


def handler_facts(files: DataFrame) -> DataFrame:
    """file_id and functions (name, api) of every file, without functions that cannot be request handlers: nothing is read of a
    file that names no such parameters, and little of a function that has none."""
    fields, context_id = ("name", "api"), files.sparkSession.sparkContext.applicationId
    # a conditional text, not a filter: the optimiser would move a filter into the few tasks of the scan
    asked = files.withColumn("content", F.when(D.may_handle(F.col("content")), F.col("content")))
    df = code_texts(asked).withColumn("parts", D.spans(F.col("marked"))).withColumn("raw_functions", _built("raw_handlers", context_id, fields))
    return df.select("file_id", _built("functions", context_id, fields).alias("functions"))


def quarantine(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable files, error rows): a file whose brackets do not pair up is set aside and the batch goes on.

    The judgement is an exploded element: the optimiser moves a plain filter below an exchange that spreads the files, into
    the few tasks of the scan."""
    judged = files.select("*", F.explode_outer(F.array(S.balanced(S.brackets(F.col("content"))))).alias("_ok"))
    return judged.filter("_ok").drop("_ok"), judged.filter("NOT _ok").select("file_id", "file_name", F.lit("Unbalanced brackets").alias("message"))


# ---- catalogues ----------------------------------------------------------------------------------------


def import_edges(facts: DataFrame) -> DataFrame:
    return inlined(facts, ["file_id"], "imports")


def reverse_dependencies(facts: DataFrame) -> DataFrame:
    return import_edges(facts).groupBy("source").agg(F.count("*").alias("imports"), F.count_distinct("file_id").alias("files"))


def export_list(facts: DataFrame) -> DataFrame:
    return inlined(facts, ["file_id"], "exports")


def function_catalogue(facts: DataFrame) -> DataFrame:
    return inlined(facts, ["file_id"], "functions")


def class_catalogue(facts: DataFrame) -> DataFrame:
    return inlined(facts, ["file_id"], "classes")


def interface_catalogue(facts: DataFrame) -> DataFrame:
    return inlined(facts, ["file_id"], "interfaces")


def ui_facts(facts: DataFrame) -> DataFrame:
    return facts.select("file_id", ((F.size("jsx_elements") > 0) | (F.size("hooks") > 0)).alias("is_react"), "hooks", "jsx_elements",
                        "event_handlers", "directives")


def throw_inventory(facts: DataFrame) -> DataFrame:
    functions = elements(facts, ["file_id"], F.col("functions"), "f")
    return elements(functions, ["file_id", F.col("f.name").alias("function_name")], F.col("f.throws"), "thrown")


def handler_surface(facts: DataFrame) -> DataFrame:
    return elements(facts, ["file_id"], F.col("functions"), "f").filter("f.api IS NOT NULL").select(
        "file_id", F.col("f.name").alias("function_name"), "f.api.*")


def response_shapes(handlers: DataFrame) -> DataFrame:
    """First shape per (function, status) of a table of responses with positions, by status."""
    return handlers.groupBy("file_id", "function_name", "status").agg(F.min_by("shape", "pos").alias("shape"))


def doc_tag_catalogue(facts: DataFrame) -> DataFrame:
    return elements(facts, ["file_id"], F.col("functions"), "f").filter("f.tags IS NOT NULL").select(
        "file_id", F.col("f.name").alias("function_name"), "f.tags.*")


def comment_inventory(facts: DataFrame) -> DataFrame:
    return with_position(facts, ["file_id"], F.col("comments"), "comment")


def route_catalogue(facts: DataFrame) -> DataFrame:
    return doc_tag_catalogue(facts).filter("route IS NOT NULL").select("file_id", "function_name", "route.method", "route.path", "access")


def duplicate_routes(routes: DataFrame) -> DataFrame:
    return routes.groupBy("method", "path").agg(F.count("*").alias("handlers")).filter("handlers > 1")


def env_inventory(facts: DataFrame) -> DataFrame:
    """(env_var, file_id) pairs; names per document follow from a distinct over its files."""
    return elements(facts, ["file_id"], F.col("env_vars"), "env_var")


def env_totals(facts: DataFrame) -> DataFrame:
    return env_inventory(facts).groupBy("env_var").agg(F.count("*").alias("files"))


def code_totals(facts: DataFrame, by: list[str]) -> DataFrame:
    return facts.groupBy(*by).agg(
        F.count("*").alias("files"), F.sum(F.size("functions")).alias("functions"), F.sum(F.size("classes")).alias("classes"),
        F.sum(F.size("interfaces")).alias("interfaces"))


# ---- roles ---------------------------------------------------------------------------------------------


def _base_name() -> Column:
    return F.lower(F.element_at(F.split("file_name", "/"), -1))


def _file_named(base: Column, stem: str) -> Column:
    return base.rlike(rf"\A{stem}\.(t|j)sx?\z")


def file_roles(facts: DataFrame) -> DataFrame:
    """Role and signals per file; the first rule that applies decides."""
    base = _base_name()
    verbs = F.filter(F.transform("exports", lambda e: e["name"]), lambda n: n.isin(*HTTP_METHODS))
    hook = F.get(F.filter("functions", lambda f: f["exported"] & f["name"].rlike(r"\Ause[A-Z]")), F.lit(0))["name"]
    pascal = F.exists("functions", lambda f: f["exported"] & f["name"].rlike(r"\A[A-Z]"))
    props = F.exists("functions", lambda f: F.exists(f["params"], lambda p: F.coalesce(
        F.exists(p["properties"], lambda x: x["name"] == "error") & F.exists(p["properties"], lambda x: x["name"] == "reset"), F.lit(False))))
    elements, hook_calls = F.col("jsx_elements"), F.transform("hooks", lambda h: h["name"])
    n_functions, n_classes = F.size("functions"), F.size("classes")

    def named(stem: str) -> Column:
        return _file_named(base, stem)

    def signals(*xs) -> Column:
        return F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])

    listed = F.array_join(verbs, ", ")
    rules = (
        ("next-error-boundary", named("error") & props, signals("error.tsx filename", "{ error, reset } props")),
        ("next-route-handler", named("route") & (F.size(verbs) > 0), signals("route.ts filename", F.concat(F.lit("exports "), listed))),
        ("api-endpoint", F.size(verbs) > 0, signals(F.concat(F.lit("exports HTTP methods: "), listed))),
        ("next-page", named("page"), signals("page.tsx filename")),
        ("next-layout", named("layout"), signals("layout.tsx filename")),
        ("react-hook", hook.isNotNull(), signals(F.concat(F.lit("exports hook "), hook), F.when(
            F.size("hooks") > 0, F.concat(F.lit("calls "), F.array_join(hook_calls, ", "))))),
        ("react-component", (F.size(elements) > 0) | (pascal & (F.size("hooks") > 0)), signals("renders JSX", F.when(
            F.size(elements) > 0, F.concat(F.lit("elements: "), F.array_join(F.slice(elements, 1, 5), ", "))))),
        ("types", (n_functions == 0) & (n_classes == 0) & (F.size("interfaces") > 0), signals("only interfaces/types exported")),
        ("util", (n_functions > 0) | (n_classes > 0), signals("exports functions/classes, no JSX")),
    )
    role, why = F, F
    for name, test, texts in rules:
        role, why = role.when(test, name), why.when(test, texts)
    directive = F.transform(F.filter(F.array(F.lit("use client"), F.lit("use server")), lambda d: F.array_contains("directives", d)),
                            lambda d: F.concat(F.lit('"'), d, F.lit('" directive')))
    return facts.withColumn("role", role.otherwise("module")).withColumn(
        "signals", F.concat(directive, F.array_compact(why.otherwise(signals("no recognised signals")))))


def role_histogram(roles: DataFrame) -> DataFrame:
    return roles.groupBy("role").agg(F.count("*").alias("files"))


# ---- signatures ----------------------------------------------------------------------------------------


def _fields(xs: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(xs, lambda p: F.concat(
        p["name"], F.lit(":"), F.coalesce(p["type"], F.lit("?")), F.when(p["optional"], "?").otherwise("")))), ",")


def _call(name: Column, ps: Column, returns: Column) -> Column:
    def one(p: Column) -> Column:
        inner = F.when(F.size(F.coalesce(p["properties"], F.array().cast(D.EMPTY_PROPERTIES))) > 0, F.concat(F.lit("{"), _fields(p["properties"]), F.lit("}")))
        return F.concat(p["name"], F.lit(":"), F.coalesce(p["type"], F.lit("?")), F.when(p["optional"], "?").otherwise(""), F.coalesce(inner, F.lit("")))

    return F.concat(F.lit("fn:"), name, F.lit("("), F.array_join(F.transform(ps, one), ","), F.lit("):"), F.coalesce(returns, F.lit("?")))


def signature_entries() -> Column:
    """ARRAY<STRUCT<name, sig>> over the fact columns: exported functions, methods of exported classes, exported
    interfaces and types."""
    listed = F.transform("exports", lambda e: e["name"])

    def entry(name: Column, sig: Column) -> Column:
        return F.struct(name.alias("name"), sig.alias("sig"))

    def methods(c: Column) -> Column:
        return F.transform(c["methods"], lambda m: entry(F.concat(c["name"], F.lit("."), m["name"]),
                                                         _call(F.concat(c["name"], F.lit("."), m["name"]), m["params"], m["return_type"])))

    fns = F.transform(F.filter("functions", lambda f: f["exported"]), lambda f: entry(f["name"], _call(f["name"], f["params"], f["return_type"])))
    cls = F.flatten(F.transform(F.filter("classes", lambda c: F.array_contains(listed, c["name"])), methods))
    faces = F.transform(F.filter("interfaces", lambda i: F.array_contains(listed, i["name"])), lambda i: entry(
        i["name"], F.concat(i["kind"], F.lit(":"), i["name"], F.lit("{"), _fields(i["members"]), F.lit("}"))))
    return F.concat(fns, cls, faces)


def _with_entries(facts: DataFrame) -> DataFrame:
    return facts.withColumn("entries", _built("entries", facts.sparkSession.sparkContext.applicationId))


def with_signatures(facts: DataFrame) -> DataFrame:
    """Adds ``entries`` and ``signature_hash``: no exchange, a file's signatures are in its row."""
    return _with_entries(facts).withColumn(
        "signature_hash", hash_of(F.transform("entries", lambda e: e["sig"])))


def entry_rows(facts: DataFrame) -> DataFrame:
    """(file_id, pos, name, sig) rows for comparisons between two states of a file."""
    return with_position(_with_entries(facts), ["file_id"], F.col("entries"), "e").select("file_id", "pos", "e.name", "e.sig")
