"""Code inventory queries over the derived source files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspan.functions.types import type_name
from docspan.operators import code as C
from docspan.operators import drift as D
from docspan.operators.access import stage
from docspan.operators.rows import with_position
from docspan.plans.inputs import built_in_tasks, fixture, spread, sql_input

TYPES_SQL = """
SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'string' WHEN 1 THEN concat(upper(p_type), '<Map<string, number>>') WHEN 2 THEN 'number[][]' WHEN 3 THEN concat('''', p_type, ''' | null | 3')
  WHEN 4 THEN '{ a: string }' WHEN 5 THEN '(x: number, y) => void' WHEN 6 THEN 'A.B' WHEN 7 THEN 'A & B<C> | D[]' WHEN 8 THEN '(A | B)[]' WHEN 9 THEN '[A, B]' WHEN 10 THEN 'keyof T' ELSE '' END AS raw
FROM part"""


def _files(spark, sf, name):
    return built_in_tasks(spark, sf, f"SELECT * FROM {name}")


def _facts(spark, sf, *wanted, name="fx_source_files"):
    return C.code_facts(_files(spark, sf, name), wanted or C.FACTS)


def _modules(spark, sf, *wanted, fields=C.FIELDS, class_fields=C.CLASS_FIELDS, interface_fields=C.INTERFACE_FIELDS, role_params=False):
    return C.code_facts(C.quarantine(_files(spark, sf, "fx_modules"))[0], wanted or C.FACTS, fields, class_fields, interface_fields, role_params)


def _handlers(spark, sf):
    return C.handler_facts(C.quarantine(_files(spark, sf, "fx_modules"))[0])


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit("—"))


def _params(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda p: F.concat(
        p["name"], F.when(p["optional"], "?").otherwise(""), F.lit(":"), F.coalesce(p["type"], F.lit("?")))), ", ")


def import_edges(spark, sf):
    both = _facts(spark, sf, "imports").unionByName(_modules(spark, sf, "imports").withColumn("file_id", -F.col("file_id") - 1))
    return C.import_edges(both).select("file_id", "source", _text(F.col("default_name")).alias("default_name"),
                                       _text(F.col("namespace")).alias("namespace"), F.array_join("named", ",").alias("named"))


def reverse_dependencies(spark, sf):
    return C.reverse_dependencies(_modules(spark, sf, "imports"))


def export_list(spark, sf):
    return C.export_list(_facts(spark, sf, "exports"))


def module_exports(spark, sf):
    return C.export_list(_modules(spark, sf, "exports"))


def function_catalogue(spark, sf):
    return C.function_catalogue(_facts(spark, sf, "functions")).select(
        "file_id", "name", "kind", "is_async", "exported", "line", _params(F.col("params")).alias("params"), _text(F.col("return_type")).alias("return_type"))


def module_functions(spark, sf):
    fields = ("name", "kind", "is_async", "exported", "params", "throws", "notes")
    return C.function_catalogue(_modules(spark, sf, "functions", fields=fields)).select(
        "file_id", "name", "kind", "is_async", "exported", _params(F.col("params")).alias("params"), F.array_join("throws", ",").alias("throws"),
        F.array_join("notes", ",").alias("notes"))


def normalised_types(spark, sf):
    return sql_input(spark, sf, TYPES_SQL).select("p_partkey", "raw", _text(type_name(F.col("raw"))).alias("type"))


def class_catalogue(spark, sf):
    c = C.class_catalogue(_modules(spark, sf, "classes", fields=("name", "params", "return_type", "throws"), class_fields=("name", "super_class", "methods", "properties")))
    return c.select("file_id", "name", "super_class", F.array_join(F.transform("methods", lambda m: F.concat(
        m["name"], F.lit("("), _params(m["params"]), F.lit("):"), m["return_type"], F.lit(" throws "), F.array_join(m["throws"], ","))), ";").alias("methods"),
        F.array_join(F.transform("properties", lambda p: F.concat(F.when(p["static"], "static ").otherwise(""), p["name"], F.lit(":"), p["type"])), ";").alias("properties"))


def interface_catalogue(spark, sf):
    return C.interface_catalogue(_modules(spark, sf, "interfaces")).select(
        "file_id", "name", "kind", F.array_join(F.transform("members", lambda m: F.concat(
            m["name"], F.when(m["optional"], "?").otherwise(""), F.lit(":"), F.coalesce(m["type"], F.lit("?")))), ";").alias("members"))


def ui_facts(spark, sf):
    return C.ui_facts(_modules(spark, sf, "hooks", "jsx_elements", "event_handlers", "directives")).select(
        "file_id", "is_react", F.array_join(F.transform("hooks", lambda h: F.concat(h["name"], F.lit("("), F.array_join(h["args"], " ; "), F.lit(")"))), ",").alias("hooks"),
        F.array_join("jsx_elements", ",").alias("elements"), F.array_join(F.transform("event_handlers", lambda h: F.concat(
            h["event"], F.lit(">"), F.array_join(h["calls"], "/"))), ",").alias("handlers"), F.array_join("directives", ",").alias("directives"))


def throw_inventory(spark, sf):
    return C.throw_inventory(_facts(spark, sf, "functions"))


def handler_surface(spark, sf):
    return C.handler_surface(_handlers(spark, sf)).select(
        "file_id", "function_name", *[F.array_join(c, ",").alias(c) for c in ("body_fields", "route_params", "query_params")],
        F.array_join(F.transform("responses", lambda r: F.concat(r["status"].cast("string"), F.lit(" "), r["shape"])), " | ").alias("responses"))


def response_shapes(spark, sf):
    rows = with_position(C.handler_surface(_handlers(spark, sf)), ["file_id", "function_name"], F.col("responses"), "r")
    return C.response_shapes(rows.select("file_id", "function_name", "pos", "r.status", "r.shape"))


def doc_tag_catalogue(spark, sf):
    return C.doc_tag_catalogue(_modules(spark, sf, "functions", fields=("name", "tags"))).select(
        "file_id", "function_name", "description", _text(F.col("route.method")).alias("method"), _text(F.col("route.path")).alias("path"), _text(F.col("access")).alias("access"))


def comment_inventory(spark, sf):
    return C.comment_inventory(_modules(spark, sf, "comments"))


def route_catalogue(spark, sf):
    return C.route_catalogue(_facts(spark, sf, "functions")).select("file_id", "function_name", "method", "path", _text(F.col("access")).alias("access"))


def duplicate_routes(spark, sf):
    return C.duplicate_routes(C.route_catalogue(_facts(spark, sf, "functions")))


def error_quarantine(spark, sf):
    return C.quarantine(_files(spark, sf, "fx_modules"))[1]


def file_roles(spark, sf):
    return C.file_roles(_facts(spark, sf, *C.ROLE_FACTS)).select("file_id", "role", F.array_join("signals", "; ").alias("signals"))


def module_roles(spark, sf):
    return C.file_roles(_modules(spark, sf, *C.ROLE_FACTS, fields=C.ROLE_FIELDS, class_fields=C.COUNTED, interface_fields=C.COUNTED, role_params=True)).select("file_id", "role", F.array_join("signals", "; ").alias("signals"))


def role_histogram(spark, sf):
    return C.role_histogram(C.file_roles(_facts(spark, sf, *C.ROLE_FACTS)))


def signature_entries(spark, sf):
    return C.entry_rows(_facts(spark, sf, *C.SIGNATURE_FACTS)).select("file_id", "name", "sig")


def module_signatures(spark, sf):
    return C.with_signatures(_modules(spark, sf, *C.SIGNATURE_FACTS, fields=C.SIGNATURE_FIELDS, class_fields=C.SIGNATURE_CLASS_FIELDS, interface_fields=C.SIGNATURE_INTERFACE_FIELDS)).select("file_id", "signature_hash")


def env_inventory(spark, sf):
    return C.env_inventory(_facts(spark, sf, "env_vars"))


def env_totals(spark, sf):
    return C.env_totals(_facts(spark, sf, "env_vars"))


def code_totals(spark, sf):
    f = _modules(spark, sf, "functions", "classes", "interfaces", fields=C.COUNTED, class_fields=C.COUNTED, interface_fields=C.COUNTED).withColumn("project_id", F.col("file_id") % 25)
    return C.code_totals(f, ["project_id"])


# a binding per file; the text changes with the remainder of the key
NEW_FILES_SQL = """
SELECT file_id, file_name, CASE WHEN file_id % 19 = 0 THEN NULL WHEN file_id % 7 = 0 THEN replace(content, '(a: number', '(a: string') WHEN file_id % 11 = 0 THEN concat(content, 'export const extra = (q) => q;', chr(10))
  WHEN file_id % 13 = 0 THEN replace(content, 'export function fn', 'function fn') WHEN file_id % 3 = 0 THEN replace(content, 'return "" + a', 'return a + ""') ELSE content END AS content
FROM fx_source_files"""
OLD_FILES_SQL = "SELECT file_id, file_name, CASE WHEN file_id % 17 = 0 THEN NULL ELSE content END AS content FROM fx_source_files"
FILE_BINDINGS_SQL = """
SELECT p_partkey AS file_id, p_partkey % 50 AS doc_id, concat('src/f', cast(p_partkey AS string)) AS path, concat('a', cast(p_partkey AS string)) AS commit_sha,
  CASE WHEN p_partkey % 19 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 3 = 0 THEN concat('b', cast(p_partkey AS string)) ELSE NULL END AS snapshot_sha,
  TRUE AS content_requested FROM part"""


def content_drift(spark, sf):
    old = spread(fixture(spark, sf, "fx_source_files"))
    stored = C.with_signatures(C.code_facts(old, C.SIGNATURE_FACTS, C.SIGNATURE_FIELDS, C.SIGNATURE_CLASS_FIELDS, C.SIGNATURE_INTERFACE_FIELDS)).select("file_id", F.when(F.col("file_id") % 2 == 0, F.col("signature_hash")).alias("signature_hash"))
    bindings = sql_input(spark, sf, FILE_BINDINGS_SQL).join(stored, "file_id", "left")
    out = D.content_drift(bindings, spread(sql_input(spark, sf, NEW_FILES_SQL)), spread(sql_input(spark, sf, OLD_FILES_SQL)))
    return out.withColumn("changed_functions", F.array_join("changed_functions", ","))


def first_staged_files(spark, sf):
    return stage(fixture(spark, sf, "fx_source_files"), "file_name", ["file_id"])


QUERIES = {f.__name__: f for f in (
    import_edges, reverse_dependencies, export_list, module_exports, function_catalogue, module_functions, normalised_types, class_catalogue,
    interface_catalogue, ui_facts, throw_inventory, handler_surface, response_shapes, doc_tag_catalogue, comment_inventory, route_catalogue,
    duplicate_routes, error_quarantine, file_roles, module_roles, role_histogram, signature_entries, module_signatures, env_inventory, env_totals,
    code_totals, content_drift, first_staged_files)}

_K = "cast(p_partkey AS varchar)"
_M = "part WHERE p_partkey % 4"
_FNS = r"""
fns AS (SELECT file_id, unnest(regexp_extract_all(content, 'export (?:async )?function \w+\([^)]*\)(?:: \w+)? \{[^\n]*')) AS head, content FROM fx_source_files),
fn AS (SELECT file_id, regexp_extract(head, 'function (\w+)', 1) AS name, contains(head, 'async') AS is_async, regexp_extract(head, '\(([^)]*)\)', 1) AS ps,
  regexp_extract(head, '\): (\w+)', 1) AS ret, len(string_split(content[1:strpos(content, head)], chr(10))) AS line FROM fns)"""
_ROLE = """CASE file_id % 5 WHEN 0 THEN 'next-page' WHEN 1 THEN 'next-route-handler' WHEN 2 THEN 'util' WHEN 3 THEN 'react-hook' ELSE 'util' END"""
_BRACKETS = "(len(content) - len(replace(content, '(', ''))) = (len(content) - len(replace(content, ')', '')))"
_SIG_ROWS = r"""
WITH """ + _FNS + r"""
SELECT file_id, name, concat('fn:', name, '(', array_to_string(list_transform(string_split(ps, ', '), lambda p: CASE WHEN p = '' THEN '' ELSE
  concat(regexp_extract(p, '^\w+'), ':', regexp_extract(p, ': (\w+)', 1), CASE WHEN contains(p, '?') THEN '?' ELSE '' END) END), ','), '):', CASE WHEN ret = '' THEN '?' ELSE ret END) AS sig FROM fn"""
_SIG = "concat('fn:fn', k, '(a:number,b:string?):string')"
_ADDS = "CASE WHEN p_partkey % 5 = 1 THEN 'fn:GET(req:Request):?' WHEN p_partkey % 5 = 3 THEN 'fn:useThing():?' END"

ORACLES = {
    "import_edges": f"""
SELECT file_id, regexp_extract(content, 'from ''(\\w+)''', 1) AS source, '—' AS default_name, '—' AS namespace, regexp_extract(content, 'import \\{{ (\\w+) \\}}', 1) AS named FROM fx_source_files
UNION ALL SELECT -p_partkey - 1, 'react', 'React', '—', 'useMemo' FROM {_M} = 2
UNION ALL SELECT -p_partkey - 1, concat('./api', p_size), '—', 'api', '' FROM {_M} = 2""",
    "reverse_dependencies": f"""
SELECT source, count(*) AS imports, count(DISTINCT f) AS files FROM (SELECT 'react' AS source, p_partkey AS f FROM {_M} = 2 UNION ALL SELECT concat('./api', p_size), p_partkey FROM {_M} = 2) GROUP BY source""",
    "export_list": f"WITH {_FNS} SELECT file_id, name, 'function' AS kind, false AS is_default FROM fn",
    "module_exports": f"""
SELECT p_partkey AS file_id, concat('list', {_K}) AS name, 'variable' AS kind, false AS is_default FROM {_M} = 0
UNION ALL SELECT p_partkey, 'helper', 'reference', false FROM {_M} = 0 UNION ALL SELECT p_partkey, 'total', 'variable', false FROM {_M} = 0
UNION ALL SELECT p_partkey, concat('Box', {_K}), 'class', false FROM {_M} = 1 UNION ALL SELECT p_partkey, concat('Shape', {_K}), 'interface', false FROM {_M} = 1
UNION ALL SELECT p_partkey, 'Kind', 'type', false FROM {_M} = 1 UNION ALL SELECT p_partkey, concat('View', {_K}), 'FunctionDeclaration', true FROM {_M} = 2""",
    "function_catalogue": f"""WITH {_FNS} SELECT file_id, name, 'function' AS kind, is_async, true AS exported, line, regexp_replace(ps, ': ', ':', 'g') AS params,
  CASE WHEN ret = '' THEN '—' ELSE ret END AS return_type FROM fn""",
    "module_functions": f"""
SELECT p_partkey AS file_id, concat('list', {_K}) AS name, 'arrow' AS kind, true AS is_async, true AS exported, 'req:?, res:?' AS params, '' AS throws, '' AS notes FROM {_M} = 0
UNION ALL SELECT p_partkey, 'helper', 'function', false, true, 'x:?', 'fail', '' FROM {_M} = 0
UNION ALL SELECT p_partkey, 'total', 'arrow', false, true, 'a:?, b:?', '', '' FROM {_M} = 0
UNION ALL SELECT p_partkey, concat('View', {_K}), 'function', false, true, '{{ title, size }}:{{ … }}', '', 'keep the total' FROM {_M} = 2""",
    "normalised_types": f"""
SELECT p_partkey, raw, CASE p_partkey % 12 WHEN 0 THEN 'string' WHEN 1 THEN regexp_extract(raw, '^\\w+') WHEN 2 THEN 'number[][]' WHEN 3 THEN concat('"', regexp_extract(raw, '''([^'']*)''', 1), '" | null | 3')
  WHEN 4 THEN '{{ … }}' WHEN 5 THEN 'function' WHEN 6 THEN 'ref' WHEN 7 THEN 'A & B | D[]' WHEN 8 THEN 'parenthesizedtype[]' WHEN 9 THEN 'tupletype' WHEN 10 THEN 'typeoperator' ELSE '—' END AS type
FROM ({TYPES_SQL})""",
    "class_catalogue": f"""
SELECT p_partkey AS file_id, concat('Box', {_K}) AS name, 'Base' AS super_class, concat('add(item:string, {{ note }}:{{ … }}):Promise throws new RangeError("full ', p_size, '")') AS methods,
  'static limit:number' AS properties FROM {_M} = 1""",
    "interface_catalogue": f"""
SELECT p_partkey AS file_id, concat('Shape', {_K}) AS name, 'interface' AS kind, 'id:string;tags?:string[];member:?' AS members FROM {_M} = 1
UNION ALL SELECT p_partkey, 'Kind', 'type', '' FROM {_M} = 1""",
    "ui_facts": f"""
SELECT p_partkey AS file_id, p_partkey % 4 = 2 AS is_react, CASE WHEN p_partkey % 4 = 2 THEN concat('useMemo(() => size + ', p_size, ' ; [size])') ELSE '' END AS hooks,
  CASE WHEN p_partkey % 4 = 2 THEN 'Panel.Body,button' ELSE '' END AS elements, CASE WHEN p_partkey % 4 = 2 THEN 'onClick>api.save/done' ELSE '' END AS handlers,
  CASE WHEN p_partkey % 4 = 2 THEN 'use client' ELSE '' END AS directives FROM {_M} <> 3""",
    "throw_inventory": r"SELECT file_id, regexp_extract(content, 'function (\w+)', 1) AS function_name, unnest(regexp_extract_all(content, 'throw (new Error\(\"[^\"]*\"\))', 1)) AS thrown FROM fx_source_files".replace('\\"', '"'),
    "handler_surface": f"""
SELECT p_partkey AS file_id, concat('list', {_K}) AS function_name, 'size,name' AS body_fields, 'id' AS route_params, 'page' AS query_params,
  '200 {{ ok: true, q: req.query.page }} | 404 {{ ok: false }}' AS responses FROM {_M} = 0""",
    "response_shapes": f"""
SELECT p_partkey AS file_id, concat('list', {_K}) AS function_name, 200 AS status, '{{ ok: true, q: req.query.page }}' AS shape FROM {_M} = 0
UNION ALL SELECT p_partkey, concat('list', {_K}), 404, '{{ ok: false }}' FROM {_M} = 0""",
    "doc_tag_catalogue": f"""
SELECT p_partkey AS file_id, concat('list', {_K}) AS function_name, concat('List ', p_brand) AS description, 'GET' AS method, concat('/api/', p_size, '/:id') AS path, concat('Private (', p_type, ')') AS access FROM {_M} = 0""",
    "comment_inventory": f"""
SELECT p_partkey AS file_id, 0 AS pos, concat('@desc    List ', p_brand) AS comment FROM {_M} = 0 UNION ALL SELECT p_partkey, 1, concat('@route   GET /api/', p_size, '/:id') FROM {_M} = 0
UNION ALL SELECT p_partkey, 2, concat('@access  Private (', p_type, ')') FROM {_M} = 0 UNION ALL SELECT p_partkey, 0, concat('Holds ', p_name, '. @deprecated') FROM {_M} = 1
UNION ALL SELECT p_partkey, 0, concat('Shows ', p_name, '.') FROM {_M} = 2 UNION ALL SELECT p_partkey, 1, 'keep the total' FROM {_M} = 2""",
    "route_catalogue": r"SELECT file_id, regexp_extract(content, 'function (\w+)', 1) AS function_name, regexp_extract(content, '@route (\w+)', 1) AS method, regexp_extract(content, '@route \w+ (\S+)', 1) AS path, '—' AS access FROM fx_source_files",
    "duplicate_routes": r"SELECT 'GET' AS method, regexp_extract(content, '@route \w+ (\S+)', 1) AS path, count(*) AS handlers FROM fx_source_files GROUP BY 2 HAVING count(*) > 1",
    "error_quarantine": f"SELECT file_id, file_name, 'Unbalanced brackets' AS message FROM fx_modules WHERE NOT {_BRACKETS}",
    "file_roles": f"""
SELECT file_id, {_ROLE} AS role, CASE file_id % 5 WHEN 0 THEN 'page.tsx filename' WHEN 1 THEN 'route.ts filename; exports GET' WHEN 3 THEN 'exports hook useThing; calls useState'
  ELSE 'exports functions/classes, no JSX' END AS signals FROM fx_source_files""",
    "module_roles": """
SELECT file_id, CASE file_id % 4 WHEN 2 THEN 'react-component' ELSE 'util' END AS role,
  CASE file_id % 4 WHEN 2 THEN '"use client" directive; renders JSX; elements: Panel.Body, button' ELSE 'exports functions/classes, no JSX' END AS signals FROM fx_modules WHERE file_id % 4 < 3""",
    "role_histogram": f"SELECT {_ROLE} AS role, count(*) AS files FROM fx_source_files GROUP BY 1",
    "signature_entries": _SIG_ROWS,
    "module_signatures": f"""
SELECT p_partkey AS file_id, sha256(CASE p_partkey % 4
  WHEN 0 THEN concat('fn:helper(x:?):?|fn:list', {_K}, '(req:?,res:?):?|fn:total(a:?,b:?):?')
  WHEN 1 THEN concat('fn:Box', {_K}, '.add(item:string,{{ note }}:{{ … }}{{note:string?}}):Promise|interface:Shape', {_K}, '{{id:string,member:?,tags:string[]?}}|type:Kind{{}}')
  ELSE concat('fn:View', {_K}, '({{ title, size }}:{{ … }}{{size:number?,title:string}}):?') END) AS signature_hash FROM part WHERE p_partkey % 4 < 3""",
    "env_inventory": r"SELECT file_id, unnest(list_distinct(regexp_extract_all(content, 'process\.env\.(\w+)', 1))) AS env_var FROM fx_source_files",
    "env_totals": r"SELECT env_var, count(*) AS files FROM (SELECT file_id, unnest(list_distinct(regexp_extract_all(content, 'process\.env\.(\w+)', 1))) AS env_var FROM fx_source_files) GROUP BY env_var",
    "code_totals": """
SELECT file_id % 25 AS project_id, count(*) AS files, sum(CASE file_id % 4 WHEN 0 THEN 3 WHEN 2 THEN 1 ELSE 0 END) AS functions,
  sum(CASE file_id % 4 WHEN 1 THEN 1 ELSE 0 END) AS classes, sum(CASE file_id % 4 WHEN 1 THEN 2 ELSE 0 END) AS interfaces FROM fx_modules WHERE file_id % 4 < 3 GROUP BY 1""",
    "content_drift": f"""
WITH b AS (SELECT *, cast(file_id AS varchar) AS k, file_id % 2 = 0 AS has_hash, file_id % 17 <> 0 AS old_ok,
  CASE WHEN file_id % 19 = 0 THEN 'gone' WHEN file_id % 7 = 0 THEN 'changed' WHEN file_id % 11 = 0 THEN 'added' WHEN file_id % 13 = 0 THEN 'removed' ELSE 'body' END AS what
  FROM ({FILE_BINDINGS_SQL}) WHERE snapshot_sha IS NOT NULL)
SELECT doc_id, path, commit_sha AS old_sha, snapshot_sha AS new_sha,
  CASE WHEN what = 'gone' THEN 'signature_changed' WHEN what = 'body' THEN 'implementation_changed' WHEN old_ok OR has_hash THEN 'signature_changed' ELSE 'implementation_changed' END AS drift_state,
  CASE WHEN what = 'gone' THEN '{D.CONTENT_UNAVAILABLE}' WHEN what = 'body' THEN '' WHEN old_ok THEN
    CASE what WHEN 'changed' THEN concat('fn', k, ' (signature changed)') WHEN 'added' THEN 'extra (added)' ELSE concat('fn', k, ' (removed)') END
    WHEN has_hash THEN '{D.DETAILS_UNAVAILABLE}' ELSE '' END AS changed_functions FROM b""",
    "first_staged_files": "SELECT file_name, min(file_id) AS file_id, arg_min(content, file_id) AS content FROM fx_source_files GROUP BY file_name",
}
