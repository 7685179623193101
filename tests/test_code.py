import pytest

from docspan.functions import declarations as D
from docspan.operators import code as C

LEDGER = '''/**
 * Adds two amounts.
 * @param {number} left - first amount
 * @param [right=0] - second amount
 * @returns {number} the sum
 * @example
 * add(1, 2)
 * @deprecated use plus
 */
export function add(left: number, right = 0): number {
  // carry over
  if (!left) throw new RangeError("left 'x'");
  throw limit;
}
const twice = async (x) => { throw build(x); };
export { twice as double };
export const eager = (a?: Map<string, number>[]): Promise<A> | null => a;
export default class Ledger extends Base<Row> {
  private rows: Row[] = [];
  static size = 0;
  /** Push a row. */
  async push({ row, at = 1 }: { row: Row; at?: number }, ...rest: string[]): Promise<void> { this.rows.push(row); }
}
export interface Row { id: string; note?: 'a' | "b"; run(): void }
export type Key = string | number;
import base, { one as uno, two } from './base';
import * as all from "all";
import './side';
'''
ROUTES = '''const wrap = require('wrap');
// @desc    Create item
// @route   POST /items
// @access  Private (staff)
exports.create = wrap(async (req, res) => {
  const { title, size: s } = req.body;
  const { page } = req.query;
  if (!req.params.id) return res.status(404).json({ ok: false, why: 'gone (really)' });
  res.status(201).json({ ok: true,
    title });
  res.status(201).json({ second: true });
  res.json(title);
});
module.exports.ping = (req, res, next) => next();
function local(a) { return process.env.ALPHA + process.env.BETA + process.env.ALPHA; }
module.exports = { local, inline: async (u) => u, limit: 3 };
// process.env.COMMENTED
'''
VIEW = """'use client';
import React from 'react';
export function Panel({ error, reset }: { error: Error; reset: () => void }) {
  const [a, set] = useState(useMemo(() => 1, []));
  return <Box.Main><a onClick={() => { save(a); api.post(1); }} onBlur={set}>Don't</a></Box.Main>;
}
"""
FILES = [("ledger", "src/ledger.ts", LEDGER), ("routes", "api/routes.js", ROUTES), ("view", "app/error.tsx", VIEW),
         ("types", "types.ts", "export interface A { x: string }\nexport type B = A;\n"), ("empty", "empty.js", ""),
         ("verbs", "api/route.ts", "export async function POST(req: Request) { return 1; }\n"), ("hook", "x/use.ts", "export const useIt = () => useRef(null);\n")]


@pytest.fixture(scope="module")
def facts(spark):
    df = spark.createDataFrame(FILES, "file_id string, file_name string, content string")
    return {r.file_id: r for r in C.with_signatures(C.file_roles(C.code_facts(df))).collect()}


def fn(facts, file, name):
    return next(f for f in facts[file].functions if f.name == name)


def test_functions_with_their_exports_lines_and_kinds(facts):
    got = [(f.name, f.kind, f.is_async, f.exported, f.line) for f in facts["ledger"].functions]
    assert got == [("add", "function", False, True, 10), ("twice", "arrow", True, False, 15), ("eager", "arrow", False, True, 17)]


def test_parameters_and_types(facts):
    ps = fn(facts, "ledger", "add").params
    assert [(p.name, p.type, p.optional) for p in ps] == [("left", "number", False), ("right", None, True)]
    e = fn(facts, "ledger", "eager")
    assert [(p.name, p.type, p.optional) for p in e.params] == [("a", "Map[]", True)] and e.return_type == "Promise | null"


def test_throws_are_labelled_sorted_and_kept_to_their_function(facts):
    assert fn(facts, "ledger", "add").throws == ["limit", 'new RangeError("left \'x\'")']
    assert fn(facts, "ledger", "twice").throws == ["build(…)"]


def test_documentation_tags(facts):
    t = fn(facts, "ledger", "add").tags
    assert t.description == "Adds two amounts." and t.examples == ["add(1, 2)"] and t.deprecated == "plus"
    assert [(p.name, p.type, p.optional) for p in t.params] == [("left", "number", False), ("right", None, True)]
    assert fn(facts, "ledger", "add").notes == ["carry over"]
    c = fn(facts, "routes", "create").tags
    assert (c.description, c.route.method, c.route.path, c.access) == ("Create item", "POST", "/items", "Private (staff)")


def test_imports(facts):
    got = [(i.source, i.default_name, i.namespace, i.named) for i in facts["ledger"].imports]
    assert got == [("./base", "base", None, ["one", "two"]), ("all", None, "all", []), ("./side", None, None, [])]


def test_exports(facts):
    assert [(e.name, e.kind, e.is_default) for e in facts["ledger"].exports] == [
        ("add", "function", False), ("double", "reference", False), ("eager", "variable", False), ("Ledger", "ClassDeclaration", True),
        ("Row", "interface", False), ("Key", "type", False)]
    assert [(e.name, e.kind) for e in facts["routes"].exports] == [
        ("create", "variable"), ("ping", "variable"), ("local", "reference"), ("inline", "variable")]


def test_commonjs_functions(facts):
    got = [(f.name, f.is_async, f.exported) for f in facts["routes"].functions]
    assert got == [("create", True, True), ("ping", False, True), ("local", False, True), ("inline", True, True)]


def test_request_surface(facts):
    api = fn(facts, "routes", "create").api
    assert (api.body_fields, api.query_params, api.route_params) == (["title", "size"], ["page"], ["id"])
    assert [(r.status, r.shape) for r in api.responses] == [
        (200, "title"), (201, "{ ok: true, title }"), (404, "{ ok: false, why: 'gone (really)' }")]
    assert fn(facts, "routes", "local").api is None


def test_classes_and_interfaces(facts):
    c = facts["ledger"].classes[0]
    assert (c.name, c.super_class) == ("Ledger", "Base")
    assert [(p.name, p.type, p.static) for p in c.properties] == [("rows", "Row[]", False), ("size", None, True)]
    m = c.methods[0]
    assert (m.name, m.is_async, m.return_type, m.doc) == ("push", True, "Promise", "Push a row.")
    assert [p.name for p in m.params] == ["{ row, at }", "...rest"]
    row, key = facts["ledger"].interfaces
    assert [(x.name, x.type, x.optional) for x in row.members] == [("id", "string", False), ("note", '"a" | "b"', True), ("member", None, False)]
    assert (key.kind, key.members) == ("type", [])


def test_ui_facts_and_env(facts):
    v = facts["view"]
    assert v.directives == ["use client"] and v.jsx_elements == ["Box.Main", "a"]
    assert [h.name for h in v.hooks] == ["useState", "useMemo"]
    assert [(h.event, h.calls) for h in v.event_handlers] == [("onClick", ["save", "api.post"]), ("onBlur", ["set"])]
    assert facts["routes"].env_vars == ["ALPHA", "BETA"]


def test_roles(facts):
    assert {k: r.role for k, r in facts.items()} == {
        "ledger": "util", "routes": "util", "view": "next-error-boundary", "types": "types", "empty": "module", "verbs": "next-route-handler", "hook": "react-hook"}
    assert facts["verbs"].signals == ["route.ts filename", "exports POST"]


def test_signatures(facts):
    assert [e.sig for e in facts["ledger"].entries] == [
        "fn:add(left:number,right:??):number", "fn:eager(a:Map[]?):Promise | null",
        "fn:Ledger.push({ row, at }:{ … }{at:number?,row:Row},...rest:string[]):Promise",
        'interface:Row{id:string,member:?,note:"a" | "b"?}', "type:Key{}"]


def test_signature_hash_ignores_bodies_and_sees_interfaces_of_functions(spark):
    base = "export function f(a: number): string { return 1; }\nfunction g() {}\n"
    variants = {
        "same": base, "body": base.replace("return 1", "return 2"), "private": base + "function h() {}\n", "renamed": base.replace("f(", "k("),
        "added": base + "export function z() {}\n", "returns": base.replace("): string", "): number"), "generic": base.replace("): string", "): string")}
    df = spark.createDataFrame([(k, "a.ts", v) for k, v in variants.items()], "file_id string, file_name string, content string")
    h = {r.file_id: r.signature_hash for r in C.with_signatures(C.code_facts(df, C.SIGNATURE_FACTS)).collect()}
    assert h["same"] == h["body"] == h["private"]
    assert len({h["same"], h["renamed"], h["added"], h["returns"]}) == 4


def test_unbalanced_files_are_set_aside(spark):
    df = spark.createDataFrame([("a", "a.ts", "f({"), ("b", "b.ts", "f('({[')"), ("c", "c.ts", "// (\nf()")], "file_id string, file_name string, content string")
    good, bad = C.quarantine(df)
    assert [r.file_id for r in bad.collect()] == ["a"] and {r.file_id for r in good.collect()} == {"b", "c"}


def test_long_files_need_no_deep_stack(spark):
    body = "".join(f"export function f{i}(a: number) {{ if (a) {{ return {i}; }} }}\n/* note {i} */\n" for i in range(3000))
    df = spark.createDataFrame([("a", "a.ts", body)], "file_id string, file_name string, content string")
    r = C.code_facts(df, ("functions", "comments")).collect()[0]
    assert len(r.functions) == 3000 and r.functions[-1].line == 2 * 3000 - 1 and len(r.comments) == 3000


DEEP = 12
NESTS = """exports.list = wrap(async (req, res) => {
  const pick = (x) => { throw pickError; };
  const { a, b } = req.body;
  if (!a) { throw new Error("no }a{"); }
  [1].forEach(function (y) { throw anonymous; });
  const o = { m(z) { throw method; } };
  // after the inner functions
  res.status(201).json({ ok: true });
});
function outer() { function inner() { throw innerError; } if (x) { throw outerError; } return "}"; }
module.exports = { outer, deep: (q) => { %s throw q; %s } };
const View = () => <a onClick={() => { %s save(); %s }}>x</a>;
""" % (("if (q) { " * DEEP, " }" * DEEP) * 2)
DEEP_CLASS = """class Deep { run() { %s throw new E('deep'); %s }
  size = 3;
  other(a: { b: { c: { d: { e: number } } } }) { return [1].map(() => { throw inner; }); } }
interface Tree { root: %s leaf: string %s; name: string }
""" % ("if (a) { " * DEEP, " }" * DEEP, "{ x: " * DEEP + "{", "}" + " }" * DEEP)


@pytest.fixture(scope="module")
def nests(spark):
    df = spark.createDataFrame([("nests", "n.js", NESTS), ("deep", "d.ts", DEEP_CLASS)], "file_id string, file_name string, content string")
    return {r.file_id: r for r in C.code_facts(df).collect()}


def test_blocks_are_followed_to_any_depth(nests):
    deep = nests["deep"].classes[0]
    assert [(m.name, m.throws) for m in deep.methods] == [("run", ['new E("deep")']), ("other", [])]
    assert [p.name for p in deep.properties] == ["size"] and [p.type for p in deep.methods[1].params] == ["{ … }"]
    assert [(m.name, m.type) for m in nests["deep"].interfaces[0].members] == [("root", "{ … }"), ("name", "string")]
    assert [(e.event, e.calls) for e in nests["nests"].event_handlers] == [("onClick", ["save"])]
    assert [(e.name, e.kind) for e in nests["nests"].exports] == [("list", "variable"), ("outer", "reference"), ("deep", "variable")]


def test_a_function_has_its_whole_text_but_not_the_throws_of_inner_ones(nests):
    assert {f.name: f.throws for f in nests["nests"].functions} == {
        "list": ['new Error("no }a{")'], "pick": ["pickError"], "outer": ["outerError"], "inner": ["innerError"], "View": [], "deep": ["q"]}
    f = fn(nests, "nests", "list")
    assert f.notes == ["after the inner functions"] and f.api.body_fields == ["a", "b"]
    assert [(r.status, r.shape) for r in f.api.responses] == [(201, "{ ok: true }")]


def test_texts_without_partners_for_their_braces(spark):
    from pyspark.sql import functions as F

    from docspan.functions import source as S
    texts = ["", "}", "{", "}{", "{{}", "{}}", "a { b '{' { c } } `}` d", "{" * 40 + "}" * 40, "{}" * 300, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("l", S.leveled(F.col("t")))
    rows = df.select("t", S.plain(F.col("l")).alias("again"), S.plain(S.shallow(F.col("l"))).alias("shallow")).collect()
    assert all(r.again == r.t and r.shallow == r.t for r in rows)


def of_text(spark, text, name="a.ts"):
    return C.with_signatures(C.code_facts(spark.createDataFrame([(1, name, text)], "file_id int, file_name string, content string"))).first()


def test_every_function_of_a_declaration_list(spark):
    text = ("export const one = (x: number): number => x, /* twice */\n  two = async (y) => { throw y; },\n  limit = 3, three = function (z = f(1, 2)) { return z; };\n"
            "let n = g(1, h = (k) => k), plain = 4\nconst last = (q) => q\nfor (let i = 0, m = list.length; i < m; i++) { const deep = () => i, deeper = () => m; }\n")
    row = of_text(spark, text)
    got = [(f.name, f.kind, f.is_async, f.exported, f.line, [p.name for p in f.params], f.throws) for f in row.functions]
    assert got == [
        ("one", "arrow", False, True, 1, ["x"], []), ("two", "arrow", True, True, 2, ["y"], ["y"]), ("three", "function", False, True, 3, ["z"], []),
        ("last", "arrow", False, False, 5, ["q"], []), ("deep", "arrow", False, False, 6, [], []), ("deeper", "arrow", False, False, 6, [], []),
    ]
    assert [(e.name, e.kind) for e in row.exports] == [("one", "variable"), ("two", "variable"), ("limit", "variable"), ("three", "variable")]


@pytest.mark.parametrize("depth", [1, 3, 6, 9, 12])
def test_brackets_of_every_kind_nest(spark, depth):
    calls, lists = "f(" * depth + "1, 2" + ")" * depth, "[" * depth + "1, 2" + "]" * depth
    generic = "Map<string, " * (depth - 1) + "Set<number>" + ">" * (depth - 1)
    text = f"export function deep(a = {calls}, b = {lists}, c: {generic}, d?: string): {generic} {{ return a; }}\nexport const arrow = (x = {calls}) => x;\n"
    row = of_text(spark, text)
    assert [(f.name, [(p.name, p.optional) for p in f.params]) for f in row.functions] == [
        ("deep", [("a", True), ("b", True), ("c", False), ("d", True)]), ("arrow", [("x", True)])]
    assert [e.name for e in row.entries] == ["deep", "arrow"]
    good, bad = C.quarantine(spark.createDataFrame([(1, "a.ts", text), (2, "b.ts", text + "(")], "file_id int, file_name string, content string"))
    assert [r.file_id for r in good.collect()] == [1] and [r.file_id for r in bad.collect()] == [2]


@pytest.mark.parametrize("literal", [r"/[{]/", r"/\//g", r"/[/'\"]+(/", "/`/", r"/a{2,}\(/i"])
def test_patterns_are_no_code(spark, literal):
    text = (f"export function strip(s) {{ const r = {literal}; return s.replace({literal}, '') || {literal}.test(s) ? a / b : c / (d); }}\n"
            f"export const half = (n) => n / 2, rest = (m) => m / 3;\nuseEffect({literal}, [a / b]);\n")
    files = spark.createDataFrame([(1, "a.ts", text)], "file_id int, file_name string, content string")
    good, bad = C.quarantine(files)
    assert good.count() == 1 and bad.count() == 0
    row = C.code_facts(files).first()
    assert [(f.name, f.line) for f in row.functions] == [("strip", 1), ("half", 2), ("rest", 2)]
    assert [h.args for h in row.hooks] == [[literal, "[a / b]"]]


def test_tags_are_no_patterns(spark):
    text = "export function View() {\n  return <A\n    b={1}\n  /> && <B c={x / 2} /><C /> && <i>it</i>;\n}\nexport function next(a) { return a; }\n"
    row = of_text(spark, text, "v.tsx")
    assert [f.name for f in row.functions] == ["View", "next"] and set(row.jsx_elements) >= {"A", "B", "C", "i"}


def test_files_are_judged_after_they_are_spread(spark):
    files = spark.createDataFrame([(1, "a.js", "f(1)"), (2, "b.js", "f(1"), (3, "c.js", None)], "file_id int, file_name string, content string").repartition(5)
    for side in C.quarantine(files):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Filter") < plan.index("Repartition"), plan  # a filter below the exchange runs in the tasks of the scan
    good, bad = C.quarantine(files)
    assert good.columns == files.columns and sorted(r.file_id for r in good.collect()) == [1, 3]
    assert [tuple(r) for r in bad.collect()] == [(2, "b.js", "Unbalanced brackets")]


def test_brackets_outside_strings_comments_and_patterns(spark):
    from pyspark.sql import functions as F

    from docspan.functions.source import balanced, brackets

    cases = [("f(a[0]) { g() }", "([]){()}", True), ("x = ')' + \"(\" + `{`", "", True), ("a // (\r\n/* [ */ b)", ")", False), ("r = /[(]{2}/g; s = a / (b)", "()", True),
             ("'it (", "(", False), ("/* open (", "(", False), ("}{", "}{", False), ("([)]", "([)]", True), ("((((((()))))))" * 3, "((((((()))))))" * 3, True), ("(()", "(()", False),
             ("", "", True), (None, "", True)]
    rows = spark.createDataFrame([(n, c) for n, (c, _, _) in enumerate(cases)], "n int, c string")
    got = rows.select("n", brackets(F.col("c")).alias("b"), balanced(brackets(F.col("c"))).alias("ok")).orderBy("n").collect()
    assert [(r.b, r.ok) for r in got] == [(b, ok) for _, b, ok in cases]


def test_only_the_fields_that_are_read_are_built(spark):
    text = DEEP_CLASS + "/** Adds.\n * @access all */\nexport function add(req, res) { throw new E('x'); /* note */ }\nmodule.exports = { sub: (a: number) => a };\n"
    files = spark.createDataFrame([(1, "a.ts", text), (2, "b.ts", None)], "file_id int, file_name string, content string")
    whole = {r.file_id: r.asDict(True) for r in C.code_facts(files).collect()}
    for fields, class_fields in ((C.SIGNATURE_FIELDS, C.SIGNATURE_CLASS_FIELDS), (C.ROLE_FIELDS, C.COUNTED), (("name", "api"), ("doc",)), (("name", "tags", "notes"), ("properties",))):
        facts = C.code_facts(files, ("functions", "classes"), fields, class_fields)
        for r in facts.collect():
            got, all_of = r.asDict(True), whole[r.file_id]
            assert got["functions"] == [{k: f[k] for k in C.FIELDS if k in fields} for f in all_of["functions"]]
            assert [{k: v for k, v in c.items() if k != "methods"} for c in got["classes"]] == [
                {k: c[k] for k in C.CLASS_FIELDS if k in class_fields and k != "methods"} for c in all_of["classes"]]


def test_exports_and_interfaces_are_read_as_far_as_asked(spark):
    text = ("/** A shape. */\nexport interface Shape<T> extends Base { id: string; tags?: string[]; run(): void }\ntype Kind = 'a';\nexport default interface Other {}\n"
            "export class Box { a = 1 }\nexport function add(a) {}\nfunction own() {}\nmodule.exports = { own, sub: (a) => a };\n")
    files = spark.createDataFrame([(1, "a.ts", text), (2, "b.ts", None)], "file_id int, file_name string, content string")
    whole = {r.file_id: r.asDict(True) for r in C.code_facts(files).collect()}
    assert [i["name"] for i in whole[1]["interfaces"]] == ["Shape", "Kind", "Other"]
    for fields in (("name",), ("name", "members"), ("kind", "doc"), C.INTERFACE_FIELDS):
        for r in C.code_facts(files, ("interfaces",), interface_fields=fields).collect():
            assert r.asDict(True)["interfaces"] == [{k: i[k] for k in C.INTERFACE_FIELDS if k in fields} for i in whole[r.file_id]["interfaces"]]

    def plan(*fields):
        facts = C.code_facts(files, ("functions", "classes", "interfaces"), fields, C.COUNTED, C.COUNTED)
        for r in facts.collect():
            assert r.asDict(True)["functions"] == [{k: f[k] for k in C.FIELDS if k in fields} for f in whole[r.file_id]["functions"]]
        return facts.select("functions", "classes", "interfaces")._jdf.queryExecution().optimizedPlan().toString()

    assert D.EXPORT in plan("name", "exported") and D.EXPORT not in plan("name", "line") and D.EXPORT not in plan("name")


def test_errors_are_judged_once(spark):
    from docspan.operators import assembly as A

    files = spark.createDataFrame([(1, 5, 7, "a.ts", "f("), (1, 6, 8, "b.ts", "f()"), (2, 7, 9, "c.ts", "]")], "doc_id int, file_no int, file_id int, file_name string, content string")
    rows = A.error_rows(A._keyed_facts(files)[1])
    assert "Scan parquet" in rows._jdf.queryExecution().executedPlan().toString() and "content" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.ord1) for r in rows.collect()) == [(1, -1), (1, 5), (1, 1 << 40), (2, -1), (2, 7), (2, 1 << 40)]


def test_texts_are_built_after_tables_are_spread(spark, sf_dir):
    from docspan.plans import code as P

    plan = P.error_quarantine(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("lib/broken.ts") < plan.index("Repartition"), plan  # what is built below the exchange is built in the tasks of the scan


def test_handlers_are_looked_for_where_their_parameters_stand(spark):
    texts = ["exports.a = (REQ, Res, next) => { res.json({a: 1}) };\nmodule.exports = { b: async (req, res) => { const {x} = req.body; res.status(404).json({n: x}); }, c: (a) => a };\n"
             "function d(re\x10q, res) { res.json([1]) }\nfunction e(req, /* c */ res) { return req.query.q }\nconst f = (x) => x, g = function(req, res) { res.json(f(2)) };\n"
             "export function h({req}, res) {}\nfunction i(q) { const j = (req, res) => res.json({j: req.params.id}); }",
             None, "function k(rEq, reS) { req.body.z }", "function l(req) { res.json(1) }", "export const m = (a, b) => a + b;", "function n(Req, resp, res) {}"]
    files = spark.createDataFrame([(k, "a.js", t) for k, t in enumerate(texts)], "file_id int, file_name string, content string")
    facts = C.handler_facts(files)
    rows = lambda f: sorted(map(str, C.handler_surface(f).collect()))
    assert rows(facts) == rows(C.code_facts(files, ("functions",), ("name", "api"))) and len(rows(facts)) == 6
    assert {r.file_id: [f.name for f in r.functions] for r in facts.collect()} == {
        0: ["a", "d", "e", "g", "h", "j", "b"], 1: [], 2: ["k"], 3: [], 4: [], 5: ["n"]}


def test_roles_need_parameters_of_error_files_only(spark):
    text = "export default function View({ error, reset }: P) { return <p/>; }\n"
    names = ["app/Error.tsx", "app/view.tsx", "error.js/x.ts", "error.ts", None]
    files = spark.createDataFrame([(k, n, text) for k, n in enumerate(names)], "file_id int, file_name string, content string")
    some, every = (C.code_facts(files, C.ROLE_FACTS, C.ROLE_FIELDS, C.COUNTED, C.COUNTED, role_params=r) for r in (True, False))
    rows = lambda f: sorted(map(str, C.file_roles(f).select("file_id", "role", "signals").collect()))
    assert rows(some) == rows(every) and "error-boundary" in rows(some)[0]
    assert {r.file_id: r.functions[0].params is None for r in some.collect()} == {0: False, 1: True, 2: True, 3: False, 4: True}
