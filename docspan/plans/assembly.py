"""Document assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspan.operators import assembly as A
from docspan.operators import code as C
from docspan.plans import markdown as MD
from docspan.plans import notes as NT
from docspan.plans.inputs import built_in_tasks, fixture, spread, sql_input

AT = "2024-03-05 06:07:08"
AT_TEXT = "Tue, 05 Mar 2024 06:07:08 GMT"
DOCS_SQL = """
SELECT doc_id, title, CASE WHEN doc_id % 3 = 0 THEN concat('org/repo', cast(doc_id AS string)) ELSE NULL END AS source_repo,
  CASE WHEN doc_id % 4 = 0 THEN concat('c', cast(doc_id AS string)) ELSE NULL END AS source_commit FROM fx_documents"""
NOTES_SQL = "SELECT note_id AS doc_id, content FROM fx_notes"
FILES_SQL = """
SELECT file_id % 97 AS doc_id, 2 * file_id AS file_no, file_id, file_name, content FROM fx_modules
UNION ALL SELECT file_id % 97, 2 * file_id + 1, file_id, file_name, content FROM fx_source_files"""
HEADS_SQL = "SELECT doc_id, concat('# Head ', cast(doc_id AS string), chr(10), chr(10), chr(10), 'Overview ') AS head FROM documents WHERE doc_id % 2 = 0"
UNIT_TEXTS_SQL = "SELECT doc_id, content AS unit_text FROM fx_markdown WHERE doc_id % 3 <> 0"
VARIANTS_SQL = "SELECT doc_id, text AS rule_text, CASE WHEN doc_id % 2 = 0 THEN concat('generated ', cast(doc_id AS string)) ELSE NULL END AS generated_text FROM documents"


def _compose(spark, sf, **how):
    return A.compose(sql_input(spark, sf, DOCS_SQL), spread(sql_input(spark, sf, NOTES_SQL)), built_in_tasks(spark, sf, FILES_SQL),
                     F.lit(AT).cast("timestamp"), **how)


def composed_documents(spark, sf):
    return _compose(spark, sf).select("doc_id", "piece_no", "content")


def document_note_sections(spark, sf):
    return A.note_rows(spread(sql_input(spark, sf, NOTES_SQL))).select("doc_id", "ord1", "text")


def document_configuration(spark, sf):
    files = built_in_tasks(spark, sf, "SELECT * FROM fx_source_files")
    facts = C.code_facts(files, ("env_vars",)).withColumn("doc_id", F.col("file_id") % 97)
    return A.config_rows(facts).select("doc_id", "ord1", "ord2", "text")


def document_file_sections(spark, sf):
    facts, _ = A._keyed_facts(built_in_tasks(spark, sf, FILES_SQL))
    return A.file_rows(A.file_sections(facts)).select("doc_id", F.col("ord1").alias("file_no"), "text")


def document_footers(spark, sf):
    return A.footer_rows(sql_input(spark, sf, DOCS_SQL), F.lit(AT).cast("timestamp")).select("doc_id", "text")


def document_error_notes(spark, sf):
    return A.error_rows(A._keyed_facts(built_in_tasks(spark, sf, FILES_SQL))[1]).select("doc_id", "ord1", "text")


def unit_payloads(spark, sf):
    p = A.unit_payloads(C.file_roles(C.code_facts(C.quarantine(built_in_tasks(spark, sf, "SELECT * FROM fx_modules"))[0])))
    field = lambda path: F.coalesce(F.get_json_object("payload", path), F.lit("—"))
    return p.select("file_id", "unit_count", field("$.role").alias("role"), field("$.signals[0]").alias("signal"), field("$.comments.file_level[0]").alias("comment"),
                    field("$.fact_sheet.functions[0].name").alias("first_function"), F.length(field("$.source")).alias("source_length"))


def declaration_summaries(spark, sf):
    facts = C.code_facts(C.quarantine(built_in_tasks(spark, sf, "SELECT * FROM fx_modules"))[0], C.FACTS, ("name", "exported", "params", "doc"), ("name", "doc"), ("name", "kind", "doc"), role_params=True)
    s = A.declaration_summary(C.file_roles(facts))
    field = lambda path: F.coalesce(F.get_json_object("summary", path), F.lit("—"))
    return s.select("file_id", field("$.role").alias("role"), field("$.declarations[0].kind").alias("kind"), field("$.declarations[0].name").alias("name"),
                    field("$.declarations[0].purpose").alias("purpose"), field("$.imports[0]").alias("import"))


def merged_documents(spark, sf):
    docs = sql_input(spark, sf, "SELECT doc_id, title FROM fx_documents")
    m = A.merge_generated(sql_input(spark, sf, HEADS_SQL), sql_input(spark, sf, UNIT_TEXTS_SQL), docs, sql_input(spark, sf, MD.UNITS_SQL))
    return m.select("doc_id", *[F.coalesce(c, F.lit("—")).alias(c) for c in ("content", "derived_title", "error")])


def chosen_variants(spark, sf):
    return A.choose_variant(sql_input(spark, sf, VARIANTS_SQL))


QUERIES = {f.__name__: f for f in (
    composed_documents, document_note_sections, document_configuration, document_file_sections, document_footers, document_error_notes,
    unit_payloads, declaration_summaries, merged_documents, chosen_variants)}


def _norm(e: str) -> str:
    return f"concat(regexp_replace(regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g'), chr(10), chr(10))"


def _lit(text: str, **cols: str) -> str:
    """A SQL concat of a template whose {name} parts are SQL expressions."""
    parts = []
    for i, chunk in enumerate(text.replace("{", "}").split("}")):
        parts.append(cols[chunk] if i % 2 else "'" + chunk.replace("'", "''") + "'")
    return "concat(" + ", ".join(p for p in parts if p != "''") + ")"


_HEAD = "| Parameter | Type | Required | Description |\n| --- | --- | --- | --- |\n"
_CTL = ("### `{file}` · Utility Module\n\n_@desc    List {brand}_\n\n**Functions**\n\n#### `list{k}` — GET /api/{size}/:id  ·  Private ({type})\n\nList {brand}\n\n"
        "```js\nasync list{k}(req, res)\n```\n\n**Request body** (`req.body`):\n\n| Field | Required |\n| --- | --- |\n| `size` | yes |\n| `name` | yes |\n\n"
        "**Path parameters** (`req.params`):\n\n| Param | Description |\n| --- | --- |\n| `id` | |\n\n**Query parameters** (`req.query`):\n\n| Param | Description |\n| --- | --- |\n| `page` | |\n\n"
        "**Responses:**\n\n| Status | Shape |\n| --- | --- |\n| `200` | `«ok: true, q: req.query.page»` |\n| `404` | `«ok: false»` |\n\n"
        "#### `helper`\n\n```js\nhelper(x)\n```\n\n" + _HEAD + "| `x` | — | yes |  |\n\n**Throws:** `fail`\n\n"
        "#### `total`\n\n```js\ntotal(a, b)\n```\n\n" + _HEAD + "| `a` | — | yes |  |\n| `b` | — | yes |  |\n\n")
_BOX = ("### `lib/box.ts` · Utility Module\n\n_Holds {name}. @deprecated_\n\n#### class `Box{k}` extends `Base`\n\nHolds {name}.\n\nProperties:\n\n- `static limit`: number\n\n"
        "#### `Box{k}.add` _(internal)_\n\n```js\nBox{k}.add(item: string, «note»: «…»): Promise\n```\n\n" + _HEAD + "| `item` | string | yes |  |\n| `«note»` | «…» | yes |  |\n\n"
        "**Returns:** `Promise`\n\n**Throws:** `new RangeError(\"full {size}\")`\n\n#### interface `Shape{k}`\n\n| Field | Type | Required |\n| --- | --- | --- |\n"
        "| `id` | string | yes |\n| `tags` | string[] | no |\n| `member` | — | yes |\n\n#### type `Kind`\n\n")
_VIEW = ("### `app/view.tsx` · React Component\n\n_Shows {name}._\n\n**Dependencies:** `react` (React, «useMemo»), `./api{size}` (* as api)\n\n**Hooks:** useMemo\n**Renders:** Panel.Body, button\n"
         "**Handlers:** onClick → api.save/done\n\n**Functions**\n\n#### `View{k}`\n\n_Notes: keep the total_\n\n```js\nView{k}(«title, size»: «…»)\n```\n\n" + _HEAD + "| `«title, size»` | «…» | yes |  |\n\n")
_FN = ("#### `fn{k}` — GET /api/{size}\n\n```js\nfn{k}(a: number, b?: string): string\n```\n\n" + _HEAD + "| `a` | number | yes |  |\n| `b` | string | no |  |\n\n"
       "**Returns:** `string`\n\n**Throws:** `new Error(\"bad {size}\")`\n\n")
_PLAIN_HEAD = "### `{file}` · {role}\n\n_@route GET /api/{size}_\n\n**Dependencies:** `react` («useState»)\n\n"
_GET = "#### `GET`\n\n```js\nasync GET(req: Request)\n```\n\n" + _HEAD + "| `req` | Request | yes |  |\n\n"
_USE = "#### `useThing`\n\n```js\nuseThing()\n```\n\nTakes no parameters.\n\n"


def _braces(sql: str) -> str:
    return sql.replace("«", "{ ").replace("»", " }")


_COLS = dict(file="file_name", brand="p_brand", k="cast(p_partkey AS varchar)", size="p_size", type="p_type", name="p_name", role="role")
_FILES = f"""
files AS (
  SELECT p_partkey % 97 AS doc_id, 2 * p_partkey AS file_no, CASE p_partkey % 4 WHEN 0 THEN {_braces(_lit(_CTL, **_COLS))} WHEN 1 THEN {_braces(_lit(_BOX, **_COLS))}
    ELSE {_braces(_lit(_VIEW, **_COLS))} END AS text FROM part JOIN fx_modules m ON m.file_id = p_partkey WHERE p_partkey % 4 < 3
  UNION ALL
  SELECT p_partkey % 97, 2 * p_partkey + 1, concat({_braces(_lit(_PLAIN_HEAD, **_COLS))}, CASE WHEN p_partkey % 5 = 3 THEN concat('**Hooks:** useState', chr(10), chr(10)) ELSE '' END,
    '**Functions**', chr(10), chr(10), {_lit(_FN, **_COLS)}, CASE p_partkey % 5 WHEN 1 THEN {_lit(_GET)} WHEN 3 THEN {_lit(_USE)} ELSE '' END) AS text
  FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'Next.js Page' WHEN 1 THEN 'Next.js Route Handler' WHEN 3 THEN 'React Hook' ELSE 'Utility Module' END AS role FROM part) p
  JOIN fx_source_files f ON f.file_id = p_partkey)"""
_TITLES = " ".join(f"WHEN '{r.rule_id}' THEN '{r.title}'" for r in NT.RULES)
_NOTE_SECTIONS = f"""
note_sections AS (
  SELECT note_id AS doc_id, {NT._ORDER} AS ord1, {_norm("concat('## ', CASE section_id " + _TITLES + " END, chr(10), chr(10), string_agg(CASE WHEN is_code THEN text || chr(10) ELSE '- ' || text END, chr(10) ORDER BY block_no))")} AS text
  FROM classified GROUP BY note_id, section_id)"""
_ENV = """
env AS (SELECT DISTINCT p_partkey % 97 AS doc_id, concat('KEY_', p_size) AS v FROM part)"""


def _config(env: str) -> str:
    head = "## Configuration\n\nThe following environment variables are read by this module:\n\n| Variable | Notes |\n| --- | --- |\n"
    return f"""SELECT DISTINCT doc_id, 0 AS ord1, '' AS ord2, {_lit(head)} AS text FROM {env} UNION ALL SELECT doc_id, 1, v, concat('| `', v, '` | |', chr(10)) FROM {env}
UNION ALL SELECT DISTINCT doc_id, 2, '', chr(10) FROM {env}"""


_FOOTER = f"""concat('---', chr(10), chr(10), '<sub>Generated {AT_TEXT}', CASE WHEN source_repo IS NULL THEN '' ELSE concat(' · Source: `', source_repo, '`') END,
  CASE WHEN source_commit IS NULL THEN ' · Commit: _pending first save_' ELSE concat(' · Commit: `', source_commit, '`') END, '</sub>', chr(10))"""
_ERRORS = """
SELECT DISTINCT p_partkey % 97 AS doc_id, -1 AS ord1, concat('## Generation Notes', chr(10), chr(10)) AS text FROM part WHERE p_partkey % 4 = 3
UNION ALL SELECT p_partkey % 97, 2 * p_partkey, concat('- ⚠ Could not parse `lib/broken.ts`: Unbalanced brackets', chr(10)) FROM part WHERE p_partkey % 4 = 3
UNION ALL SELECT DISTINCT p_partkey % 97, 1099511627776, chr(10) FROM part WHERE p_partkey % 4 = 3"""

ORACLES = {
    "composed_documents": NT.CLASSIFIED_SQL + f""", {_NOTE_SECTIONS}, {_FILES},
env AS (SELECT DISTINCT p_partkey % 97 AS doc_id, concat('KEY_', p_size) AS v FROM part),
totals AS (
  SELECT doc_id, count(*) AS files, sum(fns) AS fns, sum(cls) AS cls, sum(ifs) AS ifs FROM (
    SELECT p_partkey % 97 AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS fns, CASE WHEN p_partkey % 4 = 1 THEN 1 ELSE 0 END AS cls, CASE WHEN p_partkey % 4 = 1 THEN 2 ELSE 0 END AS ifs FROM part WHERE p_partkey % 4 < 3
    UNION ALL SELECT p_partkey % 97, CASE WHEN p_partkey % 5 IN (1, 3) THEN 2 ELSE 1 END, 0, 0 FROM part) GROUP BY doc_id),
sections AS (
  SELECT doc_id, 0 AS part, 0 AS ord1, '' AS ord2, concat('# ', regexp_replace(title, '^\\n+|\\n+$', '', 'g'), chr(10), chr(10), '> Generated by docspan · {AT_TEXT}', chr(10), chr(10)) AS text FROM ({DOCS_SQL})
  UNION ALL SELECT doc_id, 1, ord1, '', text FROM note_sections
  UNION ALL SELECT doc_id, 2, ord1, ord2, text FROM ({_config('env')})
  UNION ALL SELECT doc_id, 3, 0, '', concat('## API Reference', chr(10), chr(10), 'Parsed **', files, '** file(s): ', fns, ' function(s), ', cls, ' class(es), ', ifs, ' interface/type(s).', chr(10), chr(10)) FROM totals
  UNION ALL SELECT doc_id, 4, file_no, '', text FROM files
  UNION ALL SELECT doc_id, 5, ord1, '', text FROM ({_ERRORS})
  UNION ALL SELECT doc_id, 6, 0, '', {_FOOTER} FROM ({DOCS_SQL}))
SELECT doc_id, 0 AS piece_no, regexp_replace(string_agg(text, '' ORDER BY part, ord1, ord2), '\\n{{3,}}', chr(10) || chr(10), 'g') AS content FROM sections GROUP BY doc_id""",
    "document_note_sections": NT.CLASSIFIED_SQL + f", {_NOTE_SECTIONS} SELECT * FROM note_sections",
    "document_configuration": f"WITH {_ENV} {_config('env')}",
    "document_file_sections": f"WITH {_FILES} SELECT doc_id, file_no, text FROM files",
    "document_footers": f"SELECT doc_id, {_FOOTER} AS text FROM ({DOCS_SQL})",
    "document_error_notes": _ERRORS,
    "unit_payloads": """
SELECT m.file_id, CASE m.file_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 ELSE 1 END AS unit_count, CASE m.file_id % 4 WHEN 2 THEN 'React Component' ELSE 'Utility Module' END AS role,
  CASE m.file_id % 4 WHEN 2 THEN '"use client" directive' ELSE 'exports functions/classes, no JSX' END AS signal,
  CASE m.file_id % 4 WHEN 0 THEN concat('@desc    List ', p_brand) WHEN 1 THEN concat('Holds ', p_name, '. @deprecated') ELSE concat('Shows ', p_name, '.') END AS comment,
  CASE m.file_id % 4 WHEN 0 THEN concat('list', m.file_id) WHEN 1 THEN '—' ELSE concat('View', m.file_id) END AS first_function, length(content) AS source_length
FROM fx_modules m JOIN part ON p_partkey = m.file_id WHERE m.file_id % 4 < 3""",
    "declaration_summaries": """
SELECT m.file_id, CASE m.file_id % 4 WHEN 2 THEN 'React Component' ELSE 'Utility Module' END AS role, CASE m.file_id % 4 WHEN 1 THEN 'class' ELSE 'function' END AS kind,
  CASE m.file_id % 4 WHEN 0 THEN concat('list', m.file_id) WHEN 1 THEN concat('Box', m.file_id) ELSE concat('View', m.file_id) END AS name,
  CASE m.file_id % 4 WHEN 0 THEN concat('List ', p_brand) WHEN 1 THEN concat('Holds ', p_name, '.') ELSE '—' END AS purpose, CASE m.file_id % 4 WHEN 2 THEN 'react' ELSE '—' END AS import
FROM fx_modules m JOIN part ON p_partkey = m.file_id WHERE m.file_id % 4 < 3""",
    "merged_documents": rf"""
WITH h AS ({HEADS_SQL}), u AS ({UNIT_TEXTS_SQL}), n AS (SELECT doc_id, count(*) AS c FROM ({MD.UNITS_SQL}) GROUP BY doc_id),
j AS (SELECT d.doc_id, d.title, h.head, u.unit_text, n.c, len(regexp_extract_all(u.unit_text, '(?m)^###\s')) AS found
  FROM fx_documents d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN head IS NULL AND unit_text IS NULL THEN '—' ELSE concat(regexp_replace(regexp_replace(concat(coalesce(regexp_replace(head, '\s+$', ''), concat('# ', title)),
    CASE WHEN unit_text IS NULL THEN '' ELSE concat(chr(10), chr(10), '---', chr(10), chr(10), '## API Reference', chr(10), chr(10), regexp_replace(regexp_replace(unit_text, '\s+$', ''), '^\s+', ''),
      CASE WHEN found < c THEN concat(chr(10), chr(10), '> ⚠️ **Incomplete documentation:** ', found, ' of ', c, ' functions were documented above. Check server logs for details.') ELSE '' END) END),
    '\n{{3,}}', chr(10) || chr(10), 'g'), '\s+$', ''), chr(10)) END AS content,
  CASE WHEN head IS NULL AND unit_text IS NULL THEN '—' WHEN head IS NULL THEN title ELSE concat('Head ', doc_id) END AS derived_title,
  CASE WHEN head IS NULL AND unit_text IS NULL THEN 'Both synthesis passes returned empty.' ELSE '—' END AS error FROM j""",
    "chosen_variants": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('generated ', doc_id) ELSE text END AS content,
  CASE WHEN doc_id % 2 = 0 THEN 'Regenerated from updated source (AI-enhanced)' ELSE 'Regenerated from updated source' END AS message FROM documents""",
}
