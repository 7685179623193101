"""Inputs for the registered queries, derived from the given tables.

Each text is valid in Spark SQL and in DuckDB, so that a query and its SQL check read the same rows.
``fx_`` names may be used by later entries; ``with_fixtures`` adds the common table expressions a text needs.
"""

from __future__ import annotations

import re

FIXTURES: dict[str, str] = {}

FIXTURES["fx_projects"] = """
SELECT n_nationkey AS project_id, n_name AS project_name, min(c_custkey) AS owner_id
FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"""

FIXTURES["fx_members"] = """
SELECT c_nationkey AS project_id, c_custkey AS user_id, c_name AS login,
  CASE WHEN c_custkey = first_key THEN 'owner' ELSE 'editor' END AS role
FROM customer JOIN (SELECT c_nationkey AS nk, min(c_custkey) AS first_key FROM customer GROUP BY c_nationkey) f ON c_nationkey = nk"""

FIXTURES["fx_documents"] = """
SELECT doc_id, doc_id % 25 AS project_id, split_part(text, chr(10), 1) AS title, text AS content FROM documents"""

FIXTURES["fx_saves"] = """
SELECT o_custkey AS doc_id, o_orderkey AS event_id, o_orderdate AS saved_at, o_orderkey % 5 AS author_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'generate' WHEN 1 THEN 'edit' WHEN 2 THEN 'rollback' ELSE 'regenerate' END AS source,
  concat('content ', cast(o_orderkey % 3 AS string)) AS content, concat('message ', o_orderpriority) AS message
FROM orders"""

FIXTURES["fx_versions_text"] = """
SELECT doc_id, 1 AS version_no, replace(text, '. ', concat('.', chr(10))) AS content FROM documents
UNION ALL SELECT doc_id, 2, concat(replace(replace(text, '. ', concat('.', chr(10))), 'the ', 'that '), chr(10), 'added line') FROM documents
UNION ALL SELECT doc_id, 3, replace(text, '. ', concat('.', chr(10))) FROM documents"""

FIXTURES["fx_entries_old"] = """
SELECT p_partkey % 97 AS file_id, p_partkey AS pos, concat('fn', cast(p_partkey AS string)) AS name,
  concat('fn:fn', cast(p_partkey AS string), '(a:', p_type, '):', p_brand) AS sig FROM part"""

FIXTURES["fx_entries_new"] = """
SELECT p_partkey % 97 AS file_id, p_partkey AS pos, concat('fn', cast(p_partkey AS string)) AS name,
  concat('fn:fn', cast(p_partkey AS string), '(a:', p_type, '):',
    CASE WHEN p_partkey % 7 = 0 AND (p_partkey % 97) % 4 <> 0 THEN 'void' ELSE p_brand END) AS sig
FROM part WHERE p_partkey % 11 <> 0 OR (p_partkey % 97) % 4 = 0
UNION ALL
SELECT p_partkey % 97, p_partkey + 1000000000, concat('new', cast(p_partkey AS string)), concat('fn:new', cast(p_partkey AS string), '():void')
FROM part WHERE p_partkey % 13 = 0 AND (p_partkey % 97) % 4 <> 0"""

FIXTURES["fx_bindings"] = """
SELECT f AS file_id, f % 20 AS doc_id, concat('src/f', cast(f AS string), '.ts') AS path, concat('a', cast(f AS string)) AS commit_sha,
  CASE WHEN f % 5 = 0 THEN concat('a', cast(f AS string)) WHEN f % 17 = 0 THEN NULL ELSE concat('b', cast(f AS string)) END AS snapshot_sha,
  f % 3 <> 0 AS has_stored_hash, f % 19 <> 0 AS content_ok, f % 4 <> 1 AS old_ok, f % 23 <> 0 AS content_requested
FROM (SELECT DISTINCT p_partkey % 97 AS f FROM part) t"""

FIXTURES["fx_feedback"] = """
SELECT user_id AS doc_id, event_id, 1 + cast(event_id % 5 AS int) AS rating, ts AS at FROM events"""

FIXTURES["fx_notes"] = """
SELECT doc_id AS note_id, concat(
  CASE doc_id % 8 WHEN 0 THEN 'Purpose: this service provides billing' WHEN 1 THEN '- Run npm install ledger'
    WHEN 2 THEN 'PATCH /v2/ledger accepts a body' WHEN 3 THEN '2) FIXME: revisit later'
    WHEN 4 THEN concat('For example:', chr(10), '```ts', chr(10), 'run(1)', chr(10), '```')
    WHEN 5 THEN 'Set LEDGER_KEY in .env' WHEN 6 THEN 'Warning: does not support batches'
    ELSE concat('```', chr(10), 'never closed') END, chr(10), text) AS content
FROM documents"""

FIXTURES["fx_source_files"] = """
SELECT p_partkey AS file_id,
  concat('src/', CASE p_partkey % 5 WHEN 0 THEN 'page.tsx' WHEN 1 THEN 'route.ts' WHEN 2 THEN 'util.ts' WHEN 3 THEN 'use.ts' ELSE 'old.js' END) AS file_name,
  concat('import { useState } from ''react'';', chr(10), 'const K = process.env.KEY_', cast(p_size AS string), ';', chr(10),
    '// @route GET /api/', cast(p_size AS string), chr(10), 'export function fn', cast(p_partkey AS string),
    '(a: number, b?: string): string {', chr(10), '  if (!a) throw new Error("bad ', cast(p_size AS string), '");', chr(10), '  return "" + a;', chr(10), '}', chr(10),
    CASE WHEN p_partkey % 5 = 1 THEN concat('export async function GET(req: Request) { return 1; }', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 5 = 3 THEN concat('export function useThing() { return useState(0); }', chr(10)) ELSE '' END) AS content
FROM part"""

FIXTURES["fx_markdown"] = """
SELECT doc_id, concat('# ', split_part(text, chr(10), 1), chr(10), chr(10), '> quoted', chr(10), '- one', chr(10), '- two', chr(10),
  chr(10), '| h | k |', chr(10), '| --- | --- |', chr(10), '| a | b |', chr(10), '---', chr(10), '```js', chr(10), 'x', chr(10), '```', chr(10),
  '### fn', cast(doc_id AS string), chr(10), text) AS content
FROM documents"""

FIXTURES["fx_repo_tree"] = """
SELECT concat('src/app/', replace(p_brand, '#', ''), '/', cast(p_partkey AS string),
  CASE p_partkey % 3 WHEN 0 THEN '.tsx' WHEN 1 THEN '.md' ELSE '.json' END) AS path, 'file' AS type FROM part
UNION ALL SELECT DISTINCT concat('src/app/', replace(p_brand, '#', '')), 'dir' FROM part"""

FIXTURES["fx_profiles"] = """
SELECT c_custkey * 10 AS github_id, c_name AS login,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('u', cast(c_custkey % 1000 AS string), '@example.com') END AS email
FROM customer"""

FIXTURES["fx_modules"] = r"""
SELECT p_partkey AS file_id, CASE p_partkey % 4 WHEN 0 THEN concat('lib/ctl', cast(p_partkey AS string), '.js') WHEN 1 THEN 'lib/box.ts' WHEN 2 THEN 'app/view.tsx' ELSE 'lib/broken.ts' END AS file_name,
  CASE p_partkey % 4
  WHEN 0 THEN concat('// @desc    List ', p_brand, chr(10), '// @route   GET /api/', cast(p_size AS string), '/:id', chr(10), '// @access  Private (', p_type, ')', chr(10),
    'exports.list', cast(p_partkey AS string), ' = asyncHandler(async (req, res) => {', chr(10), '  const { size, name: n } = req.body;', chr(10),
    '  if (!req.params.id) return res.status(404).json({ ok: false });', chr(10), '  res.status(200).json({ ok: true, q: req.query.page });', chr(10),
    '  res.json({ again: ', cast(p_size AS string), ' });', chr(10), '});', chr(10),
    'function helper(x) { throw fail; }', chr(10), 'module.exports = { helper, total: (a, b) => a + b };', chr(10))
  WHEN 1 THEN concat('/**', chr(10), ' * Holds ', p_name, '.', chr(10), ' * @deprecated', chr(10), ' */', chr(10), 'export class Box', cast(p_partkey AS string), ' extends Base {', chr(10),
    '  static limit: number = ', cast(p_size AS string), ';', chr(10), '  add(item: string, { note }: { note?: string }): Promise<void> {', chr(10),
    '    throw new RangeError(', chr(39), 'full ', cast(p_size AS string), chr(39), ');', chr(10), '  }', chr(10), '}', chr(10),
    'export interface Shape', cast(p_partkey AS string), ' { id: string; tags?: string[]; run(): void }', chr(10), 'export type Kind = ''a'' | ''b'';', chr(10))
  WHEN 2 THEN concat(chr(39), 'use client', chr(39), ';', chr(10), 'import React, { useMemo as memo } from ', chr(39), 'react', chr(39), ';', chr(10), 'import * as api from "./api', cast(p_size AS string), '";', chr(10),
    '/** Shows ', p_name, '. */', chr(10), 'export default function View', cast(p_partkey AS string), '({ title, size = 1 }: { title: string; size?: number }) {', chr(10),
    '  // keep the total', chr(10), '  const total = useMemo(() => size + ', cast(p_size AS string), ', [size]);', chr(10),
    '  return (<Panel.Body><button onClick={() => { api.save(total); done(); }}>go</button></Panel.Body>);', chr(10), '}', chr(10))
  ELSE concat('export const x = (', cast(p_size AS string), ';', chr(10)) END AS content
FROM part"""

FIXTURES["fx_mixed_markdown"] = r"""
SELECT doc_id, concat(
  replace(replace(replace(replace(replace(replace(text, ' the ', concat(chr(10), '- ')), ' of ', concat(chr(10), '---', chr(10))), ' and ', concat(chr(10), ' ***', chr(10))),
    ' is ', concat(chr(10), '| a | b |', chr(10))), ' to ', concat(chr(10), '|:--|', chr(10))), ' in ', concat(chr(10), '## ')), chr(10),
  CASE doc_id % 4 WHEN 0 THEN concat('```js', chr(10), '# x', chr(10)) WHEN 1 THEN concat('> q', chr(10), '| a', chr(10), 'x', chr(10)) ELSE '' END,
  replace(replace(replace(text, ' with ', concat(chr(10), '> ')), ' it ', concat(chr(10), '```', chr(10))), ' a ', concat(chr(10), chr(10)))) AS content
FROM documents"""

_NAME = re.compile(r"\bfx_[a-z_]+\b")
# Strings may mention a fixture name only by accident; none does.


def needed(text: str) -> list[str]:
    """Fixture names a text uses, dependencies first."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in _NAME.findall(body):
            if name in FIXTURES and name not in order:
                visit(FIXTURES[name])
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def with_fixtures(sql: str) -> str:
    """Prefix a query with the common table expressions it needs."""
    names = needed(sql)
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in names)
    body = sql.lstrip()
    if body[:15].upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
