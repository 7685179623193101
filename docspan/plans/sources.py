"""Source, sink and column-expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspan.functions import text as X
from docspan.operators.storage import new_path
from docspan.plans.inputs import fixture, spread, sql_input
from docspan.sources import collections as C
from docspan.sources import manifest as M
from docspan.sources import packed as P

AS_OF = "1998-08-02 12:00:00"
REPOS_SQL = """
SELECT s_suppkey AS id, s_name AS name, concat('org', cast(s_nationkey AS string), '/', s_name) AS full_name,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('repo of ', n_name) END AS description, (s_suppkey * 7919) % 10007 AS updated_at
FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
_ENTRY = """concat('{"doc_path": "docs/', lower(p_brand), '.md", "sources": [{"repo_full_name": "o/', p_type, '", "path": "src/', cast(p_partkey AS string),
  '.ts", "branch": "main", "commit_sha": "a', cast(p_size AS string), '"}], "generator": "x", "author_login": "dev", "version": ', cast(p_size AS string), '}')"""
MANIFESTS_SQL = f"""
SELECT p_partkey AS manifest_id, CASE p_partkey % 4 WHEN 0 THEN '{{"not": "an array"}}' WHEN 1 THEN 'broken [' ELSE concat('[', {_ENTRY}, ', ',
  '{{"doc_path": "docs/empty.md", "sources": [], "version": 1}}]') END AS json FROM part"""
SCANNED_FILES_SQL = """
SELECT replace(p_brand, '#', '-') AS brand, p_partkey AS file_id, CASE p_partkey % 5 WHEN 0 THEN '' ELSE replace(content, chr(10), ' ') END AS value
FROM part JOIN fx_source_files ON file_id = p_partkey"""
_USER_LINE = """concat('{"user_id": "', cast(c_custkey AS string), '", "full_name": "', c_name, '", "email": "u', cast(c_custkey AS string), '@example.com", "github_id": null}')"""
USER_LINES_SQL = f"SELECT c_nationkey AS part, CASE WHEN c_custkey % 7 = 0 THEN substr({_USER_LINE}, 1, 30) ELSE {_USER_LINE} END AS value FROM customer"
_MANIFEST_LINE = """concat('{"doc_path": "docs/', cast(p_partkey AS string), '.md", "sources": [', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('{"path": "src/', cast(p_partkey AS string),
  '.ts", "commit_sha": "a', cast(p_size AS string), '"}') END, '], "version": ', cast(p_size AS string), '}')"""
# Even parts hold one entry a line, some of them cut; odd parts are one array over several lines, every fifth of them cut.
MANIFEST_LINES_SQL = f"""
SELECT p_partkey % 20 AS part, p_partkey AS entry, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN substr({_MANIFEST_LINE}, 1, 25) ELSE {_MANIFEST_LINE} END
  ELSE concat(CASE WHEN p_partkey < 20 THEN '[' ELSE ',' END, {_MANIFEST_LINE}) END AS value FROM part
UNION ALL SELECT k, 1000000000000, CASE WHEN k = 5 THEN '' ELSE ']' END FROM (SELECT DISTINCT p_partkey % 20 AS k FROM part) t WHERE k % 2 = 1"""
OLD_ENTRIES_SQL = "SELECT concat('docs/', cast(p_partkey AS string), '.md') AS doc_path, p_size AS version, p_partkey AS entry_no FROM part"
NEW_ENTRIES_SQL = "SELECT concat('docs/', cast(p_partkey * 3 AS string), '.md') AS doc_path, 99 AS version, p_partkey AS entry_no FROM part"
BOUND_DOCS_SQL = """
SELECT c_custkey AS user_id, c_custkey AS doc_id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN NULL ELSE ' docs/custom.md ' END AS path_override,
  CASE WHEN c_custkey % 2 = 0 THEN concat(CASE c_custkey % 5 WHEN 0 THEN 'src/app/(shop)/(a)/' WHEN 1 THEN 'app/' WHEN 2 THEN 'src/pages/' WHEN 3 THEN 'pages/' ELSE 'src/lib/' END, 'f',
    cast(c_custkey AS string), CASE c_custkey % 4 WHEN 0 THEN '.tsx' ELSE '.json' END) ELSE NULL END AS source_path, c_nationkey AS current_version FROM customer"""
AUTHORS_SQL = "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS github_login, CASE WHEN c_custkey % 2 = 0 THEN 'm@example.com' ELSE NULL END AS email, 'Full Name' AS full_name FROM customer"
EXPORT_DOCS_SQL = "SELECT doc_id, title, doc_id % 9 AS current_version FROM fx_documents"
COMMITS_SQL = "SELECT o_custkey AS doc_id, o_orderkey AS version_no, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('commit', cast(o_orderkey AS string), 'abcdef') END AS commit_hash FROM orders"
PAGES_SQL = "SELECT page_id, concat('**', url, '** and `code` <sub>x</sub> *it* ', html) AS line FROM pages"


def source_file_types(spark, sf):
    return fixture(spark, sf, "fx_source_files").select("file_id", "file_name", C.file_type(F.col("file_name")).alias("file_type"))


def source_file_scan(spark, sf):
    """The files of every brand written as text files, with an empty and a cut one a brand, and scanned again by name."""
    files = sql_input(spark, sf, SCANNED_FILES_SQL)
    path = new_path(spark, "files")
    files.repartition("brand").sortWithinPartitions("brand", "file_id").select("brand", "value").write.partitionBy("brand").text(path)
    scanned = C.read_source_files(spark, path, "part-*.txt")
    return scanned.select(F.regexp_extract("file_path", "brand=([^/]*)", 1).alias("brand"), "file_type", F.col("file_size").alias("n_bytes"), F.sha2("content", 256).alias("content_sha"))


def user_scan(spark, sf):
    """Users as JSON lines, every seventh cut off in the middle, among files that a scan by name leaves out."""
    path = new_path(spark, "users")
    lines = sql_input(spark, sf, USER_LINES_SQL)
    lines.select("part", "value").repartition("part").write.partitionBy("part").text(path)
    lines.filter("FALSE").select("value").coalesce(1).write.text(f"{path}/empty")
    rows = C.scan(spark, "users", path, "part-*.txt")
    return rows.select(F.coalesce("user_id", F.lit("—")).alias("user_id"), F.coalesce("email", F.lit("—")).alias("email"), F.coalesce(C.MALFORMED, F.lit("—")).alias("malformed"))


def _manifest_files(spark, sf):
    path = new_path(spark, "manifests")
    lines = sql_input(spark, sf, MANIFEST_LINES_SQL)
    lines.repartition("part").sortWithinPartitions("part", "entry").select("part", "value").write.partitionBy("part").text(path)
    return path


def manifest_scan(spark, sf):
    """Entries of files in both forms: one entry a line, and one array a file."""
    rows = M.read_manifest(spark, _manifest_files(spark, sf), glob="part-*")
    return rows.select("doc_path", "version", F.coalesce("path", F.lit("—")).alias("path"), F.coalesce("commit_sha", F.lit("—")).alias("commit_sha"))


def manifest_scan_errors(spark, sf):
    return M.manifest_errors(spark, _manifest_files(spark, sf), glob="part-*").select(F.col("line_no").cast("int").alias("line_no"), F.regexp_replace("text", r"\s+\z", "").alias("text"))


def documentable_nodes(spark, sf):
    return C.documentable(fixture(spark, sf, "fx_repo_tree"))


def repository_page(spark, sf):
    return C.list_repos(sql_input(spark, sf, REPOS_SQL), "ORG", page=2, per_page=4).select("id", "full_name", "has_more")


def repository_first_page(spark, sf):
    """The search leaves out rows of the page; the page itself does not change."""
    return C.list_repos(sql_input(spark, sf, REPOS_SQL), "1/", page=1, per_page=50).select("id", "full_name", "has_more")


def packed_export(spark, sf):
    """All documents written as packs and read back through their byte ranges."""
    path = new_path(spark, "packed")
    P.export_packed(fixture(spark, sf, "fx_documents"), path)
    return P.read_packed(spark, path).select("doc_id", "slug", F.sha2("content", 256).alias("content_sha"))


def packed_documents(spark, sf):
    """Documents of the customers' ids, read from several packs."""
    path = new_path(spark, "packed")
    P.export_packed(fixture(spark, sf, "fx_documents"), path, packs=5)
    wanted = sql_input(spark, sf, "SELECT c_custkey AS doc_id FROM customer")
    return P.read_packed(spark, path, wanted).select("doc_id", F.length("content").cast("bigint").alias("n_chars"), F.sha2("content", 256).alias("content_sha"))


def repository_search(spark, sf):
    return C.list_repos(sql_input(spark, sf, REPOS_SQL), "1", signed_in=False).select("id", "full_name", "has_more")


def manifest_sources(spark, sf):
    return M.flatten(sql_input(spark, sf, MANIFESTS_SQL)).select(
        "manifest_id", "entry_no", "doc_path", F.coalesce("path", F.lit("—")).alias("path"), F.coalesce("commit_sha", F.lit("—")).alias("commit_sha"), "version")


def snapshot_contents(spark, sf):
    docs = spread(sql_input(spark, sf, "SELECT doc_id, text FROM documents"))
    wrapped = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\r", "")
    raw = docs.select(F.lit("o/r").alias("repo_full_name"), F.col("doc_id").cast("string").alias("blob_sha"),
                      F.when(F.col("doc_id") % 3 > 0, "base64").otherwise("utf-8").alias("encoding"),
                      F.when(F.col("doc_id") % 3 > 0, wrapped).otherwise(F.col("text")).alias("content"))
    return C.read_snapshot(raw).select("blob_sha", F.sha2("content", 256).alias("content_sha"))


def manifest_upsert(spark, sf):
    return M.upsert_manifest(sql_input(spark, sf, OLD_ENTRIES_SQL), sql_input(spark, sf, NEW_ENTRIES_SQL))


def manifest_rows(spark, sf):
    binding = F.struct(F.lit("o/r").alias("repo_full_name"), F.col("source_path").alias("path"), F.lit("main").alias("branch"),
                       F.lit("s").alias("commit_sha"), F.lit(None).cast("string").alias("signature_hash"))
    docs = sql_input(spark, sf, BOUND_DOCS_SQL).withColumn(
        "source_bindings", F.when(F.col("source_path").isNotNull(), F.array(binding)).otherwise(F.array().cast(
            "array<struct<repo_full_name:string,path:string,branch:string,commit_sha:string,signature_hash:string>>"))).withColumn(
        "generated_at", F.lit(AS_OF))
    return M.manifest_entries(docs, sql_input(spark, sf, AUTHORS_SQL)).select(
        "doc_path", "author_login", "version", F.size("sources").alias("n_sources"))


def export_index(spark, sf):
    docs = sql_input(spark, sf, EXPORT_DOCS_SQL).withColumn("updated_at", F.timestamp_seconds(F.col("doc_id") * 86399 + 800000000))
    return M.export_index(docs, sql_input(spark, sf, COMMITS_SQL))


def slug_collisions(spark, sf):
    return M.slug_collisions(sql_input(spark, sf, "SELECT concat('The ', p_name, CASE WHEN p_partkey % 2 = 0 THEN '!!' ELSE '' END) AS title FROM part"))


def document_slugs(spark, sf):
    return fixture(spark, sf, "fx_documents").select("doc_id", X.slug(F.col("title")).alias("slug"))


def mirrored_paths(spark, sf):
    return fixture(spark, sf, "fx_repo_tree").select("path", X.mirrored_path(F.col("path")).alias("doc_path"))


def short_digests(spark, sf):
    return sql_input(spark, sf, COMMITS_SQL).select("doc_id", "version_no", X.short_commit(F.col("commit_hash")).alias("commit"),
                                                   X.short_digest(F.coalesce("commit_hash", F.lit(""))).alias("digest"))


def relative_times(spark, sf):
    o = sql_input(spark, sf, "SELECT o_orderkey, o_orderdate, o_orderkey % 97 AS m FROM orders")
    # spread the dates over minutes and hours before the reference time
    ts = F.when(F.col("m") < 40, F.expr(f"timestamp '{AS_OF}' - make_interval(0, 0, 0, 0, 0, cast(m * m AS int), m)")).otherwise(F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", X.relative_time(ts, F.lit(AS_OF).cast("timestamp")).alias("age"))


def plain_text(spark, sf):
    return sql_input(spark, sf, PAGES_SQL).select("page_id", X.strip_inline(F.col("line")).alias("plain"))


def document_titles(spark, sf):
    d = sql_input(spark, sf, "SELECT m.doc_id, CASE WHEN m.doc_id % 3 = 0 THEN m.content ELSE d.text END AS content, d.source FROM fx_markdown m JOIN documents d ON d.doc_id = m.doc_id")
    return d.select("doc_id", X.document_title(F.col("content"), F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.col("source")), F.lit("Project")).alias("title"))


def file_languages(spark, sf):
    return fixture(spark, sf, "fx_source_files").select("file_id", X.language(F.col("file_name"), F.col("content")).alias("language"))


def capped_texts(spark, sf):
    d = sql_input(spark, sf, "SELECT doc_id, text FROM documents")
    return d.select("doc_id", X.capped(F.col("text"), 1200).alias("snippet"), X.capped(F.col("text"), 14000, "\n/* …truncated… */").alias("source"))


def repository_names(spark, sf):
    return sql_input(spark, sf, REPOS_SQL).select("id", X.repo_owner(F.col("full_name")).alias("owner"), X.repo_name(F.col("full_name")).alias("repo"))


QUERIES = {f.__name__: f for f in (
    source_file_types, source_file_scan, user_scan, manifest_scan, manifest_scan_errors, documentable_nodes, repository_page, repository_first_page, repository_search, packed_export, packed_documents, manifest_sources, snapshot_contents, manifest_upsert,
    manifest_rows, export_index, slug_collisions, document_slugs, mirrored_paths, short_digests, relative_times, plain_text,
    document_titles, file_languages, capped_texts, repository_names)}


def _slug(c: str) -> str:
    return f"coalesce(nullif(substr(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'document')"


def _mirror(c: str) -> str:
    p = rf"regexp_replace({c}, '^(src/)?app/(\(.*?\)/)*', '')"
    return rf"concat('docs/', regexp_replace(regexp_replace(regexp_replace({p}, '^(src/)?pages/', ''), '^src/', ''), '\.(tsx?|jsx?|mdx?)$', ''), '.md')"


ORACLES = {
    "source_file_types": "SELECT file_id, file_name, regexp_extract(file_name, '[^.]*$') AS file_type FROM fx_source_files",
    "source_file_scan": f"""
SELECT brand, 'txt' AS file_type, cast(strlen(t) AS bigint) AS n_bytes, sha256(t) AS content_sha
FROM (SELECT brand, string_agg(value || chr(10), '' ORDER BY file_id) AS t FROM ({SCANNED_FILES_SQL}) GROUP BY brand)""",
    "user_scan": f"""
SELECT CASE WHEN c_custkey % 7 = 0 THEN '—' ELSE cast(c_custkey AS varchar) END AS user_id, CASE WHEN c_custkey % 7 = 0 THEN '—' ELSE concat('u', c_custkey, '@example.com') END AS email,
  CASE WHEN c_custkey % 7 = 0 THEN substr({_USER_LINE}, 1, 30) ELSE '—' END AS malformed FROM customer""",
    "manifest_scan": """
SELECT concat('docs/', p_partkey, '.md') AS doc_path, p_size AS version, CASE WHEN p_partkey % 4 = 0 THEN '—' ELSE concat('src/', p_partkey, '.ts') END AS path,
  CASE WHEN p_partkey % 4 = 0 THEN '—' ELSE concat('a', p_size) END AS commit_sha
FROM part WHERE CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 3 <> 0 ELSE p_partkey % 20 <> 5 END""",
    "manifest_scan_errors": f"""
WITH l AS ({MANIFEST_LINES_SQL}), n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY entry) AS line_no FROM l)
SELECT cast(line_no AS int) AS line_no, value AS text FROM n WHERE part % 2 = 0 AND entry % 3 = 0
UNION ALL SELECT 0, regexp_replace(string_agg(value, chr(10) ORDER BY entry), '\\s+$', '') FROM l WHERE part = 5 GROUP BY part""",
    "documentable_nodes": r"SELECT path, type FROM fx_repo_tree WHERE type = 'dir' OR regexp_matches(path, '(?i)\.(jsx?|tsx?|mdx?)$')",
    "repository_page": f"""
SELECT id, full_name, has_more FROM (SELECT *, (count(*) OVER ()) = 4 AS has_more FROM (SELECT * FROM ({REPOS_SQL}) ORDER BY updated_at DESC, full_name LIMIT 4 OFFSET 4))
WHERE contains(lower(full_name), 'org')""",
    "repository_first_page": f"""
SELECT id, full_name, has_more FROM (SELECT *, (count(*) OVER ()) = 50 AS has_more FROM (SELECT * FROM ({REPOS_SQL}) ORDER BY updated_at DESC, full_name LIMIT 50))
WHERE contains(lower(full_name), '1/')""",
    "packed_export": f"SELECT doc_id, {_slug('title')} AS slug, sha256(coalesce(content, '')) AS content_sha FROM fx_documents",
    "packed_documents": "SELECT doc_id, length(coalesce(content, '')) AS n_chars, sha256(coalesce(content, '')) AS content_sha FROM fx_documents WHERE doc_id IN (SELECT c_custkey FROM customer)",
    "repository_search": f"SELECT id, full_name, false AS has_more FROM ({REPOS_SQL}) WHERE contains(lower(name), '1') OR contains(lower(coalesce(description, '')), '1')",
    "manifest_sources": """
SELECT p_partkey AS manifest_id, 0 AS entry_no, concat('docs/', lower(p_brand), '.md') AS doc_path, concat('src/', p_partkey, '.ts') AS path, concat('a', p_size) AS commit_sha, p_size AS version
FROM part WHERE p_partkey % 4 > 1
UNION ALL SELECT p_partkey, 1, 'docs/empty.md', '—', '—', 1 FROM part WHERE p_partkey % 4 > 1""",
    "snapshot_contents": "SELECT cast(doc_id AS varchar) AS blob_sha, sha256(text) AS content_sha FROM documents",
    "manifest_upsert": f"""
SELECT doc_path, version, entry_no, 0 AS part FROM ({OLD_ENTRIES_SQL}) WHERE doc_path NOT IN (SELECT doc_path FROM ({NEW_ENTRIES_SQL}))
UNION ALL SELECT doc_path, version, entry_no, 1 FROM ({NEW_ENTRIES_SQL})""",
    "manifest_rows": f"""
SELECT coalesce(nullif(trim(d.path_override), ''), {_mirror('d.source_path')}, concat('docs/', {_slug('d.title')}, '.md')) AS doc_path,
  coalesce(nullif(a.github_login, ''), nullif(a.email, ''), a.full_name) AS author_login, d.current_version AS version, cast(d.source_path IS NOT NULL AS int) AS n_sources
FROM (SELECT * FROM ({BOUND_DOCS_SQL})) d JOIN ({AUTHORS_SQL}) a ON a.user_id = d.user_id""".replace(_mirror('d.source_path'), f"CASE WHEN d.source_path IS NOT NULL THEN {_mirror('d.source_path')} END"),
    "export_index": f"""
SELECT d.doc_id, d.title, concat({_slug('d.title')}, '.md') AS file_name, d.current_version AS version, coalesce(left(n.c, 7), '—') AS commit,
  strftime(make_timestamp((d.doc_id * 86399 + 800000000) * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS date
FROM ({EXPORT_DOCS_SQL}) d LEFT JOIN (SELECT doc_id, arg_max(coalesce(commit_hash, '—'), version_no) AS c FROM ({COMMITS_SQL}) GROUP BY doc_id) n ON n.doc_id = d.doc_id""",
    "slug_collisions": f"""SELECT {_slug('title')} AS slug, count(*) AS documents FROM (SELECT concat('The ', p_name, CASE WHEN p_partkey % 2 = 0 THEN '!!' ELSE '' END) AS title FROM part) GROUP BY 1 HAVING count(*) > 1""",
    "document_slugs": f"SELECT doc_id, {_slug('title')} AS slug FROM fx_documents",
    "mirrored_paths": f"SELECT path, {_mirror('path')} AS doc_path FROM fx_repo_tree",
    "short_digests": f"SELECT doc_id, version_no, coalesce(left(commit_hash, 7), '—') AS commit, left(sha256(coalesce(commit_hash, '')), 12) AS digest FROM ({COMMITS_SQL})",
    "relative_times": f"""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 < 40 THEN timestamp '{AS_OF}' - to_seconds((o_orderkey % 97) * (o_orderkey % 97) * 60 + o_orderkey % 97) ELSE o_orderdate END AS ts FROM orders),
m AS (SELECT *, floor(epoch_ms(timestamp '{AS_OF}' - ts) / 60000.0 + 0.5) AS mi FROM (SELECT o_orderkey, ts FROM t)),
h AS (SELECT *, floor(mi / 60.0 + 0.5) AS hr FROM m), d AS (SELECT *, floor(hr / 24.0 + 0.5) AS da FROM h)
SELECT o_orderkey, CASE WHEN mi < 1 THEN 'just now' WHEN mi < 60 THEN concat(cast(mi AS bigint), 'm ago') WHEN hr < 24 THEN concat(cast(hr AS bigint), 'h ago')
  WHEN da < 30 THEN concat(cast(da AS bigint), 'd ago') ELSE strftime(ts, '%b %-d, %Y') END AS age FROM d""".replace(
        f"epoch_ms(timestamp '{AS_OF}' - ts)", f"(epoch_ms(timestamp '{AS_OF}') - epoch_ms(ts))"),
    "plain_text": rf"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '`([^`]+)`', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '</?sub>', '', 'g') AS plain FROM ({PAGES_SQL})""",
    "document_titles": r"""
SELECT m.doc_id, coalesce(nullif(trim(regexp_extract(CASE WHEN m.doc_id % 3 = 0 THEN m.content ELSE d.text END, '(?m)^#\s+(.+)', 1)), ''),
  nullif(trim(CASE WHEN m.doc_id % 2 = 0 THEN ' ' ELSE d.source END), ''), 'Project') AS title FROM fx_markdown m JOIN documents d ON d.doc_id = m.doc_id""",
    "file_languages": r"SELECT file_id, CASE WHEN regexp_matches(file_name, '\.tsx?$') OR regexp_matches(content, ':\s*\w|interface\s+\w|<[A-Z]\w*>') THEN 'typescript' ELSE 'javascript' END AS language FROM fx_source_files",
    "capped_texts": """SELECT doc_id, CASE WHEN length(text) > 1200 THEN concat(left(text, 1200), '…') ELSE text END AS snippet,
  CASE WHEN length(text) > 14000 THEN concat(left(text, 14000), chr(10), '/* …truncated… */') ELSE text END AS source FROM documents""",
    "repository_names": f"SELECT id, split_part(full_name, '/', 1) AS owner, split_part(full_name, '/', 2) AS repo FROM ({REPOS_SQL})",
}
