import json

from pyspark.sql import functions as F

from docspan.functions import text as X
from docspan.operators import validation as C
from docspan.sources import collections as S
from docspan.operators.storage import new_path
from docspan.sources import manifest as M


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def test_source_files_and_types(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.b.ts").write_text("one\ntwo")
    (tmp_path / "Makefile").write_text("all:")
    got = {r.file_name: (r.file_type, r.content) for r in S.read_source_files(spark, str(tmp_path)).collect()}
    assert got == {"a.b.ts": ("ts", "one\ntwo"), "Makefile": ("Makefile", "all:")}


def test_collections_read_declared_columns_only(spark, tmp_path):
    path = str(tmp_path / "users")
    spark.sql("SELECT 'u1' AS user_id, 'Ada' AS full_name, 'x' AS password_hash").write.parquet(path)
    df = S.load(spark, "users", path)
    assert "password_hash" not in df.columns and df.select("user_id", "email").collect()[0] == ("u1", None)


def test_manifest_round_trip_and_bad_input(spark, tmp_path):
    entry = {"doc_path": "docs/a.md", "sources": [{"repo_full_name": "o/r", "path": "a.ts", "branch": "main", "commit_sha": "s"}], "version": 2}
    (tmp_path / "m.json").write_text(json.dumps([entry, {**entry, "doc_path": "docs/b.md", "sources": []}]))
    (tmp_path / "bad.json").write_text("{\"doc_path\": 1}")
    rows = M.read_manifest(spark, str(tmp_path)).orderBy("doc_path").collect()
    assert [(r.doc_path, r.path, r.version) for r in rows] == [("docs/a.md", "a.ts", 2), ("docs/b.md", None, 2)]


def test_manifest_upsert_replaces_and_appends(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "doc_path string, version int, entry_no int")
    new = spark.createDataFrame([("a", 2, 0), ("c", 1, 1)], "doc_path string, version int, entry_no int")
    out = M.upsert_manifest(old, new)
    assert [(r.doc_path, r.version) for r in out.orderBy("part", "entry_no").collect()] == [("b", 1), ("a", 2), ("c", 1)]
    M.write_manifest(out, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_export_writes_one_file_per_document_even_when_slugs_collide(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hello, World", "a\nb"), (2, "hello world!", "c")], "doc_id int, title string, content string")
    out = str(tmp_path / "md")
    M.export_markdown(docs, out)
    got = {(r.slug, r.doc_id): r.value for r in spark.read.text(out, wholetext=True).select("slug", "doc_id", F.trim("value").alias("value")).collect()}
    assert {k: v.rstrip("\n") for k, v in got.items()} == {("hello-world", 1): "a\nb", ("hello-world", 2): "c"}


def test_text_expressions(spark):
    assert one(spark, X.slug(F.lit("  Été & co. "))) == "t-co" and one(spark, X.slug(F.lit("!!"))) == "document"
    assert one(spark, X.slug(F.lit("a" * 59 + " b"))) == "a" * 59 + "-"
    assert one(spark, X.mirrored_path(F.lit("src/app/(shop)/(x)/cart/page.tsx"))) == "docs/cart/page.md"
    assert one(spark, X.mirrored_path(F.lit("src/pages/a.jsx"))) == "docs/a.md"
    assert one(spark, X.strip_inline(F.lit("**b** `c` *i* <sub>s</sub>"))) == "b c i s"
    assert one(spark, X.document_title(F.lit("x\n#  Real \n"), F.lit("ext"), F.lit("p"))) == "Real"
    assert one(spark, X.document_title(F.lit("#no"), F.lit("  "), F.lit(""))) == "Untitled Documentation"
    assert one(spark, X.short_commit(F.lit(""))) == "—"
    at = F.lit("2024-01-10 00:00:00").cast("timestamp")
    for ts, want in (("2024-01-09 23:59:31", "just now"), ("2024-01-09 23:59:30", "1m ago"), ("2024-01-09 23:29:59", "30m ago"),
                     ("2024-01-09 23:00:20", "1h ago"), ("2024-01-08 12:20:00", "2d ago"), ("2023-12-01 00:00:00", "Dec 1, 2023")):
        assert one(spark, X.relative_time(F.lit(ts).cast("timestamp"), at)) == want, ts


def test_validation_keeps_the_first_message_per_field(spark):
    df = spark.createDataFrame([("", "d" * 1001), ("x" * 141, None), (" ok ", None)], "project_name string, description string")
    good, bad = C.validate(df, C.RULESETS["projects"])
    assert good.count() == 1
    assert [[(e.field, e.message) for e in r.errors] for r in bad.orderBy("project_name").collect()] == [
        [("project_name", "Project name is required"), ("description", "String must contain at most 1000 character(s)")],
        [("project_name", "String must contain at most 140 character(s)")]]


def test_written_manifest_is_read_again(spark, tmp_path):
    from docspan.sources.manifest import read_manifest, write_manifest

    source = "named_struct('repo', 'r', 'path', 'src/a.ts', 'commit_sha', 's', 'signature_hash', 'h')"
    entries = spark.sql(
        f"SELECT 'docs/' || id || '.md' AS doc_path, array({source}) AS sources, 'line\\nend' AS author_login, 'g' AS generator, 1 AS version, 0 AS part, id AS entry_no FROM range(3)"
    )
    write_manifest(entries, f"{tmp_path}/m")
    rows = read_manifest(spark, f"{tmp_path}/m", lines=True).select("doc_path", "path", "author_login").collect()
    assert sorted(map(tuple, rows)) == [(f"docs/{i}.md", "src/a.ts", "line\nend") for i in range(3)]


def test_packs_are_read_by_byte_ranges(spark):
    from docspan.sources import packed as P

    texts = ["# é\n🙂 one\n", "", None, "x" * 5000, "no end", "tab\tand\r\nreturn", "same", "same"]
    rows = [(i if i < 7 else 6, f"Title {i}", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, content string").repartition(3)
    for packs in (1, 3):
        path = new_path(spark, "packed")
        P.export_packed(docs, path, packs)
        got = sorted((r.doc_id, r.slug, r.content) for r in P.read_packed(spark, path).collect())
        assert got == sorted((i, f"title-{t[-1]}", c or "") for i, t, c in rows)
        assert P.read_document(spark, path, 0) == [texts[0]] and P.read_document(spark, path, 3) == [texts[3]]
        assert P.read_document(spark, path, 6) == ["same", "same"] and P.read_document(spark, path, 99) == []
        some = spark.createDataFrame([(4,), (4,), (77,)], "doc_id bigint")
        assert [tuple(r) for r in P.read_packed(spark, path, some).collect()] == [(4, "title-4", "no end")]
    path = new_path(spark, "packed")
    P.export_packed(docs.filter("false"), path)
    assert P.read_index(spark, path).count() == 0


def test_many_documents_of_one_pack_are_cut_from_small_pieces(spark, tmp_path):
    from pyspark.sql import functions as F

    from docspan.sources import packed as P

    rows = [(i // 2, f"T{i}", f"é{i}\n" * (i % 7)) for i in range(400)] + [(None, "T", "none"), (500, "T", "long" * 900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, content string").repartition(4)
    P.export_packed(docs, str(tmp_path / "p"), 1, piece_bytes=1000)
    index = P.read_index(spark, str(tmp_path / "p"))
    sizes = index.groupBy("piece").agg(F.sum(F.col("n_bytes") + 1 + P.ENTRY_BYTES).alias("n"), F.max("n_bytes").alias("most")).collect()
    assert len(sizes) > 30 and all(r.n <= 1000 + r.most + 1 + P.ENTRY_BYTES for r in sizes)
    got = P.read_packed(spark, str(tmp_path / "p"))
    assert sorted((r.doc_id or -1, r.slug, r.content) for r in got.collect()) == sorted((i or -1, t.lower(), c) for i, t, c in rows)
    # bytes and documents meet one row a piece, not one a document
    pieces = spark.read.format("binaryFile").load(str(tmp_path / "p" / "packs")).count()
    assert pieces == len(sizes)
    assert P.read_document(spark, str(tmp_path / "p"), 3) == [c for i, _, c in rows if i == 3]


def test_scans_of_broken_and_empty_files(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.json").write_text('{"user_id": "1", "email": "a@b.c"}\n{"user_id": "2", "ema\n\n[1]\n')
    (tmp_path / "u" / "empty.json").write_text("")
    (tmp_path / "u" / "other.txt").write_text('{"user_id": "9"}\n')
    rows = S.scan(spark, "users", str(tmp_path / "u"), "*.json").collect()
    assert sorted((r.user_id or "", r.malformed_record or "") for r in rows) == [("", '[1]'), ("", '{"user_id": "2", "ema'), ("1", "")]
    assert all(r.file_path.endswith("a.json") and r.file_size == 62 and r.file_changed_at for r in rows)
    assert {r.file_name: r.content for r in S.read_source_files(spark, str(tmp_path / "u"), "*.txt").collect()} == {"other.txt": '{"user_id": "9"}\n'}
    assert S.read_source_files(spark, str(tmp_path / "u"), "e*").count() == 0  # an empty file is no row


def test_manifests_of_both_forms_and_their_errors(spark, tmp_path):
    entry = json.dumps({"doc_path": "a.md", "sources": [], "version": 1})
    other = json.dumps({"doc_path": "b.md", "sources": [{"path": "x.ts"}], "version": 2})
    (tmp_path / "lines.json").write_text(f"{entry}\n\n{entry[:9]}\r\n{other}")
    (tmp_path / "array.json").write_text(f"  \n[{entry},\n{other}]")
    (tmp_path / "cut.json").write_text(f"[{entry}, ")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "object.json").write_text('{"doc_path": null}')
    rows = M.read_manifest(spark, str(tmp_path), glob="*.json").collect()
    assert sorted((r.file_path.split("/")[-1], r.entry_no, r.doc_path, r.path or "") for r in rows) == [
        ("array.json", 0, "a.md", ""), ("array.json", 1, "b.md", "x.ts"), ("lines.json", 0, "a.md", ""), ("lines.json", 3, "b.md", "x.ts")]
    bad = M.manifest_errors(spark, str(tmp_path), "*.json").collect()
    assert sorted((r.file_path.split("/")[-1], r.line_no, r.text) for r in bad) == [
        ("cut.json", 0, f"[{entry}, "), ("lines.json", 3, entry[:9]), ("object.json", 1, '{"doc_path": null}')]
