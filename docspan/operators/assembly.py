"""Assembly of documents from notes and source files.

Every section is rendered inside the row it comes from; what is exchanged are finished section texts. A document
is put together in pieces of a fixed number of sections, so a document of very many files is several rows
whose concatenation by ``piece_no`` is the document, and no task holds an unbounded group."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.functions import render as R
from docspan.functions.notes import RULES, Rule
from docspan.functions.text import capped, collapse_blank, heading_title, http_date
from docspan.operators import code as C
from docspan.operators.markdown import completeness
from docspan.operators.notes import note_sections
from docspan.operators.storage import stored

GENERATOR = "docspan"
WIDTH = 1000
# Limits of the texts handed to an external generator, and the mark of a cut.
SOURCE_CAP = 14000
HEAD_SOURCE_CAP = 6000
CUT_MARK = "\n/* …truncated… */"
FILE_COMMENTS, HEAD_COMMENTS = 5, 3

TITLE, NOTES, CONFIG, REFERENCE, FILES, ERRORS, FOOTER = range(7)


def _rows(df: DataFrame, part: int, text: Column, ord1: Column | int = 0, ord2: Column | str = "") -> DataFrame:
    def col(x, kind):
        return (x if isinstance(x, Column) else F.lit(x)).cast(kind)

    return df.select("doc_id", F.lit(part).alias("part"), col(ord1, "bigint").alias("ord1"), col(ord2, "string").alias("ord2"), text.alias("text"))


def title_rows(docs: DataFrame, generated_at: Column) -> DataFrame:
    return _rows(docs, TITLE, R.section_text(R.lines(R.cat("# ", F.col("title")), "", R.cat(f"> Generated by {GENERATOR} · ", http_date(generated_at)))))


def note_rows(notes: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Note sections: code verbatim, other blocks as bullets. ``notes`` has doc_id and content."""
    sections = note_sections(notes.withColumnRenamed("doc_id", "note_id"), rules).withColumnRenamed("note_id", "doc_id")
    blocks = F.flatten(F.transform("blocks", lambda b: F.when(b["is_code"], R.lines(b["text"], "")).otherwise(R.lines(R.cat("- ", b["text"])))))
    return _rows(sections, NOTES, R.section_text(R.stack(R.lines(R.cat("## ", F.col("section_title")), ""), blocks)), F.col("section_order"))


def config_rows(facts: DataFrame) -> DataFrame:
    """The environment variables of a document's files, one row each, between a heading and an end; only where
    there are any."""
    names = C.elements(facts, ["doc_id"], F.col("env_vars"), "env_var").groupBy("doc_id", "env_var").agg(F.lit(1).alias("one"))
    having = names.select("doc_id").distinct()
    head = ("## Configuration\n\nThe following environment variables are read by this module:\n\n"
            "| Variable | Notes |\n| --- | --- |\n")
    return (_rows(having, CONFIG, F.lit(head), 0).unionByName(_rows(names, CONFIG, R.cat("| ", R.code(F.col("env_var")), " | |\n"), 1, F.col("env_var")))
            .unionByName(_rows(having, CONFIG, F.lit("\n"), 2)))


def reference_rows(sections: DataFrame) -> DataFrame:
    n = sections.groupBy("doc_id").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("functions", "classes", "interfaces")])
    return _rows(n, REFERENCE, R.cat(
        "## API Reference\n\nParsed **", F.col("files").cast("string"), "** file(s): ", F.col("functions").cast("string"), " function(s), ",
        F.col("classes").cast("string"), " class(es), ", F.col("interfaces").cast("string"), " interface/type(s).\n\n"))


def file_sections(facts: DataFrame) -> DataFrame:
    """One finished section per file with what the document-wide sections need, rendered in the file's row."""
    context_id = facts.sparkSession.sparkContext.applicationId
    return C.file_roles(facts).select("doc_id", "file_no", _file_text(context_id).alias("text"), "env_vars", *[
        F.size(c).alias(c) for c in ("functions", "classes", "interfaces")])


@lru_cache(maxsize=None)
def _file_text(context_id: str) -> Column:
    return R.file_text()


def file_rows(sections: DataFrame) -> DataFrame:
    return _rows(sections, FILES, F.col("text"), F.col("file_no"))


def error_rows(errors: DataFrame) -> DataFrame:
    errors = stored(errors.select("doc_id", "file_no", "file_name", "message"), "error-files")  # read three times, judged once
    having = errors.select("doc_id").distinct()
    line = R.cat("- ⚠ Could not parse ", R.code(F.col("file_name")), ": ", F.col("message"), "\n")
    return (_rows(having, ERRORS, F.lit("## Generation Notes\n\n"), -1).unionByName(_rows(errors, ERRORS, line, F.col("file_no")))
            .unionByName(_rows(having, ERRORS, F.lit("\n"), 1 << 40)))


def footer_rows(docs: DataFrame, generated_at: Column) -> DataFrame:
    meta = F.array_join(F.array_compact(F.array(
        R.cat("Generated ", http_date(generated_at)), R.cat("Source: ", R.code(F.col("source_repo"))),
        F.coalesce(R.cat("Commit: ", R.code(F.col("source_commit"))), F.lit("Commit: _pending first save_")))), " · ")
    return _rows(docs, FOOTER, R.cat("---\n\n<sub>", meta, "</sub>\n"))


def assemble(rows: DataFrame, last_piece: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """(doc_id, piece_no, content): sections joined in order, ``width`` at a time and then ``width`` of those.

    Documents of fewer than ``width`` squared files are one piece. ``last_piece`` (doc_id, last_piece) tells where the
    sections after the files go in longer ones. Groups are bounded in both steps."""
    files = F.col("part") == FILES
    own = F.when(files, F.floor(F.col("ord1") / F.lit(width * width))).otherwise(F.lit(0)).cast("int")
    if last_piece is not None:
        rows = rows.join(last_piece, "doc_id", "left")
        own = F.when(F.col("part") > FILES, F.coalesce("last_piece", F.lit(0))).otherwise(own)
    run = F.when(F.col("part") == CONFIG, F.col("ord1") * 1024 + F.ascii("ord2")).otherwise(F.floor(F.col("ord1") / F.lit(width))).cast("bigint")

    def joined(parts: str) -> Column:
        return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "")

    runs = (rows.groupBy("doc_id", own.alias("piece_no"), "part", run.alias("run"))
            .agg(F.collect_list(F.struct("ord1", "ord2", "text")).alias("parts")).withColumn("text", joined("parts")))
    return (runs.groupBy("doc_id", "piece_no").agg(F.collect_list(F.struct("part", "run", "text")).alias("parts"))
            .select("doc_id", "piece_no", collapse_blank(joined("parts")).alias("content")))


def compose(docs: DataFrame, notes: DataFrame, files: DataFrame, generated_at: Column, width: int = WIDTH) -> DataFrame:
    """Documents from docs (doc_id, title, source_repo, source_commit), notes (doc_id, content) and files
    (doc_id, file_no, file_id, file_name, content), where file_no is the file's position in its document. The
    rendered file sections are written once, since three document-wide sections draw on them too."""
    facts, errors = _keyed_facts(files)
    sections = stored(file_sections(facts), "file-sections")
    parts = [title_rows(docs, generated_at), note_rows(notes), config_rows(sections), reference_rows(sections), file_rows(sections),
             error_rows(errors), footer_rows(docs, generated_at)]
    rows = reduce(DataFrame.unionByName, parts)
    last = files.groupBy("doc_id").agg(F.floor(F.max("file_no") / F.lit(width * width)).cast("int").alias("last_piece")).filter("last_piece > 0")
    return assemble(rows, last, width)


def _keyed_facts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, errors), both with doc_id and file_no: the key travels inside file_id."""
    keyed = files.withColumn("file_id", F.struct("doc_id", "file_no", "file_id")).select("file_id", "file_name", "content")
    good, bad = C.quarantine(keyed)
    def key(df: DataFrame) -> DataFrame:
        return df.select(F.col("file_id.doc_id").alias("doc_id"), F.col("file_id.file_no").alias("file_no"), *df.columns)

    return key(C.code_facts(good)), key(bad)


# ---- hand-over to an external generator ----------------------------------------------------------------


def unit_payloads(roles: DataFrame) -> DataFrame:
    """One JSON record per file: role, signals, fact sheet, comments that say something, and the capped source."""
    no_tags = lambda f: f["tags"].isNotNull() | (F.size(f["notes"]) > 0)
    own = F.transform("functions", lambda f: F.struct(f["name"].alias("name"), f["tags"].alias("jsdoc"), f["notes"].alias("inline_comments")))
    said = F.transform(F.filter("functions", no_tags), lambda f: F.struct(f["name"].alias("name"), f["tags"].alias("jsdoc"), f["notes"].alias("inline_comments")))
    facts = F.struct("language", "directives", "exports", "imports", "env_vars", "functions", "classes", "interfaces", "hooks", "jsx_elements", "event_handlers")
    payload = F.struct(
        "file_name", R.role_label(F.col("role")).alias("role"), "signals", facts.alias("fact_sheet"),
        F.struct(F.slice("comments", 1, FILE_COMMENTS).alias("file_level"), said.alias("per_declaration")).alias("comments"),
        capped(F.col("content"), SOURCE_CAP, CUT_MARK).alias("source"))
    return roles.select("file_id", F.size(own).alias("unit_count"), F.to_json(payload).alias("payload"))


def declaration_summary(roles: DataFrame) -> DataFrame:
    """One JSON record per file for a document's head: declarations with their purpose."""
    fns = F.transform("functions", lambda f: F.struct(
        F.lit("function").alias("kind"), f["name"].alias("name"), f["exported"].alias("exported"), f["doc"].alias("purpose")))
    cls = F.transform("classes", lambda c: F.struct(F.lit("class").alias("kind"), c["name"].alias("name"), F.lit(None).cast("boolean").alias("exported"), c["doc"].alias("purpose")))
    faces = F.transform("interfaces", lambda i: F.struct(i["kind"].alias("kind"), i["name"].alias("name"), F.lit(None).cast("boolean").alias("exported"), i["doc"].alias("purpose")))
    record = F.struct("file_name", R.role_label(F.col("role")).alias("role"), F.slice("comments", 1, HEAD_COMMENTS).alias("file_comments"), "env_vars",
                      F.transform("imports", lambda i: i["source"]).alias("imports"), F.concat(fns, cls, faces).alias("declarations"),
                      capped(F.col("content"), HEAD_SOURCE_CAP, CUT_MARK).alias("source"))
    return roles.select("file_id", F.to_json(record).alias("summary"))


def merge_generated(heads: DataFrame, unit_texts: DataFrame, docs: DataFrame, units: DataFrame) -> DataFrame:
    """Documents from generated heads (doc_id, head) and unit texts (doc_id, unit_text); ``docs`` has doc_id and
    title, ``units`` the expected (doc_id, name). Either text may be missing; without both there is an error."""
    counted = completeness(units, unit_texts.withColumnRenamed("unit_text", "content")).select("doc_id", "warning")
    joined = docs.join(heads, "doc_id", "left").join(unit_texts, "doc_id", "left").join(counted, "doc_id", "left")
    head, body = F.col("head"), F.col("unit_text")
    text = F.concat(F.coalesce(R.missing(trim_all(head)), R.cat("# ", F.col("title"))), F.when(body.isNotNull(), F.concat(
        F.lit("\n\n---\n\n## API Reference\n\n"), trim_all(body), F.coalesce(R.cat("\n\n", F.col("warning")), F.lit("")))).otherwise(""))
    content = R.cat(F.regexp_replace(collapse_blank(text), r"\s+\z", ""), "\n")
    lost = head.isNull() & body.isNull()
    return joined.select("doc_id", F.when(~lost, content).alias("content"), F.when(~lost, F.coalesce(R.missing(heading_title(trim_all(head))), F.col("title"))).alias("derived_title"),
                         F.when(lost, "Both synthesis passes returned empty.").alias("error"))


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def choose_variant(docs: DataFrame) -> DataFrame:
    """Generated text where there is one, else the rule-based text, and the version message that goes with it."""
    generated = F.col("generated_text").isNotNull()
    return docs.select("doc_id", F.coalesce("generated_text", "rule_text").alias("content"), F.when(
        generated, "Regenerated from updated source (AI-enhanced)").otherwise("Regenerated from updated source").alias("message"))
