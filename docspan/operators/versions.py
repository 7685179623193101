"""The append-only version log: numbering, current state, timelines, rollback, stamps, patches and the hash chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspan.functions.text import version_source
from docspan.operators.rows import inlined
from docspan.operators.skew import HOT_ROWS, number_within


def number_versions(saves: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Dense version numbers per document in save order; ties are broken by event id."""
    return number_within(saves.withColumn("source", version_source(F.col("source"))), "doc_id",
                         [F.col("saved_at"), F.col("event_id")], "version_no", F.date_trunc("minute", "saved_at"), hot_rows)


def current_docs(versions: DataFrame) -> DataFrame:
    """Newest content and number per document; each task keeps one row per document before the exchange."""
    return (versions.groupBy("doc_id")
            .agg(F.max_by(F.struct("version_no", "content"), "version_no").alias("v"))
            .select("doc_id", F.col("v.version_no").alias("current_version"), F.col("v.content").alias("content")))


def timeline(versions: DataFrame) -> DataFrame:
    """Versions with author and external commit as nullable structs, and the commit before. Content is left out.

    Numbers are dense, so the version before is the one numbered one less: an equi-join on (document, number),
    whose keys are unique, instead of a window that would hold a document's whole log in one task."""
    before = versions.select(F.col("doc_id").alias("_doc"), (F.col("version_no") + 1).alias("_no"),
                             F.col("commit_hash").alias("previous_commit"))
    author = F.when(F.coalesce(F.col("author_login"), F.lit("")) != "",
                    F.struct(F.col("author_login").alias("login"), F.col("author_avatar_url").alias("avatar_url")))
    external = F.when(F.coalesce(F.col("external_commit_url"), F.lit("")) != "",
                      F.struct(F.col("external_commit_sha").alias("sha"), F.col("external_commit_url").alias("url")))
    return (versions.select("doc_id", "version_no", "commit_hash", "message", version_source(F.col("source")).alias("source"),
                            author.alias("author"), external.alias("external_commit"), "created_at")
            .join(before, (F.col("doc_id") == F.col("_doc")) & (F.col("version_no") == F.col("_no")), "left")
            .drop("_doc", "_no"))


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("doc_id"), F.col("version_no").desc())


def default_pairs(versions: DataFrame) -> DataFrame:
    """The two newest version numbers of documents with at least two. A collected top two would be one row per
    task and document as well, but two maxima keep the buffer fixed."""
    keys = versions.select("doc_id", "version_no")
    newest = keys.groupBy("doc_id").agg(F.max("version_no").alias("to_version"), F.min("version_no").alias("_first"))
    older = (keys.join(newest.filter("to_version > _first"), "doc_id")
             .filter("version_no < to_version").groupBy("doc_id", "to_version").agg(F.max("version_no").alias("from_version")))
    return older.select("doc_id", "from_version", "to_version")


def version_pairs(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """Both contents of requested (doc_id, from_version, to_version) pairs; ``error`` says what was wrong."""
    def side(name: str) -> DataFrame:
        return versions.select(F.col("doc_id"), F.col("version_no").alias(f"{name}_version"),
                               F.col("content").alias(f"{name}_content"), F.lit(True).alias(f"_{name}"))

    joined = (pairs.join(side("from"), ["doc_id", "from_version"], "left").join(side("to"), ["doc_id", "to_version"], "left"))
    unusable = (F.coalesce(F.col("from_version"), F.lit(0)) == 0) | (F.coalesce(F.col("to_version"), F.lit(0)) == 0)
    error = F.when(unusable, "bad_request").when(F.col("_from").isNull() | F.col("_to").isNull(), "not_found")
    return joined.select("doc_id", "from_version", "to_version", "from_content", "to_content", error.alias("error"))


def contributors(versions: DataFrame, shown: int = 5) -> DataFrame:
    """Distinct author logins per document, newest first: their number and the first few.

    Logins are reduced per (document, login) first; the first few come from a ranked filter, which Spark cuts
    to ``shown`` rows per task before the exchange."""
    logins = (versions.filter(F.coalesce(F.col("author_login"), F.lit("")) != "")
              .groupBy("doc_id", "author_login").agg(F.max("version_no").alias("newest")))
    totals = logins.groupBy("doc_id").agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("newest").desc(), "author_login"))
    first = (logins.withColumn("rank", rank).filter(F.col("rank") <= shown).groupBy("doc_id")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "author_login"))), lambda x: x["author_login"]).alias("first_logins")))
    return totals.join(first, "doc_id")


def apply_rollbacks(versions: DataFrame, rollbacks: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """New versions for (doc_id, version_no, event_id, at) requests, and the requests whose target is missing.

    History is never rewritten: each rollback appends the target's content under the next free number."""
    target = versions.select("doc_id", "version_no", F.col("content"), F.lit(True).alias("_hit"))
    asked = rollbacks.join(target, ["doc_id", "version_no"], "left")
    errors = asked.filter(F.col("_hit").isNull()).select("doc_id", "version_no", "event_id", F.lit("not_found").alias("error"))
    found = asked.filter(F.col("_hit")).drop("_hit")
    numbered = number_within(found, "doc_id", [F.col("at"), F.col("event_id")], "_nth", F.date_trunc("minute", "at"), hot_rows)
    last = versions.groupBy("doc_id").agg(F.max("version_no").alias("_last"))
    appended = numbered.join(last, "doc_id").select(
        "doc_id", (F.col("_last") + F.col("_nth")).cast("int").alias("version_no"), "content",
        F.concat(F.lit("Rolled back to v"), F.col("version_no").cast("string")).alias("message"),
        F.lit("rollback").alias("source"))
    return appended, errors


def stamp_published(versions: DataFrame, commits: DataFrame) -> DataFrame:
    """Set the external commit on the versions named by (doc_id, version_no, sha, url)."""
    stamped = versions.join(commits, ["doc_id", "version_no"], "left")
    return stamped.select(*[
        F.coalesce(F.col("sha"), F.col(c)).alias(c) if c == "external_commit_sha"
        else F.coalesce(F.col("url"), F.col(c)).alias(c) if c == "external_commit_url" else F.col(c)
        for c in versions.columns])


def apply_patches(table: DataFrame, patches: DataFrame, key: str, fields: list[str], order: tuple[str, str] = ("at", "seq")) -> DataFrame:
    """Last written value per field; NULL in a patch means "not written". ``updated_at`` moves to the last patch."""
    when = F.struct(*[F.col(c) for c in order])
    last = patches.groupBy(key).agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), when)).alias(f"_new_{f}") for f in fields],
        F.max(order[0]).alias("_at"))
    joined = table.join(last, key, "left")
    def value(c: str) -> Column:
        if c in fields:
            return F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c)
        if c == "updated_at":
            return F.greatest(F.col(c), F.col("_at")).alias(c)
        return F.col(c)
    return joined.select(*[value(c) for c in table.columns])


def default_project(users: DataFrame, projects: DataFrame) -> DataFrame:
    """Each user's oldest own project, or a new "My Documents" one."""
    oldest = projects.groupBy(F.col("owner_id").alias("user_id")).agg(
        F.min_by(F.struct("project_id", "project_name"), F.struct("created_at", "project_id")).alias("p"))
    return users.select("user_id").join(oldest, "user_id", "left").select(
        "user_id", F.col("p.project_id").alias("project_id"),
        F.coalesce(F.col("p.project_name"), F.lit("My Documents")).alias("project_name"), F.col("p").isNull().alias("is_new"))


# ---- hash chain ----------------------------------------------------------------------------------------

SEGMENT = 1000
LEVELS = 3


def entry_digest() -> Column:
    """Digest of one version: number, content and message, each delimited by its length."""
    def part(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.concat(F.length(text).cast("string"), F.lit(":"), text)

    return F.sha2(F.concat(part(F.col("version_no")), part(F.col("content")), part(F.col("message"))), 256)


def _linked(parent: Column, digest: Column) -> Column:
    return F.sha2(F.concat(parent, F.lit(">"), digest), 256)


def _chain(entries: DataFrame, segment: int, levels: int) -> DataFrame:
    """(doc_id, n, digest) with n = 0.. to (doc_id, n, chained).

    A segment of at most ``segment`` entries is folded inside one row. Segment ends form a shorter log, chained
    the same way; a later segment's entries are then linked to the chain value of the segment before. Any group
    therefore holds at most ``segment`` digests, however long a document's log is."""
    cut = F.floor(F.col("n") / F.lit(segment)) if levels > 1 else F.lit(0)
    folded = (
        entries.groupBy("doc_id", cut.cast("long").alias("seg"))
        .agg(F.array_sort(F.collect_list(F.struct("n", "digest"))).alias("es"))
        .withColumn("links", F.aggregate(
            "es", F.struct(F.lit("").alias("last"), F.expr("cast(array() as array<struct<n:bigint,local:string>>)").alias("out")),
            lambda acc, e: F.struct(
                _linked(acc["last"], e["digest"]).alias("last"),
                F.concat(acc["out"], F.array(F.struct(e["n"].cast("bigint").alias("n"), _linked(acc["last"], e["digest"]).alias("local")))).alias("out"))))
        .select("doc_id", "seg", F.col("links.last").alias("last"), F.col("links.out").alias("out"))
    )
    local = inlined(folded, ["doc_id", "seg"], "out")
    if levels == 1:
        return local.select("doc_id", "n", F.col("local").alias("chained"))
    anchors = _chain(folded.select("doc_id", F.col("seg").alias("n"), F.col("last").alias("digest")), segment, levels - 1)
    anchors = anchors.select("doc_id", (F.col("n") + 1).alias("seg"), F.col("chained").alias("anchor"))
    return local.join(anchors, ["doc_id", "seg"], "left").select(
        "doc_id", "n", F.when(F.col("anchor").isNull(), F.col("local")).otherwise(_linked(F.col("anchor"), F.col("local"))).alias("chained"))


def chain(versions: DataFrame, segment: int = SEGMENT, levels: int = LEVELS) -> DataFrame:
    """Commit id per version. A version's link is a SHA-256 over the link before it in its segment and its own digest; its
    id is a SHA-256 over the id of the segment before and that link, and ids of segments are made the same way. So every
    id depends on all versions before it, at every length of the log. ``segment`` and ``levels`` belong to the definition
    of an id: a log is checked with the ones it was written with. Only digests move; contents stay where they were read."""
    entries = versions.select("doc_id", (F.col("version_no") - 1).cast("bigint").alias("n"), entry_digest().alias("digest"))
    return _chain(entries, segment, levels).select("doc_id", (F.col("n") + 1).cast("int").alias("version_no"), F.col("chained").alias("commit_hash"))


def verify_chain(versions: DataFrame, segment: int = SEGMENT, levels: int = LEVELS) -> DataFrame:
    """First broken version per document, for stored logs with a ``commit_hash`` column."""
    again = chain(versions, segment, levels).withColumnRenamed("commit_hash", "_expected")
    return (versions.select("doc_id", "version_no", "commit_hash").join(again, ["doc_id", "version_no"], "left")
            .filter(~F.col("commit_hash").eqNullSafe(F.col("_expected")))
            .groupBy("doc_id").agg(F.min("version_no").alias("first_broken"), F.count("*").alias("broken")))
