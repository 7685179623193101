"""Roles, access, identities, memberships and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.functions.text import truthy
from docspan.operators.skew import HOT_ROWS, salted_join

ROLES = ["owner", "editor"]


def flat_members(projects: DataFrame) -> DataFrame:
    """(project_id, user_id, login, role) from the nested member lists."""
    return projects.select("project_id", F.explode("members").alias("m")).select("project_id", "m.user_id", "m.login", "m.role")


def effective_roles(projects: DataFrame, members: DataFrame) -> DataFrame:
    """One role per (project, user): the project's owner is owner, others have the role they were given."""
    claims = projects.select("project_id", F.col("owner_id").alias("user_id"), F.lit("owner").alias("role"), F.lit(0).alias("rank")).unionByName(
        members.select("project_id", "user_id", "role", F.lit(1).alias("rank")))
    return claims.filter(F.col("user_id").isNotNull()).groupBy("project_id", "user_id").agg(F.min_by("role", F.struct("rank", "role")).alias("role"))


def accessible_projects(projects: DataFrame, roles: DataFrame, user_id) -> DataFrame:
    mine = roles.filter(F.col("user_id") == F.lit(user_id)).select("project_id", "role")
    return projects.join(mine, "project_id")


def accessible_docs(docs: DataFrame, projects: DataFrame, roles: DataFrame, user_id) -> DataFrame:
    """Documents of the projects a user owns or belongs to, newest first, with the project's name."""
    mine = roles.filter(F.col("user_id") == F.lit(user_id))
    names = projects.select("project_id", "project_name")
    return (docs.join(mine, "project_id", "left_semi").join(names, "project_id", "left")
            .withColumn("project_name", F.coalesce("project_name", F.lit("—")))
            .orderBy(F.col("updated_at").desc(), "doc_id"))


def audit_access(requests: DataFrame, docs: DataFrame, roles: DataFrame) -> DataFrame:
    """Outcome of each (user_id, doc_id, owner_only) request. A missing document is not found; any project role,
    or being the document's own user, opens it; owner-only actions need the owner role."""
    known = docs.select("doc_id", "project_id", F.col("user_id").alias("_doc_user"))
    asked = requests.join(known, "doc_id", "left").join(roles, ["project_id", "user_id"], "left")
    allowed = F.when(F.col("owner_only"), F.col("role") == "owner").otherwise(F.col("role").isNotNull() | (F.col("_doc_user") == F.col("user_id")))
    outcome = F.when(F.col("project_id").isNull(), "not_found").when(F.coalesce(allowed, F.lit(False)), "ok").otherwise("forbidden")
    return asked.select(*requests.columns, outcome.alias("outcome"))


def resolve_identities(profiles: DataFrame, users: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """User behind each outside profile: by profile id, else by e-mail, else a new account. Profiles without an id or an address
    stay where they are; ids and addresses that very many share are joined in slices."""
    by_id = users.filter(F.col("github_id").isNotNull()).groupBy("github_id").agg(F.min("user_id").alias("_by_id"))
    by_email = users.filter(truthy(F.col("email")).isNotNull()).groupBy(F.lower("email").alias("_email")).agg(F.min("user_id").alias("_by_email"))
    rows, keyed = profiles.count(), profiles.withColumn("_email", F.lower(truthy(F.col("email"))))
    joined = salted_join(salted_join(keyed, by_id, ["github_id"], "left", hot_rows, rows), by_email, ["_email"], "left", hot_rows, rows)
    user = F.coalesce("_by_id", "_by_email")
    action = F.when(F.col("_by_id").isNotNull(), "found-by-github-id").when(F.col("_by_email").isNotNull(), "found-by-email").otherwise("created")
    email = F.lower(F.coalesce("email", F.concat("login", F.lit("@users.noreply.github.com"))))
    return joined.select("github_id", "login", user.alias("user_id"), action.alias("action"),
                         F.when(user.isNull(), email).alias("new_email"))


def resolve_invites(invites: DataFrame, users: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Members for (project_id, identifier) invitations and the invitations nobody matches. A login is matched
    without case; an e-mail address is tried only for identifiers with an @ sign. Identifiers that very many invitations share
    are joined in slices, and those without an address stay where they are."""
    by_login = users.filter(truthy(F.col("github_login")).isNotNull()).groupBy(F.lower("github_login").alias("_login")).agg(
        F.min_by(F.struct("user_id", "github_login", "email"), "user_id").alias("_l"))
    by_email = users.filter(F.col("email").isNotNull()).groupBy(F.col("email").alias("_email")).agg(
        F.min_by(F.struct("user_id", "github_login", "email"), "user_id").alias("_e"))
    as_email = F.when(F.contains("identifier", F.lit("@")), F.lower("identifier"))
    rows, keyed = invites.count(), invites.withColumns({"_email": as_email, "_login": F.lower("identifier")})
    joined = salted_join(salted_join(keyed, by_login, ["_login"], "left", hot_rows, rows), by_email, ["_email"], "left", hot_rows, rows)
    joined = joined.withColumn("_u", F.coalesce("_l", "_e"))
    members = joined.filter(F.col("_u").isNotNull()).select(
        "project_id", "identifier", F.col("_u.user_id").alias("user_id"), F.coalesce("_u.github_login", "_u.email").alias("login"), F.lit("editor").alias("role"))
    return members, joined.filter(F.col("_u").isNull()).select("project_id", "identifier", F.lit("not_found").alias("error"))


def resolve_branches(requests: DataFrame, refs: DataFrame, repos: DataFrame) -> DataFrame:
    """The requested branch where the repository has it, else the repository's default branch."""
    have = refs.select("repo_full_name", "branch", F.lit(True).alias("_has")).distinct()
    defaults = repos.select(F.col("full_name").alias("repo_full_name"), "default_branch")
    return (requests.join(have, ["repo_full_name", "branch"], "left").join(defaults, "repo_full_name", "left")
            .select(*[c for c in requests.columns], F.when(F.col("_has"), F.col("branch")).otherwise(F.col("default_branch")).alias("resolved_branch"),
                    F.coalesce(~F.col("_has"), F.lit(True)).alias("fell_back")))


def apply_membership(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Members after (project_id, user_id, login, action add|remove, at, seq) changes. Adding replaces a user's
    entry by an editor's; removing does nothing to an owner."""
    last = changes.groupBy("project_id", "user_id").agg(
        F.max_by(F.struct("action", "login"), F.struct("at", "seq")).alias("c"), F.max(F.col("action") == "add").alias("ever_added"))
    both = members.withColumn("_member", F.lit(True)).join(last, ["project_id", "user_id"], "full")
    added = F.col("c.action") == "add"
    stays_owner = (F.col("role") == "owner") & ~F.col("ever_added")
    keep = F.col("c").isNull() | added | (F.col("_member") & stays_owner)
    return both.filter(F.coalesce(keep, F.lit(False))).select(
        "project_id", "user_id", F.when(added, F.col("c.login")).otherwise(F.col("login")).alias("login"),
        F.when(added, "editor").otherwise(F.col("role")).alias("role"))


# ---- summaries -----------------------------------------------------------------------------------------


def project_summary(projects: DataFrame, members: DataFrame, docs: DataFrame, roles: DataFrame) -> DataFrame:
    """One row per (user, accessible project): document and member counts, the user's role, and when the project was last
    changed, newest first. Counts are made once per project, not once per user."""
    doc_counts = docs.groupBy("project_id").agg(F.count("*").alias("doc_count"))
    member_counts = members.groupBy("project_id").agg(F.count("*").alias("member_count"))
    per_project = projects.join(doc_counts, "project_id", "left").join(member_counts, "project_id", "left").select(
        "project_id", "project_name", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.coalesce("member_count", F.lit(0)).alias("member_count"), "updated_at")
    listed = roles.join(per_project, "project_id").select("user_id", "project_id", "project_name", "doc_count", "member_count", "role", "updated_at")
    return listed.orderBy("user_id", F.col("updated_at").desc(), "project_id")


def feedback_summary(feedback: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count and mean rating to two decimals, zero when there is none."""
    return feedback.groupBy(*(by or [])).agg(F.count("*").alias("count"), F.coalesce(F.round(F.avg("rating"), 2), F.lit(0.0)).alias("average"))


def delete_impact(gone: DataFrame, docs: DataFrame, versions: DataFrame, notes: DataFrame, files: DataFrame) -> DataFrame:
    """Rows that go with each project in ``gone`` (project_id). Versions are counted per document first, so a
    document's log crosses the exchange as one number per task."""
    kept = docs.join(gone, "project_id", "left_semi").select("project_id", "doc_id")
    per_doc = versions.groupBy("doc_id").agg(F.count("*").alias("n"))
    by_docs = kept.join(per_doc, "doc_id", "left").groupBy("project_id").agg(
        F.count("*").alias("documents"), F.sum(F.coalesce("n", F.lit(0))).alias("versions"))

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.join(gone, "project_id", "left_semi").groupBy("project_id").agg(F.count("*").alias(name))

    out = gone.select("project_id").distinct().join(by_docs, "project_id", "left").join(tally(notes, "notes"), "project_id", "left").join(
        tally(files, "source_files"), "project_id", "left")
    return out.select("project_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "versions", "notes", "source_files")])


def deleted_docs(gone: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids of the documents that go: rows, since one project may hold very many."""
    return docs.join(gone, "project_id", "left_semi").select("project_id", "doc_id")


def account_removal(leavers: DataFrame, projects: DataFrame, roles: DataFrame) -> DataFrame:
    """What happens to each project of the users leaving: own projects are deleted, others lose the member."""
    return (roles.join(leavers.select("user_id"), "user_id", "left_semi")
            .join(projects.select("project_id", "owner_id"), "project_id")
            .select("user_id", "project_id", F.when(F.col("owner_id") == F.col("user_id"), "delete_project").otherwise("remove_member").alias("action")))


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def search_titles(docs: DataFrame, query: str, column: str = "title") -> DataFrame:
    return docs.filter(F.contains(F.lower(F.col(column)), F.lit(query.lower())))


def stage(files: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First staged file per key."""
    rest = [c for c in files.columns if c != key]
    return files.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("f")).select(key, "f.*")


# ---- repository tree -----------------------------------------------------------------------------------


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def tree_index(tree: DataFrame) -> DataFrame:
    """Every node with its parent directory (NULL at the root) and depth: the number of directory rows directly
    above it without a gap. Works on distinct parent paths, so a crowded directory is looked up once."""
    nodes = tree.select("path", "type", parent_of(F.col("path")).alias("_parent"))
    dirs = tree.filter("type = 'dir'").select(F.col("path").alias("dir")).distinct()
    parents = nodes.select(F.col("_parent").alias("parent")).filter("parent <> ''").distinct()
    steps = parents.withColumn("parts", F.split("parent", "/")).select(
        "parent", F.size("parts").alias("k"), F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("pos", "prefix"))
    checked = steps.join(dirs, F.col("prefix") == F.col("dir"), "left")
    depth = checked.groupBy("parent", "k").agg(F.max(F.when(F.col("dir").isNull(), F.col("pos") + 1)).alias("gap")).select(
        "parent", (F.col("k") - F.coalesce("gap", F.lit(0))).alias("depth"))
    return nodes.join(depth, F.col("_parent") == F.col("parent"), "left").select(
        "path", "type", F.when(F.col("depth") > 0, F.col("_parent")).alias("parent_path"), F.coalesce("depth", F.lit(0)).alias("depth"))


def tree_order(index: DataFrame) -> DataFrame:
    """Directories first, then by path."""
    return index.orderBy(F.col("type") != "dir", "path")
