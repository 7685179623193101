"""Text and label expressions: slugs, paths, titles, digests, relative times, labels.

Patterns follow JavaScript's idea of white space and word boundaries, because the results have to
equal those of a JavaScript program: Java's ``\\s`` misses the no-break space and its ``\\b`` treats
accented letters as word characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters JavaScript's \s and trim() treat as white space, and the same without line ends.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WS_INLINE = r"[\t\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

WORD_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# Labels shown for drift states, roles and the default version source.
DRIFT_HEADLINES = {
    "current": "Documentation is current.",
    "implementation_changed": "Source updated — API surface unchanged.",
    "signature_changed": "API surface changed — documentation may be wrong.",
}
DRIFT_TONES = {"current": "add", "implementation_changed": "amber", "signature_changed": "remove"}
ROLE_LABELS = {
    "next-error-boundary": "Next.js Error Boundary",
    "next-page": "Next.js Page",
    "next-layout": "Next.js Layout",
    "next-route-handler": "Next.js Route Handler",
    "api-endpoint": "API Endpoint",
    "react-component": "React Component",
    "react-hook": "React Hook",
    "util": "Utility Module",
    "types": "Type Definitions",
    "module": "Module",
}
VERSION_SOURCES = ["generate", "edit", "rollback", "regenerate"]


def ascii_edges(pattern: str) -> str:
    """A JavaScript pattern for Java: ASCII word edges and JavaScript white space."""
    return pattern.replace(r"\b", WORD_EDGE).replace(r"\s", WS)


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def truthy(c: Column) -> Column:
    """NULL for the empty string, so that ``coalesce`` can pick a fallback."""
    return F.nullif(c, F.lit(""))


def lines_of(c: Column) -> Column:
    """The lines of a text; a NULL text is one empty line."""
    return F.split(F.coalesce(c, F.lit("")), "\n", -1)


def slug(title: Column) -> Column:
    dashed = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    return F.coalesce(truthy(F.substring(F.regexp_replace(dashed, r"\A-+|-+\z", ""), 1, 60)), F.lit("document"))


def mirrored_path(source_path: Column) -> Column:
    """Where the document for a source file lives: its path under docs/, without router folders."""
    p = F.regexp_replace(source_path, r"\A(src/)?app/(\(.*?\)/)*", "")
    p = F.regexp_replace(p, r"\A(src/)?pages/", "")
    p = F.regexp_replace(p, r"\Asrc/", "")
    return F.concat(F.lit("docs/"), F.regexp_replace(p, r"\.(tsx?|jsx?|mdx?)\z", ""), F.lit(".md"))


def document_path(override: Column, first_source_path: Column, title: Column) -> Column:
    return F.coalesce(
        truthy(js_trim(override)),
        mirrored_path(truthy(first_source_path)),
        F.concat(F.lit("docs/"), slug(title), F.lit(".md")),
    )


def short_commit(commit_hash: Column) -> Column:
    return F.coalesce(F.left(truthy(commit_hash), F.lit(7)), F.lit("—"))


def short_digest(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(12))


def relative_time(ts: Column, as_of: Column) -> Column:
    """Age bucket of ``ts`` at ``as_of``; each unit is rounded half up from the previous rounded unit."""

    def half_up(x: Column) -> Column:
        return F.floor(x + F.lit(0.5))

    ms = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(1000))
    minutes = half_up(ms / F.lit(60000))
    hours = half_up(minutes / F.lit(60))
    days = half_up(hours / F.lit(24))
    return (
        F.when(ts.isNull(), "")
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "MMM d, yyyy"))
    )


def strip_inline(text: Column) -> Column:
    """Plain text of one Markdown line: code, bold and italic marks and <sub> tags removed, in that order."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, "`([^`]+)`", "$1")
    t = F.regexp_replace(t, r"\*\*([^*]+)\*\*", "$1")
    t = F.regexp_replace(t, r"\*([^*]+)\*", "$1")
    return F.regexp_replace(t, "</?sub>", "")


def heading_title(markdown: Column) -> Column:
    """Text of the first ``# …`` line, NULL when there is none."""
    return js_trim(truthy(F.regexp_extract(markdown, r"(?:\A|(?<=[\n\r\x{2028}\x{2029}]))#" + WS + r"+([^\n\r\x{2028}\x{2029}]+)", 1)))


def document_title(markdown: Column, external: Column, project_name: Column) -> Column:
    return F.coalesce(
        truthy(heading_title(markdown)),
        truthy(js_trim(external)),
        truthy(project_name),
        F.lit("Untitled Documentation"),
    )


def language(file_name: Column, code: Column) -> Column:
    typed = file_name.rlike(r"\.tsx?\z") | code.rlike(rf":{WS}*[A-Za-z0-9_]|interface{WS}+[A-Za-z0-9_]|<[A-Z][A-Za-z0-9_]*>")
    return F.when(typed, "typescript").otherwise("javascript")


def capped(text: Column, limit: int, marker: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def author_name(github_login: Column, email: Column, full_name: Column) -> Column:
    return F.coalesce(truthy(github_login), truthy(email), full_name)


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    """A fixed label table as a literal map: no join."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def drift_headline(state: Column) -> Column:
    return lookup(DRIFT_HEADLINES, state)


def drift_tone(state: Column) -> Column:
    return lookup(DRIFT_TONES, state)


def role_label(role: Column) -> Column:
    return lookup(ROLE_LABELS, role, "Module")


def version_source(source: Column) -> Column:
    return F.coalesce(source, F.lit("edit"))


def repo_owner(full_name: Column) -> Column:
    return F.split_part(full_name, F.lit("/"), F.lit(1))


def repo_name(full_name: Column) -> Column:
    return F.split_part(full_name, F.lit("/"), F.lit(2))


def http_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def collapse_blank(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")
