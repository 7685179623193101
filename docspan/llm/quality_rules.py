"""Quality rules with cross-document line frequency, as DataFrame operations only.

Within a document: word, symbol, repeated-line and repeated-word counts. Across documents: lines are normalised and hashed,
the different documents of one host that hold a line are counted, and lines held by more than ``limit`` of them are
removed. A document left with too small a share of its words is rejected.

With ``copies_once`` documents of one text count as one, and with ``spare_first`` the first document of a host keeps a frequent
line: a text that its host repeats is then not lost with its repetitions. Both are off unless asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.operators.storage import stored

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line held by more documents of its host than this is removed.
LIMIT = 10
#: A document left with less than this share of its words is rejected.
LEFT = 0.2
WINDOW = 3
#: The removed lines go to all tasks if they are no larger than this; else texts and removed lines meet in an exchange.
SENT_BYTES = 32 << 20


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also where lambdas inside use it many times."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the array. Windows are compared by 64-bit hashes
    of their words; only documents with equal hashes go on to the positions, which are sorted by hash, cut to those with an
    equal neighbour, and sorted back."""
    n = F.size(found)

    def covered(hashes: Column) -> Column:
        sorted_places = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            last = F.size(p)
            same = F.filter(
                F.transform(p, lambda x, k: F.when(
                    ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k < last - 1) & (F.get(p, k + 1)["h"] == x["h"])), x["i"]
                )),
                lambda i: i.isNotNull(),
            )
            return F.sort_array(same)

        def total(at: Column) -> Column:
            return F.aggregate(
                at, F.struct(F.lit(0).alias("sum"), F.lit(-window).alias("before")),
                lambda s, i: F.struct((s["sum"] + F.least(i - s["before"], F.lit(window))).alias("sum"), i.alias("before")),
            )["sum"]

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bound(bound(sorted_places, places), total))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))

    return F.when(n <= window, 0).otherwise(bound(found, lambda w: bound(windows(w), covered)))


def _lines(text: Column) -> Column:
    """The non-blank lines as (at, line, hash of the normalised line)."""
    split = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    return F.filter(split, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), BLANKS, " "), "[0-9]", "0"))


def base_measures(text: Column) -> dict[str, Column]:
    """Columns of one text; a null text has no words, symbols or lines."""
    whole = F.coalesce(text, F.lit(""))
    found = words(whole)
    filled = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bound(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(found).cast("long"),
    }


def line_rows(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, text_hash, at, line_hash, n_words of every non-blank line."""
    rows = docs.select(
        "doc_id", F.col(host).alias("host"), F.xxhash64("text").alias("text_hash"), F.explode_outer(_lines(F.col("text"))).alias("x")
    ).filter("x IS NOT NULL")
    return rows.select(
        "doc_id", "host", "text_hash", F.col("x.at").alias("at"), F.xxhash64(normalised(F.col("x.line"))).alias("line_hash"),
        F.size(words(F.col("x.line"))).alias("n_words"),
    )


def frequent_lines(rows: DataFrame, limit: int = LIMIT, copies_once: bool = False) -> DataFrame:
    """host, line_hash and first_doc of lines held by more than ``limit`` documents of a host. Counts are combined before each
    exchange, so a line that most documents hold is a few rows per task."""
    holders = rows.groupBy("host", "line_hash", "text_hash" if copies_once else "doc_id").agg(F.min("doc_id").alias("first_of_them"))
    return (
        holders.groupBy("host", "line_hash").agg(F.count("*").alias("n_docs"), F.min("first_of_them").alias("first_doc"))
        .filter(F.col("n_docs") > limit)
    )


def removed_lines(docs: DataFrame, host: str = "source", limit: int = LIMIT, copies_once: bool = False, spare_first: bool = False) -> DataFrame:
    """doc_id, host_hash, text_hash and the removed lines as sorted ``lines`` and their ``removed_words``; only documents that
    lose a line. The frequent lines are written first: Spark then knows their size and sends them to all tasks only if
    they are small. Equal rows are one here."""
    rows = line_rows(docs, host)
    frequent = stored(frequent_lines(rows, limit, copies_once), "frequent-lines").select(F.col("host").alias("_h"), F.col("line_hash").alias("_l"), "first_doc")
    hits = rows.join(frequent, F.col("host").eqNullSafe(F.col("_h")) & (F.col("line_hash") == F.col("_l")))
    losing = hits.filter(~F.col("doc_id").eqNullSafe(F.col("first_doc"))) if spare_first else hits
    once = losing.groupBy("doc_id", F.xxhash64("host").alias("host_hash"), "text_hash", "at").agg(F.max("n_words").alias("n_words"))
    return once.groupBy("doc_id", "host_hash", "text_hash").agg(F.sort_array(F.collect_list("at")).alias("lines"), F.sum("n_words").alias("removed_words"))


def _sent(removed: DataFrame) -> DataFrame:
    size = removed.agg(F.coalesce(F.sum(F.size("lines") * 4 + 64), F.lit(0)).alias("bytes")).first().bytes
    return F.broadcast(removed) if size <= SENT_BYTES else removed


def without_lines(text: Column, lines: Column) -> Column:
    """The text without the lines whose sorted numbers (from 0) are in ``lines``: every kept run of lines between two removed ones
    is one slice."""
    def kept(every: Column) -> Column:
        stops = F.concat(lines, F.array(F.size(every)))
        starts = F.concat(F.array(F.lit(0)), F.transform(lines, lambda i: i + 1))
        runs = F.zip_with(starts, stops, lambda a, b: F.slice(every, a + 1, b - a))
        return F.array_join(F.flatten(runs), "\n")

    return bound(F.split(text, "\n"), kept)


def quality_rules(
    docs: DataFrame, host: str = "source", limit: int = LIMIT, left: float = LEFT, min_words: int = 50, repeat_percent: int = 50, carry: tuple[str, ...] = (),
    copies_once: bool = False, spare_first: bool = False,
) -> DataFrame:
    """doc_id, the five counts, removed_words, base_failed and kept of every row of ``docs`` (doc_id, text and the host).

    A null text has no words and fails; so does an empty one. A null host is a host of its own. Repeated rows give repeated
    results and are one document. All documents with a null id count as one, and none is the first of a frequent line. Columns
    named in ``carry`` are kept as they are, but ``text`` without its removed lines; other columns are not read."""
    extra = [c for c in carry if c not in ("doc_id", "text")]
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(host).alias("_host"), *(F.col(c).alias(f"_carry_{c}") for c in extra))
    removed = stored(removed_lines(plain, "_host", limit, copies_once, spare_first), "removed-lines").select(
        F.col("doc_id").alias("_d"), F.col("host_hash").alias("_h"), F.col("text_hash").alias("_t"), "lines", "removed_words"
    )
    measured = plain.select("doc_id", F.xxhash64("_host").alias("_host"), F.xxhash64("text").alias("_hash"), *([F.col("text")] if "text" in carry else []), *(f"_carry_{c}" for c in extra), *(c.alias(n) for n, c in base_measures(F.col("text")).items()))
    joined = measured.join(
        _sent(removed), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_host") == F.col("_h")) & (F.col("_hash") == F.col("_t")), "left"
    )
    lost = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    whole = ~failed & (F.col("n_words") - lost >= left * F.col("n_words"))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    cleaned = [F.when(F.col("lines").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("lines"))).alias("text")] if "text" in carry else []
    cleaned += [F.col(f"_carry_{c}").alias(c) for c in extra]
    return joined.select(*out, lost.alias("removed_words"), failed.alias("base_failed"), whole.alias("kept"), *cleaned)
