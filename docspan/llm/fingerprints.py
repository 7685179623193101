"""Document fingerprints by consistent weighted sampling, as DataFrame operations only.

A text is its words with their counts as weights. For each of k samples every word gets two gamma variates and a uniform one
from hashes of the word and the sample's number; the word with the smallest variate, with its quantised weight, is the
sample. Two texts agree in a sample with the probability of their generalised Jaccard similarity
(sum of smaller counts over sum of larger ones), so the share of equal samples estimates it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspan.llm.quality_rules import BLANKS, bound

SAMPLES = 32
#: What the fingerprint of a text without words is.
EMPTY = "empty"
_LOW = 0xFFFFFFFF


def weighted_terms(text: Column) -> Column:
    """Array of (term, weight): 64-bit hashes of the words of a text, sorted, with the number of times each occurs."""
    hashes = F.transform(F.filter(F.split(text, BLANKS), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i)))
        return bound(ends, lambda e: F.transform(e, lambda end, k: F.struct(
            F.get(s, end - 1).alias("term"), (end - F.when(k == 0, 0).otherwise(F.get(e, k - 1))).alias("weight")
        )))

    return bound(F.sort_array(hashes), lambda s: F.when(F.size(s) > 0, runs(s)))


def sample(term: Column, log_weight: Column, number: int) -> Column:
    """One sample's variate and choice as a long whose order is that of the variate: its quantised logarithm in the high half,
    a hash of the word and its quantised weight in the low half. Nothing here is conditional, as Spark shares the hashes and
    logarithms that occur several times only where they are always needed; a null term gives a number of no meaning."""
    first = F.xxhash64(term, F.lit(number))
    second = F.xxhash64(first)
    unit = lambda bits, size: (bits.cast("double") + 0.5) / float(1 << size)
    u = [
        unit(first.bitwiseAND(F.lit(_LOW)), 32), unit(F.shiftrightunsigned(first, 32), 32),
        unit(second.bitwiseAND(F.lit((1 << 21) - 1)), 21), unit(F.shiftrightunsigned(second, 21).bitwiseAND(F.lit((1 << 21) - 1)), 21),
        unit(F.shiftrightunsigned(second, 42), 22),
    ]
    r = -F.ln(u[0] * u[1])  # Gamma(2, 1)
    log_c = F.ln(-F.ln(u[2] * u[3]))  # logarithm of a second Gamma(2, 1)
    step = F.floor(log_weight / r + u[4])
    log_a = log_c - r * (step - u[4] + 1)
    order = F.least(F.greatest(F.floor((log_a + 400.0) * float(1 << 21)), F.lit(0)), F.lit((1 << 31) - 1))
    return F.shiftleft(order, 32).bitwiseOR(F.xxhash64(term, step).bitwiseAND(F.lit(_LOW)))


def with_samples(df: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``sample_0`` ... (32-bit numbers; null for a text without words), one row per row of ``df``. Rows must
    differ in ``keys``. If ``df`` is partitioned by some of them, nothing is exchanged; only aggregates of a text's words leave
    its row, so memory is bounded by one text."""
    terms = df.select(*keys, F.inline_outer(weighted_terms(F.col(text)))).select(*keys, "term", F.ln("weight").alias("log_weight"))
    least = terms.groupBy(*keys).agg(
        F.count("term").alias("n_terms"), *(F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"sample_{k}") for k in range(samples)))
    return least.select(*keys, *(F.when(F.col("n_terms") > 0, F.col(f"sample_{k}").bitwiseAND(F.lit(_LOW))).alias(f"sample_{k}") for k in range(samples)))


def fingerprint_text(samples: int = SAMPLES) -> Column:
    """Eight hexadecimal digits per sample; a fixed word for a text without words."""
    digits = F.concat(*(F.lpad(F.lower(F.hex(f"sample_{k}")), 8, "0") for k in range(samples)))
    return F.when(F.col("sample_0").isNull(), EMPTY).otherwise(digits)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; 1 for two texts without words, 0 if one has none."""
    equal = reduce(lambda x, y: x + y, ((F.substring(a, 1 + 8 * k, 8) == F.substring(b, 1 + 8 * k, 8)).cast("int") for k in range(samples)))
    return F.when((a == EMPTY) | (b == EMPTY), (a == b).cast("double")).otherwise(equal / float(samples))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text): equal texts have equal ones. A null text counts as
    empty. Repeated rows give repeated results; other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return with_samples(rows, ["row", "doc_id"], "text", samples).select("doc_id", fingerprint_text(samples).alias("fingerprint"))


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of (doc_id, text) dealt into ranges of doc_id: part, heir, doc_id, text.

    ``heir`` rows repeat the first row of the range that follows in descending order (after the last: of the first range), so
    that a window over a range sees the row after its last. The bounds and the heads of the ranges, at most ``parts`` numbers
    each, are all that the driver learns. Null ids come last."""
    steps = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx("doc_id", F.lit(steps), F.lit(max(10_000, 20 * parts))).alias("b")).first().b if steps else []
    bounds = sorted(set(bounds or []))
    below = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(1 + below).cast("int")
    heads = {r.part: r.head for r in docs.select("doc_id", part.alias("part")).groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    after = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}
    size = len(bounds) + 2
    head = F.element_at(F.lit([heads.get(p) for p in range(size)]).cast("array<bigint>"), part + 1)
    target = F.element_at(F.lit([after.get(p, p) for p in range(size)]).cast("array<int>"), part + 1)
    own = F.struct(part.alias("part"), F.lit(False).alias("heir"))
    places = F.when(F.col("doc_id").eqNullSafe(head), F.array(own, F.struct(target.alias("part"), F.lit(True).alias("heir")))).otherwise(F.array(own))
    return docs.select("doc_id", "text", F.explode(places).alias("place")).select("place.*", "doc_id", "text").repartitionByRange(parts, "part")


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text: the last third of its code points replaced by the first as
    many (or all) of the next document's, in descending order of doc_id (ties by text, nulls last; after the last the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. Texts are exchanged
    once, into ranges of doc_id; everything after that stays in its range. A null text counts as empty; other columns are
    not read; repeated rows follow each other."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    along = Window.partitionBy("part").orderBy("heir", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    placed = in_order(plain, parts).select("*", F.row_number().over(along).alias("place"), F.lead("text").over(along).alias("next_text"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.when(~F.col("heir"), F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    both = placed.select("part", "place", "heir", "doc_id", n.cast("long").alias("n_chars"), F.array("text", edited).alias("texts"))
    bodies = both.select("part", "place", "heir", "doc_id", "n_chars", F.posexplode("texts").alias("which", "body")).filter("body IS NOT NULL")
    keyed = bodies.withColumn("sha", F.when(F.col("which") == 1, F.sha2("body", 256)))
    marks = with_samples(keyed, ["part", "place", "which", "heir", "doc_id", "n_chars", "sha"], "body", samples).select(
        "part", "place", "which", "heir", "doc_id", "n_chars", "sha", fingerprint_text(samples).alias("mark")
    )
    pairs = Window.partitionBy("part").orderBy("place", "which")
    rows = marks.select("*", F.lead("mark").over(pairs).alias("edited"), F.lead("sha").over(pairs).alias("edited_sha256"), F.lead("mark", 2).over(pairs).alias("next"))
    return rows.filter("which = 0 AND NOT heir").select(
        "doc_id", "n_chars", "edited_sha256", F.col("mark").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited"), samples).alias("near_edited"), likeness(F.col("mark"), F.col("next"), samples).alias("near_next"),
    )
