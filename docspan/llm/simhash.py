"""SimHash near duplicates through a byte-position index with count filtering.

Two 64-bit fingerprints that differ in at most d bits share at least m = 8 - d of their eight bytes at the same position. The
index posts every different fingerprint under each choice of m - 1 positions with its bytes there: a pair that shares m bytes
meets in at least m posting lists, one that shares fewer only in one or in none. So the meetings of a pair are counted over all
lists, pairs below the guaranteed number are left out, and the bit distance decides.

Lists of equal or near copies are not expanded into all their pairs. First every fingerprint is compared with the least one
of its list, and the components of these links are found. Then only lists that still hold several components are compared
pairwise, and only across components: all other links lie within one component already. A pair of two components meets in such
lists only, so its count is whole."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspan.llm.batches import slices, strings
from docspan.llm.components import components
from docspan.operators.skew import HOT_ROWS, salted_join
from docspan.operators.storage import stored

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BYTES = 8
#: Fingerprints that one task posts under all choices.
POSTED_ROWS = 10_000
#: Joins of postings are always sorted and merged. Spark takes postings for as large as the codes they are exploded from, or as their
#: well compressed files, and would send millions of them through the driver.
POSTINGS_JOIN = "merge"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of each bit over the hashes of all word shingles, repeats included; fewer words than a shingle are one, and
    no words give zero."""
    from xxhash import xxh64_intdigest

    found = _WORDS.findall(text.translate(_LOWER))
    if not found:
        return 0
    runs = zip(*(found[k:] for k in range(shingle))) if len(found) >= shingle else [found]
    hashes = np.asarray([xxh64_intdigest(" ".join(run), seed) for run in runs], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a long text needs no table of all its bits
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and code (the fingerprint as a signed long) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes = np.asarray([simhash(t, shingle, seed) for t in strings(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, code long")


def _mask(positions: tuple[int, ...]) -> int:
    bits = sum(0xFF << 8 * p for p in positions)
    return bits - (1 << 64) if bits >> 63 else bits


def postings(codes: DataFrame, shared: int) -> DataFrame:
    """code under each choice of ``shared`` byte positions: choice, kept (the code's bytes there), code."""
    choices = [F.struct(F.lit(k).cast("short").alias("choice"), F.col("code").bitwiseAND(F.lit(_mask(c))).alias("kept")) for k, c in enumerate(combinations(range(BYTES), shared))]
    return codes.select("code", F.explode(F.array(*choices)).alias("p")).select("p.choice", "p.kept", "code")


def is_link(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def least_meetings(max_bits: int) -> tuple[int, int]:
    """Positions of a posting, and the lists in which two codes within ``max_bits`` meet at least."""
    shared = BYTES - max_bits
    posted = max(shared - 1, 1)
    return posted, comb(shared, posted)


def candidates(left: DataFrame, right: DataFrame, meetings: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs code, code_2 of different roots that meet in at least ``meetings`` lists (choice, kept). Long lists are split."""
    other = right.withColumnsRenamed({"code": "code_2", "root": "root_2"})
    met = salted_join(left, other, ["choice", "kept"], hot_rows=hot_rows, hint=POSTINGS_JOIN).filter("root < root_2")
    return met.groupBy("code", "root", "code_2", "root_2").agg(F.count("*").alias("met")).filter(F.col("met") >= meetings)


def groups(codes: DataFrame, max_bits: int = MAX_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """node and root for every code of ``codes`` (different longs) that is linked to another but for the roots."""
    if not 0 <= max_bits < BYTES:
        raise ValueError("the index needs at least one shared byte")
    posted, meetings = least_meetings(max_bits)
    index = postings(codes.repartition(1 + codes.count() // POSTED_ROWS, "code"), posted)
    lists = index.groupBy("choice", "kept").agg(F.count("*").alias("n"), F.min("code").alias("pivot")).filter("n > 1").drop("n")
    lists = lists.withColumnsRenamed({"choice": "_c", "kept": "_k"})
    met = stored(index.join(lists.hint(POSTINGS_JOIN), (F.col("choice") == F.col("_c")) & (F.col("kept") == F.col("_k"))).select("choice", "kept", "code", "pivot"), "postings")
    stars = met.filter(F.col("code") != F.col("pivot")).filter(is_link(F.col("code"), F.col("pivot"), max_bits)).select(F.col("code").alias("a"), F.col("pivot").alias("b"))
    stars = stored(stars.distinct(), "stars")
    first = components(stars)
    named = met.join(first.withColumnRenamed("node", "code"), "code", "left").select("choice", "kept", "code", F.coalesce("root", "code").alias("root"))
    open_lists = named.groupBy("choice", "kept").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("choice", "kept")
    rest = stored(named.join(open_lists, ["choice", "kept"], "left_semi"), "open-postings")
    across = candidates(rest, rest, meetings, hot_rows).filter(is_link(F.col("code"), F.col("code_2"), max_bits))
    between = stored(across.select(F.col("root").alias("a"), F.col("root_2").alias("b")).distinct(), "links")
    return components(stars.select("a", "b").union(between)) if not between.isEmpty() else first


def near_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the least doc_id reachable over links of at most
    ``max_bits`` different bits, itself included) of every row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal fingerprints are one node, so
    copies cost nothing. A null id is in a group but is its least id only if the group has no other. Repeated rows give repeated
    results; other columns are not read."""
    marks = stored(fingerprints(docs, shingle, seed), "fingerprints")
    codes = stored(marks.groupBy("code").agg(F.min("doc_id").alias("least_doc")), "codes")
    found = groups(codes.select("code"), max_bits)
    rooted = codes.join(found.withColumnRenamed("node", "code"), "code", "left").select("code", F.coalesce("root", "code").alias("root"), "least_doc")
    least = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("code").alias("_code"), "component_id")
    # every code of marks is in named; a left join keeps Spark from broadcasting the documents, whose file may be well compressed
    return marks.join(named, F.col("code") == F.col("_code"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The row with the least doc_id of each group, with all its columns; of rows that share that id, the one with the least
    text. Rows with a null id are kept, since they cannot be told apart.

    Only the ids that go, and those of several rows, are brought back to the texts; rows of other ids are not exchanged for
    them while that list is small."""
    groups_of = near_groups(docs.select("doc_id", "text"), shingle, max_bits)
    of_id = groups_of.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        (F.count("*") > 1).alias("_several"), F.max("component_id").alias("_least")
    )
    marked = stored(of_id.select("_id", (F.col("_id") != F.col("_least")).alias("_goes"), "_several").filter("_goes OR _several"), "going-ids")
    left = docs.join(marked, F.col("doc_id") == F.col("_id"), "left").filter("_goes IS NULL OR NOT _goes")
    single = left.filter("_several IS NULL").select(docs.columns)
    again = docs.join(marked.filter("NOT _goes"), F.col("doc_id") == F.col("_id"))
    ordered = again.withColumn("_place of its id", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return single.unionByName(ordered.filter("`_place of its id` = 1").select(docs.columns))
