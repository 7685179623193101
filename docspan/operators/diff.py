"""Line diffs between versions.

Pairs of texts are rows; Spark spreads them over tasks and a vectorised helper aligns one pair at a time.
Texts that are equal never leave the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.functions.lcs import edit_script, lcs_length, line_ids, shared_lines
from docspan.functions.text import lines_of
from docspan.operators.rows import with_position

_SCRIPT = T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("op", "old_line", "new_line")])


@F.pandas_udf(T.IntegerType())
def _common_lines(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else lcs_length(*line_ids(a, b)) for a, b in zip(old, new)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def _shared_lines(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else shared_lines(*line_ids(a, b)) for a, b in zip(old, new)], dtype="Int32")


@F.pandas_udf(_SCRIPT)
def _script(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    scripts = [([], [], []) if a is None or b is None else edit_script(a, b) for a, b in zip(old, new)]
    return pd.DataFrame(scripts, columns=["op", "old_line", "new_line"])


def _texts(pairs: DataFrame) -> DataFrame:
    """Missing contents are empty; equal pairs carry NULL to the helper."""
    old, new = (F.coalesce(F.col(c), F.lit("")) for c in ("from_content", "to_content"))
    return (pairs.withColumn("_old", old).withColumn("_new", new).withColumn("_same", F.col("_old") == F.col("_new"))
            .withColumn("_a", F.when(~F.col("_same"), F.col("_old"))).withColumn("_b", F.when(~F.col("_same"), F.col("_new"))))


def diff_stats(pairs: DataFrame) -> DataFrame:
    """Additions and deletions per pair, exact for any size."""
    n, m = F.size(lines_of(F.col("_old"))), F.size(lines_of(F.col("_new")))
    common = F.when(F.col("_same"), n).otherwise(F.col("_common"))
    return _texts(pairs).withColumn("_common", _common_lines("_a", "_b")).select(
        *[c for c in pairs.columns if not c.endswith("_content")], (m - common).alias("additions"), (n - common).alias("deletions"))


def diff_lines(pairs: DataFrame) -> DataFrame:
    """The edit script: one row per line in order, with op context, del or add and the line numbers."""
    keys = [c for c in pairs.columns if not c.endswith("_content")]
    same = F.transform(F.col("_news"), lambda _, i: F.struct(F.lit(0).alias("op"), (i + 1).alias("old_line"), (i + 1).alias("new_line")))
    script = _texts(pairs).withColumn("_s", _script("_a", "_b")).select(
        *keys, "_same", "_s", lines_of(F.col("_old")).alias("_olds"), lines_of(F.col("_new")).alias("_news"))
    rows = with_position(script, [*keys, "_olds", "_news"], F.when(F.col("_same"), same).otherwise(
        F.arrays_zip("_s.op", "_s.old_line", "_s.new_line")), "d")
    has_old, has_new = F.col("d.old_line") > 0, F.col("d.new_line") > 0
    return rows.select(
        *keys, (F.col("pos") + 1).alias("line_no"),
        F.when(has_old & has_new, "context").when(has_old, "del").otherwise("add").alias("op"),
        F.when(has_old, F.get("_olds", F.col("d.old_line") - 1)).otherwise(F.get("_news", F.col("d.new_line") - 1)).alias("text"),
        F.when(has_old, F.col("d.old_line")).alias("old_line"), F.when(has_new, F.col("d.new_line")).alias("new_line"))


def line_delta(pairs: DataFrame) -> DataFrame:
    """Additions and deletions when order is ignored: surplus occurrences per distinct line. Bounds the exact
    statistics from below. Both texts are in one row, so nothing is exchanged."""
    n, m = F.size(lines_of(F.col("_old"))), F.size(lines_of(F.col("_new")))
    common = F.when(F.col("_same"), n).otherwise(F.col("_common"))
    return _texts(pairs).withColumn("_common", _shared_lines("_a", "_b")).select(
        *[c for c in pairs.columns if not c.endswith("_content")], (m - common).alias("additions"), (n - common).alias("deletions"))
