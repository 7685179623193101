"""Joins and numbering when a single key may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows. At most (all rows / hot_rows) keys can be hot, so the result stays
    small enough to broadcast whatever the input; counts are combined before the exchange."""
    return df.groupBy(key).count().filter(F.col("count") > hot_rows).select(F.col(key).alias("hot_key"))


def number_within(df: DataFrame, key: str, order: list[Column], out: str, slice_by: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Dense numbers 1..n per key, as ``row_number`` would give.

    ``slice_by`` must be non-decreasing along ``order`` (say, the minute of the ordering timestamp). Rows of hot
    keys are partitioned by key and slice, each slice is numbered alone, and the slice's offset is a running
    sum over the key's slice counts. Other keys have one slice. The data is exchanged once either way.
    """
    hot = hot_keys(df, key, hot_rows)
    sliced = (
        df.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
        .withColumn("_slice", F.when(F.col("hot_key").isNotNull(), slice_by))
        .drop("hot_key")
    )
    numbered = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order)))
    counts = (
        df.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left_semi")
        .groupBy(F.col(key).alias("_key"), slice_by.alias("_of")).agg(F.count("*").alias("_n"))
    )
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_key", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        numbered.join(offsets, (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_of")), "left")
        .withColumn(out, (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_rank")).cast("int"))
        .select(*df.columns, out)
    )


#: Most keys that count as hot; for larger inputs the threshold rises, so their list has a fixed bound and may be broadcast.
MOST_HOT = 10_000


def slices_of_hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame | None:
    """The keys with more rows than a threshold, and _slices, the number of slices that brings them below it. The threshold is
    ``hot_rows`` or, for larger inputs, all rows / ``MOST_HOT``. ``rows`` is the number of rows if it is known already; no key
    can be hot among fewer than the threshold: then there is no list."""
    rows = df.count() if rows is None else rows
    limit = max(hot_rows, rows // MOST_HOT)
    if rows <= limit:
        return None
    return df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("_slices"))


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, rows: int | None = None, hint: str | None = None
) -> DataFrame:
    """Equi-join on columns that have the same names on both sides; ``how`` is inner or left, and ``left`` is the side that may
    be skewed (``rows`` its number of rows, if known).

    Rows of hot keys are spread over slices of their key by a hash of all their columns (so no column may be a map), which a
    repeated task finds again, and the right rows of these keys are repeated once per slice. Left
    rows with a null in a key meet nothing: they stay where they are and never go to one task together. Columns beside the keys
    must have different names. ``hint`` is a join hint for this join, for tables that Spark sizes too low."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    hinted = (lambda df: df.hint(hint)) if hint else (lambda df: df)
    whole = left.filter(known)
    hot = slices_of_hot_keys(whole, keys, hot_rows, rows)
    if hot is None:
        met = whole.join(hinted(right), keys, how)
    else:
        hot = F.broadcast(hot)
        spread_left = whole.join(hot, keys, "left").withColumn("_slice", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_slices")).cast("int"), F.lit(0))).drop("_slices")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)).alias("_slice")
        spread_right = right.join(hot, keys, "left").select(*right.columns, copies)
        met = spread_left.join(hinted(spread_right), [*keys, "_slice"], how).drop("_slice")
    return met if how == "inner" else met.unionByName(left.filter(~known), allowMissingColumns=True)
