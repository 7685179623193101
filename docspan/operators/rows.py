"""Arrays to rows without computing the array twice.

A plain ``explode`` or ``inline`` lets the optimiser add "array is not empty" filters below it, and for a computed
array such a filter computes the array again. The outer forms get no such filter; empty arrays are dropped after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_position(df: DataFrame, keep: list[str | Column], array: Column, name: str) -> DataFrame:
    """``keep`` plus ``pos`` (from 0) and the element as ``name``."""
    return df.select(*keep, F.posexplode_outer(array).alias("pos", name)).filter(F.col("pos").isNotNull())


def elements(df: DataFrame, keep: list[str | Column], array: Column, name: str) -> DataFrame:
    return with_position(df, keep, array, name).drop("pos")


def inlined(df: DataFrame, keep: list[str], array: str) -> DataFrame:
    """``keep`` plus the fields of an array of structs."""
    return elements(df, [F.col(k) for k in keep], F.col(array), "_e").select(*keep, "_e.*")
