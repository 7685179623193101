"""Loading of the given tables and of the inputs derived from them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspan.fixtures import FIXTURES, needed, with_fixtures

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
_WORD = re.compile(r"[a-z_]+")


def spread(df: DataFrame) -> DataFrame:
    """Split an input of fewer partitions than twice the cores: a small file would otherwise be one task, and splits of a file
    that has fewer row groups than splits are empty. Inputs of a cluster's size already have more partitions than that and
    are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def sql_input(spark: SparkSession, sf_dir: str, text: str, read: Callable[[DataFrame], DataFrame] = lambda table: table) -> DataFrame:
    """Rows of a SQL text over the given tables, each passed through ``read``, and the fixtures."""
    bodies = [text, *(FIXTURES[n] for n in needed(text))]
    used = {w for b in bodies for w in _WORD.findall(b)} & set(TABLES)
    for t in sorted(used):
        read(spark.read.parquet(f"{sf_dir}/{t}.parquet")).createOrReplaceTempView(t)
    return spark.sql(with_fixtures(text))


def built_in_tasks(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``sql_input`` for a text that builds long columns row by row: the tables are spread, not what is built from them. The few
    tasks of the scan then pass on short rows, and all tasks build."""
    return sql_input(spark, sf_dir, text, spread)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql_input(spark, sf_dir, f"SELECT * FROM {name}")
