"""The newest row of every key, in hash buckets beside a stream's log: last version numbers, latest drift states.

A bucket is rewritten as a whole by each batch that touches it, under the batch's number. A batch reads the newest generation
before its own, so a repeated batch finds what the first attempt found; older generations are removed once a newer one than
the one it was read from is complete. What a batch reads and writes depends on the buckets it touches, not on the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a store; fixed for its life. A bucket should hold some million keys.
BUCKETS = 64
SCHEMA = "doc_id bigint, last int"
KEY = ("doc_id",)


def _files(spark: SparkSession, pattern: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, [f.getPath() for f in system.globStatus(path) or []]


def _generations(spark: SparkSession, store: str) -> dict[int, list[int]]:
    """Generations on disk by bucket: a listing of folder names."""
    out: dict[int, list[int]] = {}
    for path in _files(spark, f"{store}/bucket=*/generation=*")[1]:
        out.setdefault(int(path.getParent().getName().split("=")[1]), []).append(int(path.getName().split("=")[1]))
    return out


def exists(spark: SparkSession, store: str) -> bool:
    return bool(_files(spark, f"{store}/bucket=*")[1])


def _bucket(buckets: int, key: tuple[str, ...]):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, buckets: int = BUCKETS, key: tuple[str, ...] = KEY) -> list[int]:
    """Buckets of the keys in ``rows``: at most as many numbers as there are buckets."""
    return sorted(r.bucket for r in rows.select(_bucket(buckets, key).alias("bucket")).distinct().collect())


def newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.max("last").alias("last"))


def read(spark: SparkSession, store: str, of: list[int] | None = None, before: int | None = None, schema: str = SCHEMA) -> DataFrame:
    """Rows of the given buckets (of all, if none are named) as they were before a batch (as they are now, if none is named)."""
    known = _generations(spark, store)
    earlier = {b: max((g for g in known.get(b, []) if before is None or g < before), default=None) for b in (known if of is None else of)}
    paths = [f"{store}/bucket={b}/generation={g}" for b, g in earlier.items() if g is not None]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write(rows: DataFrame, store: str, batch: int, buckets: int = BUCKETS, key: tuple[str, ...] = KEY) -> None:
    """Replaces this batch's generation of the buckets that ``rows`` fall into."""
    placed = rows.select("*", _bucket(buckets, key).alias("bucket"), F.lit(batch).alias("generation")).repartition("bucket")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "generation").parquet(store)


def forget(spark: SparkSession, store: str, of: list[int], batch: int) -> None:
    """Removes the generations of the given buckets that no repetition of ``batch`` can need."""
    known = _generations(spark, store)
    for bucket in of:
        needed = max((g for g in known.get(bucket, []) if g < batch), default=batch)
        for generation in known.get(bucket, []):
            if generation < needed:
                system, found = _files(spark, f"{store}/bucket={bucket}/generation={generation}")
                for path in found:
                    system.delete(path, True)
