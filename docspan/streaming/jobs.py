"""The three continuous jobs: version log, drift and feedback.

Sinks are folders with one sub-folder per micro-batch, overwritten when a batch is replayed, so a restarted query
leaves the same rows. Readers are plain batch scans of those folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspan.operators.drift import drift_files, worst_drift
from docspan.operators.storage import stored
from docspan.streaming import heads as H
from docspan.operators.versions import number_versions

VERSIONS = "doc_id bigint, event_id bigint, saved_at timestamp, source string, content string, message string, version_no int, batch bigint"
DRIFTED = "doc_id bigint, path string, new_sha string, drift_state string, changed_functions array<string>, pushed_at timestamp, push_id bigint"


def _write_batch(df: DataFrame, store: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{store}/batch={batch}")


def _read(spark: SparkSession, store: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("basePath", store).parquet(f"{store}/batch=*")


def _has_batches(spark: SparkSession, store: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/batch=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_versions(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, store, VERSIONS).drop("batch")


def stream_versions(saves: DataFrame, store: str, checkpoint: str, delay: str = "1 hour", buckets: int = H.BUCKETS) -> StreamingQuery:
    """Number save events after the last stored version of their document. Repeated events are dropped by id
    within the watermark; numbers of a batch build on the batches before it, never on itself. The last numbers are kept
    beside the log in a table of buckets, of which a batch reads and rewrites those it touches: the log itself is never read."""
    unique = saves.withColumn("saved_at", F.col("saved_at").cast("timestamp")).withWatermark("saved_at", delay).dropDuplicatesWithinWatermark(["event_id"])

    def save(batch_df: DataFrame, batch: int) -> None:
        spark = batch_df.sparkSession
        # numbering reads its input more than once; the stateful part of the batch must run once
        unique_saves = stored(batch_df, "saves")
        fresh = number_versions(unique_saves.select("doc_id", "event_id", "saved_at", "source", "content", "message"))
        heads = f"{store}/heads"
        if batch and not H.exists(spark, heads) and _has_batches(spark, store):  # a log from before there were heads
            earlier = _read(spark, store, VERSIONS).filter(F.col("batch") < batch)
            H.write(H.newest(earlier.select("doc_id", F.col("version_no").alias("last"))), heads, -1, buckets)
        touched = H.touched(unique_saves, buckets)
        before = H.read(spark, heads, touched, batch)
        fresh = fresh.join(before, "doc_id", "left").withColumn("version_no", (F.coalesce("last", F.lit(0)) + F.col("version_no")).cast("int")).drop("last")
        _write_batch(fresh, store, batch)
        written = spark.read.schema(VERSIONS).parquet(f"{store}/batch={batch}").select("doc_id", F.col("version_no").alias("last"))
        H.write(H.newest(before.unionByName(written)), heads, batch, buckets)
        H.forget(spark, heads, touched, batch)

    return unique.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(states: DataFrame) -> DataFrame:
    """The state of the newest push of every binding."""
    rest = [c for c in states.columns if c not in ("doc_id", "path")]
    return states.groupBy("doc_id", "path").agg(F.max_by(F.struct(*rest), F.struct("pushed_at", "push_id")).alias("r")).select("doc_id", "path", "r.*")


def stream_drift(
    pushes: DataFrame, bindings: DataFrame, old_entries: DataFrame, new_entries: DataFrame, store: str, checkpoint: str, buckets: int = H.BUCKETS
) -> StreamingQuery:
    """Judge pushed files (path, snapshot_sha, pushed_at, push_id) against the bindings; the static side is joined
    in the stream. Each batch's states are a folder of their own, and are merged into the latest state of every binding,
    of which a batch rewrites the buckets it touches."""
    bound = bindings.drop("snapshot_sha")
    joined = pushes.join(bound, "path")

    def judge(batch_df: DataFrame, batch: int) -> None:
        # the newest push of a binding within the batch counts
        keys = ["doc_id", "path"]
        newest = stored(batch_df, "pushes").groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch_df.columns if c not in keys]), F.struct("pushed_at", "push_id")).alias("r")).select(*keys, "r.*")
        states = drift_files(newest, old_entries, new_entries).select("doc_id", "path", "new_sha", "drift_state", "changed_functions")
        # a push back to the bound SHA makes the file current again
        out = newest.select(*keys, "pushed_at", "push_id", "snapshot_sha").join(states, keys, "left").select(
            *keys, F.coalesce("new_sha", "snapshot_sha").alias("new_sha"), F.coalesce("drift_state", F.lit("current")).alias("drift_state"),
            "changed_functions", "pushed_at", "push_id")
        _write_batch(out, store, batch)
        spark, states = batch_df.sparkSession, f"{store}/states"
        fresh = spark.read.schema(DRIFTED).parquet(f"{store}/batch={batch}")
        of = H.touched(fresh, buckets, ("doc_id", "path"))
        H.write(_latest(H.read(spark, states, of, batch, DRIFTED).unionByName(fresh)), states, batch, buckets, ("doc_id", "path"))
        H.forget(spark, states, of, batch)

    return joined.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_drift(spark: SparkSession, store: str, docs: DataFrame) -> DataFrame:
    """Latest state of every pushed file, folded to the worst state per document: reads the merged states, not the batches."""
    return worst_drift(docs, H.read(spark, f"{store}/states", schema=DRIFTED).select("doc_id", "path", "drift_state").filter("drift_state <> 'current'"))


def running_feedback(feedback: DataFrame) -> DataFrame:
    """Count and mean rating per document so far."""
    return feedback.groupBy("doc_id").agg(F.count("*").alias("count"), F.round(F.avg("rating"), 2).alias("average"))


def windowed_feedback(feedback: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """The same per tumbling window; rows later than the watermark are dropped."""
    timed = feedback.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    return (timed.groupBy(F.window("at", width).alias("w"), "doc_id").agg(F.count("*").alias("count"), F.round(F.avg("rating"), 2).alias("average"))
            .select(F.col("w.start").alias("window_start"), "doc_id", "count", "average"))


def stream_feedback(feedback: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keep the running summary: each batch rewrites the changed documents, readers take the newest row."""
    def save(batch_df: DataFrame, batch: int) -> None:
        _write_batch(batch_df, store, batch)

    return (running_feedback(feedback).writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_feedback(spark: SparkSession, store: str) -> DataFrame:
    rows = _read(spark, store, "doc_id bigint, count bigint, average double, batch bigint")
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("count", "average"), "batch").alias("r")).select("doc_id", "r.count", "r.average")


def stream_windows(feedback: DataFrame, store: str, checkpoint: str, width: str = "1 day", delay: str = "1 hour") -> StreamingQuery:
    """Closed windows, appended once the watermark has passed them."""
    return (windowed_feedback(feedback, width, delay).writeStream.outputMode("append").format("parquet").option("path", store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
