"""Streaming queries: each reads a given table as a stream to its end and returns what the job stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.operators.storage import is_directory, new_path
from docspan.plans import drift as DR
from docspan.plans.inputs import fixture, sql_input
from docspan.streaming import jobs as J


def stream_session(spark):
    """A session of its own for a stream: state is kept per shuffle partition for good, and more partitions than
    cores only cost time here."""
    own = spark.newSession()
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def source(spark, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables as a file stream. Streams read folders, so a table that is one file is picked from
    the folder it is in."""
    path = f"{sf_dir}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_directory(spark, path):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _saves(orders: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("generate", "edit", "rollback", "regenerate")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return orders.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("saved_at"), kind.alias("source"),
        F.concat(F.lit("content "), (F.col("o_orderkey") % 3).cast("string")).alias("content"), F.concat(F.lit("message "), "o_orderpriority").alias("message"))


def streamed_versions(spark, sf):
    store = new_path(spark, "versions")
    J.stream_versions(_saves(source(stream_session(spark), sf, "orders")), store, new_path(spark, "versions-log")).awaitTermination()
    return J.read_versions(spark, store).select("doc_id", "event_id", "version_no", "source", "message")


# Fixed dates that cut the given tables' years and month.
SAVE_CUTS = ("1994-06-01", "1996-06-01")
FEEDBACK_CUT = "2024-01-15"


def streamed_version_batches(spark, sf):
    """The same log in three batches, each arriving when the one before is stored."""
    saves = _saves(spark.read.parquet(f"{sf}/orders.parquet"))
    folder, store, log = (new_path(spark, n) for n in ("saves-in", "versions", "versions-log"))
    at, bounds, own = F.col("saved_at").cast("timestamp"), (None, *SAVE_CUTS, None), stream_session(spark)
    for low, high in zip(bounds, bounds[1:]):
        part = saves.filter((F.lit(low is None) | (at >= F.lit(low).cast("timestamp"))) & (F.lit(high is None) | (at < F.lit(high).cast("timestamp"))))
        part.write.mode("append").parquet(folder)
        J.stream_versions(own.readStream.schema(saves.schema).parquet(folder), store, log).awaitTermination()
    return J.read_versions(spark, store).select("doc_id", "event_id", "version_no", "source", "message")


def streamed_windows(spark, sf):
    """Closed windows over two batches. The second brings some rows of the first half again under new ids, too late for all days
    but the last of that half: the watermark leaves them out."""
    events = _feedback(spark.read.parquet(f"{sf}/events.parquet")).withColumn("at", F.col("at").cast("timestamp"))
    first = F.col("at") < F.lit(FEEDBACK_CUT).cast("timestamp")
    again = events.filter(first & (F.col("event_id") % 7 == 0)).withColumn("event_id", -F.col("event_id") - 1)
    folder, store, log = (new_path(spark, n) for n in ("feedback-in", "windows", "windows-log"))
    own = stream_session(spark)
    for part in (events.filter(first), events.filter(~first).unionByName(again)):
        part.write.mode("append").parquet(folder)
        J.stream_windows(own.readStream.schema(events.schema).parquet(folder), store, log).awaitTermination()
    closed = spark.read.schema("window_start timestamp, doc_id bigint, count bigint, average double").parquet(store)
    return closed.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "doc_id", "count", "average")


def _pushes(parts: DataFrame) -> DataFrame:
    """Every part is a push of the file it names."""
    f = (F.col("p_partkey") % 97)
    return parts.select(
        F.concat(F.lit("src/f"), f.cast("string"), F.lit(".ts")).alias("path"),
        F.when(f % 5 == 0, F.concat(F.lit("a"), f.cast("string"))).when(f % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("b"), f.cast("string"))).alias("snapshot_sha"),
        F.timestamp_seconds(F.col("p_size")).alias("pushed_at"), F.col("p_partkey").alias("push_id"))


def streamed_drift(spark, sf):
    own, store = stream_session(spark), new_path(spark, "drift")
    J.stream_drift(_pushes(source(own, sf, "part")), DR._hashed(own, sf), fixture(own, sf, "fx_entries_old"), fixture(own, sf, "fx_entries_new"), store,
                   new_path(spark, "drift-log")).awaitTermination()
    return J.read_drift(spark, store, sql_input(spark, sf, DR.DOCS_SQL))


def streamed_drift_batches(spark, sf):
    """The same pushes in three batches, in no order of time; the state of the newest push counts."""
    pushes = _pushes(spark.read.parquet(f"{sf}/part.parquet"))
    folder, store, log = (new_path(spark, n) for n in ("pushes-in", "drift", "drift-log"))
    own = stream_session(spark)
    for third in range(3):
        pushes.filter(F.col("push_id") % 3 == third).write.mode("append").parquet(folder)
        stream = own.readStream.schema(pushes.schema).parquet(folder)
        J.stream_drift(stream, DR._hashed(own, sf), fixture(own, sf, "fx_entries_old"), fixture(own, sf, "fx_entries_new"), store, log).awaitTermination()
    return J.read_drift(spark, store, sql_input(spark, sf, DR.DOCS_SQL))


def _feedback(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("doc_id"), "event_id", (F.col("event_id") % 5 + 1).cast("int").alias("rating"), F.col("ts").alias("at"))


def streamed_feedback(spark, sf):
    store = new_path(spark, "feedback")
    J.stream_feedback(_feedback(source(stream_session(spark), sf, "events")), store, new_path(spark, "feedback-log")).awaitTermination()
    return J.read_feedback(spark, store)


def feedback_windows(spark, sf):
    """The windows' batch form."""
    w = J.windowed_feedback(fixture(spark, sf, "fx_feedback"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "doc_id", "count", "average")


QUERIES = {f.__name__: f for f in (streamed_versions, streamed_version_batches, streamed_drift, streamed_drift_batches, streamed_feedback, streamed_windows, feedback_windows)}
_NUMBERED_SQL = "SELECT doc_id, event_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY saved_at, event_id) AS int) AS version_no, source, message FROM fx_saves"
ORACLES = {
    "streamed_version_batches": _NUMBERED_SQL,
    "streamed_windows": f"""
WITH timed AS (SELECT doc_id, event_id, rating, cast("at" AS timestamp) AS t, date_trunc('day', cast("at" AS timestamp)) AS d FROM fx_feedback),
first_half AS (SELECT * FROM timed WHERE t < TIMESTAMP '{FEEDBACK_CUT}'),
in_time AS (SELECT * FROM first_half WHERE event_id % 7 = 0 AND d + INTERVAL 1 DAY > (SELECT max(t) - INTERVAL 1 HOUR FROM first_half)),
seen AS (SELECT * FROM timed UNION ALL SELECT * FROM in_time)
SELECT strftime(d, '%Y-%m-%d') AS day, doc_id, count(*) AS count, round(avg(rating), 2) AS average FROM seen
WHERE d + INTERVAL 1 DAY <= (SELECT max(t) - INTERVAL 1 HOUR FROM timed) GROUP BY ALL""",
    "streamed_versions": _NUMBERED_SQL,
    "streamed_drift": DR._STATES + "SELECT * FROM docs",
    "streamed_drift_batches": DR._STATES + "SELECT * FROM docs",
    "streamed_feedback": "SELECT doc_id, count(*) AS count, round(avg(rating), 2) AS average FROM fx_feedback GROUP BY doc_id",
    "feedback_windows": "SELECT strftime(\"at\", '%Y-%m-%d') AS day, doc_id, count(*) AS count, round(avg(rating), 2) AS average FROM fx_feedback GROUP BY ALL",
}
