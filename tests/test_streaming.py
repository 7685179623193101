from pyspark.sql import functions as F

from docspan.operators.storage import new_path
from docspan.operators.versions import number_versions
from docspan.streaming import jobs as J

SAVES = "doc_id bigint, event_id bigint, saved_at timestamp, source string, content string, message string"


def save_rows(spark, ids, hour):
    return spark.createDataFrame([(i % 3, i) for i in ids], "doc_id bigint, event_id bigint").select(
        "doc_id", "event_id", F.to_timestamp(F.lit(f"2024-01-01 {hour:02d}:00:00")).alias("saved_at"), F.lit("edit").alias("source"),
        F.lit("c").alias("content"), F.lit("m").alias("message"))


def test_versions_over_several_batches_equal_the_batch_numbers(spark):
    folder, store, log = (new_path(spark, n) for n in ("in", "store", "log"))
    everything = None
    for hour, ids in ((1, [1, 2, 3, 4]), (2, [4, 5, 6, 7]), (3, [8, 9])):
        rows = save_rows(spark, ids, hour)
        rows.coalesce(1).write.mode("append").parquet(folder)
        everything = rows if everything is None else everything.unionByName(rows)
        J.stream_versions(spark.readStream.schema(SAVES).parquet(folder), store, log, "2 hours").awaitTermination()
    got = {(r.event_id, r.version_no) for r in J.read_versions(spark, store).collect()}
    first = everything.groupBy("event_id").agg(F.min_by(F.struct("doc_id", "saved_at", "source", "content", "message"), "saved_at").alias("r")).select("event_id", "r.*")
    assert got == {(r.event_id, r.version_no) for r in number_versions(first).collect()}


def test_a_replayed_batch_leaves_the_same_rows(spark):
    folder, store = new_path(spark, "in"), new_path(spark, "store")
    save_rows(spark, [1, 2, 3, 4, 5], 1).coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(SAVES).parquet(folder)
    for _ in range(2):  # a fresh log makes the second run repeat batch 0
        J.stream_versions(stream(), store, new_path(spark, "log")).awaitTermination()
    rows = [(r.doc_id, r.event_id, r.version_no) for r in J.read_versions(spark, store).collect()]
    assert len(rows) == len(set(rows)) == 5


def test_feedback_windows_drop_late_rows_and_running_summary_keeps_all(spark):
    ddl = "doc_id bigint, event_id bigint, rating int, at timestamp"
    folder, store, log, wins, wlog = (new_path(spark, n) for n in ("in", "store", "log", "wins", "wlog"))
    for day, ids in (("2024-01-01", [1, 2]), ("2024-01-05", [3]), ("2024-01-01", [4]), ("2024-01-09", [5])):
        spark.createDataFrame([(1, i, i % 5 + 1) for i in ids], "doc_id bigint, event_id bigint, rating int").withColumn(
            "at", F.to_timestamp(F.lit(day))).coalesce(1).write.mode("append").parquet(folder)
        read = lambda: spark.readStream.schema(ddl).parquet(folder)
        J.stream_feedback(read(), store, log).awaitTermination()
        J.stream_windows(read(), wins, wlog).awaitTermination()
    assert [tuple(r) for r in J.read_feedback(spark, store).collect()] == [(1, 5, 3.0)]
    closed = {str(r.window_start)[:10]: r["count"] for r in spark.read.parquet(wins).collect()}
    assert closed == {"2024-01-01": 2, "2024-01-05": 1}


def test_drift_follows_the_newest_push(spark):
    bindings = spark.createDataFrame([(1, 7, "a.ts", "s0", "h", True, True, True)],
                                     "file_id int, doc_id bigint, path string, commit_sha string, signature_hash string, content_requested boolean, content_ok boolean, old_ok boolean")
    ddl = "file_id int, pos int, name string, sig string"
    old, new = spark.createDataFrame([(1, 0, "f", "x")], ddl), spark.createDataFrame([(1, 0, "f", "y")], ddl)
    folder, store, log = (new_path(spark, n) for n in ("in", "store", "log"))
    docs = spark.createDataFrame([(7,), (8,)], "doc_id bigint")
    seen = []
    for n, sha in enumerate(("s1", "s0")):
        spark.createDataFrame([("a.ts", sha, n)], "path string, snapshot_sha string, push_id bigint").withColumn(
            "pushed_at", F.timestamp_seconds("push_id")).coalesce(1).write.mode("append").parquet(folder)
        pushes = spark.readStream.schema("path string, snapshot_sha string, push_id bigint, pushed_at timestamp").parquet(folder)
        J.stream_drift(pushes, bindings, old, new, store, log).awaitTermination()
        seen.append({r.doc_id: r.worst_state for r in J.read_drift(spark, store, docs).collect()})
        # the batches' own folders are not read: only the merged states are
        from docspan.streaming import heads as H
        for path in H._files(spark, f"{store}/batch=*")[1]:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        assert H.read(spark, f"{store}/states", schema=J.DRIFTED).count() == 1
    assert seen == [{7: "signature_changed", 8: "current"}, {7: "current", 8: "current"}]


def test_a_batch_reads_its_buckets_and_never_the_log(spark):
    """The log of earlier batches is taken away; numbers go on, also when a batch is repeated, and few generations stay."""
    from docspan.streaming import heads as H

    folder, store, log = (new_path(spark, n) for n in ("in", "store", "log"))
    expected, last = {}, {}
    for hour in range(1, 6):
        ids = range(10 * hour, 10 * hour + 4 + hour)
        save_rows(spark, ids, hour).coalesce(1).write.mode("append").parquet(folder)
        J.stream_versions(spark.readStream.schema(SAVES).parquet(folder), store, log, buckets=5).awaitTermination()
        for i in ids:
            last[i % 3] = last.get(i % 3, 0) + 1
            expected[i] = last[i % 3]
        rows = J.read_versions(spark, store).collect()
        assert {r.event_id: r.version_no for r in rows} == {i: expected[i] for i in ids}
        for path in H._files(spark, f"{store}/batch=*")[1]:
            spark.createDataFrame([], J.VERSIONS).drop("batch").write.mode("overwrite").parquet(path.toString())
    kept = H._generations(spark, f"{store}/heads")
    newest = max(g for gs in kept.values() for g in gs)
    assert all(len(gs) <= 2 for gs in kept.values())
    at = lambda batch: {r.doc_id: r.last for r in H.read(spark, f"{store}/heads", [0, 1, 2, 3, 4], batch).collect()}
    assert at(newest + 1) == last
    assert at(newest) == {d: n - sum(i % 3 == d for i in range(50, 59)) for d, n in last.items()}  # what a repetition would find


def test_heads_are_made_from_an_older_log(spark):
    folder, store, log = (new_path(spark, n) for n in ("in", "store", "log"))
    stream = lambda: spark.readStream.schema(SAVES).parquet(folder)
    save_rows(spark, [1, 2, 3, 4], 1).coalesce(1).write.parquet(folder)
    J.stream_versions(stream(), store, log).awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/heads")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    save_rows(spark, [7, 8], 3).coalesce(1).write.mode("append").parquet(folder)
    J.stream_versions(stream(), store, log).awaitTermination()
    assert {r.event_id: r.version_no for r in J.read_versions(spark, store).collect()} == {1: 1, 4: 2, 7: 3, 2: 1, 8: 2, 3: 1}
