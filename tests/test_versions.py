import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from docspan.operators import versions as V
from docspan.operators.skew import hot_keys, number_within
from docspan.plans.inputs import fixture


def test_slices_of_hot_documents_give_plain_numbers(spark):
    rows = [(1 if i % 3 else i, i, f"2024-01-0{1 + i % 7} {i % 5:02d}:00:00") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id int, event_id int, at string").withColumn("at", F.to_timestamp("at"))
    got = number_within(df, "doc_id", [F.col("at"), F.col("event_id")], "n", F.date_trunc("hour", "at"), hot_rows=50)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "event_id")))
    assert hot_keys(df, "doc_id", 50).collect()[0][0] == 1
    assert sorted(map(tuple, got.select("event_id", "n").collect())) == sorted(map(tuple, want.select("event_id", "n").collect()))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def chain_by_hand(entries, segment):
    def part(x):
        x = "" if x is None else str(x)
        return f"{len(x)}:{x}"

    level = [sha("".join(part(x) for x in e)) for e in entries]

    def link(digests, left):
        if left == 1:
            segment_ = len(digests)
        else:
            segment_ = segment
        local, ends = [], []
        for s in range(0, len(digests), segment_):
            last = ""
            for d in digests[s:s + segment_]:
                last = sha(f"{last}>{d}")
                local.append(last)
            ends.append(last)
        if left == 1:
            return local
        anchors = link(ends, left - 1)
        return [x if i < segment_ else sha(f"{anchors[i // segment_ - 1]}>{x}") for i, x in enumerate(local)]

    return link(level, 3)


def test_chain_over_several_levels_equals_the_chain_by_hand(spark):
    entries = [(n, f"content {n % 4}", None if n % 5 == 0 else f"m{n}") for n in range(1, 41)]
    df = spark.createDataFrame([(9, *e) for e in entries], "doc_id int, version_no int, content string, message string")
    got = [r.commit_hash for r in V.chain(df, segment=3).orderBy("version_no").collect()]
    assert got == chain_by_hand(entries, 3)


def test_verifier_finds_the_first_broken_version(spark):
    df = spark.createDataFrame([(d, n, f"c{n}", "m") for d in (1, 2) for n in range(1, 13)], "doc_id int, version_no int, content string, message string")
    stored = df.join(V.chain(df, segment=4), ["doc_id", "version_no"])
    assert V.verify_chain(stored, segment=4).count() == 0
    broken = stored.withColumn("content", F.when((F.col("doc_id") == 2) & (F.col("version_no") == 6), "x").otherwise(F.col("content")))
    assert [tuple(r) for r in V.verify_chain(broken, segment=4).collect()] == [(2, 6, 7)]


def test_timeline_reads_no_content(spark, sf_dir):
    from docspan.plans.versions import log

    plan = V.timeline(log(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "content " not in plan


def test_numbering_exchanges_the_rows_once(spark, sf_dir):
    plan = V.number_versions(fixture(spark, sf_dir, "fx_saves"))._jdf.queryExecution().executedPlan().toString()
    # the other exchanges carry counts
    rows = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_slice" in x]
    assert len(rows) == 1 and "SinglePartition" not in plan and "CartesianProduct" not in plan
