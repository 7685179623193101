import pytest
from pyspark.sql import functions as F

from docspan.operators import drift as D
from docspan.operators import signatures as S

IMPL, SIG = "implementation_changed", "signature_changed"
# requested, content ok, old ok, stored hash, new hash, changes -> state, names
CASES = [
    ((False, True, True, "h", "h2", ["a (added)"]), (IMPL, [])),
    ((True, False, True, "h", None, None), (SIG, [D.CONTENT_UNAVAILABLE])),
    ((True, True, True, "h", "h", ["a (added)"]), (IMPL, [])),
    ((True, True, True, "h", "h2", ["a (added)"]), (SIG, ["a (added)"])),
    ((True, True, True, "h", "h2", None), (IMPL, [])),
    ((True, True, False, "h", "h2", None), (SIG, [D.DETAILS_UNAVAILABLE])),
    ((True, True, True, None, "h2", ["a (removed)"]), (SIG, ["a (removed)"])),
    ((True, True, True, None, "h2", []), (IMPL, [])),
    ((True, True, False, None, "h2", None), (IMPL, [])),
    ((True, True, False, "", "h2", None), (IMPL, [])),
]


@pytest.mark.parametrize("case,want", CASES)
def test_decision_table(spark, case, want):
    df = spark.createDataFrame([case], "requested boolean, content_ok boolean, old_ok boolean, stored string, fresh string, changes array<string>")
    r = df.select(D.drift_state(*[F.col(c) for c in df.columns]).alias("d")).select("d.*").collect()[0]
    assert (r.drift_state, r.changed_functions) == want


def test_later_duplicates_of_a_name_count(spark):
    ddl = "file_id int, pos int, name string, sig string"
    old = spark.createDataFrame([(1, 0, "f", "x"), (1, 1, "f", "y"), (1, 2, "gone", "z")], ddl)
    new = spark.createDataFrame([(1, 0, "f", "q"), (1, 1, "f", "y"), (1, 2, "new", "z")], ddl)
    assert S.diff_signatures(old, new).collect()[0].changed_functions == ["gone (removed)", "new (added)"]


def test_hash_ignores_order_and_empty_files_hash_the_empty_string(spark):
    import hashlib

    ddl = "file_id int, pos int, name string, sig string"
    e = spark.createDataFrame([(1, 0, "b", "sb"), (1, 1, "a", "sa"), (2, 0, "a", "sa"), (2, 1, "b", "sb")], ddl)
    files = spark.createDataFrame([(1,), (2,), (3,)], "file_id int")
    got = {r.file_id: r.signature_hash for r in S.signature_hash(e, files).collect()}
    assert got[1] == got[2] == hashlib.sha256(b"sa|sb").hexdigest() and got[3] == hashlib.sha256(b"").hexdigest()


def test_a_text_that_cannot_be_read_counts_as_unavailable(spark):
    ddl = "doc_id int, file_id int, path string, commit_sha string, snapshot_sha string, signature_hash string, content_requested boolean"
    bindings = spark.createDataFrame([(1, k, f"f{k}.ts", "a", "b", "h" if k < 3 else None, True) for k in (1, 2, 3)], ddl)
    good, broken = "export function f(a: string) { return a }", "export function f(a: string {"
    text = lambda rows: spark.createDataFrame([(k, f"f{k}.ts", t) for k, t in rows], "file_id int, file_name string, content string")
    found = D.content_drift(bindings, text([(1, broken), (2, good), (3, good)]), text([(1, good), (2, ") ("), (3, broken)]))
    assert {r.path: (r.drift_state, r.changed_functions) for r in found.collect()} == {
        "f1.ts": (SIG, [D.CONTENT_UNAVAILABLE]), "f2.ts": (SIG, [D.DETAILS_UNAVAILABLE]), "f3.ts": (IMPL, [])}
