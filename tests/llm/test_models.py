"""Classifiers: held-out accuracy, gradients, odd rows."""

import numpy as np

from docspan.llm import gru, language, quality, queries

SF01 = "/root/testdata/sf0.01"


def test_gradients_match_finite_differences():
    net = gru.fresh(3, 4, 1)
    for d in (net.forward, net.backward):
        d.inputs, d.recurrent = d.inputs.astype("f8"), d.recurrent.astype("f8")
    rng = np.random.default_rng(2)
    steps, labels, mask = rng.integers(0, 256, (6, 5)), rng.integers(0, 4, 5), np.ones((6, 5), "f4")
    _, grads = gru.gradients(net, steps, labels, mask)
    for array, grad in zip(net.arrays, grads):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        old = array[at]
        array[at] = old + 1e-2
        up, _ = gru.gradients(net, steps, labels, mask)
        array[at] = old - 1e-2
        down, _ = gru.gradients(net, steps, labels, mask)
        array[at] = old
        assert abs(grad[at] - (up - down) / 2e-2) < 1e-2 * max(1e-2, abs(grad[at]))


def test_language_of_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in queries.documents(spark, SF01).collect()}
    rows = queries.op6_language_id(spark, SF01).collect()
    assert len(rows) == len(langs)
    out = [r for r in rows if r.held_out]
    assert len(out) > 200 and sum(r.lang_pred == langs[r.doc_id] for r in out) / len(out) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5, 50))
    assert by[51].lang_pred == "en" and not by[None].held_out
    nothing = language.identify(odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1)).filter("doc_id = 0").replace("", None)).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert language.identify(no_docs).count() == 0


def test_pooling_does_not_depend_on_neighbours():
    net = gru.fresh(4, 3, 5)
    texts = [b"a" * 63, b"b" * 64, b"c" * 65, b"", b"xyz" * 100]
    together = language.pooled(net, texts)
    for text, row in zip(texts, together):
        assert np.allclose(language.pooled(net, [text])[0], row, atol=1e-5)
    assert np.allclose(together.sum(1), [1, 1, 1, 0, 1], atol=1e-4)


def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = queries.op3_quality_classifier(spark, SF01).collect()
    out = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(out) > 50 and sum(p == y for p, y in out) / len(out) >= 0.95
    assert all((r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 1), (51, 0), (51, 1), (None, 0), (999, 1), (6, None)], "doc_id long, quality int")
    rows = quality.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    empty = {r.score for r in rows if r.doc_id in (3, 4, 5, 50)}
    assert len(empty) == 1
    assert {r.score for r in quality.classify(odd_docs, labels.filter("false")).collect()} == {0.5}
    assert quality.classify(no_docs, labels).count() == 0


def test_updates_follow_a_plain_rule():
    """One coordinate, by hand: after one step the weight is -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2)."""
    w = quality.ftrl([(np.array([3]), np.array([1.0]), 1)], bits=3, rounds=1, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    g = 0.5 - 1
    assert np.isclose(w[3], -(g - np.sign(g) * 0.1) / ((1 + abs(g)) / 0.5 + 0.2)) and not w[[0, 1, 2, 4]].any()


def test_forms():
    assert [quality.form(t) for t in ("Abc", "ABC", "abc", "12", "a1", "!!", "#####")] == ["<capital>", "<upper>", "<lower>", "<number>", "<mixed>", "!!", "####"]
