"""Every stage of the corpus pipeline on odd and on given rows."""

import corpus_pipeline
from docspan.llm import simhash
from test_groups import plain_base, plain_roots, plain_simhash
from test_native import plain_measures


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    judged = stages["quality rules"](spark, docs, sf_dir)
    assert judged.columns == list(corpus_pipeline.COLUMNS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {i for i, t in texts.items() if (m := plain_measures(t or ""))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    judged = judged.cache()
    assert {r.doc_id for r in judged.collect()} == good  # no line is frequent in so few documents
    spoken = stages["language id"](spark, judged, sf_dir).cache()
    assert len({r.doc_id for r in spoken.collect()}) >= 0.98 * len(good)
    single = stages["simhash near-dedup"](spark, spoken, sf_dir).cache()
    codes = {r.doc_id: plain_simhash(r.text) for r in spoken.collect()}
    ids = sorted(codes)
    roots = plain_roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (codes[a] ^ codes[b]).bit_count() <= simhash.MAX_BITS])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(roots.values()))
    masked = stages["secret scans"](spark, single, sf_dir).cache()
    assert masked.count() == single.count()
    assert all(not plain_base(r.text) and r.n_chars == len(r.text) for r in masked.collect())
    packed = stages["packing"](spark, masked, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in masked.collect()}


def test_run_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert rows.columns[:4] == ["doc_id", "start", "length", "doc_tokens"] and rows.count() >= 0
