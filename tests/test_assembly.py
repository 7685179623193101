from pyspark.sql import functions as F

from docspan.operators import assembly as A


def inputs(spark, n_files=23):
    docs = spark.createDataFrame([(1, "Ledger", "org/ledger", None), (2, "Empty", None, "abc")], "doc_id int, title string, source_repo string, source_commit string")
    notes = spark.createDataFrame([(1, "- Run npm install ledger\n```\nx\n\n\n\ny\n```\nTODO later")], "doc_id int, content string")
    files = [(1, i, i, f"f{i}.ts", f"export function f{i}(a: number): void {{ return process.env.K{i % 4}; }}\n" if i % 6 else "broken (") for i in range(n_files)]
    return docs, notes, spark.createDataFrame(files, "doc_id int, file_no int, file_id int, file_name string, content string")


def compose(spark, width):
    at = F.lit("2024-03-05 06:07:08").cast("timestamp")
    rows = A.compose(*inputs(spark), at, width=width).orderBy("doc_id", "piece_no").collect()
    return {d: [r.content for r in rows if r.doc_id == d] for d in (1, 2)}


def test_pieces_put_together_are_the_document(spark):
    whole, cut = compose(spark, 1000), compose(spark, 2)
    assert len(whole[1]) == 1 and len(cut[1]) > 3
    assert "".join(cut[1]) == whole[1][0] and cut[2] == whole[2]


def test_document_text(spark):
    doc = compose(spark, 1000)
    assert doc[2] == ["# Empty\n\n> Generated by docspan · Tue, 05 Mar 2024 06:07:08 GMT\n\n---\n\n<sub>Generated Tue, 05 Mar 2024 06:07:08 GMT · Commit: `abc`</sub>\n"]
    text = doc[1][0]
    assert "## Installation\n\n- Run npm install ledger\n\n## Usage\n\n```\nx\n\ny\n```\n\n## TODO\n\n- TODO later\n\n## Configuration" in text
    assert "| Variable | Notes |\n| --- | --- |\n| `K0` | |\n| `K1` | |\n| `K2` | |\n| `K3` | |\n\n## API Reference\n\nParsed **19** file(s): 19 function(s)" in text
    assert "- ⚠ Could not parse `f0.ts`: Unbalanced brackets\n- ⚠ Could not parse `f6.ts`" in text
    assert "\n\n\n" not in text and text.endswith("Source: `org/ledger` · Commit: _pending first save_</sub>\n")
    assert "**Returns" not in text and "| `a` | number | yes |  |" in text


def test_merge_without_either_text_is_an_error(spark):
    docs = spark.createDataFrame([(1, "T"), (2, "T")], "doc_id int, title string")
    heads = spark.createDataFrame([(1, " # Real\n\n\n\ntext ")], "doc_id int, head string")
    texts = spark.createDataFrame([(1, "### f\n")], "doc_id int, unit_text string")
    units = spark.createDataFrame([(1, "f"), (1, "g")], "doc_id int, name string")
    r = {x.doc_id: x for x in A.merge_generated(heads, texts, docs, units).collect()}
    assert r[1].content.startswith("# Real\n\ntext\n\n---\n\n## API Reference\n\n### f\n\n> ⚠️ **Incomplete documentation:** 1 of 2")
    assert r[1].derived_title == "Real" and r[2].content is None and r[2].error
