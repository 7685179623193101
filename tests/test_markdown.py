from docspan.operators import markdown as M


def tokens(spark, text):
    rows = M.md_tokens(spark.createDataFrame([(1, text)], "doc_id int, content string")).orderBy("token_no").collect()
    out = []
    for r in rows:
        value = {"heading": (r.level, r.text), "code": (r.lang, r.text), "list": r["items"], "table": r.rows}.get(r.type, r.text)
        out.append((r.type, value))
    return out


def test_blocks(spark):
    text = "# Title\r\n\r\n> one\n>two\n- a\n  * b \n\ntext\nmore \n| x | y |\n|---|:-:|\n| 1 | 2 |\n---\n```js \n# raw\n\n```\n####### deep"
    assert tokens(spark, text) == [
        ("heading", (1, "Title")), ("quote", "one"), ("quote", "two"), ("list", ["a", "b"]), ("paragraph", "text more"),
        ("table", [["x", "y"], ["1", "2"]]), ("hr", None), ("code", ("js", "# raw\n")), ("paragraph", "####### deep")]


def test_fences_look_at_the_untrimmed_line_and_may_stay_open(spark):
    assert tokens(spark, " ```\na\n```\n- x\n\n") == [("paragraph", "``` a"), ("code", ("", "- x\n\n"))]
    assert tokens(spark, "```\n```") == [("code", ("", ""))]
    assert tokens(spark, "```py") == [("code", ("py", ""))]


def test_rules_below_paragraph_text_join_it_unless_bare_dashes(spark):
    assert tokens(spark, "text\n***\nmore") == [("paragraph", "text *** more")]
    assert tokens(spark, "text\n --- \nmore") == [("paragraph", "text --- more")]
    assert tokens(spark, "text\n---\nmore") == [("paragraph", "text"), ("hr", None), ("paragraph", "more")]
    assert tokens(spark, "***\n --- ") == [("hr", None), ("hr", None)]


def test_tables_start_where_a_separator_follows(spark):
    assert tokens(spark, "| a |\n| b |\n|---|\n| c |") == [("paragraph", "| a |"), ("table", [["b"], ["c"]])]


def test_lines_no_rule_takes_stand_alone(spark):
    assert tokens(spark, "text\n| a\nmore") == [("paragraph", "text"), ("paragraph", "| a"), ("paragraph", "more")]
    assert [t for t, _ in tokens(spark, "# a\rb\nnext")] == ["paragraph", "paragraph"]


def test_nothing(spark):
    assert tokens(spark, "") == tokens(spark, None) == tokens(spark, " \n\t\n") == []


def test_long_paragraphs_and_lists_need_no_deep_stack(spark):
    assert len(tokens(spark, "word\n" * 100_000)[0][1]) == 5 * 100_000 - 1
    assert len(tokens(spark, "- item\n" * 100_000)[0][1]) == 100_000


def test_completeness_and_missing_units(spark):
    docs = spark.createDataFrame([(1, "### `f` — GET /x\n\n### g\ntext\n")], "doc_id int, content string")
    units = spark.createDataFrame([(1, "f"), (1, "g"), (1, "h")], "doc_id int, name string")
    assert [r.name for r in M.missing_units(units, M.md_tokens(docs)).collect()] == ["h"]
    r = M.completeness(units, docs).collect()[0]
    assert (r.unit_count, r.documented_count) == (3, 2) and "2 of 3 functions" in r.warning
