import pytest

from docspan.functions.notes import RULES, required_literal
from docspan.operators import notes as N


def sections(spark, text):
    rows = N.note_sections(spark.createDataFrame([(1, text)], "note_id int, content string")).orderBy("section_order").collect()
    return {r.section_id: [b.text for b in r.blocks] for r in rows}


def classified(spark, *lines):
    blocks = spark.createDataFrame([(1, i, x, False) for i, x in enumerate(lines)], "note_id int, block_no int, text string, is_code boolean")
    return [(r.section_id, r.confidence) for r in N.classify_notes(blocks).orderBy("block_no").collect()]


def test_sections_come_in_rule_order(spark):
    text = "TODO: tidy up\n- GET /v1/items returns a list\n* Run yarn add ledger\n1. For example: ledger.run()\nThis service provides billing"
    assert list(sections(spark, text)) == ["overview", "installation", "usage", "api", "todo"]


def test_empty_and_blank_notes_have_no_sections(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " \n\t\n")], "note_id int, content string")
    assert N.note_sections(df).count() == 0
    assert {(r.block_count, r.categorised) for r in N.note_stats(df).collect()} == {(0, 0)}


def test_fences_keep_their_text_and_unclosed_ones_run_to_the_end(spark):
    df = spark.createDataFrame([(1, "a\r\n  ```ts\n  - x\n\n```\nb\n```\nc\n d")], "note_id int, content string")
    got = [(r.text, r.is_code) for r in N.segment_notes(df).orderBy("block_no").collect()]
    assert got == [("a", False), ("  ```ts\n  - x\n\n```", True), ("b", False), ("```\nc\n d", True)]


def test_very_long_fence_needs_no_deep_stack(spark):
    df = spark.createDataFrame([(1, "```\n" + "line\n" * 200_000 + "```\nafter")], "note_id int, content string")
    assert [r.is_code for r in N.segment_notes(df).orderBy("block_no").collect()] == [True, False]


def test_bullets_and_javascript_white_space_are_stripped(spark):
    df = spark.createDataFrame([(1, " - one \n12) two\n3. three\n• four\n-five")], "note_id int, content string")
    assert [r.text for r in N.segment_notes(df).orderBy("block_no").collect()] == ["one", "two", "three", "four", "-five"]


def test_ties_go_to_the_earlier_rule_and_nothing_is_overview(spark):
    # one keyword each of usage (1.0) and overview (1.0)
    assert classified(spark, "use purpose", "zzz") == [("overview", 1 / 3), ("overview", 0.0)]


def test_words_are_whole_and_edges_are_ascii(spark):
    assert classified(spark, "reuse", "use-case", "éprovides", "provides_x") == [
        ("overview", 0.0), ("overview", 0.0), ("overview", 0.5), ("overview", 0.0)]


def test_case_sensitive_patterns(spark):
    assert [s for s, _ in classified(spark, "set LEDGER_KEY", "set ledger_key", "get x", "GET x")] == ["configuration", "overview", "overview", "api"]


def test_confidence_is_capped(spark):
    assert classified(spark, "npm install: yarn add, pnpm add, docker setup requirements")[0] == ("installation", 1.0)


def test_literals_really_are_required():
    import re

    samples = ["this module", "provides", "npm i", "yarn add", "docker", "e.g. x", "to call", "a/b", "f( )", "x.env", "note: y", "only supports", "TODO", "accepts"]
    for rule in RULES:
        for pattern, ignore in rule.patterns:
            literal = required_literal(pattern)
            for s in samples:
                if re.search(pattern, s, re.I if ignore else 0):
                    assert literal.lower() in s.lower()


def test_patterns_of_a_users_own_rules_lose_no_match(spark):
    from pyspark.sql import functions as F

    from docspan.functions.notes import pattern_hit

    cases = [("todo|fixme", "a todo here"), (r"\bv\d+\b", "see v12 now"), ("ab{0,1}c", "xacx"), ("(a(b)c)d", "abcd")]
    for pattern, line in cases:
        col = F.lit(line)
        assert spark.range(1).select(pattern_hit(col, F.lower(col), pattern, True)).first()[0], pattern


def test_brackets_close_in_order(spark):
    from pyspark.sql import functions as F

    from docspan.functions.source import balanced

    for text, good in (("", True), ("f(a[0]) { g() }", True), ("x ) (", False), ("((", False), ("}{", False), ("plain", True)):
        assert spark.range(1).select(balanced(F.lit(text))).first()[0] is good, text


def test_rules_as_a_table(spark):
    """The fixed rules, read as rows, choose as the fixed expressions do; a user's rules need no plain patterns."""
    from docspan.functions.notes import RULES
    from docspan.operators import notes as N
    from docspan.operators import rules as R

    texts = ["Purpose: this service provides x", "PATCH /v2/a accepts", "TODO later", "", "plain", "what is a known issue", "foo() returns\n```\nuse\n```", "unknown issues doesn't e.g. run", "ENV_KEY .env"]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id int, content string")
    blocks = N.segment_notes(notes)
    want = {(r.note_id, r.block_no): (r.section_id, round(r.confidence, 9)) for r in N.classify_notes(blocks).collect()}
    got = R.classify_by_rules(blocks, R.as_table(spark, RULES)).collect()
    assert {(r.note_id, r.block_no): (r.section_id, round(r.confidence, 9)) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("pattern", "needed"), [
    ("billing|ledger", ""), (r"\bv\d{1,3}\b", "v"), ("((foo|npm) )+install", "install"), ("(abc){2,}", "abc"), ("(abc)?de", "de"), (r"a\.env\b", "a.env"),
    ("x*yz[ab]", "yz"), ("(?:long)er", "longer"), ("ab(?=cdef)", "ab"), ("(?i:abc)d", "d"), (r"\Qabc\E", ""), ("[", ""), ("straße", ""),
])
def test_text_that_every_match_holds(pattern, needed):
    from docspan.operators.rules import required_text

    assert required_text(pattern, True) == needed


def test_points_are_exact_and_limits_are_checked(spark, monkeypatch):
    from decimal import Decimal

    from docspan.operators import rules as R

    blocks = spark.createDataFrame([(1, 1, "alpha beta 77", False), (1, 2, "code", True), (1, 3, "", False), (2, 1, "beta", False)], "note_id int, block_no int, text string, is_code boolean")
    rows = [("a", "A", 1, Decimal("0.001"), ["alpha", "alpha", None, "pha be"], [(r"\d{2}", False)]), ("b", "B", 2, Decimal("0.0005"), ["beta"], [("al|be", True), ("bet+a", False)]),
            ("c", "C", 3, Decimal("0.002"), ["beta"], [(None, False)]), ("d", "D", 4, None, ["beta"], None)]
    rules = spark.createDataFrame(rows, R.SCHEMA)
    scores = {(r.note_id, r.block_no, r.rule_id): r.score for r in R.rule_scores(blocks, R.prepared(rules)).collect()}
    assert scores[1, 1, "a"] == Decimal("0.0035") and scores[2, 1, "b"] == Decimal("0.002") and scores[2, 1, "c"] == Decimal("0.002")
    got = {(r.note_id, r.block_no): (r.section_id, r.section_title, r.confidence) for r in R.classify_by_rules(blocks, rules).collect()}
    assert got[1, 1][0] == "a" and got[2, 1] == ("b", "B", 0.002 / 3) and got[1, 2] == ("a", "A", 0.6) and got[1, 3] == ("a", "A", 0.0)
    monkeypatch.setattr(R, "MOST_LOOSE", 0)
    with pytest.raises(ValueError, match="fixed text"):
        R.prepared(rules)
    with pytest.raises(ValueError, match="unique"):
        R.prepared(rules.union(rules))


def test_keys_of_phrases_and_patterns_are_found_without_all_pieces_of_a_line(spark):
    from pyspark.sql import functions as F

    from docspan.operators import rules as R

    keys = ("npm", "ins", "nst", "s a", "é b", "🙂 x", "a.b", "[-^", "aaa")
    lines = ["npm install", "aaaa", "this allé b", "🙂 x 🙂🙂 x", "a.b axb [-^ ^-[", "", "xy"]
    found = spark.createDataFrame(list(enumerate(lines)), "n int, t string").select("n", F.sort_array(F.array_distinct(F.regexp_extract_all("t", F.lit(R.any_of(keys)), F.lit(1)))).alias("k"))
    assert [r.k for r in found.orderBy("n").collect()] == [sorted(k for k in keys if k in t) for t in lines]
    rules = spark.createDataFrame([("a", "A", 1, 1, ["of the", "word"], [("instal+", True)])], "rule_id string, title string, rule_order int, weight int, keywords array<string>, patterns array<struct<pattern:string,ignore_case:boolean>>")
    blocks = spark.createDataFrame([(1, 1, "End of the INSTALL " + "prose " * 20000 + "word", False)], "note_id int, block_no int, text string, is_code boolean")
    scores = R.rule_scores(blocks, R.prepared(rules.withColumn("weight", F.col("weight").cast("decimal(18,6)"))))
    assert [(r.rule_id, float(r.score)) for r in scores.collect()] == [("a", 3.5)]
    assert "lower" not in scores._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # lines are read once for all kinds
