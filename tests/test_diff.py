import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docspan.functions import lcs
from docspan.operators import diff as D


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t


def script(old, new):
    """Textbook walk over the whole table: equal lines match, deletion wins ties."""
    a, b = old.split("\n"), new.split("\n")
    t, i, j, out = table(a, b), 0, 0, []
    while i < len(a) or j < len(b):
        left, right = i < len(a), j < len(b)
        if left and right and a[i] == b[j]:
            i, j = i + 1, j + 1
            out.append((lcs.CONTEXT, i, j))
        elif left and (not right or t[i + 1][j] >= t[i][j + 1]):
            i += 1
            out.append((lcs.DEL, i, 0))
        else:
            j += 1
            out.append((lcs.ADD, 0, j))
    return out


texts = st.lists(st.sampled_from(["a", "b", "c", "", "x"]), min_size=1, max_size=14).map("\n".join)


@given(texts, texts, st.sampled_from([4_000_000, 0]))
@settings(max_examples=400, deadline=None)
def test_script_is_the_delete_first_one(old, new, keep):
    before, lcs.KEEP_ALL_CELLS = lcs.KEEP_ALL_CELLS, keep
    try:
        assert list(zip(*lcs.edit_script(old, new))) == script(old, new)
        assert lcs.lcs_length(*lcs.line_ids(old, new)) == table(old.split("\n"), new.split("\n"))[0][0]
    finally:
        lcs.KEEP_ALL_CELLS = before


def pairs(spark, *rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "pair int, from_content string, to_content string")


def test_rows_rebuild_both_texts_and_agree_with_the_statistics(spark):
    r = random.Random(7)
    rows = [("\n".join(r.choice("abcde") for _ in range(r.randint(1, 30))), "\n".join(r.choice("abcde") for _ in range(r.randint(1, 30)))) for _ in range(60)]
    rows += [("same\ntext", "same\ntext"), (None, "x"), ("x", None), (None, None), ("", "x")]
    df = pairs(spark, *rows)
    lines = D.diff_lines(df).orderBy("pair", "line_no").collect()
    stats = {s.pair: s for s in D.diff_stats(df).collect()}
    delta = {s.pair: s for s in D.line_delta(df).collect()}
    for i, (old, new) in enumerate(rows):
        mine = [x for x in lines if x.pair == i]
        assert "\n".join(x.text for x in mine if x.op != "add") == (old or "")
        assert "\n".join(x.text for x in mine if x.op != "del") == (new or "")
        assert [x.old_line for x in mine if x.op != "add"] == list(range(1, len((old or "").split("\n")) + 1))
        assert stats[i].additions == sum(x.op == "add" for x in mine) and stats[i].deletions == sum(x.op == "del" for x in mine)
        assert delta[i].additions <= stats[i].additions and delta[i].deletions <= stats[i].deletions


def test_empty_against_one_line_deletes_before_it_adds(spark):
    got = [(x.op, x.text, x.old_line, x.new_line) for x in D.diff_lines(pairs(spark, ("", "x"))).orderBy("line_no").collect()]
    assert got == [("del", "", 1, None), ("add", "x", None, 1)]


@pytest.mark.parametrize("n", [3000])
def test_long_texts_stay_exact(n):
    old = "\n".join(f"line {i % 700}" for i in range(n))
    new = "\n".join(f"line {i % 700}" for i in range(n) if i % 10)
    ops, _, _ = lcs.edit_script(old, new)
    assert ops.count(lcs.CONTEXT) == lcs.lcs_length(*lcs.line_ids(old, new)) >= n - n // 10
