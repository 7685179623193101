"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

from docspan.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_pairs(words):
    words = sorted(words, key=len)
    return {frozenset((a, b)) for k, a in enumerate(words) for b in words[k + 1:] if len(b) - len(a) <= 1 and one_apart(a, b)}


def plain_groups(rows):
    counts = plain_counts(rows)
    near = {w: [] for w in counts}
    for a, b in map(tuple, plain_pairs(counts)):
        near[a].append(b)
        near[b].append(a)
    forms = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best and counts[best] >= 5 * counts[word]:
            forms[word] = best
    out = {}
    for word, n in counts.items():
        root = word
        while root in forms:
            root = forms[root]
        out[word] = (n, len(near[word]), forms.get(word), counts.get(forms.get(word)), root)
    return out


def as_dict(frame):
    rows = [tuple(r) for r in frame.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_registered_query(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    want = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert as_dict(queries.op12_spelling_groups(spark, sf_dir)) == want and any(v[2] for v in want.values())


def test_odd_and_empty_tables(odd_docs, no_docs):
    assert as_dict(spelling.spelling_groups(odd_docs)) == plain_groups([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert spelling.spelling_groups(no_docs).count() == 0


def test_chains_ties_and_letters(spark):
    texts = ["aaaaaa " * 125 + "aaaaab " * 25 + "aaaabb " * 5, "zebrax zebray " * 30 + "zebraz " * 6, "ÀÉÎõüÿ×÷ " * 5 + "Éabcde éabcde " * 7, "x" * 40 + " " + "y" * 9]
    docs = spark.createDataFrame([(10 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    got, want = as_dict(spelling.spelling_groups(docs)), plain_groups(rows)
    assert got == want
    assert got["aaaabb"][2] == "aaaaab" and got["aaaabb"][4] == "aaaaaa" and got["zebraz"][2] in ("zebrax", "zebray")
    assert got["Éabcde"][1] == 1 and "x" * 40 not in got


def test_every_pair_is_found_once(spark):
    """Few letters and long shared beginnings and ends, so that edits have several places and nodes many states; also sliced."""
    rng = random.Random(5)
    words = {"".join(rng.choices("ab", k=rng.randrange(6, 10))) for _ in range(150)}
    words |= {"aaab" * 8 + "".join(rng.choices("ab", k=3)) for _ in range(8)} | {"".join(rng.choices("aéb", k=3)) + "long" * 12 for _ in range(20)}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for hot in (1_000_000, 40):
        pairs = [frozenset((r.a, r.b)) for r in spelling.near_words(frame, hot_rows=hot).collect()]
        assert set(pairs) == plain_pairs(words) and len(pairs) == len(set(pairs))


def test_very_long_words(spark):
    base = "".join(random.Random(1).choices("abcdefgh", k=3000))
    words = [base, base[:2000] + base[2001:], base[:10] + "z" + base[10:], base + "q", "z" + base[1:]]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    assert {frozenset((r.a, r.b)) for r in spelling.near_words(frame).collect()} == plain_pairs(words)
