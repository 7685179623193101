"""Licences, fingerprints and quality rules against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docspan.llm import fingerprints, licences, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Some other words here.\n"
    "The above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY."
)


def plain_measures(text):
    words = WORD.findall(text)
    seen, mark = Counter(zip(words, words[1:], words[2:])), [False] * len(words)
    for i in range(len(words) - 2):
        if seen[tuple(words[i:i + 3])] > 1:
            mark[i:i + 3] = [True] * 3
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(mark)


def test_measures(spark, sf_dir, odd_docs):
    for docs in (queries.documents(spark, sf_dir), odd_docs):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, r.text or "")
        rows = quality_rules.quality_rules(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = plain_measures(texts[r.doc_id])
            assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.doc_id
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_frequent_lines(spark, no_docs):
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    notice = "Please ACCEPT 12 cookies  now and read on " + own("n", 50)
    rows = [(i, f"{notice}\n{own(i, 60)}", "a") for i in range(5)]  # five texts of host a hold the line
    rows += [(10 + i, f"{notice}\n{own(20, 8)}", "a") for i in range(3)]  # copies of one text, almost only the line
    rows += [(20, f"{notice}\n{own(20, 8)}", "b"), (21, f"{notice}\n{own(21, 8)}", None), (None, f"{notice}\n{own(22, 8)}", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    at = lambda limit: {(r.doc_id, r.source): r for r in quality_rules.quality_rules(docs, limit=limit, carry=("text", "source"), copies_once=True, spare_first=True).collect()}
    few = at(6)
    assert few[0, "a"].kept and few[0, "a"].removed_words == 0  # the first of the host keeps the line
    assert all(few[i, "a"].kept and few[i, "a"].removed_words == 58 and few[i, "a"].text == own(i, 60) for i in range(1, 5))
    assert not any(few[10 + i, "a"].kept for i in range(3)) and not few[None, "a"].kept
    assert few[20, "b"].kept and few[21, None].kept and few[20, "b"].text.startswith(notice)
    assert all(r.kept and not r.removed_words for r in at(7).values())  # seven different texts, copies counted once
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_every_document_counts(spark):
    """The plain method: all documents of a host that hold a frequent line lose it, copies and the first one too."""
    own = lambda i, n: " ".join(f"{'abcdefghijklmn'[int(i, 36) % 14 if isinstance(i, str) else i]}x{k}" for k in range(n))
    notice = "Read  this\tNotice 77 " + own("n", 20)
    texts = [f"{notice}\n{own(i, 60)}\n\n{notice}\nend {"xyz"[i]}" for i in range(3)] + [f"{notice}\n{own(9, 60)}"] * 3 + [own(5, 70)]
    docs = spark.createDataFrame([(i, t, "a", "k") for i, t in enumerate(texts)], "doc_id long, text string, source string, lines string")
    docs = docs.union(docs.filter("doc_id = 6"))  # a repeated row is one document
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, limit=2, carry=("text", "lines")).collect()}
    assert [got[i].text for i in range(3)] == [f"{own(i, 60)}\n\nend {"xyz"[i]}" for i in range(3)] and all(got[i].removed_words == 48 and got[i].kept and got[i].lines == "k" for i in range(3))
    assert not any(got[i].kept or got[i].text for i in range(3, 6)) and got[6].kept and not got[6].removed_words
    assert all(r.kept and not r.removed_words for r in quality_rules.quality_rules(docs, limit=6).collect())


def test_registered_rules_equal_their_sql(spark, sf_dir):
    from docspan.plans.compare import compare, duck

    for name, sql in queries.ORACLES.items():
        problem, rows, *_ = compare(spark, sf_dir, name, queries.QUERIES[name], sql, duck(sf_dir))
        assert problem is None and rows, (name, problem)


def plain_likeness(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def test_edited_fingerprints(spark, sf_dir, odd_docs):
    for docs, parts in ((queries.documents(spark, sf_dir), 7), (odd_docs, 4), (odd_docs, 1)):
        ordered = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), reverse=True)
        got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edited_fingerprints(docs, 8, parts).collect())
        want = Counter()
        for k, (has, i, text) in enumerate(ordered):
            after, n = ordered[(k + 1) % len(ordered)][2], len(text) // 3
            edited = text[:len(text) - n] + after[:n]
            want[i if has else None, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
        assert got == want


def test_likeness_estimates_weighted_jaccard(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:30] * 2), " ".join(words[10:] + words[10:20] * 3), " ".join(words), "", None, "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs, 256).collect()}
    assert marks[0] == marks[3] and marks[4] == marks[5] == "empty"
    one = spark.range(1)
    like = lambda a, b: one.select(fingerprints.likeness(F.lit(marks[a]), F.lit(marks[b]), 256)).first()[0]
    for a in (0, 1, 2, 6):
        for b in (0, 1, 2, 6):
            assert abs(like(a, b) - plain_likeness(texts[a], texts[b])) < 0.12
    assert like(4, 5) == 1 and like(4, 0) == 0


def test_samples_compute_each_logarithm_once(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, " "), (3, None)], "doc_id long, text string")
    marks = fingerprints.fingerprints(docs, 2)
    # below a condition Spark computes a repeated hash or logarithm again wherever it stands
    assert "min(CASE" not in marks._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.fingerprint for r in marks.collect()} == {1: "671e9a3abddfaf86", 2: "empty", 3: "empty"}


def test_single_document_follows_itself(spark, no_docs):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.edited_fingerprints(no_docs).count() == 0 and fingerprints.fingerprints(no_docs).count() == 0


@pytest.mark.parametrize(("text", "licence", "sequence"), [
    (MIT, "MIT", "mit-grant mit-notice asis-warranty"),
    ("Released under the MIT License.", "MIT", "mit"),
    ("Lorem.\nLicensed under the Apache Licence, Version 2.0. You may not use this file except in compliance with the License.", "Apache-2.0", "apache2 apache-condition"),
    ("under the GNU General Public License, version 3 of the License; or (at your option) any later version.", "GPL-3.0-or-later", "gpl3 later-option"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", "gpl3"),
    ("Licensed under CC BY-NC 4.0. Released under the MIT License. Released under the MIT License.", "CC-BY-NC-4.0 AND MIT", "cc-by-nc-4 mit mit"),
    ("# SPDX-License-Identifier: BSD-3-Clause\ncode", "BSD-3-Clause", "spdx-bsd-3-clause"),
    ("A licence of some kind applies.", "", "unknown"),
    ("the warrior liked his islands", "", ""), ("", "", ""), (None, "", ""),
])
def test_licences(spark, text, licence, sequence):
    row = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.licence, row.sequence) == (licence, sequence)
    assert row.n_unknown == sequence.split().count("unknown")


def test_licences_of_odd_rows(odd_docs, no_docs):
    assert licences.scan(odd_docs).count() == odd_docs.count() and licences.scan(no_docs).count() == 0
