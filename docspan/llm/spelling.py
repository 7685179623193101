"""Spelling variants: words one edit apart, found by a frontier that walks a distributed trie level by level.

Words of one length are a trie; its edges are a table (node, next characters, how many words lie below, the word if it is the only
one). A search state is (word, place in the word, node, edits). Each level joins all states with the edges of their nodes: an edge
with the word's next characters is followed, and once per word another character may stand for one or be put in. A state that
meets an edge with a single word below is decided at once, so the walk ends where words stop sharing beginnings. Edges are one
character long for the first levels; behind those every level is twice as long as the one before, so that very long words that
share very long parts need few more levels.

An edit lies in the second half of a word or, seen from the end, of the reversed word. So one trie is walked from the middle of
the words on and one from the middle of the reversed words on, and no state branches near a root. Removing a character from one
word is putting it into the other, and of two words that differ in one character the lesser one searches, so each pair is
looked for once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.operators.skew import HOT_ROWS, salted_join
from docspan.operators.storage import stored

LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A word's form is at least this many times as frequent.
TIMES = 5
#: A run whose checksum is a multiple of this loses one code point.
DAMAGED = 199
#: Levels whose edges are one character long.
SINGLE_LEVELS = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _cut(text: Column, start: Column | int, length: Column | int = 1 << 30) -> Column:
    """Code points from ``start`` (from 0) on."""
    return F.substr(text, (start if isinstance(start, Column) else F.lit(start)) + 1, length if isinstance(length, Column) else F.lit(length))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """word and n of all words of whole texts that are long and frequent enough.

    Words are the maximal runs of Latin letters, A-Z lower-cased; a run whose CRC-32 (of "<doc_id>:<run>") is a multiple of
    ``damaged`` loses the code point at that number modulo its length. A null text has no words, a null id is spelt as nothing.
    Counts are combined before the exchange, so a very common word is one row per task."""
    runs = F.split(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), f"[^{LETTERS}]+")
    long = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.filter(runs, lambda r: F.length(r) >= least_length)).alias("run"))
    hashed = long.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % damaged == 0, F.concat(_cut(F.col("run"), 0, at), _cut(F.col("run"), at + 1))).otherwise(F.col("run"))
    counts = hashed.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def _start(size: Column, side: Column) -> Column:
    """Depth at which the walk of a trie of words of one length begins."""
    half = F.floor((size - 1) / 2).cast("int")
    return F.when(side == 0, half).otherwise(size - half)


def _sides(words: DataFrame) -> DataFrame:
    return words.select(F.explode(F.array(
        F.struct(F.lit(0).cast("byte").alias("side"), F.col("word").alias("key")), F.struct(F.lit(1).cast("byte").alias("side"), F.reverse("word").alias("key"))
    )).alias("x")).select("x.side", "x.key", F.length("x.key").alias("size"))


def first_states(words: DataFrame) -> DataFrame:
    """Every word, from both ends, in the middle of the tries of its own length and of one character more."""
    both = _sides(words).withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    return both.select("side", "size", _cut(F.col("key"), 0, _start(F.col("size"), F.col("side"))).alias("node"), "key", F.lit(0).cast("byte").alias("edits"))


def reach(level: int) -> tuple[int, int]:
    """Characters between the start and a level, and length of its edges."""
    beyond = max(level - SINGLE_LEVELS, 0)
    return min(level, SINGLE_LEVELS) + (1 << beyond) - 1, 1 << beyond


def edges(words: DataFrame, level: int) -> DataFrame:
    """Edges of a level: side, size, node, step (the next characters), below, only (one word below)."""
    both, (before, length) = _sides(words), reach(level)
    depth = _start(F.col("size"), F.col("side")) + before
    at = both.filter(depth < F.col("size")).select("side", "size", _cut(F.col("key"), 0, depth).alias("node"), _cut(F.col("key"), depth, length).alias("step"), "key")
    return at.groupBy("side", "size", "node", "step").agg(F.count("*").alias("below"), F.min("key").alias("only"))


def step(states: DataFrame, of_level: DataFrame, hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """One level: the states' successors, and found where a state is decided."""
    met = salted_join(states, of_level, ["side", "size", "node"], hot_rows=hot_rows, rows=rows)
    key, ahead, depth = F.col("key"), F.col("step"), F.length("node")
    longer, fresh, alone = F.col("size") > F.length("key"), F.col("edits") == 0, F.col("below") == 1
    place = depth - (longer & ~fresh).cast("int")
    mine, left, right = _cut(key, place, F.length("step")), _cut(key, place), _cut(F.col("only"), depth)
    same = mine == ahead
    # strings of one length with one edit between them differ in one character
    replaced = ~longer & (ahead > mine) & (F.levenshtein(mine, ahead, 1) == 1)
    put_in = longer & (F.levenshtein(_cut(key, place, F.length("step") - 1), ahead, 1) == 1)
    decided = F.when(fresh, (longer | (left < right)) & (F.levenshtein(left, right, 1) == 1)).otherwise(left == right)
    moved = met.filter(F.when(alone, decided).otherwise(same | (fresh & (replaced | put_in))))
    return moved.select(
        "side", "size", F.concat("node", "step").alias("node"), "key", F.when(same, F.col("edits")).otherwise(F.lit(1)).cast("byte").alias("edits"),
        F.when(alone, F.col("only")).alias("found"),
    )


def near_words(words: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """a and b of every two different words of ``words`` (word, each once) that are one inserted, deleted or replaced code point
    apart, each pair once, in either order.

    Every level is written to the shared folder. Nodes that many states have reached are split into slices."""
    words = words.select("word")
    states, level, rows, parts = first_states(words), 0, None, []
    while True:
        done = stored(step(states, edges(words, level), hot_rows, rows), "frontier")
        parts.append(done.filter("found IS NOT NULL").select("side", "key", "found"))
        states = done.filter("found IS NULL").drop("found")
        rows, level = states.count(), level + 1
        if not rows:
            break
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    forward = F.col("side") == 0
    a, b = (F.when(forward, F.col(c)).otherwise(F.reverse(c)).alias(n) for c, n in (("key", "a"), ("found", "b")))
    return every.select(a, b).distinct()


def last_forms(links: DataFrame) -> DataFrame:
    """word and root (the end of its chain) of ``links`` (word, form), which have no cycles: every round doubles the steps."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, damaged: int = DAMAGED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """word, n, n_near (words one edit away), form (the most frequent of them, the least in code-point order of equally frequent ones,
    if it is ``times`` as frequent as the word; else null), form_n and root (where following forms ends; the word itself without one).

    See ``word_counts`` for nulls, empty texts and repeated rows, which count again. An empty table has no words. Other columns are
    not read. A form is more frequent than its word, so chains end, after as many steps as counts can grow ``times``-fold."""
    words = stored(word_counts(docs, least_length, least_count, damaged), "words")
    pairs = stored(near_words(words, hot_rows), "near-words")
    both = pairs.union(pairs.select("b", "a"))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    best = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("b"))).alias("best"))
    linked = words.join(best, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    formed = stored(linked.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    ), "forms")
    roots = last_forms(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
