"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's tokens are its words and its runs of other signs. Each token also has a form (lower, capital, upper, number, the
sign itself, or the same as the token before), so that junk is known by its look and not only by its words. One- and
two-token n-grams of both sequences are hashed into a table of fixed size; a score is a sparse dot product."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.batches import lists, slices, strings
from docspan.operators.storage import stored

BITS = 18
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: At most so many labelled documents, by the order of a hash of the id, are fitted on the driver.
SAMPLE_DOCUMENTS = 4000
#: Tokens a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Shares of the FNV-1a prime and of the golden ratio; they spread pairs over the table.
_PAIR, _KIND = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def form(token: str) -> str:
    """How a token looks; signs stand for themselves."""
    if not token[0].isalnum():
        return token[:4]
    if token.isdigit():
        return "<number>"
    if any(c.isdigit() for c in token):
        return "<mixed>"
    if len(token) > 1 and token.isupper():
        return "<upper>"
    return "<capital>" if token[0].isupper() else "<lower>"


class Features:
    """Hashed n-grams of texts, with the hashes of tokens remembered."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.table: dict[str, tuple[int, int]] = {}
        self.repeat = zlib.crc32(b"<again>")

    def _codes(self, tokens: list[str]) -> np.ndarray:
        if len(self.table) > REMEMBERED:
            self.table.clear()
        for t in set(tokens).difference(self.table):
            self.table[t] = zlib.crc32(t.lower().encode()), zlib.crc32(form(t).encode())
        return np.asarray([self.table[t] for t in tokens], dtype=np.uint64).reshape(-1, 2)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted slots and their values; values have unit length. Slot 0 is the constant of every text."""
        codes = self._codes(TOKEN.findall(text))
        if not len(codes):
            return np.zeros(1, np.int32), np.ones(1, np.float32)
        words, forms = codes[:, 0], codes[:, 1].copy()
        forms[1:][words[1:] == words[:-1]] = self.repeat
        hashes = np.concatenate([
            words * _KIND, (words[:-1] * _PAIR ^ words[1:]) * _KIND + np.uint64(1),
            forms * _KIND + np.uint64(2), (forms[:-1] * _PAIR ^ forms[1:]) * _KIND + np.uint64(3),
        ])
        slots, counts = np.unique((hashes ^ hashes >> np.uint64(29)) & self.mask, return_counts=True)
        values = (counts / len(codes)).astype(np.float32)
        values /= np.sqrt((values * values).sum())
        return np.concatenate([[0], slots]).astype(np.int32), np.concatenate([[1.0], values]).astype(np.float32)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, rounds: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> np.ndarray:
    """Weights after per-coordinate follow-the-regularised-leader updates over ``rows`` (slots, values, label), the rarer
    label weighted up to half of the usual balance so that scores stay close to probabilities."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    ones = sum(y for *_, y in rows)
    weight = {1: 1.0, 0: max(1.0, (ones / max(1, len(rows) - ones)) ** 0.5)}

    def weights(slots: np.ndarray) -> np.ndarray:
        own = z[slots]
        w = -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[slots])) / alpha + l2)
        return np.where(np.abs(own) <= l1, 0.0, w)

    for _ in range(rounds):
        for slots, values, label in rows:
            w = weights(slots)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * weight[label] * values
            z[slots] += g - (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha * w
            n[slots] += g * g
    return weights(np.arange(1 << bits)).astype(np.float32)


def features(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, slots, features of every whole text; null and empty texts have the constant slot only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(bits).of
        for batch in slices(batches, "text"):
            found = [of(t) for t in strings(batch, "text")]
            sizes = [len(s) for s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists(np.concatenate([s for s, _ in found]), sizes, pa.int32()), lists(np.concatenate([v for _, v in found]), sizes, pa.float32())],
                ["doc_id", "slots", "features"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, slots array<int>, features array<float>")


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCUMENTS, bits: int = BITS) -> np.ndarray | None:
    """Weights learned from ``labels`` (doc_id, label 0 or 1). At most ``limit`` labelled ids are used, the first by a hash;
    a document labelled more than once counts with its lowest label. None where no labelled document exists."""
    lowest = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = stored(lowest.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), "quality-sample")  # of known small size: texts are not exchanged
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id")
    labelled = features(texts.select("doc_id", "text"), bits).join(chosen, "doc_id")
    rows = sorted(labelled.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.slots))
    if not rows:
        return None
    return ftrl([(np.asarray(r.slots), np.asarray(r.features, dtype=np.float64), r.label) for r in rows], bits)


def score(docs: DataFrame, weights: np.ndarray | None, bits: int = BITS) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; 0.5 where nothing was learned. Empty texts get the constant's score.
    Repeated rows give repeated results; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(np.zeros(1 << bits, np.float32) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, w = Features(bits).of, shared.value
        for batch in slices(batches, "text"):
            margins = [float(w[slots] @ values) for slots, values in map(of, strings(batch, "text"))]
            scores = 1 / (1 + np.exp(-np.clip(np.asarray(margins), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """Learns from labelled rows (doc_id, quality) outside the held-out fold and scores all: doc_id, held_out, score,
    predicted. A null id teaches nothing and is not held out."""
    in_fold = F.crc32(F.col("doc_id").cast("string")) % folds == held_out
    weights = fit(docs, labels.filter(~in_fold).select("doc_id", F.col("quality").alias("label")))
    return score(docs, weights).select(
        "doc_id", F.coalesce(in_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
