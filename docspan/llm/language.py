"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text; a document's probabilities are the means over its bytes. Texts are cut into
windows, so tasks run thousands of windows side by side, whatever the lengths of the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspan.llm.batches import slices, strings
from docspan.llm.gru import Network, probabilities, train
from docspan.operators.storage import stored

UNKNOWN = "und"
WINDOW = 64
#: Windows that a task runs side by side.
TILE = 4096
#: Bounds of the training sample: documents per language, windows per document.
SAMPLE_DOCUMENTS = 256
SAMPLE_WINDOWS = 8


def fold(doc_id: str, folds: int) -> Column:
    """CRC-32 of the id's decimal text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def sample_windows(docs: DataFrame, labels: Column, per_label: int, per_document: int) -> DataFrame:
    """At most ``per_label`` documents of each label by the order of a hash of the id, and of each at most ``per_document``
    evenly spread windows: rows (label, window). The ranking runs on ids alone and is cut in every task first."""
    marked = docs.select("doc_id", labels.alias("label")).filter("label IS NOT NULL AND doc_id IS NOT NULL")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = marked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_label).select("doc_id", "label")
    chosen = stored(ranked, "language-sample")  # of known small size: the texts need no exchange to meet it

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for label, text in zip(frame.label, frame.text):
                data = text.encode()
                spots = np.unique(np.linspace(0, max(0, len(data) - WINDOW), per_document).astype(int)) if data else []
                rows += [(label, data[s:s + WINDOW]) for s in spots]
            yield pd.DataFrame(rows, columns=["label", "window"])

    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    return texts.join(chosen, "doc_id").select("label", "text").mapInPandas(cut, "label string, window binary")


def fit(windows: DataFrame, hidden: int = 8, rounds: int = 120, batch: int = 256, rate: float = 0.05, seed: int = 7) -> tuple[list[str], Network | None]:
    """Languages in order and the network. The sample is bounded by its parameters, so the driver may hold it; it is
    sorted first, so the same rows give the same network. No windows: no languages and no network."""
    rows = sorted((r.label, bytes(r.window)) for r in windows.collect())
    names = sorted({label for label, _ in rows})
    if not names:
        return [], None
    data, lengths = as_windows([w for _, w in rows])
    labels = np.asarray([names.index(label) for label, _ in rows])
    return names, train(data, lengths, labels, len(names), hidden, rounds, batch, rate, seed)


def as_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts (window, time), the last of each padded with zeros, and the bytes in each."""
    counts = [-(-len(t) // WINDOW) for t in texts]
    data = np.frombuffer(b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts)), np.uint8).reshape(-1, WINDOW)
    lengths = np.full(len(data), WINDOW)
    ends = np.cumsum(counts)
    for t, n, end in zip(texts, counts, ends):
        if n:
            lengths[end - 1] = len(t) - (n - 1) * WINDOW
    return data, lengths


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities over all bytes of each text; zeros for an empty one."""
    data, lengths = as_windows(texts)
    owner = np.repeat(np.arange(len(texts)), [-(-len(t) // WINDOW) for t in texts])
    sums = np.zeros((len(texts), len(net.bias)))
    for at in range(0, len(data), TILE):
        part = slice(at, at + TILE)
        mask = np.arange(WINDOW)[:, None] < lengths[part][None, :]
        own = probabilities(net, data[part].T.astype(np.intp), mask).sum(0)
        for k in range(sums.shape[1]):
            sums[:, k] += np.bincount(owner[part], own[:, k], len(texts))
    return sums / np.maximum(np.asarray([[len(t)] for t in texts]), 1)


def predict(docs: DataFrame, names: list[str], net: Network | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (pooled probability of that language) of every whole text, and the columns named in ``carry``.

    A null or empty text, or one without any letter, is ``und`` with score 0, and so is every text when nothing was learned.
    Repeated rows give repeated results; other columns are not read."""
    rest = [c for c in carry if c != "doc_id"]
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("_text"), *rest)
    schema = "".join(f", `{c}` {plain.schema[c].dataType.simpleString()}" for c in rest)
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = strings(batch, "_text")
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if names and any(map(str.isalpha, t))]
            if rows:
                p = pooled(model.value, [texts[i].encode() for i in rows])
                best = p.argmax(1)
                scores[rows] = np.clip(p[np.arange(len(rows)), best], 0, 1)
                for i, k in zip(rows, best):
                    langs[i] = names[k]
            found = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*found, *(batch.column(c) for c in rest)], ["doc_id", "lang_pred", "score", *rest])

    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double" + schema)


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1, per_label: int = SAMPLE_DOCUMENTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Learns from the text and lang of documents outside the held-out fold and predicts all: doc_id, held_out, lang_pred,
    score and the columns named in ``carry``. Rows with a null lang, null text or null id teach nothing; a null id is not held out."""
    learned = F.when(fold("doc_id", folds) != held_out, F.col("lang"))
    names, net = fit(sample_windows(docs, learned, per_label, SAMPLE_WINDOWS))
    out = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False))
    rest = [c for c in carry if c != "doc_id"]
    return predict(docs, names, net, carry).select("doc_id", out.alias("held_out"), "lang_pred", "score", *rest)
