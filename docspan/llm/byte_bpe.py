"""Byte-level BPE: text to ids with byte and character offsets, and ids back to bytes and text."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.batches import lists, slices, strings
from docspan.llm.tokens import ByteTokens, Vocabulary, byte_level_json, read_ranks


def character_spans(text: bytes, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last code point that each token touches, from the tokens' byte widths. Two tokens that share a
    split character both touch it."""
    ends = np.cumsum(widths)
    starts = ends - widths
    leads = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    of_byte = np.cumsum(leads) - 1
    return of_byte[starts].astype(np.int32), (of_byte[ends - 1] + 1).astype(np.int32)


def encode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """doc_id and ids of every whole text, as the rank file and the splitting pattern give them; with ``offsets`` also
    char_start and char_end per id (code points).

    A null text counts as empty and has no ids. Special tokens do not exist: their strings are ordinary text. Repeated
    rows give repeated results; other columns are not read."""
    ranks = read_ranks(ranks_path)
    vocabulary = Vocabulary.of(docs.sparkSession, byte_level_json(ranks, pattern))
    width = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
    for token, rank in ranks.items():
        width[rank] = len(token)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.load(ByteTokens)
        for batch in slices(batches, "text"):
            texts = strings(batch, "text")
            ids = [np.frombuffer(own, dtype="<u4").astype(np.int32) for own in tokens.many(texts)]
            sizes = [len(x) for x in ids]
            columns = {"doc_id": batch.column("doc_id"), "ids": lists(np.concatenate(ids), sizes, pa.int32())}
            if offsets:
                spans = [character_spans(t.encode(), width[x]) if len(x) else (x, x) for t, x in zip(texts, ids)]
                columns["char_start"] = lists(np.concatenate([s for s, _ in spans]), sizes, pa.int32())
                columns["char_end"] = lists(np.concatenate([e for _, e in spans]), sizes, pa.int32())
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    schema = "doc_id long, ids array<int>" + ", char_start array<int>, char_end array<int>" * offsets
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and decoded (the bytes of all ids, joined). A character that several ids share is whole again in the
    bytes. Null ids decode to no bytes; an id outside the table is an error."""
    table = [token for token, _ in sorted(read_ranks(ranks_path).items(), key=lambda x: x[1])]
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                piece = batch.slice(part, 512)
                texts = [b"".join(map(token, x)) if x else b"" for x in piece.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by one space) and decoded_sha256 (of the bytes that the ids
    spell): ``encode`` and ``decode`` in one pass, so that no id leaves the task. The same rows and cases as ``encode``."""
    ranks = read_ranks(ranks_path)
    vocabulary = Vocabulary.of(docs.sparkSession, byte_level_json(ranks, pattern))
    table = docs.sparkSession.sparkContext.broadcast([token for token, _ in sorted(ranks.items(), key=lambda x: x[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, token = vocabulary.load(ByteTokens), table.value.__getitem__
        for batch in slices(batches, "text"):
            counts, ids, texts = [], [], []
            for own in tokens.many(strings(batch, "text")):
                number, decoded = np.frombuffer(own, dtype="<u4"), hashlib.sha256()
                decimal = hashlib.sha256()
                for at in range(0, len(number), 1 << 16):  # a long text needs no list of all its ids
                    part = number[at:at + (1 << 16)].tolist()
                    decimal.update((" " * (at > 0) + " ".join(map(str, part))).encode())
                    decoded.update(b"".join(map(token, part)))
                counts.append(len(number))
                ids.append(decimal.hexdigest())
                texts.append(decoded.hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_texts(ids: list[int], table: list[bytes]) -> list[str]:
    """Text that becomes readable with each id: bytes of an unfinished character wait for the id that ends it."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    out = [reader.decode(table[i]) for i in ids]
    if ids:
        out[-1] += reader.decode(b"", True)
    return out
