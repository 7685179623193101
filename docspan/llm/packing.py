"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces of 2^k ids, the largest allowed length first and then the binary digits of the
rest. Every piece is a sequence of its own, so no sequence crosses documents and none is padded; sequences of equal length
form a bucket, from which a loader draws batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.batches import SLICE_BYTES, lists, slices, strings
from docspan.llm.tokens import Vocabulary, WordTokens

LONGEST = 2048
END = 1
SCHEMA = "doc_id long, start long, length long, doc_tokens long"


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that sum to ``n``, descending, none above ``longest`` (itself a power of two)."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def checksums(values: np.ndarray, lengths: Iterable[int]) -> pa.Array:
    """CRC-32 of consecutive runs of ids, each as little-endian unsigned 32-bit integers."""
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    raw = memoryview(np.ascontiguousarray(values, dtype="<u4")).cast("B")
    return pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], pa.int64())


def pack(
    docs: DataFrame, path: str, longest: int = LONGEST, end: int = END, digest: bool = False, remembered: int | None = None, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length, doc_tokens, ids, bucket (log2 of the length),
    sequence_id, offset (always 0: a piece is a whole sequence). With ``digest``, ids_crc32 stands in place of ids: the ids
    of a piece are summed up where they are cut and never leave the worker.

    A null text counts as empty: its one id is the end id. Repeated rows and equal ids are packed once per row. A
    sequence_id is unique; it numbers the rows of each task, so a repeated task may give other numbers but no number twice.
    Other columns of the input are not read. ``path`` names a tokenizers file; no row is exchanged.

    A worker cuts texts of about ``slice_bytes`` at a time and remembers ids of pieces in two generations of ``remembered``
    bytes (the module's usual size if none is given): less of either takes less memory and more time, and changes no row."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    vocabulary = Vocabulary.file(docs.sparkSession, path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.load(WordTokens, remembered)
        last = np.asarray([end], dtype="<u4").tobytes()
        for batch in slices(batches, "text", slice_bytes):
            ids = [np.frombuffer(own + last, dtype="<u4") for own in tokens.many(strings(batch, "text"))]
            pieces = [piece_lengths(len(x), longest) for x in ids]
            counts = [len(p) for p in pieces]
            lengths = np.asarray([n for p in pieces for n in p], dtype=np.int64)
            starts = np.concatenate([np.cumsum([0, *p[:-1]]) for p in pieces])
            rows = np.repeat(np.arange(len(ids)), counts)
            every = np.concatenate(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)), pa.array(starts, pa.int64()), pa.array(lengths),
                    pa.array(np.asarray([len(x) for x in ids], dtype=np.int64)[rows]),
                    checksums(every, lengths) if digest else lists(every.astype(np.int32), lengths, pa.int32()),
                ],
                ["doc_id", "start", "length", "doc_tokens", content],
            )

    content, kind = ("ids_crc32", "long") if digest else ("ids", "array<int>")
    cuts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, f"{SCHEMA}, {content} {kind}")
    return cuts.select(
        "*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences in one folder per length (at most twelve for the usual longest length), ready for a loader."""
    packed.write.partitionBy("bucket").parquet(path)
