"""Token ids in files of directly addressable codes.

A file row is a segment: ids of consecutive documents, split into 8-bit chunks by level. Level 0 holds the low chunk of
every id; a bitmap marks the ids that go on, whose next chunks form level 1, and so on. A rank directory counts the marks
before every 512th position, so the place of any id in the next level is one look-up and one popcount of at most 64 bytes:
any token is read without decoding what lies before it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspan.llm.batches import lists, slices, strings
from docspan.llm.packing import checksums
from docspan.llm.tokens import Vocabulary, WordTokens

MAGIC = b"DAC1"
END = 2
#: Ids in a segment before the next document starts a new one.
SEGMENT_IDS = 1 << 20
RANK_STEP = 512
SCHEMA = "part int, segment int, base long, n_tokens long, doc_ids array<long>, doc_starts array<long>, codes binary"


def encode_codes(ids: np.ndarray) -> bytes:
    """Magic, number of levels, then per level: number of chunks, chunks, bitmap, rank directory (the last level has
    chunks only). All numbers are little-endian."""
    rest, levels = ids.astype("<u4"), []
    while True:
        more = rest > 0xFF
        chunks = (rest & 0xFF).astype(np.uint8).tobytes()
        if not more.any():
            levels.append(struct.pack("<Q", len(chunks)) + chunks)
            break
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // RANK_STEP) * RANK_STEP, dtype=bool)
        padded[: len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_STEP).sum(1))])[:-1].astype("<u8")
        levels.append(struct.pack("<Q", len(chunks)) + chunks + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Codes:
    """Random access to the ids of one segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 8
        (count,) = struct.unpack_from("<I", data, 4)
        for level in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if level < count - 1:
                bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u8", -(-n // RANK_STEP), at)
                at += 8 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Marks before position ``i``."""
        block = i // RANK_STEP
        if block == len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bits[(block - 1) * RANK_STEP // 8:]).sum()) if block else 0
        first = block * RANK_STEP
        marks = np.unpackbits(bits[first // 8:-(-i // 8)], bitorder="little")[: i - first]
        return int(ranks[block]) + int(marks.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(bits, ranks, i)
        raise ValueError("the last level goes on")

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range; touches only that range's chunks on each level."""
        out = np.zeros(stop - start, dtype=np.uint32)
        where, a, b = None, start, stop
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            part = chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= part
            else:
                out[where] |= part
            if bits is None or a == b:
                break
            more = np.unpackbits(bits[a // 8:-(-b // 8)], bitorder="little")[a % 8:a % 8 + b - a].astype(bool)
            where = np.flatnonzero(more) if where is None else where[more]
            a = self._rank(bits, ranks, a)
            b = a + len(where)
        return out


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end: int = END, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of all documents, each with the end id, in ascending doc_id order (null first, equal ids by text).

    A null text counts as empty. Files are in ranges of doc_id; ``part`` numbers the ranges and ``base`` counts the ids of
    the same part before a segment. Other columns are not read. An empty table gives an empty set of files."""
    vocabulary = Vocabulary.file(docs.sparkSession, tokenizer_path)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = vocabulary.load(WordTokens), np.asarray([end], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        held, starts, ids, size, number, base = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            codes = encode_codes(np.frombuffer(b"".join(ids), dtype="<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([base], pa.int64()), pa.array([size], pa.int64()),
                    pa.array([held], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([codes], pa.binary()),
                ],
                ["part", "segment", "base", "n_tokens", "doc_ids", "doc_starts", "codes"],
            )

        for batch in slices(batches, "text"):
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), tokens.many(strings(batch, "text"))):
                own += last
                held.append(doc_id)
                starts.append(size)
                ids.append(own)
                size += len(own) // 4
                if size >= segment_ids:
                    yield row()
                    number, base = number + 1, base + size
                    held, starts, ids, size = [], [], [], 0
        if held:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before), n_tokens, ids; with ``digest``,
    ids_crc32 (CRC-32 of the ids, taken where they are read) in place of ids.

    The starts of the parts are running sums over one row per part, of which there are as many as shuffle partitions."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("ids_of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("of_part"), F.coalesce(F.sum("ids_of_part").over(before), F.lit(0)).alias("part_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, base, n, doc_ids, starts, data = (batch.column(c)[r].as_py() for c in ("part", "base", "n_tokens", "doc_ids", "doc_starts", "codes"))
                codes, ends = Codes(data), [*starts[1:], n]
                for at in range(0, len(doc_ids), 256):
                    own = [codes.read(a, b) for a, b in zip(starts[at:at + 256], ends[at:at + 256])]
                    sizes, every = [len(x) for x in own], np.concatenate(own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * len(own), pa.int32()), pa.array(doc_ids[at:at + 256], pa.int64()),
                            pa.array([base + s for s in starts[at:at + 256]], pa.int64()), pa.array(sizes, pa.int64()),
                            checksums(every, sizes) if digest else lists(every.astype(np.int32), sizes, pa.int32()),
                        ],
                        ["part", "doc_id", "at", "n_tokens", content],
                    )

    content, kind = ("ids_crc32", "long") if digest else ("ids", "array<int>")
    read = files.drop("segment").mapInArrow(documents, f"part int, doc_id long, at long, n_tokens long, {content} {kind}")
    return read.join(bases, F.col("part") == F.col("of_part")).select("doc_id", (F.col("at") + F.col("part_start")).alias("start"), "n_tokens", content)


def token_at(files: DataFrame, doc_id: int, position: int) -> int | None:
    """One id of one document by random access; None where there is no such document or position."""
    found = files.filter(F.array_contains("doc_ids", doc_id)).limit(1).collect()
    if not found:
        return None
    row = found[0]
    at = row.doc_ids.index(doc_id)
    stop = [*row.doc_starts[1:], row.n_tokens][at]
    place = row.doc_starts[at] + position
    return Codes(row.codes)[place] if 0 <= position and place < stop else None
