"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest prefixes: at every place the longest key of the model's compiled character map is replaced, or
one character is taken over. For every normalised byte the source byte it came from is recorded, so that each piece of the
normalised text is projected to a span of bytes of the original text. The pieces themselves are found by the sentencepiece
library on the text as normalised here; its own normaliser is switched off for that."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.llm.batches import lists, slices, strings

SPACE = "▁"
REPLACEMENT = "�".encode()
_LOADED: dict[str, "Pieces"] = {}


def wire_fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a serialised protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at:at + size]
        at += size


class CharacterMap:
    """The compiled map of a model: a double-array trie over byte strings, and the zero-ended texts its values point to."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size:]

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest key at ``at`` and what replaces it."""
        if not self.units:
            return None
        found, node = None, self._step(self.units[0])
        for end in range(at, len(text)):
            node ^= text[end]
            unit = self.units[node]
            if unit & 0x800000FF != text[end]:
                break
            node ^= self._step(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1]:self.texts.index(0, found[1])]


@dataclass(frozen=True)
class Rules:
    """What a model says about normalising."""

    charmap: CharacterMap
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    own_symbols: tuple[bytes, ...] = ()

    @property
    def space(self) -> bytes:
        return SPACE.encode() if self.escape else b" "

    @property
    def plain(self) -> bool:
        """No character changes but the space."""
        return not (self.charmap.units or self.squeeze or self.own_symbols) and self.escape and self.dummy_prefix

    def at(self, text: bytes, place: int) -> tuple[int, bytes]:
        """Source bytes taken at ``place`` and what they become."""
        for symbol in self.own_symbols:
            if text.startswith(symbol, place):
                return len(symbol), symbol
        found = self.charmap.longest(text, place)
        if found:
            return found
        width = _character_width(text, place)
        return (width, text[place:place + width]) if width else (1, REPLACEMENT)

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the place in ``text`` it came from."""
        if self.plain:
            return _plain_text(text.decode()).encode(), _plain_source(text)
        taken: list[tuple[int, bytes]] = []  # place, replacement
        place = 0
        while place < len(text):
            width, becomes = self.at(text, place)
            taken.append((place, becomes))
            place += width
        if self.squeeze:
            taken = _squeezed(taken)
        if not taken:
            return b"", np.zeros(1, np.int64)
        if self.dummy_prefix:
            taken.insert(0, (taken[0][0], b" "))
        out = [becomes.replace(b" ", self.space) for _, becomes in taken]
        source = np.append(np.repeat([start for start, _ in taken], [len(x) for x in out]), place).astype(np.int64)
        text = b"".join(out)
        length = len(text)
        while self.squeeze and text.endswith(self.space, 0, length):
            length -= len(self.space)
        return text[:length], source[:length + 1]


def _character_width(text: bytes, place: int) -> int:
    """Bytes of the UTF-8 character at ``place``, 0 if there is none."""
    lead = text[place]
    width = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    try:
        text[place:place + width].decode()
    except UnicodeDecodeError:
        return 0
    return width if place + width <= len(text) else 0


def _squeezed(taken: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Without spaces at the start and behind another space; what is left empty keeps its place."""
    first = next((k for k, (_, becomes) in enumerate(taken) if becomes != b" "), len(taken))
    kept, after_space = [], True
    for place, becomes in taken[first:]:
        body = becomes.lstrip(b" ") if after_space else becomes
        kept.append((place, body))
        after_space = body.endswith(b" ") if body else after_space
    return kept


def _plain_text(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _plain_source(text: bytes) -> np.ndarray:
    """The places of ``Rules.normalised`` where only spaces change: whole arrays at once."""
    if not text:
        return np.zeros(1, np.int64)
    bytes_of = np.frombuffer(text, np.uint8)
    places = np.arange(len(text), dtype=np.int32 if len(text) < 1 << 31 else np.int64)
    if not text.isascii():
        places = np.maximum.accumulate(np.where((bytes_of & 0xC0) != 0x80, places, 0))
    widths = np.where(bytes_of == 0x20, np.int8(3), np.int8(1))
    widths[0] += 3
    return np.append(np.repeat(places, widths), np.asarray([len(text)], places.dtype))


class Pieces:
    """A loaded model."""

    NORMAL_OFF = b"\x1a" + bytes([12]) + b"\x0a\x00\x12\x00\x18\x00\x20\x00\x28\x00\x32\x00"

    def __init__(self, model: bytes):
        import sentencepiece

        spec, symbols, widths, self.unknown = {}, [], [], None
        for field, value in wire_fields(model):
            if field == 1:
                piece = dict(wire_fields(value))
                kind = piece.get(3, 1)
                if kind == 2:
                    self.unknown = len(widths)
                widths.append(1 if kind == 6 else len(piece[1]))
                if kind == 4:
                    symbols.append(piece[1])
            elif field == 3:
                spec.update(wire_fields(value))
        self.rules = Rules(CharacterMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), tuple(sorted(symbols, key=len, reverse=True)))
        # a later field of a message overrides an earlier one: the library then takes the text as it is
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=model + self.NORMAL_OFF)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.widths = np.asarray(widths, "<u4")
        self.decimal = [str(k) for k in range(len(widths))]

    def widths_of(self, ids: np.ndarray, normal: str) -> np.ndarray:
        """Normalised bytes of each id. Only the unknown id does not tell how many."""
        if self.unknown is not None and (ids == self.unknown).any():
            return np.asarray([len(p) for p in self.raw.encode(normal, return_type=bytes)], "<u4")
        return self.widths[ids]

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text its ids, and first and one-past-last byte of each piece in the text."""
        plain = self.rules.plain
        found = None if plain else [self.rules.normalised(t.encode()) for t in texts]
        normals = [_plain_text(t) for t in texts] if plain else [normal.decode() for normal, _ in found]
        for k, (text, normal, ids) in enumerate(zip(texts, normals, self.raw.encode(normals, return_type="numpy", num_threads=1))):
            source = _plain_source(text.encode()) if plain else found[k][1]
            ends = np.cumsum(self.widths_of(ids, normal), dtype=np.int64)
            bounds = source[np.concatenate([np.zeros(1, np.int64), ends])] if len(ends) else np.zeros(1, np.int64)
            yield ids, bounds[:-1], bounds[1:]

    def decoded(self, ids: list[list[int]]) -> list[str]:
        return [self.whole.decode(own) if own else "" for own in ids]


@dataclass(frozen=True)
class Model:
    """A model as tasks get it: a broadcast of a file of fixed size, loaded once per worker process."""

    key: str
    content: Broadcast

    @staticmethod
    def file(spark: SparkSession, path: str) -> "Model":
        with open(path, "rb") as f:
            content = f.read()
        return Model(hashlib.sha1(content).hexdigest(), spark.sparkContext.broadcast(content))

    def load(self) -> Pieces:
        if self.key not in _LOADED:
            _LOADED[self.key] = Pieces(self.content.value)
        return _LOADED[self.key]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, byte_start and byte_end of every whole text: one span of the text's UTF-8 bytes per id.

    The spans of a text follow each other without gaps but for characters that normalising drops. Of the ids that spell one
    character byte by byte, the last has the character's span and the others are empty at its start; the space that is put
    before a text is empty too. A null text counts as empty and has no ids. Repeated rows give repeated results; other columns are
    not read."""
    model = Model.file(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model.load()
        for batch in slices(batches, "text"):
            found = [*pieces.encoded(strings(batch, "text"))]
            sizes = [len(f[0]) for f in found]
            columns = [lists(np.concatenate([f[k] for f in found]), sizes, kind) for k, kind in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "ids", "byte_start", "byte_end"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, byte_start array<long>, byte_end array<long>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and the text they spell, as the library decodes them. Null ids spell the empty text; bytes that are no
    character become U+FFFD; an id outside the vocabulary is an error."""
    model = Model.file(encoded.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model.load()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = pieces.decoded([own or [] for own in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas), decoded_sha256 and spans_crc32 (of the starts,
    then the ends of all spans as little-endian 64-bit integers): ``encode`` and ``decode`` in one pass, so that no id leaves
    the task. The same rows and cases as ``encode``."""
    model = Model.file(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model.load()
        for batch in slices(batches, "text", 1 << 20):
            counts, ids, texts, spans = [], [], [], []
            for own, starts, ends in pieces.encoded(strings(batch, "text")):
                listed = own.tolist()
                counts.append(len(listed))
                ids.append(hashlib.sha256(",".join(map(pieces.decimal.__getitem__, listed)).encode()).hexdigest())
                texts.append(hashlib.sha256(pieces.whole.decode(listed).encode() if listed else b"").hexdigest())
                spans.append(zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(starts.astype("<i8").tobytes())))
            columns = [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(spans, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
