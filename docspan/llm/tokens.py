"""Public tokenizers inside tasks: the vocabulary is read once on the driver and sent as a text of fixed size.

Invented or natural prose repeats its words, so ids are looked up by the piece between two spaces, and only new pieces
go through the tokenizers library, many in one text with a mark behind each. Cutting at these spaces never changes an id:
see ``WordTokens`` and ``ByteTokens``.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Bytes of pieces and ids in a generation; a worker remembers two. What is met again moves to the younger one.
REMEMBERED_BYTES = 112 << 20
#: Stands, after a space, behind each of the pieces that are encoded together; a piece that holds it is encoded alone.
MARK = "|"
#: Pieces that are encoded together.
TOGETHER = 64
#: Texts that the library encodes in one call. Beside ids, its results hold tokens, offsets and masks: some hundred bytes an id.
AT_ONCE = 64
_LOADED: dict[tuple[str, str], object] = {}


@dataclass(frozen=True)
class Vocabulary:
    """A serialised tokenizer as tasks get it."""

    key: str
    text: Broadcast

    @staticmethod
    def of(spark: SparkSession, text: str) -> "Vocabulary":
        return Vocabulary(hashlib.sha1(text.encode()).hexdigest(), spark.sparkContext.broadcast(text))

    @staticmethod
    def file(spark: SparkSession, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            return Vocabulary.of(spark, f.read())

    def load(self, kind: type, most: int | None = None):
        """One instance of ``kind`` per worker process; from now on it remembers ``most`` bytes a generation, or the usual number."""
        if (kind.__name__, self.key) not in _LOADED:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
            _LOADED[kind.__name__, self.key] = kind(self.text.value)
        loaded = _LOADED[kind.__name__, self.key]
        loaded.most = most
        return loaded


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class _Remembered:
    """Ids of pieces, as little-endian unsigned 32-bit integers in bytes."""

    #: Share of the bytes that this kind may remember.
    share = 1.0

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.table: dict[str, bytes | None] = {}
        self.before: dict[str, bytes | None] = {}
        self.held = 0
        #: Bytes of a generation, where a caller wants fewer.
        self.most: int | None = None
        mark = self.tokenizer.encode(" " + MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def results(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; only the results of ``AT_ONCE`` texts are held at a time."""
        for at in range(0, len(texts), AT_ONCE):
            for found in self.tokenizer.encode_batch_fast(texts[at:at + AT_ONCE], add_special_tokens=False):
                yield found.ids

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [*map(_packed, self.results(texts))]

    def learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.table)
        if not new:
            return
        if self.held > (REMEMBERED_BYTES * self.share if self.most is None else self.most):
            self.before, self.table, self.held, new = self.table, {}, 0, pieces
        again = {p: self.before[p] for p in new if p in self.before}
        found = again | dict(self.known([p for p in new if p not in again]))
        self.table.update(found)
        self.held += 160 * len(found) + sum(map(len, found)) + sum(map(len, filter(None, found.values())))

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]

    def apart(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with the ids it has behind a space. The mark's id spells the mark, so no piece without it has that id."""
        plain = [p for p in pieces if MARK not in p] if self.mark is not None else []
        runs = [plain[at:at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        texts = ["".join(f" {p} {MARK}" for p in run) for run in runs]
        for run, found in zip(runs, self.results(texts), strict=True):
            ids = np.asarray(found, dtype="<u4")
            raw, start = ids.tobytes(), 0
            for piece, end in zip(run, np.flatnonzero(ids == self.mark).tolist(), strict=True):
                yield piece, raw[4 * start:4 * end]
                start = end + 1
        alone = [p for p in pieces if MARK in p] if self.mark is not None else pieces
        yield from zip(alone, self.encoded([" " + p for p in alone]))

    def known(self, pieces: list[str]) -> Iterator[tuple[str, bytes | None]]:
        return self.apart(pieces)


class WordTokens(_Remembered):
    """A tokenizer that drops white space and whose matches hold none: every space and line feed is a safe cut. Neither
    composes with its neighbours under NFC, and both end a word for lower-casing."""

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; new pieces of all of them are encoded together."""
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.table.__getitem__, pieces)) for pieces in cut]


class ByteTokens(_Remembered):
    """A byte-level tokenizer whose pattern takes one space before a word: a space between two characters that are no white
    space always starts a match, so the text is cut there. Pieces beside other white space stay together."""

    share = 0.25

    def __init__(self, text: str):
        super().__init__(text)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text

    def known(self, pieces: list[str]) -> Iterator[tuple[str, bytes | None]]:
        safe = [p for p in pieces if p and not p[0].isspace() and not p[-1].isspace()]
        yield from self.apart(safe)
        for p in set(pieces).difference(safe):
            yield p, None

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; new pieces of all of them are encoded together. No space precedes a text's first piece."""
        cut = [text.split(" ") for text in texts]
        self.learn(set().union(*cut))
        out = []
        for pieces, first in zip(cut, self.encoded([pieces[0] for pieces in cut])):
            found = [*map(self.table.__getitem__, pieces)]
            out.append(b"".join(self.encoded(self._segments(pieces)) if None in found else [first, *found[1:]]))
        return out

    @staticmethod
    def _segments(pieces: list[str]) -> list[str]:
        out, start = [], 0
        for i in range(1, len(pieces)):
            left, right = pieces[i - 1], pieces[i]
            if left and right and not left[-1].isspace() and not right[0].isspace():
                out.append(" " * (start > 0) + " ".join(pieces[start:i]))
                start = i
        out.append(" " * (start > 0) + " ".join(pieces[start:]))
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64, a blank, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``: what is left when only earlier ranks are merged, lowest first."""
    own, parts = ranks[token], [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            raise ValueError(f"no merge order for {token!r}")
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def byte_level_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A byte-level BPE tokenizer of the tokenizers library with the merges that the ranks imply."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    name = lambda b: "".join(shown[x] for x in b)
    merges = [tuple(map(name, last_merge(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tokenizer = Tokenizer(models.BPE({name(t): r for t, r in ranks.items()}, merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer.to_str()
