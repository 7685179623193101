"""Secret scans: fixed patterns, and novelty under a primed zstandard dictionary.

Beside the patterns, every token-like string on a line that speaks of keys or credentials is a candidate. Its novelty is
the number of bytes it adds to the compressed text around it, when the compressor already knows common code, common
identifiers and the document's own text before it. What hardly shrinks is no word, name or repetition: it is reported."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.batches import slices, strings

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
#: Words that make a line sensitive; fixed values.
SENSITIVE = re.compile(r"passw|secret|token|api_?key|credential|private_?key|access_?key|auth|bearer|signature|client_?id|session_?id", re.IGNORECASE)
_KEYWORDS = ("passw", "secret", "token", "api", "credential", "key", "auth", "bearer", "signature", "client", "session")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Code and identifiers the compressor knows beforehand; fixed values.
CODE = (
    "import from export default function return const let var class public private static void string number boolean null true false undefined "
    "async await new this self def lambda None True False if else elif for while try except catch finally raise throw "
    "https://www.example.com/index.html http://localhost:8080/api/v1/users application/json content-type user-agent "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 ffffffffffffffff xxxxxxxxxxxxxxxx ----------------"
)
IDENTIFIERS = (
    "username password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret session_id "
    "authorization bearer authentication credential credentials signature certificate configuration environment variable "
    "your_api_key_here YOUR_API_KEY_HERE example_token placeholder changeme get_access_token refresh_token csrf_token "
    "database connection response request handler manager service controller repository"
)


@dataclass(frozen=True)
class Novelty:
    """Reported when a candidate adds at least ``share`` of its length in bytes. ``before`` is the text before it that the
    compressor has seen, in code points; ``longest`` bounds one measurement (a longer candidate is measured in parts of that
    length, and its novelty is their sum)."""

    share: float = 0.62
    before: int = 256
    longest: int = 4096
    level: int = 9


class Meter:
    def __init__(self, how: Novelty):
        import zstandard

        self.how = how
        primed = zstandard.ZstdCompressionDict((CODE + " " + IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=how.level, dict_data=primed, write_content_size=False, write_checksum=False).compress

    def marginal(self, before: str, candidate: str) -> int:
        """Compressed bytes that the candidate adds after ``before``."""
        total, known = 0, before.encode()
        base = len(self.compress(known))
        data = candidate.encode()
        for at in range(0, len(data), self.how.longest):
            total += max(0, len(self.compress(known + data[at:at + self.how.longest])) - base)
        return total

    def is_novel(self, text: str, start: int, end: int) -> bool:
        word = text[start:end]
        kinds = any(c.isdigit() for c in word) + any(c.islower() for c in word) + any(c.isupper() for c in word)
        if kinds < 2:
            return False
        return self.marginal(text[max(0, start - self.how.before):start], word) >= self.how.share * len(word)


def base_spans(text: str, lowered: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three patterns, leftmost and without overlap within each. A match that is too short is
    dropped after matching, as it has used up its text."""
    out = []
    if any(k in lowered for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def novel_spans(text: str, lowered: str, base: list[tuple[int, int, int]], meter: Meter) -> list[tuple[int, int, int]]:
    """Candidates on sensitive lines that no base span covers and that the compressor cannot foresee."""
    if not any(k in lowered for k in _KEYWORDS):
        return []
    out, taken, at = [], sorted(base), 0
    reach = 0
    for word in CANDIDATE.finditer(text):
        start, end = word.span()
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach > start:
            continue
        left = text.rfind("\n", 0, start) + 1
        right = text.find("\n", end)
        line = text[max(left, start - 200):start] + " " + text[end:min(len(text) if right < 0 else right, end + 200)]
        if SENSITIVE.search(line) and meter.is_novel(text, start, end):
            out.append((start, end, 3))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, how: Novelty = Novelty()) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_novel, base (joined base spans), spans (all, joined), hits
    (array of kind, start, end in code points, end exclusive), by start and then kind.

    Null and empty texts have no spans. Repeated rows give repeated results; other columns are not read. The nearness of a
    sensitive word is judged on the candidate's own line, at most 200 code points to either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(how)
        for batch in slices(batches, "text"):
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_novel", "base", "spans", "hits")}
            for text in strings(batch, "text"):
                lowered = text.lower()
                base = base_spans(text, lowered)
                every = sorted(base + novel_spans(text, lowered, base, meter), key=lambda s: (s[0], s[2]))
                counts = np.bincount([k for *_, k in every], minlength=4)
                for name, value in zip(rows, (*counts.tolist(), joined(base), joined(every), [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in every])):
                    rows[name].append(value)
            hit = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [hit]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(rows.values(), kinds))], ["doc_id", *rows])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base string, spans string, hits array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def covered(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans merged where they overlap or touch."""
    out: list[list[int]] = []
    for a, b, _ in sorted(base):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def redact(docs: DataFrame, mask: str = "[SECRET]", how: Novelty = Novelty()) -> DataFrame:
    """The same rows and columns with every span in ``text`` replaced by ``mask`` (overlapping spans by one). A null text stays
    null, and a text without spans stays as it is."""
    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        meter, out = Meter(how), []
        for text in texts:
            if text:
                lowered = text.lower()
                base = base_spans(text, lowered)
                pieces, at = [], 0
                for a, b in covered(text, base + novel_spans(text, lowered, base, meter)):
                    pieces += [text[at:a], mask]
                    at = b
                text = "".join(pieces) + text[at:] if pieces else text
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", cleaned(F.col("text").cast("string")))
