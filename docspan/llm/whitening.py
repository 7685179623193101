"""Whitening of embeddings from an exact scatter of bit planes.

Entries become whole numbers. In a batch of rows every dimension is shifted by its least value, so what remains is a small number
that is not negative; its bits are packed across the rows, 64 rows to a word. The cross-product of two dimensions is then the sum
of the set bits of ANDed planes, weighted by the planes' powers of two, and the shift is taken back in whole numbers. So the
number of rows, the sums and the scatter of the whole table are exact, whatever the order in which partial results meet, and the
covariance is centred as whole numbers before any rounding."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.operators.storage import stored

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Rows whose planes are packed at a time.
BLOCK = 4096
#: A component whose eigenvalue is a smaller share of the trace cannot be told from rounding and is left out.
LEAST_SHARE = 1e-12
#: Whole numbers beyond this are not exact in double precision.
_EXACT = 1 << 53


def whole_numbers(rows: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1,000,000 of finite entries: longs, or Python integers where a long could not hold them."""
    scaled = np.floor(rows * float(SCALE))
    if not scaled.size or np.abs(scaled).max() < _EXACT:
        return scaled.astype(np.int64) + SHIFT
    # the product itself may overflow a double: the power of two is put on afterwards
    return np.asarray([[math.floor(c) * SCALE if abs(c) >= _EXACT else math.floor(c * SCALE) for c in row] for row in rows.tolist()], dtype=object) + SHIFT


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of (rows, dimensions) as (dimensions, bits, words): word w of a plane holds that bit of 64 rows."""
    n, dims = values.shape
    padded = np.zeros((dims, -(-n // 64) * 64), values.dtype)
    padded[:, :n] = values.T
    out = np.empty((dims, bits, padded.shape[1] // 64), np.uint64)
    for bit in range(bits):
        marks = (padded >> bit & 1).astype(np.uint8)
        out[:, bit] = np.packbits(marks, axis=1, bitorder="little").view("<u8")
    return out


def cross_products(values: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of the products of every two dimensions (values not negative), as Python integers."""
    bits = max(int(values.max()).bit_length(), 1)
    packed = planes(values, bits)
    dims, words = packed.shape[0], packed.shape[2]
    flat = packed.reshape(dims * bits, words)
    counts = np.zeros((dims * bits, dims * bits), np.int64)
    for k in range(dims * bits):
        counts[k, k:] = np.bitwise_count(flat[k] & flat[k:]).sum(axis=1, dtype=np.int64)
    counts += np.triu(counts, 1).T
    by_bit = counts.reshape(dims, bits, dims, bits)
    small = 2 * bits + len(values).bit_length() <= 62
    weights = np.asarray([1 << b for b in range(bits)], np.int64 if small else object)
    return np.einsum("iajb,a,b->ij", by_bit.astype(weights.dtype), weights, weights, optimize=False).astype(object) if small else np.asarray(
        [[sum(int(by_bit[i, a, j, b]) << a + b for a in range(bits) for b in range(bits)) for j in range(dims)] for i in range(dims)], dtype=object
    )


@dataclass
class Scatter:
    """Number, sums and cross-products of rows of whole numbers, as Python integers."""

    n: int
    sums: np.ndarray
    products: np.ndarray

    @staticmethod
    def empty(dims: int) -> "Scatter":
        return Scatter(0, np.zeros(dims, object), np.zeros((dims, dims), object))

    def add(self, values: np.ndarray) -> None:
        for at in range(0, len(values), BLOCK):
            block = values[at:at + BLOCK]
            least = block.min(axis=0)
            shifted = block - least
            low, n = least.astype(object), len(block)
            own = shifted.sum(axis=0, dtype=object)
            self.n += n
            self.sums += own + n * low
            self.products += cross_products(shifted) + np.outer(own, low) + np.outer(low, own) + n * np.outer(low, low)

    def covariance(self) -> np.ndarray:
        """Centred as whole numbers, then divided once."""
        centred = self.n * self.products - np.outer(self.sums, self.sums)
        return np.asarray([[int(x) / self.n**2 for x in row] for row in centred], dtype=float)


@dataclass(frozen=True)
class Whitening:
    """What a table's rows are projected with: (n x - S) / n times ``axes``."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]

    def centred(self, values: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they hold it."""
        largest = self.n * int(np.abs(values).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if values.dtype != object and largest < 1 << 62 else object
        return values.astype(kind) * (self.n if kind is object else np.int64(self.n)) - np.asarray(self.sums, dtype=kind)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.axes


def solve(found: Scatter, components: int = COMPONENTS) -> Whitening:
    """Unit eigenvectors by falling eigenvalue over the root of their eigenvalue; none where the rows do not vary."""
    dims = len(found.sums)
    values, vectors = np.linalg.eigh(found.covariance()) if found.n and dims else (np.zeros(0), np.zeros((dims, 0)))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(values.sum())
    kept = [k for k in range(min(components, len(values))) if trace > 0 and values[k] > LEAST_SHARE * trace]
    return Whitening(found.n, [int(s) for s in found.sums], vectors[:, kept] / np.sqrt(values[kept]), [float(values[k] / trace) for k in kept])


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """_id and v (doubles) of the rows whose vector is not null and holds neither nulls nor numbers that are not finite."""
    rows = vectors.select(F.col(id_column).cast("long").alias("_id"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.filter(F.col("v").isNotNull() & finite)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _coded(values: np.ndarray) -> list[bytes]:
    """One byte string per row, equal for equal rows: the least width that holds a row's distances from 1,000,000."""
    near = values - SHIFT
    if values.dtype == object:
        out = []
        for row in near.tolist():
            kind = _width(max(map(abs, row)))
            out.append(kind[2].encode() + np.asarray(row, kind).tobytes() if kind else b"t" + " ".join(map(str, row)).encode())
        return out
    kinds = map(_width, np.abs(near).max(axis=1, initial=0).tolist())
    return [kind[2].encode() + row.astype(kind).tobytes() for row, kind in zip(near, kinds)]


def _width(most: int) -> str | None:
    return next((f"<i{size}" for size in (2, 4, 8) if most < 1 << 8 * size - 2), None)


def _decoded(codes: list[bytes]) -> np.ndarray:
    rows = [code[1:].decode().split() if code[:1] == b"t" else np.frombuffer(code, f"<i{code[:1].decode()}", offset=1).astype(np.int64) + SHIFT for code in codes]
    if any(code[:1] == b"t" for code in codes):
        return np.asarray([[int(x) + SHIFT * isinstance(x, str) for x in row] for row in rows], dtype=object)
    return np.asarray(rows, np.int64)


def distinct_rows(rows: DataFrame, dims: int) -> DataFrame:
    """code of every different row of whole numbers, once. Copies are dropped before and after the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_coded(whole_numbers(_matrix(batch.column("v"), dims))), pa.binary())], ["code"])

    return rows.select("v").mapInArrow(run, "code binary").distinct()


def scatter(codes: DataFrame, dims: int) -> Scatter:
    """The exact scatter of all rows. A task gives one row per dimension pair, which are added up by Spark; the driver gets as
    many numbers as two dimensions have pairs, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Scatter.empty(dims)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                found.add(_decoded(batch.column("code").slice(at, BLOCK).to_pylist()))
        if found.n:
            places = [(-1, -1, found.n), *((i, -1, found.sums[i]) for i in range(dims)), *((i, j, found.products[i, j]) for i in range(dims) for j in range(i + 1))]
            # numbers beyond a long go in digits of 40 bits, so that their sums stay longs
            digits = [(i, j, place, int(rest)) for i, j, value in places for place, rest in enumerate(_digits(int(value)))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*digits), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "place", "digit"])

    added = codes.mapInArrow(run, "i int, j int, place int, digit long").groupBy("i", "j", "place").agg(F.sum("digit").alias("digit"))
    out = Scatter.empty(dims)
    for row in added.toLocalIterator():
        value = row.digit << 40 * row.place
        if row.i < 0:
            out.n += value
        elif row.j < 0:
            out.sums[row.i] += value
        else:
            out.products[row.i, row.j] += value
            if row.i != row.j:
                out.products[row.j, row.i] += value
    return out


def _digits(value: int) -> list[int]:
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest or not out:
        out.append(sign * (rest & (1 << 40) - 1))
        rest >>= 40
    return out


def identity_error(codes: DataFrame, dims: int, white: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity. Tasks give centred moments, which are
    merged with the shift of their means; None without components."""
    k = len(white.explained)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moments = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                z = white.project(white.centred(_decoded(batch.column("code").slice(at, BLOCK).to_pylist())))
                own = z.mean(axis=0)
                centred = z - own
                both, step = n + len(z), own - mean
                moments += centred.T @ centred + np.outer(step, step) * (n * len(z) / both)
                mean += step * (len(z) / both)
                n = both
        if n:
            # about the mean of all rows, which is zero: no large numbers are subtracted
            about = moments + n * np.outer(mean, mean)
            yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array([*(n * mean), *about.ravel()], pa.float64())], ["place", "part"])

    parts = {r.place: r.part for r in codes.mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).collect()}
    mean = np.asarray([parts[i] for i in range(k)]) / white.n
    second = np.asarray([parts[k + i] for i in range(k * k)]).reshape(k, k) / white.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``vectors`` and component, numbered from 1 by falling eigenvalue: vec_id, component, n (different
    rows), deviation (sum over the dimensions of (n x - S)^2, exact; null if a long cannot hold it), whitened, explained and
    identity_error.

    Rows with a null vector, a null entry or one that is not finite are dropped; repeated rows and null ids are kept. The table's
    dimensions are those of most usable rows (the larger number of equally many); rows of another length are dropped too.
    Components whose eigenvalue is no more than 1e-12 of the trace are left out, so rows that do not vary give no rows, as does
    an empty table. Other columns are not read. The different rows are written once to the shared folder."""
    rows = usable(vectors, id_column, vector_column)
    sizes = rows.filter(F.size("v") > 0).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = sizes["size"] if sizes else 1
    rows = rows.filter(F.size("v") == dims)
    codes = stored(distinct_rows(rows, dims), "distinct-vectors")
    white = solve(scatter(codes, dims), components)
    error = identity_error(codes, dims, white)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if not white.explained or not part.num_rows:
                    continue
                centred = white.centred(whole_numbers(_matrix(part.column("v"), dims)))
                z = white.project(centred)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(_square_sums(centred), pa.int64()), flat], ["vec_id", "deviation", "z"])

    projected = rows.mapInArrow(run, "vec_id long, deviation long, z array<double>")
    shares = F.array(*map(F.lit, white.explained)) if white.explained else F.array().cast("array<double>")
    return projected.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(white.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def _square_sums(centred: np.ndarray) -> list[int | None]:
    most = int(np.abs(centred).max(initial=0))
    if centred.dtype != object and centred.shape[1] * most**2 < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    sums = (centred.astype(object) ** 2).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in sums]
