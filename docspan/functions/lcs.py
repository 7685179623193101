"""Line alignment of two texts: the small numpy helper behind the diff jobs.

It works on one pair of texts at a time. Rows of the longest-common-subsequence table are computed as whole
vectors; when the table is large only every k-th row is kept and the others are computed again on the way
back, so memory grows with lines * sqrt(lines) and no pair is too big to be exact.
"""

from __future__ import annotations

import math

import numpy as np

KEEP_ALL_CELLS = 4_000_000
CONTEXT, DEL, ADD = 0, 1, 2


def line_ids(old: str | None, new: str | None) -> tuple[np.ndarray, np.ndarray]:
    ids: dict[str, int] = {}
    a, b = (np.fromiter((ids.setdefault(x, len(ids)) for x in (t or "").split("\n")), dtype=np.int64) for t in (old, new))
    return a, b


def _row_above(x: int, b: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Table row of old line ``x`` from the row of the next old line."""
    row = below.copy()
    np.maximum(row[:-1], np.where(b == x, below[1:] + 1, 0), out=row[:-1])
    return np.maximum.accumulate(row[::-1])[::-1]


def _common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differs = a[:n] != b[:n]
    return int(np.argmax(differs)) if differs.any() else n


def shared_lines(a: np.ndarray, b: np.ndarray) -> int:
    """Lines in common when order is ignored, counted with their repetitions."""
    size = int(max(a.max(), b.max())) + 1
    return int(np.minimum(np.bincount(a, minlength=size), np.bincount(b, minlength=size)).sum())


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length only: common ends count as they are, lines of one side alone count nothing."""
    start = _common_prefix(a, b)
    a, b = a[start:], b[start:]
    end = _common_prefix(a[::-1], b[::-1])
    a, b = a[:len(a) - end], b[:len(b) - end]
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    # one bit per new line: a bit is cleared where the length grows, so one addition moves a whole row of the table
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        hit = row & places[x]
        row = (row + hit | row - hit) & full
    return start + end + len(b) - row.bit_count()


def matches(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Matched line positions of the edit script that deletes before it adds whenever both are as good.

    Leading equal lines match as they stand, and an old line that occurs nowhere in the new text is deleted as
    soon as it is met. The mirror cases (equal ends, new lines absent from the old text) can change which of
    several equal lines is matched, so they stay in the table."""
    start = _common_prefix(a, b)
    found = [(i, i) for i in range(start)]
    tail = b[start:]
    kept = np.nonzero(np.isin(a[start:], tail))[0]
    rest = a[start:][kept]
    n, m = len(rest), len(tail)
    if n == 0 or m == 0:
        return found
    step = 1 if n * m <= KEEP_ALL_CELLS else math.isqrt(n) + 1
    saved = {n: np.zeros(m + 1, dtype=np.int32)}
    row = saved[n]
    for i in range(n - 1, -1, -1):
        row = _row_above(rest[i], tail, row)
        if i % step == 0:
            saved[i] = row
    j = 0
    for low in range(0, n, step):
        high = min(low + step, n)
        rows = [saved[high]]
        for i in range(high - 1, low, -1):
            rows.append(_row_above(rest[i], tail, rows[-1]))
        rows.append(saved[low])
        rows.reverse()
        for i in range(low, high):
            if j == m:
                return found
            here, below = rows[i - low], rows[i - low + 1]
            # skip the new lines that are added here: neither equal nor better left for later
            j += int(np.argmax((tail[j:] == rest[i]) | (below[j:-1] >= here[j + 1:])))
            if tail[j] == rest[i]:
                found.append((start + int(kept[i]), start + j))
                j += 1
    return found


def edit_script(old: str | None, new: str | None) -> tuple[list[int], list[int], list[int]]:
    """Operations in order with 1-based old and new line numbers (0 where there is none)."""
    a, b = line_ids(old, new)
    ops: list[int] = []
    olds: list[int] = []
    news: list[int] = []
    i = j = 0
    for mi, mj in [*matches(a, b), (len(a), len(b))]:
        ops += [DEL] * (mi - i) + [ADD] * (mj - j)
        olds += [*range(i + 1, mi + 1)] + [0] * (mj - j)
        news += [0] * (mi - i) + [*range(j + 1, mj + 1)]
        if mi < len(a):
            ops.append(CONTEXT)
            olds.append(mi + 1)
            news.append(mj + 1)
        i, j = mi + 1, mj + 1
    return ops, olds, news
