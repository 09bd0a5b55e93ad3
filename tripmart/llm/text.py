"""Vectorised work on the UTF-8 bytes of a column of texts.

A column is taken apart into slices of about a megabyte. Words are runs of
bytes other than ``[\\x20\\x09-\\x0D]``; each word's 64-bit hash comes from
prefix sums of byte codes times powers of an odd number, so the cost is a few
array operations a byte, whatever the words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
SPACES = b" \t\n\x0b\x0c\r"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_CODES = _CODES[LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and those of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES * 2)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of rows of about ``limit`` bytes; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of bytes outside ``gaps``, and the index of each row's first one (one more than rows)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gaps[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LOWER_CODES[buf] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def _turn(t: int) -> np.uint64:
    return np.uint64(pow(0xD1342543DE82EF95, t + 1, 1 << 64))


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within rows, the index of each run's first word, and each row's bounds.

    With ``short``, a row of fewer words (but one at least) gives its whole
    sequence as one run.
    """
    total = len(hashes)
    count = np.diff(first)
    if total >= n:
        runs = np.zeros(total - n + 1, np.uint64)
        for t in range(n):
            runs += hashes[t : total - n + 1 + t] * _turn(t)
        runs = mix(runs)
    else:
        runs = np.empty(0, np.uint64)
    left = np.repeat(first[1:], count) - np.arange(total)
    at = np.flatnonzero(left >= n)
    values = runs[at]
    if short and (few := np.flatnonzero((count > 0) & (count < n))).size:
        extra = np.zeros(len(few), np.uint64)
        for t in range(n - 1):
            has = count[few] > t
            extra[has] += hashes[first[few[has]] + t] * _turn(t)
        extra = mix(extra ^ (count[few].astype(np.uint64) + np.uint64(77)))
        at = np.concatenate([at, first[few]])
        values = np.concatenate([values, extra])
        order = np.argsort(at, kind="stable")
        at, values = at[order], values[order]
    return values, at, np.searchsorted(at, first)
