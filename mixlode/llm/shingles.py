"""Vectorised word and shingle hashing over Arrow string batches (NumPy only).

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are
lower-cased.  A text's shingle set holds the distinct runs of `width` words;
with fewer words the whole sequence is the only shingle; null texts and texts
without words have the empty set.  Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD6E8FEB86659FD93)
_CHUNK = 1 << 18
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint64)
    lower = np.where((codes >= 65) & (codes <= 90), codes + _U(32), codes)
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return mix64((lower + _U(1)) * _BASE), space


_BYTE_HASH, _SPACE = _byte_tables()


def _power_table(kind: str, n: int) -> np.ndarray:
    table = _powers.get(kind)
    if table is None or len(table) < n:
        base = _BASE if kind == "up" else _BASE_INV
        steps = np.full(max(n, _CHUNK) + 1, base, dtype=np.uint64)
        steps[0] = 1
        table = _powers[kind] = np.multiply.accumulate(steps)
    return table


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs, raw


def chunks(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about _CHUNK bytes each (one longer text stands alone)."""
    start = 0
    while start < len(offs) - 1:
        stop = max(start + 1, int(np.searchsorted(offs, offs[start] + _CHUNK, side="right")) - 1)
        yield start, min(stop, len(offs) - 1)
        start = min(stop, len(offs) - 1)


def word_hashes(offs: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of these rows, and each row's first word (n + 1 bounds)."""
    base = int(offs[0])
    data = raw[base : int(offs[-1])]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs - base] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    first = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    last = np.flatnonzero(~space & (after | edge[1:])) + 1
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_HASH[data] * _power_table("up", len(data))[: len(data)], out=total[1:])
    words = (total[last] - total[first]) * _power_table("down", len(data))[first]
    return mix64(words + (last - first).astype(np.uint64) * _STEP), np.searchsorted(first, offs - base)


def shingle_sets(column: pa.Array, width: int = 4) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each row of a string column."""
    offs, raw = text_buffers(column)
    for start, stop in chunks(offs):
        words, bounds = word_hashes(offs[start : stop + 1], raw)
        n = len(words) - width + 1
        if n > 0:
            grams = words[:n].copy()
            for i in range(1, width):
                grams *= _STEP
                grams += words[i : i + n]
            grams = mix64(grams)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                whole = _U(b - a)
                for w in words[a:b]:
                    with np.errstate(over="ignore"):
                        whole = whole * _STEP + w
                yield mix64(np.array([whole ^ _BASE]))
            else:
                yield np.zeros(0, np.uint64)
