"""Whole Arrow text columns as flat numpy byte arrays: words, hashes and n-grams without row loops.

Everything works on bounded slices (see ``slices``), so a worker's memory follows the slice, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n; kept up to one slice, so that memory stays bounded."""
    if len(_powers["up"]) <= n:
        made = []
        for b in (BASE, BASE_INV):
            p = np.full(max(n, SLICE_BYTES) + 1, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > SLICE_BYTES:
            return made[0], made[1]
        _powers["up"], _powers["down"] = made
    return _powers["up"], _powers["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n+1 offsets into them; null reads as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows with at most ``most`` bytes, or one long row."""
    raw, offsets = flat(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SEPARATOR[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def prefix_code(code: np.ndarray) -> np.ndarray:
    """Prefix sums of a positional code; ``span_hash`` reads the hash of any span from them."""
    up, _ = powers(len(code))
    total = np.empty(len(code) + 1, np.uint64)
    total[0] = 0
    np.cumsum(code * up[: len(code)], out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    return span_hash(prefix_code(BYTE_CODE[LOWER[raw] if lower else raw]), start, end)


def ngrams(codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and their rows."""
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(codes) - n + 1
    out = codes[:m].copy()
    for k in range(1, n):
        out *= BASE
        out += codes[k : k + m]
    keep = row[:m] == row[n - 1 :]
    return mix(out[keep] + U(n)), row[:m][keep]


def by_place(docs: DataFrame) -> DataFrame:
    """The same columns under plain names, whatever theirs are; ``doc_id``, ``text`` and ``n_chars`` keep their own."""
    return docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)))


def release() -> None:
    """Gives memory that a finished task has freed back to the system, for the workers that stay for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
