"""Numpy work on Arrow text batches: whole batches at once, never a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once; bounds the memory of temporary arrays. A longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: Text bytes whose running sums are made at once, so that these stay in a core's cache.
HASH_BYTES = 1 << 15

_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Maps A-Z to a-z and keeps all other bytes.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: glibc's malloc_trim; other C libraries go without.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_tables: dict[int, np.ndarray] = {}


def free_memory() -> None:
    """Gives back what Arrow and the C library keep of freed memory; for the end of a task, as its worker waits for others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


def _powers(base: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, enough for a block of HASH_BYTES."""
    if base not in _tables:
        steps = np.full(HASH_BYTES, base, np.uint64)
        steps[0] = 1
        _tables[base] = np.cumprod(steps)
    return _tables[base]


def slices(strings: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their bytes and the rows' offsets in these; a null is an empty text."""
    texts = strings.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(texts))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


@dataclass
class Spans:
    """Pieces of a slice: piece i has the bytes start[i]:end[i]; row r has the pieces bounds[r]:bounds[r+1]."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """The words: longest runs of bytes that aren't ASCII white space. UTF-8 has no such byte inside a character."""
    word = (data != 32) & (data - np.uint8(9) > 4)  # as SPACE has it; comparisons are faster than looking each byte up
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    starts[first] = word[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = word[last]
    start = np.flatnonzero(starts)
    return Spans(start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def line_spans(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """The lines: what line feeds separate, without them. Every row has at least one line."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    counts = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return Spans(start, end, np.concatenate([[0], np.cumsum(counts)]))


def span_hashes(data: np.ndarray, spans: Spans, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the pieces' bytes, A-Z lower-cased if `fold`.

    Hashes are polynomials in the bytes' random values. A running sum of
    value * step**position gives each piece's by one subtraction. The sums run
    over blocks of at most HASH_BYTES, however long the text or a piece is.
    """
    table = _BYTES[FOLD] if fold else _BYTES
    up, down = _powers(_STEP), _powers(_STEP_INVERSE)
    found = np.empty(len(spans.start), np.uint64)

    def running(low: int, high: int) -> np.ndarray:
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        values = table[data[low:high]]
        values *= up[: high - low]
        np.cumsum(values, out=total[1:])
        return total

    first = 0
    while first < len(found):
        low = int(spans.start[first])
        last = int(np.searchsorted(spans.end, low + HASH_BYTES, "right"))
        if last > first:
            start, end = spans.start[first:last] - low, spans.end[first:last] - low
            total = running(low, int(end[-1]) + low)
            found[first:last] = (total[end] - total[start]) * down[start]
        else:  # one piece that is longer than a block
            last, value = first + 1, 0
            for at in range(low, int(spans.end[first]), HASH_BYTES):
                part = running(at, min(at + HASH_BYTES, int(spans.end[first])))
                value += int(part[-1]) * pow(_STEP, at - low, 1 << 64)
            found[first] = value & ((1 << 64) - 1)
        first = last
    return mix(found)


def gather(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs source[start : start + length], one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.repeat(start - (ends - length), length) + np.arange(total)]


def reduce_rows(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty, **options) -> np.ndarray:
    """`ufunc.reduceat` over the rows' stretches of `values`, with `empty` for rows that have none."""
    out = np.full((len(bounds) - 1, *values.shape[1:]), empty, options.get("dtype", values.dtype))
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = ufunc.reduceat(values, bounds[some], axis=0, **options)
    return out


def span_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> pa.Array:
    """The pieces as an Arrow string array, A-Z lower-cased if `fold`."""
    length = end - start
    bytes_ = gather(data, start, length)
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer((FOLD[bytes_] if fold else bytes_).tobytes())]
    return pa.Array.from_buffers(pa.string(), len(start), buffers)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list per row: row r gets values[bounds[r]:bounds[r+1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
