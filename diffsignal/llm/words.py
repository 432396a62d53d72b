"""Words and word shingles of whole texts as numpy arrays, a slice of a batch at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  All separators are
ASCII, so the work is done on UTF-8 bytes.  Hashes are 64-bit and the same on
every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed at once; bounds a task's memory, never what is read.
SLICE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` odd pseudo-random multipliers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(salt << 20)) * U(0x9E3779B97F4A7C15)) | U(1)


_LETTER = seeds(64)
_WORD = seeds(64, 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


class Words:
    """The words of a few documents: ``hash[first[d]:first[d + 1]]`` are those of document ``d``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = True):
        """data: UTF-8 bytes; bounds: where each document begins, and the end."""
        inside = _IN_WORD[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = bounds[:-1][bounds[:-1] < len(data)]
        begins[heads] = inside[heads]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        tails = bounds[1:][bounds[1:] > 0] - 1
        ends[tails] = inside[tails]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        if len(self.start):
            length = self.end - self.start
            code = (_LOWER[data] if lower else data).astype(U)
            since = np.repeat(np.append(0, self.start), np.diff(np.concatenate([[0], self.start, [len(data)]])))
            at = np.arange(len(data), dtype=np.int64) - since
            code += U(1)
            code *= _LETTER[at & 63] + (at >> 6).astype(U) * U(0xD6E8FEB86659FD92)
            code[~inside] = 0
            self.hash = mix(np.add.reduceat(code, self.start) + length.astype(U) * U(0x9FB21C651E98DF25))
        else:
            self.hash = np.zeros(0, U)

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, d: int) -> np.ndarray:
        return self.hash[self.first[d] : self.first[d + 1]]

    def runs(self, k: int) -> np.ndarray:
        """At each word the hash of the ``k`` words from there; only ``k - 1`` short of a document's end does it hold."""
        n = len(self.hash)
        out = np.zeros(n, U)
        for j in range(min(k, n)):
            out[: n - j] += self.hash[j:] * _WORD[j]
        return mix(out)

    def shingles(self, k: int = 5) -> list[np.ndarray]:
        """Per document its shingles in order; with fewer than ``k`` words the whole sequence as one."""
        runs, out = self.runs(k), []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if b - a >= k:
                out.append(runs[a : b - k + 1])
            elif b > a:
                out.append(mix((self.hash[a:b] * _WORD[: b - a]).sum(keepdims=True) + np.full(1, b - a, U) * U(0xA0761D6478BD642F)))
            else:
                out.append(runs[:0])
        return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to about ``size`` bytes of text, with the bytes and bounds of ``column``; a longer text comes alone and whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, bounds = text_bytes(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
            b = min(b, batch.num_rows)
            yield batch.slice(a, b - a), data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            a = b


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
