"""Vectorised words and word n-grams over the raw UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. All
positions of a chunk are handled at once; hashes are 64-bit, of random-weight
polynomials that are mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES, SLICE_ROWS = (1 << 20) - 4096, 4096
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n at least."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _tables[base] = (out[0], out[1])
    return have


@dataclass
class Words:
    """The words of some documents. ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    @cached_property
    def total(self) -> np.ndarray:
        """Running sums of the words' hashes by powers of the base."""
        n = len(self.hashes)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * _powers(_WORD_BASE, n + 1)[0][:n], out=total[1:])
        return total

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 of a document are meaningless."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        if n >= k:
            down = _powers(_WORD_BASE, n + 1)[1]
            out[: n - k + 1] = mix((self.total[k:] - self.total[: n - k + 1]) * down[: n - k + 1] + U(k))
        return out

    def spans(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of ``length`` words from each ``start`` on, as ``grams`` has it."""
        down = _powers(_WORD_BASE, len(self.hashes) + 1)[1]
        return mix((self.total[start + length] - self.total[start]) * down[start] + np.asarray(length, np.uint64))

    def starts_of(self, k: int) -> np.ndarray:
        """Marks each word from which k words of its document follow."""
        ok = np.zeros(len(self.hashes) + 1, np.int64)
        room = np.maximum(self.first[1:] - self.first[:-1] - k + 1, 0)
        some = room > 0
        np.add.at(ok, self.first[:-1][some], 1)
        np.add.at(ok, (self.first[:-1] + room)[some], -1)
        return np.cumsum(ok)[:-1] > 0


def split(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    space = _IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    before |= edge[:-1]
    after |= edge[1:]
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    up, down = _powers(_BASE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows: what a task holds beside its input follows this, not the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def raw_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets), a few MB of whole texts at a time; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, n)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def chunks(column: pa.Array, lower: bool) -> Iterator[tuple[int, Words]]:
    """(index of the first document, its and the next documents' words)."""
    for at, data, offsets in raw_chunks(column):
        yield at, split(data, offsets, lower)


def bucket_rows(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The columns' values of each bucket, as bytes."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)]):
        yield int(bucket[a]), [c[a:b].tobytes() for c in columns]
