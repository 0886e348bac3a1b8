"""Worker-side word kernels: ASCII-lower-cased words, shingle sets, batching.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``. Words and shingles are
64-bit fingerprints computed with numpy over the UTF-8 bytes of a slice of
documents, so no Python loop touches single words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about this many bytes (one longer text is
#: its own slice), which bounds the memory of the numpy intermediates.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the polynomial base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, _inverse(int(_BASE)), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into ``(first row, bytes, offsets)`` slices.

    ``offsets`` has one entry more than the slice has rows and starts at 0; a
    null text has no bytes.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, off_buf, data_buf = column.buffers()
    off = np.frombuffer(off_buf, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(off, off[row] + SLICE_BYTES, "right")) - 1
        last = min(n, max(last, row + 1))
        yield row, data[off[row]:off[last]], off[row:last + 1] - off[row]
        row = last


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Fingerprints of the byte spans ``[start, end)``, none of them empty."""
    up, down = powers.upto(len(data))
    code = data.astype(np.uint64) + np.uint64(1)
    code *= up[:len(data)]
    total = np.cumsum(code)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix64((total[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: Powers,
                lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of a slice, and the number of words before each row.

    The second array has one entry more than there are rows, like ``offsets``.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    hashes = span_hashes(_LOWER[data] if lower else data, starts, ends + 1, powers)
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, size: int, powers: Powers) -> Iterator[np.ndarray]:
    """Per row the sorted distinct 64-bit fingerprints of its ``size``-word shingles.

    A text with words, but fewer than ``size``, has its whole word sequence as
    one shingle; a text without words has an empty set.
    """
    odd = mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for _, data, offsets in text_slices(column):
        words, at = word_hashes(data, offsets, powers)
        rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for j in range(size):
            rolled += words[j:j + len(rolled)] * odd[j]
        rolled = mix64(rolled)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= size:
                yield np.unique(rolled[a:b - size + 1])
            elif b > a:
                short = (words[a:b] * odd[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix64(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Collect row tuples into record batches of ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
