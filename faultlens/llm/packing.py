"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest; rests are cut into
parts and collected into blocks of ``BLOCK_WINDOWS`` windows. Inside a block
every part starts as a partial partition with one filled window; the two
partial partitions with the largest imbalance are merged, the fullest windows
of one onto the emptiest of the other, until one partition is left. Its windows
are near-equal; if the fullest exceeds the capacity, the number of windows
rises and the differencing starts again.

Tokenizing, cutting and packing happen in one Arrow pass over each input
partition: no shuffle, and memory is bounded by a batch and one block. Window
ids hold the partition's number, so a task that runs again replaces its own.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm import graph  # noqa: F401  ships this package's code with the tasks
from faultlens.llm.tokens import TokenIds
from faultlens.llm.words import in_batches

#: Windows to a block, tokens to a part of a rest at most, and tokens that a
#: window of a block leaves free on average, so that near-equal windows fit.
BLOCK_WINDOWS, PART, SLACK = 64, 128, 1

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in each of ``windows`` near-equal windows."""
    heap = []
    for k, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, k, sums, [[k]] + [[] for _ in range(windows - 1)]))
    heapq.heapify(heap)
    ties = len(sizes)
    while len(heap) > 1:
        _, _, x, xs = heapq.heappop(heap)
        _, _, y, ys = heapq.heappop(heap)
        sums = x + y[::-1]
        order = np.argsort(-sums, kind="stable")
        ys = ys[::-1]
        parts = [xs[i] + ys[i] for i in order.tolist()]
        sums = sums[order]
        ties += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), ties, sums, parts))
    return heap[0][3] if heap else []


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their number rises until all fit."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, windows)
        if max((sum(sizes[i] for i in p) for p in parts), default=0) <= capacity:
            return [p for p in parts if p]
        windows += 1


def _packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    token_ids, end = TokenIds(path), np.array([end_id], np.uint32).tobytes()
    number = TaskContext.get().partitionId() << 32
    goal = BLOCK_WINDOWS * (capacity - SLACK)
    block: list[tuple] = []
    held = 0

    def flush():
        nonlocal block, held, number
        for window in pack([p[2] for p in block], capacity):
            at = 0
            for i in window:
                yield (*block[i], number, at)
                at += block[i][2]
            number += 1
        block, held = [], 0

    def rows():
        nonlocal held, number
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), token_ids.rows(batch.column(1))):
                ids = ids.tobytes() + end
                n = len(ids) // 4
                for start in range(0, n - capacity + 1, capacity):
                    yield doc_id, start, capacity, zlib.crc32(ids[4 * start:4 * (start + capacity)]), n, number, 0
                    number += 1
                start, parts = n - n % capacity, -(-(n % capacity) // PART)
                while start < n:
                    size = min(-(-(n - start) // parts), goal - held)
                    parts = max(1, parts - 1)
                    block.append((doc_id, start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), n))
                    held += size
                    start += size
                    if held == goal:
                        yield from flush()
        yield from flush()

    yield from in_batches(rows(), _PIECE, 8192)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a byte-level BPE ``tokenizers`` file that all
    nodes can read. A document's ids are those of its whole text and then
    ``end_id``; each lies in exactly one piece, and the pieces of a window
    follow one another from offset 0. ``ids_crc32`` is over the piece's ids as
    little-endian unsigned 32-bit numbers.

    Null and empty texts have the end id alone. Null and repeated ids are
    ordinary values: every row is a document. Empty tables give no rows; other
    columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lambda it: _packed(it, tokenizer, capacity, end_id),
                            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
