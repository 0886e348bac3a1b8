"""Byte-level BPE by a segment tree: texts to token ids and back to bytes.

A text is split by the vocabulary's pattern, and every piece is merged by
itself. A segment tree over the byte positions of a piece holds, at the leaf of
each live token's first byte, the rank of the pair that begins there; an inner
node holds the leftmost minimum below it, so the root names the next merge. A
merge changes three leaves: the pair at the merged token, the pair at its left
neighbour, and the token that is gone. Each is a point update of logarithmic
cost, so a piece of n bytes takes O(n log n) however long it is.

Encoding and decoding are one Arrow pass each: no shuffle, and memory is bounded
by a text, a batch of ids and the table of known units.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from faultlens.llm import graph  # noqa: F401  ships this package's code with the tasks
from faultlens.llm.tokens import TokenIds, _wide_space
from faultlens.llm.words import Powers, text_slices

#: The fewest and the longest pieces that are merged side by side, bytes of a unit that is looked
#: up whole, pieces of a text that are handled at once, and ids to a batch.
FEW_PIECES, LONG_PIECE, LONG_UNIT, PIECES, BATCH_IDS = 32, 64, 1000, 1 << 16, 1 << 20

_NONE = 1 << 62
_PLACE = (1 << 32) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: a piece that is a token is that token; otherwise the
    pair of lowest rank, the leftmost of equals, is merged until none is left."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None or n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length()  # n - 1 pairs
    tree = [_NONE] * (2 * size)
    for k in range(n - 1):
        rank = ranks.get(piece[k:k + 2])
        if rank is not None:
            tree[size + k] = rank << 32 | k
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while tree[1] != _NONE:
        k = tree[1] & _PLACE
        gone = after[k]
        end = after[k] = after[gone]
        if end < n:
            before[end] = k
        left = before[k]
        for at, stop in ((gone, 0), (k, after[end] if end < n else 0), (left, end)):
            if at < 0 or at > n - 2:
                continue
            rank = ranks.get(piece[at:stop]) if stop else None
            value = _NONE if rank is None else rank << 32 | at
            at += size
            while tree[at] != value:
                tree[at] = value
                at >>= 1
                if not at:
                    break
                a, b = tree[2 * at], tree[2 * at + 1]
                value = a if a < b else b
    ids, k = [], 0
    while k < n:
        ids.append(ranks[piece[k:after[k]]])
        k = after[k]
    return ids


class Merger:
    """Merges many pieces at once: the trees of pieces of like size are the rows of
    one matrix, and every step carries out one merge in each of them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Whichever two tokens make up a token, their join has that token's rank.
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """Leaf values: rank and place of the pairs that fit and are tokens."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(fits & (self.keys[at] == key), self.joined[at] << 32 | place, _NONE)

    def __call__(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        ids: list[tuple[int, ...]] = [()] * len(pieces)
        sized: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                ids[k] = (whole,)
            elif len(piece) > LONG_PIECE:
                ids[k] = tuple(merge_piece(piece, self.ranks))
            elif piece:
                sized.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, members in sized.items():
            if len(members) < FEW_PIECES:
                for k in members:
                    ids[k] = tuple(merge_piece(pieces[k], self.ranks))
                continue
            for a in range(0, len(members), 4096):
                part = members[a:a + 4096]
                for k, found in zip(part, self._merged([pieces[k] for k in part], width)):
                    ids[k] = found
        return ids

    def _merged(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = np.array([len(p) for p in pieces])
        rows, places = np.arange(len(pieces)), np.arange(width)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        token = np.concatenate([self.byte[data], np.zeros((len(rows), 2), np.int64)], axis=1)
        after = np.tile(np.arange(1, width + 2), (len(rows), 1))
        before = np.tile(np.arange(-1, width), (len(rows), 1))
        tree = np.full((len(rows), 2 * width), _NONE)
        tree[:, width:] = self._pair(token[:, :width], token[:, 1:width + 1], places, places + 1 < n[:, None])
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        live = np.ones((len(rows), width + 1), bool)
        while True:
            rows = rows[tree[rows, 1] != _NONE]
            if not len(rows):
                break
            best = tree[rows, 1]
            k = best & _PLACE
            gone = after[rows, k]
            end = after[rows, gone]
            token[rows, k], after[rows, k], before[rows, end] = best >> 32, end, k
            live[rows, gone] = False
            left = before[rows, k]
            first = np.maximum(left, 0)
            tree[rows, width + gone] = _NONE
            tree[rows, width + k] = self._pair(best >> 32, token[rows, end], k, end < n[rows])
            tree[rows, width + first] = np.where(left < 0, tree[rows, width + first], self._pair(token[rows, first], best >> 32, first, left >= 0))
            at, flat = np.stack([gone, k, first]) + width, tree.reshape(-1)
            base = rows * (2 * width)
            for _ in range(width.bit_length() - 1):  # the paths from the three leaves to the root
                at = at >> 1
                below = base + 2 * at
                flat[base + at] = np.minimum(flat[below], flat[below + 1])
        live = live[:, :width] & (places < n[:, None])
        flat, ends = token[:, :width][live].tolist(), np.cumsum(live.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


class TextIds(TokenIds):
    """Ids of whole texts by a rank file and the pattern that splits them.

    With ``space_led`` a match begins at every space before a non-space
    character, so a text falls apart there into units that have the same ids
    wherever they stand: the units of a slice of texts are told apart by numpy
    fingerprints and each new one is split and merged once. Texts with white space
    beyond ASCII or with very long units are split as a whole.
    """

    def __init__(self, path: str, pattern: str, space_led: bool = True) -> None:
        import regex

        ranks = read_ranks(path)
        self.split, self.merge, self.space_led = regex.compile(pattern), Merger(ranks), space_led
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))
        self.powers = Powers()
        self.clear()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text by the pattern alone, some pieces at a time."""
        found = (m[0] for m in self.split.finditer(text))
        parts = iter(lambda: list(islice(found, PIECES)), [])
        out = []
        for pieces in parts:
            new = list(set(pieces))
            ids = dict(zip(new, self.merge([p.encode() for p in new])))
            out.append(np.fromiter(chain.from_iterable(map(ids.__getitem__, pieces)), np.uint32))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column."""
        for _, data, offsets in text_slices(column):
            edges = np.union1d(np.flatnonzero(data == 0x20), offsets)
            long = edges[:-1][np.diff(edges) > LONG_UNIT]
            whole = set(_wide_space(data, offsets).tolist()) | set((np.searchsorted(offsets, long, "right") - 1).tolist())
            if self.space_led and len(whole) < len(offsets) - 1:
                ids, at = self._slice(data, offsets)
            for k in range(len(offsets) - 1):
                if k in whole or not self.space_led:
                    yield self.encode(data[offsets[k]:offsets[k + 1]].tobytes().decode())
                else:
                    yield ids[at[k]:at[k + 1]]


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, space_led: bool) -> Iterator[pa.RecordBatch]:
    encode = TextIds(path, pattern, space_led)
    for batch in batches:
        made, at = encode.rows(batch.column(1)), 0
        while at < len(batch):
            ids, held = [], 0
            for row in made:
                ids.append(row)
                held += len(row)
                if held >= BATCH_IDS:
                    break
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:at + len(ids)], lists], schema=_IDS)
            at += len(ids)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     space_led: bool = True) -> DataFrame:
    """``doc_id, ids`` for every row: the token ids of its whole text.

    ``ranks`` is the path of a rank file that all nodes can read; it holds every
    single byte. ``pattern`` splits a text into pieces (syntax of ``regex``); pass
    ``space_led=False`` if a match of it may run over a space that stands before a
    non-space character.
    Null and empty texts have no ids. Ids of rows may be null or repeat: every
    row is encoded by itself. Empty tables give no rows; other columns are not
    looked at, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lambda it: _encoded(it, ranks, pattern, space_led), "doc_id long, ids array<int>")


class Decoder:
    """Bytes of many id lists at once, gathered from one table of all tokens."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        self.length = np.full(max(ranks.values()) + 1, -1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.first = np.cumsum(np.maximum(self.length, 0)) - np.maximum(self.length, 0)
        self.data = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def known(self, ids: np.ndarray) -> np.ndarray:
        inside = (ids >= 0) & (ids < len(self.length))
        return inside & (self.length[np.where(inside, ids, 0)] >= 0)

    def __call__(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of known ids, and where each id's bytes end."""
        length = self.length[ids]
        ends = np.cumsum(length)
        where = np.repeat(self.first[ids] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)
        return self.data[where].tobytes(), ends


def _decoded(batches: Iterator[pa.RecordBatch], path: str, at: int) -> Iterator[pa.RecordBatch]:
    decode = Decoder(path)

    def value(row: pa.Scalar) -> bytes | None:
        if not row.is_valid or row.values.null_count:
            return None
        ids = row.values.to_numpy(zero_copy_only=False).astype(np.int64)
        return decode(ids)[0] if decode.known(ids).all() else None

    for batch in batches:
        lists = batch.column(at)
        begin = 0
        while begin < len(batch):
            stop, held = begin, 0
            while stop < len(batch) and (stop == begin or held < BATCH_IDS):
                held += len(lists[stop].values) if lists[stop].is_valid else 0
                stop += 1
            part = batch.slice(begin, stop - begin)
            values = pa.array([value(row) for row in part.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, "decoded"])
            begin = stop


def decode_documents(encoded: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a last column ``decoded``: the bytes of each row's ids.

    An empty list has no bytes; a null list, and a list that holds a null or an
    id that the vocabulary lacks, decode to null. Rows and other columns stay as
    they are; a column that is called ``decoded`` already is replaced.
    """
    rows = encoded.drop("decoded")
    at = rows.columns.index(ids_col)
    schema = StructType([*rows.schema.fields, StructField("decoded", BinaryType())])
    return rows.mapInArrow(lambda it: _decoded(it, ranks, at), schema)
