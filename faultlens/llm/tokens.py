"""Worker-side token ids of whole texts, from a byte-level BPE file.

Texts are cut into units before every single space, where the split pattern
cuts as well, so a unit has the same ids wherever it stands. The units of a
slice of texts are fingerprinted with numpy, each distinct unit is encoded
once, and the ids of the slice are gathered from the table of known units.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from faultlens.llm.words import _SPACE, Powers, span_hashes, text_slices

#: Fixed pattern that byte-level BPE vocabularies of this kind split text by.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Units that a task remembers at most; past it, it starts afresh.
KNOWN_UNITS = 1_000_000


def encoder(path: str):
    """``str -> ids`` of a byte-level BPE ``tokenizers`` file, special tokens
    taken as ordinary text, and the bytes to each id. The ids of such a
    vocabulary are its merge ranks, so its merges run in tiktoken's encoder,
    which gives the same ids faster."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"] for t in file.get("added_tokens", [])}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, lengths


def _wide_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold white space beyond ASCII; these are encoded whole."""
    n = len(data)
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(at):
        return at
    a, b, c = data[at], data[np.minimum(at + 1, n - 1)], data[np.minimum(at + 2, n - 1)]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(offsets, at[hit], "right") - 1)


class TokenIds:
    """Ids of texts; the table of known units grows with the calls."""

    def __init__(self, path: str) -> None:
        self.encode, self.lengths = encoder(path)
        self.powers = Powers()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column, as 32-bit integers."""
        for _, data, offsets in text_slices(column):
            whole = set(_wide_space(data, offsets).tolist())
            ids, at = self._slice(data, offsets)
            for k in range(len(offsets) - 1):
                if k in whole:
                    yield np.array(self.encode(data[offsets[k]:offsets[k + 1]].tobytes().decode()), np.uint32)
                else:
                    yield ids[at[k]:at[k + 1]]

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n + 1, bool)
        cut[:n - 1] = (data[:-1] == 0x20) & ~_SPACE[data[1:]]
        led = cut.copy()
        inner = offsets[(offsets > 0) & (offsets < n)]
        tail = inner - 1  # a text's last space stands before nothing of its own
        cut[tail] = led[tail] = False
        cut[offsets] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        hashes = span_hashes(data, starts, ends, self.powers)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slot = self._slots(distinct, data, starts[where], ends[where], led[starts[where]])
        slot = slot[inverse]
        count = self.count[slot]
        upto = np.concatenate([[0], np.cumsum(count)])
        index = np.repeat(self.first[slot] - upto[:-1], count) + np.arange(upto[-1])
        return self.flat[index], upto[np.searchsorted(starts, offsets)]

    def _slots(self, distinct, data, starts, ends, led) -> np.ndarray:
        if len(self.keys) > KNOWN_UNITS:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        if new.any():
            first, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            # Units that a space leads stay apart when they are joined to one text.
            joined = np.flatnonzero(new & led)
            if len(joined):
                parts = [data[a:b].tobytes() for a, b in zip(starts[joined].tolist(), ends[joined].tolist())]
                ids = np.array(self.encode(b"".join(parts).decode()), np.uint32)
                edge = np.concatenate([[0], np.cumsum(self.lengths[ids])])
                begin = np.searchsorted(edge, np.concatenate([[0], np.cumsum(ends[joined] - starts[joined])]))
                first[joined], count[joined] = self.used + begin[:-1], np.diff(begin)
                self._append(ids)
            for k in np.flatnonzero(new & ~led).tolist():
                ids = np.array(self.encode(data[starts[k]:ends[k]].tobytes().decode()), np.uint32)
                first[k], count[k] = self.used, len(ids)
                self._append(ids)
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.first = np.concatenate([self.first, first[new]])[order]
            self.count = np.concatenate([self.count, count[new]])[order]
            at = np.searchsorted(self.keys, distinct)
        return at

    def _append(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            flat = np.zeros(2 * (self.used + len(ids)), np.uint32)
            flat[:self.used] = self.flat[:self.used]
            self.flat = flat
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
