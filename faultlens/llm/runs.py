"""Repeated stretches of words by string synchronising sets.

A run is a stretch of words with smallest period q and at least four periods
that neither neighbour extends. Runs are looked for at dyadic scales. At scale
t a fragment is t consecutive words, and every fragment has a hash that depends
on its words alone. A position is in the synchronising set of the scale if the
least hash among the fragments that begin at it or at one of the next t words is
that of its first or its last fragment. Whether a position is in the set depends
on its context, the next 2t words, so the set looks alike wherever the text is
alike. Fragments with a period of at most t / 4 propose nothing; they lie inside
runs of lower scales, and the smallest periods are detected separately by
comparing words at that distance.

Why no run is missed: let q be in [t, 2t) and s the run's start. If no position
of [s, s + t) were in the set, the first 3t - 1 words would have a period of at
most t / 4, and with it (3t - 1 >= q + t / 4) the run a period smaller than q. So
there is a position i in it. Its context ends inside the run, and so does that of
i + q, which are the same words; so i + q is in the set too. A nearer position
with the same context would again give the run a smaller period. Hence every run
shows as two consecutive positions of equal context at distance q, and it is
enough to look at neighbours. Each proposal is extended word by word.

All documents of a batch are laid end to end with a different separator after
each, so that numpy handles a scale of many documents at once; documents too
short for a scale leave. Everything happens in one Arrow pass: no shuffle, and
memory is bounded by a batch of texts, or one text, and its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm import graph  # noqa: F401  ships this package's code with the tasks
from faultlens.llm.words import mix64

#: Periods that a run holds at least, and bytes of text that are handled at once.
EXPONENT, BATCH_BYTES = 4, 1 << 20

_FIRST_SCALE = 4  # smaller periods are compared word by word
_OUT = np.iinfo(np.uint64).max


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    return edge[::2], edge[1::2]


def _small_periods(seq: np.ndarray) -> list[np.ndarray]:
    """``(start, length, period)`` of the runs whose period is below the first scale."""
    found = []
    for q in range(1, _FIRST_SCALE):
        a, b = _stretches(seq[:-q] == seq[q:])
        keep = b - a >= (EXPONENT - 1) * q
        a, b = a[keep], b[keep]
        for part in range(1, q):
            if q % part == 0 and len(a):
                base = seq[a[:, None] + np.arange(q)]
                a, b = (x[~(base == np.roll(base, part, axis=1)).all(axis=1)] for x in (a, b))
        found.append(np.stack([a, b - a + q, np.full(len(a), q)], axis=1))
    return found


def _reach(seq: np.ndarray, at: int, q: int, step: int) -> int:
    """How many words from ``at`` on, going ``step`` by ``step``, equal those ``q`` later."""
    n, size, done = len(seq), 64, 0
    while True:
        if step > 0:
            lo, hi = at + done, min(at + done + size, n - q)
            differ = seq[lo:hi] != seq[lo + q:hi + q]
        else:
            hi = at - done + 1
            lo = max(0, hi - size)
            differ = (seq[lo:hi] != seq[lo + q:hi + q])[::-1]
        hit = int(differ.argmax()) if len(differ) else 0
        if len(differ) and differ[hit]:
            return done + hit
        done += len(differ)
        if len(differ) < size:
            return done
        size *= 2


def _covered(n: int, runs: np.ndarray, t: int) -> np.ndarray:
    """Positions whose fragment of ``t`` words has a period of at most ``t / 4``."""
    edge = np.zeros(n + 1, np.int64)
    r = runs[(runs[:, 2] <= t // 4) & (runs[:, 1] >= t)]
    np.add.at(edge, r[:, 0], 1)
    np.add.at(edge, r[:, 0] + r[:, 1] - t + 1, -1)
    return np.cumsum(edge[:n]) > 0


def synchronising_set(hashes: np.ndarray, t: int, covered: np.ndarray) -> np.ndarray:
    """Positions of the set at scale ``t`` from the hashes of all fragments of ``t`` words."""
    value = np.where(covered, _OUT, hashes)
    least, width = value.copy(), 1
    while width < t:  # the least of the next ``width`` fragments, doubled
        np.minimum(least[:-width], least[width:], out=least[:-width])
        width *= 2
    first, last = value[:-t], value[t:]
    least = np.minimum(least[:-t], last)
    return np.flatnonzero(((least == first) | (least == last)) & (least != _OUT))


def find_runs(documents: list[np.ndarray]) -> np.ndarray:
    """``(document, start, length, period)`` of all runs of at least ``EXPONENT``
    periods, by document, start and period. A document is an array of word
    numbers, none negative, that are equal exactly where the words are."""
    size = np.array([len(d) for d in documents], np.int64)
    doc = np.arange(len(documents))
    if not len(doc) or size.max() < EXPONENT:
        return np.zeros((0, 4), np.int64)
    seq = np.concatenate([x for k, d in enumerate(documents) for x in (d, [-1 - k])]).astype(np.int64)
    base = np.cumsum(size + 1) - size - 1

    def own(runs: np.ndarray) -> np.ndarray:
        at = np.searchsorted(base, runs[:, 0], "right") - 1
        return np.column_stack([doc[at], runs[:, 0] - base[at], runs[:, 1:]])

    found = [own(r) for r in _small_periods(seq)]
    hashes, t = mix64(seq.astype(np.uint64) + np.uint64(1)), 1

    def joined(x: np.ndarray, t: int) -> np.ndarray:
        """Hashes of fragments of 2t words from those of t; the last ones hold the separator."""
        return mix64(x * np.uint64(0x9E3779B97F4A7C15) + mix64(np.concatenate([x[t:], x[-t:] * np.uint64(3)])[:len(x)]))

    while t < _FIRST_SCALE:
        hashes, t = joined(hashes, t), 2 * t
    while True:
        stay = size >= EXPONENT * t
        if not stay.all():
            keep = np.repeat(stay, size + 1)
            seq, hashes, size, doc = seq[keep], hashes[keep], size[stay], doc[stay]
            base = np.cumsum(size + 1) - size - 1
        if not len(size):
            break
        known = np.concatenate(found)
        at = np.searchsorted(doc, known[:, 0])
        here = (at < len(doc)) & (doc[np.minimum(at, len(doc) - 1)] == known[:, 0])
        known = np.column_stack([known[here, 1] + base[at[here]], known[here, 2:]])
        places = synchronising_set(hashes, t, _covered(len(seq), known, t))
        contexts = joined(hashes, t)
        order = np.argsort(contexts[places], kind="stable")
        places, alike = places[order], contexts[places[order]]
        gap = np.diff(places)
        proposed = np.flatnonzero((alike[1:] == alike[:-1]) & (gap >= t) & (gap < 2 * t))
        new, done = [], {}
        for i, q in sorted(zip(places[proposed].tolist(), gap[proposed].tolist())):
            if i < done.get(q, 0):
                continue
            right, left = _reach(seq, i, q, 1), _reach(seq, i - 1, q, -1) if i else 0
            done[q] = i + max(right, 1)
            if left + right >= (EXPONENT - 1) * q:
                new.append((i - left, left + right + q, q))
        if new:
            found.append(own(np.array(new, np.int64)))
        hashes, t = contexts, 2 * t
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


_ROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                  ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                  ("collapsed", pa.string())])


def _detected(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    def handle(rows: list[tuple]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        texts = [words for _, words in rows]
        ids = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in texts]
        runs = find_runs(ids)
        runs = runs[runs[:, 2] >= min_length]
        ends = np.searchsorted(runs[:, 0], np.arange(len(rows) + 1))
        collapsed = []
        for words, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist()):
            if b > a:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, runs[a:b, 1] + runs[a:b, 3], 1)
                np.add.at(edge, runs[a:b, 1] + runs[a:b, 2], -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            collapsed.append(b" ".join(words).decode())
        parts = pa.StructArray.from_arrays([pa.array(runs[:, k], pa.int64()) for k in (1, 2, 3)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in rows], pa.int64()), pa.array([len(w) for w in texts], pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts), pa.array(collapsed, pa.string())], schema=_ROW)

    for batch in batches:
        rows, held = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            rows.append((doc_id, data.split()))  # white space of bytes is \x20 and \x09-\x0D
            held += len(data)
            if held >= BATCH_BYTES:
                yield handle(rows)
                rows, held = [], 0
        if rows:
            yield handle(rows)


def detect_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row.

    ``runs`` are ``(start, length, period)`` in words from 0, by start and then
    period, of at least ``min_length`` words. ``collapsed`` is the text without
    the words that any run holds after its first period, joined by one space.
    Words are what ``\\x20`` and ``\\x09-\\x0D`` part. Null texts, empty ones and
    those without words have no runs and collapse to nothing. Ids may be null or
    repeat: every row is a text of its own. Empty tables give no rows; other
    columns are not looked at, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lambda it: _detected(it, min_length),
                            "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
