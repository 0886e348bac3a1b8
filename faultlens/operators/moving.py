"""Sliding-window statistics of many nodes in one numpy call, at a cost per row that
doesn't grow with the window.

A task reads rows sorted by (node, chunk, position) and handles whole groups, some
tens of thousands of rows at a time, as one array; no window crosses a group.

* Means, deviations, co-moments, minima and maxima: positions are cut into blocks of
  w at multiples of w, so every window is the end of one block and the beginning of
  the next. Moments of all beginnings and ends grow by Welford's recurrence, for all
  blocks at once, and two of them are combined by the parallel formula. Nothing is
  ever subtracted out, so values near 1e9 with a small spread, or a huge value that
  has left the window, cost no precision, and the result doesn't depend on chunks.
* Percentiles of wide windows: a wavelet matrix over the ranks of the rows answers
  "k-th smallest of rows l to r" for all windows at once in as many steps as a rank
  has bits. Narrow windows are sorted.
* Mode: running counts per label; with many labels, counts and counts of counts that
  one row enters and one row leaves.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from faultlens.constants import PERCENTILES
from faultlens.functions.shipping import ship_by_value

ship_by_value("faultlens.operators.moving")
ship_by_value("faultlens.constants")

#: Rows that are handled at a time (more if one group has more), the widest windows
#: that are sorted, cells of a table of sorted windows, and labels that are counted apart.
ROWS, SORT_W, CELLS, FEW_LABELS = 1 << 16, 128, 1 << 22, 64


class Windows:
    """The full windows of ``w`` rows inside groups of consecutive rows.

    ``ends`` are the rows that windows end at; ``first`` says where each row's group
    begins, ``pos`` counts rows inside a node. Groups shorter than ``w`` have none.
    """

    def __init__(self, first: np.ndarray, pos: np.ndarray, w: int, wanted: np.ndarray) -> None:
        n = len(pos)
        self.w, self.n = w, n
        self.ends = np.flatnonzero(wanted & (np.arange(n) - first >= w - 1))
        self.starts = self.ends - (w - 1)
        starts = np.flatnonzero(first == np.arange(n))
        sizes = np.diff(np.append(starts, n))
        blocks = np.where(sizes >= w, (pos[starts] + sizes - 1) // w - pos[starts] // w + 1, 0)
        self.n_blocks = int(blocks.sum())
        base = np.cumsum(blocks) - blocks
        group = np.repeat(np.arange(len(starts)), sizes)
        self.inside = np.flatnonzero(blocks[group] > 0)
        self.block = (base[group] + pos // w - (pos[starts] // w)[group])
        self.place = pos % w
        at = self.ends
        self.whole = self.place[at] == w - 1
        self.head = (self.place[at], self.block[at])  # the window's rows in its last block
        self.tail = (np.where(self.whole, 0, self.place[at] + 1), np.where(self.whole, 0, self.block[at] - 1))

    def laid_out(self, x: np.ndarray) -> np.ndarray:
        """A row per place in a block, a column per block; NaN where nothing is."""
        out = np.full((self.w, self.n_blocks), np.nan)
        out[self.place[self.inside], self.block[self.inside]] = x[self.inside]
        return out


class Moments:
    """Count, mean and squared deviations of all beginnings (or ends) of blocks."""

    def __init__(self, rows: np.ndarray, backward: bool) -> None:
        w, nb = rows.shape
        self.order = range(w - 1, -1, -1) if backward else range(w)
        self.n, self.mean, self.m2 = (np.zeros((w, nb)) for _ in range(3))
        n, mean, m2 = np.zeros(nb), np.zeros(nb), np.zeros(nb)
        for j in self.order:
            x = rows[j]
            seen = ~np.isnan(x)
            n = n + seen
            d = np.where(seen, x - mean, 0.0)
            mean = mean + d / np.maximum(n, 1)
            m2 = m2 + d * np.where(seen, x - mean, 0.0)
            self.n[j], self.mean[j], self.m2[j] = n, mean, m2

    def together(self, x: np.ndarray, y: np.ndarray, other: Moments) -> np.ndarray:
        """Co-moments with another column; right where neither has a hole."""
        out, c, old = np.zeros_like(x), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for j in self.order:
            step = (x[j] - old) * (y[j] - other.mean[j])
            c = c + np.where(np.isnan(step), 0.0, step)
            out[j], old = c, self.mean[j]
        return out


class Column:
    """One column over the windows, with what several statistics share."""

    def __init__(self, x: np.ndarray, at: Windows) -> None:
        self.x, self.at = x, at
        self._moments = None

    def moments(self):
        if self._moments is None:
            self.rows = self.at.laid_out(self.x)
            self.head, self.tail = Moments(self.rows, False), Moments(self.rows, True)
            (h, t), apart = (self.at.head, self.at.tail), ~self.at.whole
            n1, n2 = self.head.n[h], np.where(apart, self.tail.n[t], 0)
            self.d = np.where(apart & (n2 > 0) & (n1 > 0), self.tail.mean[t] - self.head.mean[h], 0.0)
            n = n1 + n2
            share = np.divide(n2, n, out=np.zeros_like(n), where=n > 0)
            mean = np.where(n1 > 0, self.head.mean[h] + self.d * share, self.tail.mean[t])
            m2 = self.head.m2[h] + np.where(apart, self.tail.m2[t], 0.0) + self.d * self.d * n1 * share
            self.weight = n1 * share
            self._moments = n, np.where(n > 0, mean, np.nan), m2
        return self._moments

    def mean(self) -> np.ndarray:
        return self.moments()[1]

    def std(self) -> np.ndarray:
        n, _, m2 = self.moments()
        return np.sqrt(np.divide(m2, n - 1, out=np.full(len(n), np.nan), where=n > 1))

    def extreme(self, pick: np.ufunc) -> np.ndarray:
        self.moments()
        head, tail = pick.accumulate(self.rows), pick.accumulate(self.rows[::-1])[::-1]
        return np.where(self.at.whole, head[self.at.head], pick(head[self.at.head], tail[self.at.tail]))

    def correlation(self, other: Column) -> np.ndarray:
        """Pearson's, 0 where a window has a hole or a column is constant."""
        (n, _, a), (k, _, b) = self.moments(), other.moments()
        head = self.head.together(self.rows, other.rows, other.head)
        tail = self.tail.together(self.rows, other.rows, other.tail)
        c = head[self.at.head] + np.where(self.at.whole, 0.0, tail[self.at.tail]) + self.d * other.d * self.weight
        size = np.sqrt(a) * np.sqrt(b)
        full = (n == self.at.w) & (k == self.at.w) & (size > 0)
        return np.divide(c, size, out=np.zeros(len(n)), where=full)

    def percentiles(self, fractions: Sequence[float]) -> list[np.ndarray]:
        """Linear interpolation between the two nearest order statistics, holes left out."""
        seen = ~np.isnan(self.x)
        upto = np.concatenate([[0], np.cumsum(seen)])
        lo, hi = upto[self.at.starts], upto[self.at.ends + 1]
        size = hi - lo
        h = np.multiply.outer(np.array(fractions), np.maximum(size - 1, 0))
        below = np.floor(h).astype(np.int64)
        above = np.minimum(below + 1, np.maximum(size - 1, 0))
        if self.at.w <= SORT_W:
            a, b = self._sorted(below, above)
        else:
            tree = WaveletMatrix(self.x[seen])
            a, b = tree.kth(lo, hi, below), tree.kth(lo, hi, above)
        return list(np.where(size > 0, a + (b - a) * (h - below), np.nan))

    def _sorted(self, below: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, m = self.at.w, len(self.at.ends)
        a, b = np.empty(below.shape), np.empty(below.shape)
        step = max(1, CELLS // w)
        views = np.lib.stride_tricks.sliding_window_view(self.x, w)
        for k in range(0, m, step):
            s = np.sort(views[self.at.starts[k:k + step]], axis=1)  # NaN goes last
            rows = np.arange(len(s))
            a[:, k:k + step], b[:, k:k + step] = s[rows, below[:, k:k + step]], s[rows, above[:, k:k + step]]
        return a, b


class WaveletMatrix:
    """Order statistics of any stretch of a sequence, for many stretches at once."""

    def __init__(self, x: np.ndarray) -> None:
        self.values, rank = np.unique(x, return_inverse=True)
        self.levels = []
        for bit in range(max(1, int(len(self.values) - 1).bit_length()) - 1, -1, -1):
            one = (rank >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)]).astype(np.int32)
            self.levels.append((bit, zeros))
            rank = np.concatenate([rank[~one], rank[one]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` (from 0) in rows ``lo`` to ``hi``; ``k`` may have
        several rows of ranks. Anything where a stretch is empty."""
        if not len(self.values):
            return np.full(k.shape, np.nan)
        lo, hi = (np.broadcast_to(v, k.shape).astype(np.int32) for v in (lo, hi))
        k, found = k.astype(np.int32), np.zeros(k.shape, np.int32)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            low = k < b - a
            k = np.where(low, k, k - (b - a))
            lo, hi = np.where(low, a, zeros[-1] + lo - a), np.where(low, b, zeros[-1] + hi - b)
            found += ~low * np.int32(1 << bit)
        return self.values[np.minimum(found, len(self.values) - 1)]


def mode_labels(x: np.ndarray, at: Windows) -> np.ndarray:
    """The most frequent label of each window, the smallest of equals; NaN if it has none."""
    labels = np.unique(x[~np.isnan(x)])
    best, most = np.full(len(at.ends), np.nan), np.zeros(len(at.ends), np.int64)
    if len(labels) > FEW_LABELS:
        return _mode_by_counts(x, at)
    for label in labels:
        upto = np.concatenate([[0], np.cumsum(x == label)])
        count = upto[at.ends + 1] - upto[at.starts]
        better = count > most
        best[better], most[better] = label, count[better]
    return best


def _mode_by_counts(x: np.ndarray, at: Windows) -> np.ndarray:
    """One row in and one out: a heap of labels per count, and how many labels have it.
    Labels whose count has changed since are dropped when they come to the top."""
    out, values = [], x.tolist()
    count: dict[float, int] = {}
    having: dict[int, int] = defaultdict(int)
    heaps: dict[int, list[float]] = defaultdict(list)
    top, lo, hi = 0, 0, 0

    def moved(label: float, by: int) -> None:
        nonlocal top
        old = count.get(label, 0)
        new = count[label] = old + by
        having[old] -= 1
        having[new] += 1
        heapq.heappush(heaps[new], label)
        if new > top:
            top = new
        elif old == top and not having[old]:
            top = new

    for start, end in zip(at.starts.tolist(), at.ends.tolist()):
        if start >= hi:  # nothing in common with the last window
            count, having, heaps, top, lo, hi = {}, defaultdict(int), defaultdict(list), 0, start, start
        for v in values[hi:end + 1]:
            if v == v:
                moved(v, 1)
        for v in values[lo:start]:
            if v == v:
                moved(v, -1)
        lo, hi = start, end + 1
        heap = heaps[top]
        while top and count[heap[0]] != top:
            heapq.heappop(heap)
        out.append(heap[0] if top else np.nan)
    return np.array(out, float)


def last_labels(x: np.ndarray, at: Windows) -> np.ndarray:
    """The latest label that is not 0, else 0."""
    last = np.maximum.accumulate(np.where((x != 0) & ~np.isnan(x), np.arange(len(x)), -1))[at.ends]
    return np.where(last >= at.starts, x[np.maximum(last, 0)], 0.0)


def _statistics(columns: dict[str, Column], metrics, stats, pairs) -> Iterator[np.ndarray]:
    wanted = [s for s in stats if s in PERCENTILES]
    for m in metrics:
        c, at = columns[m], columns[m].at
        pct = dict(zip(wanted, c.percentiles([PERCENTILES[s] for s in wanted]))) if wanted else {}
        for s in stats:
            if s in pct:
                yield pct[s]
            elif s == "mean":
                yield c.mean()
            elif s == "std":
                yield c.std()
            elif s == "min":
                yield c.extreme(np.fmin)
            elif s == "max":
                yield c.extreme(np.fmax)
            elif s == "last":
                yield c.x[at.ends]
            elif s == "sumdiff":
                yield c.x[at.ends] - c.x[at.starts]
            else:
                raise ValueError(f"unknown statistic {s}")
    for a, b in pairs:
        yield columns[a].correlation(columns[b])


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``functions.scalar.quantize``: the same operations, a whole number of 64 bits between."""
    scale = float(10 ** digits)
    whole = np.floor(x * scale + 0.5001)
    return np.clip(whole, -2.0 ** 63, 2.0 ** 63, out=whole) / scale


def _starts(keys: list[pa.ChunkedArray]) -> np.ndarray:
    """Rows whose keys differ from those of the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        codes = key.combine_chunks().dictionary_encode()
        codes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def window_batches(batches: Iterator[pa.RecordBatch], *, keys: Sequence[str], chunk: str, halo: str, pos: str, metrics: Sequence[str],
                   stats: Sequence[str], pairs: Sequence[tuple[str, str]], label: str | None, label_mode: str, w: int, step: int,
                   schema: pa.Schema, digits: int | None = None) -> Iterator[pa.RecordBatch]:
    """Window rows of record batches that are sorted by keys, chunk and position;
    statistics are rounded to ``digits`` decimals if given."""

    def handled(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        p = table.column(pos).to_numpy().astype(np.int64)
        wanted = (p >= w) & ((p - w) % step == 0) & ~table.column(halo).to_numpy()
        at = Windows(first, p, w, wanted)
        if not len(at.ends):
            return
        need = dict.fromkeys([*metrics, *(x for pair in pairs for x in pair)])
        numbers = {c: table.column(c).cast(pa.float64()).to_numpy() for c in need}
        columns = {c: Column(x, at) for c, x in numbers.items()}
        rows = pa.array(at.ends)
        out = [table.column(k).take(rows).combine_chunks() for k in keys] + [pa.array(p[at.ends]), pa.array((p[at.ends] - w) // step)]
        found = _statistics(columns, metrics, stats, pairs)
        out += [pa.array(v if digits is None else _rounded(v, digits), from_pandas=True) for v in found]
        if label:
            x = table.column(label).cast(pa.float64()).to_numpy()
            out.append(pa.array(mode_labels(x, at) if label_mode == "mode" else last_labels(x, at), from_pandas=True).cast(pa.int32()))
        made = pa.Table.from_arrays([v.cast(f.type) for v, f in zip(out, schema)], schema=schema)
        yield from made.to_batches(max_chunksize=1 << 14)

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= ROWS:
            table = pa.Table.from_batches(held)
            new = _starts([table.column(c) for c in (*keys, chunk)])
            cut = int(np.flatnonzero(new)[-1])  # the last group may go on
            if cut:
                yield from handled(table.slice(0, cut), new[:cut])
            held, rows = table.slice(cut).to_batches(), len(table) - cut
    if held:
        table = pa.Table.from_batches(held)
        yield from handled(table, _starts([table.column(c) for c in (*keys, chunk)]))
