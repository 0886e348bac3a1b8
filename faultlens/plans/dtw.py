"""k-means over multivariate node series under DTW, with DTW barycentre
averaging (DBA), and the nearest real node to every centroid (SURVEY 2.9
L17-L18, 2.1 S5, 2.8 F9).

Series are stored in blocks: a row holds at most ``BLOCK`` positions of a node.
Rows are partitioned by node and sorted, and a task puts one series after the
other together from its blocks, so no row, message or table cell holds a whole
node, and a task holds a bounded number of points besides the series at hand.
Tasks get a block as one flat list of numbers and look at it in the Arrow batch
it came in, without an object per point; rows that are read many times lie on
disk, not in the memory of executors.

* Distances walk anti-diagonals with two rolling rows. Before any table is
  walked, a lower bound from the envelope of the other series (every point is
  matched with some value between its extremes, the ends with the ends) decides
  whether it is worth it, and a walk stops as soon as two neighbouring diagonals
  are above the best distance known.
* Alignments of long series are found by divide and conquer in linear space:
  forward costs of the first half and backward costs of the second meet in the
  middle row, which splits the problem in two.
* Barycentre updates are a ``groupBy(cluster, t, dim)`` sum of aligned points;
  only centroids (k x T x d numbers) travel between driver and tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.shipping import ship_by_value
from faultlens.operators.features import zscore_scale
from faultlens.operators.keys import join_same
from faultlens.operators.sampling import hash_key

ship_by_value(__name__)

#: Positions of a node in a row, series that are compared at a time and the points
#: these may have together, and cells of a table of directions that may be kept.
BLOCK, PAIRS, POINTS, CELLS = 4096, 256, 1 << 18, 1 << 18


def node_series(df: DataFrame, metrics: Sequence[str], *, node: str = "node", pos: str = "pos",
                start: int = 1, length: int | None = None, scale: bool = True) -> DataFrame:
    """S5 + F9: the rows of each node from ``start`` (``length`` of them, or all), z-scaled per node and
    metric, as ``(node, block, series array<array<double>>)``: blocks of at most
    ``BLOCK`` positions, in position order inside and by number."""
    r = df.where(F.col(pos) >= start).select(node, pos, *metrics)
    if length is not None:
        r = r.where(F.col(pos) < start + length)
    if scale:
        r = zscore_scale(r, list(metrics), part=(node,))
    block = F.floor((F.col(pos) - start) / BLOCK).cast("long")
    pts = r.groupBy(node, block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(pos).alias("p"), F.array(*metrics).alias("v")))).alias("_s"))
    return pts.select(node, "block", F.transform("_s", lambda x: x["v"]).alias("series"))


def _diagonals(n: int, m: int):
    """Anti-diagonals of an n x m table: ``(k, rows i)`` with column ``k - i``."""
    for k in range(n + m - 1):
        yield k, np.arange(max(0, k - m + 1), min(n, k + 1))


def _dtw_batch(A: np.ndarray, la: np.ndarray, B: np.ndarray, lb: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """DTW cost (sqrt of summed squared distances) for pairs (A[p], B[p]).
    A: (P, Ta, d) padded, B: (P, Tb, d) padded; returns (P,).

    The table is walked along its anti-diagonals, whose cells don't depend on
    one another, and only the last two are kept: memory is P x Ta. A pair whose
    cells on two neighbouring diagonals are all above its ``limit`` is given up
    (infinite), as every path crosses one of them.
    """
    n, m = A.shape[1], B.shape[1]
    cost = np.full(len(A), np.inf)
    bound = np.full(len(A), np.inf) if limit is None else np.asarray(limit, float) ** 2 * (1 + 1e-12)
    pair, end, at = np.arange(len(A)), np.asarray(la) + lb - 2, np.asarray(la)
    a = np.ascontiguousarray(A.transpose(2, 1, 0))  # d x rows x pairs
    b = np.ascontiguousarray((B[:1] if B.strides[0] == 0 else B).transpose(2, 1, 0)[:, ::-1])  # columns backwards; one series for all pairs is kept once
    before, last, now = (np.full((n + 1, len(A)), np.inf) for _ in range(3))  # row i + 1 is row i
    low, alive = np.full(len(A), -np.inf), np.ones(len(A), bool)  # least cell of the last diagonal
    for k in range(n + m - 1 if len(A) else 0):
        i, j, c = max(0, k - m + 1), min(n, k + 1), m - 1 - k  # rows i to j
        step = _squares(a[:, i:j], b[:, c + i:c + j])
        if k:
            step += np.minimum(np.minimum(last[i + 1:j + 1], last[i:j]), before[i:j])
        now[i], now[i + 1:j + 1], now[j + 1:j + 2] = np.inf, step, np.inf
        done = np.flatnonzero(alive & (end == k))
        cost[pair[done]] = now[at[done], done]
        least = step.min(0)
        alive &= (end > k) & (np.minimum(low, least) <= bound)
        before, last, now, low = last, now, before, least
        if not alive.any():
            break
        if 2 * alive.sum() < len(alive):
            pair, end, at, bound, low = (x[alive] for x in (pair, end, at, bound, low))
            a, before, last, now = (x[..., alive] for x in (a, before, last, now))
            b = b if b.shape[2] == 1 else b[..., alive]
            alive = np.ones(len(pair), bool)
    return np.sqrt(cost)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of points whose components come first, added in their order."""
    total = None
    for x, y in zip(a, b):
        x = x - y
        x *= x
        total = x if total is None else np.add(total, x, out=total)
    return total


def lower_bound(a: np.ndarray, b: np.ndarray) -> float:
    """At most the DTW cost: what each point lacks to the envelope of the other
    series, the ends to the ends; the larger of both directions."""

    def outside(x: np.ndarray, y: np.ndarray) -> float:
        ends = ((x[0] - y[0]) ** 2).sum() + (((x[-1] - y[-1]) ** 2).sum() if len(x) > 1 else 0.0)
        inner = x[1:-1]
        return ends + (np.maximum(np.maximum(inner - y.max(0), y.min(0) - inner), 0) ** 2).sum()

    return float(np.sqrt(max(outside(a, b), outside(b, a))))


def _table_path(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Optimal path by a table of directions, one byte to a cell."""
    n, m = len(a), len(b)
    came = np.zeros((n, m), np.int8)
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    for k, i in _diagonals(n, m):
        step = ((a[i] - b[k - i]) ** 2).sum(-1)
        now = np.full(n + 1, np.inf)
        if k:
            options = np.stack([before[i], last[i], last[i + 1]])  # from (i-1, j-1), (i-1, j), (i, j-1)
            way = options.argmin(0)
            came[i, k - i] = way
            now[i + 1] = step + options[way, np.arange(len(i))]
        else:
            now[i + 1] = step
        before, last = last, now
    i, j, path = n - 1, m - 1, [(n - 1, m - 1)]
    while i or j:
        way = came[i, j]
        i, j = i - (way != 2), j - (way != 1)
        path.append((int(i), int(j)))
    return path[::-1]


def _table_steps(c: np.ndarray, series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_table_path`` of a centroid and each of some series, whose tables are walked
    together: rows and columns (steps x series) from the last cell back, which of them
    are steps (a path that is at its beginning stays there), and the points (T x series x d)."""
    n = len(c)
    B, lb = _pad(series)
    k_of = np.arange(len(series))
    m = B.shape[1]
    came = np.zeros((n + m - 1, n, len(series)), np.int8)  # by diagonal and row
    before, last = np.full((n + 1, len(series)), np.inf), np.full((n + 1, len(series)), np.inf)
    B = np.ascontiguousarray(B.transpose(1, 0, 2))
    a, b = c.T[:, :, None], np.ascontiguousarray(B.transpose(2, 0, 1)[:, ::-1])
    for k in range(n + m - 1):
        i0, i1, s = max(0, k - m + 1), min(n, k + 1), m - 1 - k
        step = _squares(a[:, i0:i1], b[:, s + i0:s + i1])
        now = np.full((n + 1, len(series)), np.inf)
        if k:
            slant, up, left = before[i0:i1], last[i0:i1], last[i0 + 1:i1 + 1]  # from (i-1, j-1), (i-1, j), (i, j-1)
            least = np.minimum(slant, up)
            came[k, i0:i1] = np.where(left < least, 2, up < slant)
            step += np.minimum(least, left)
        now[i0 + 1:i1 + 1] = step
        before, last = last, now
    i, j = np.full(len(series), n - 1), lb - 1
    rows, cols = [i], [j]
    while (i + j).any():
        way = came[i + j, i, k_of]
        on = i + j > 0
        i, j = i - (on & (way != 2)), j - (on & (way != 1))
        rows.append(i)
        cols.append(j)
    rows, cols = np.array(rows), np.array(cols)
    there = np.ones(rows.shape, bool)
    there[1:] = (rows[:-1] + cols[:-1]) > 0
    return rows, cols, there, B


def _table_paths(c: np.ndarray, series: list[np.ndarray]) -> list[np.ndarray]:
    """Per series an array of (row, column) pairs in order."""
    rows, cols, there, _ = _table_steps(c, series)
    return [np.stack([rows[there[:, p], p], cols[there[:, p], p]], 1)[::-1] for p in range(len(series))]


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of the best paths from (0, 0) to every cell of the last row, in linear space."""
    n, m = len(a), len(b)
    out = np.empty(m)
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    for k, i in _diagonals(n, m):
        now = np.full(n + 1, np.inf)
        now[i + 1] = ((a[i] - b[k - i]) ** 2).sum(-1) + (np.minimum(np.minimum(last[i + 1], last[i]), before[i]) if k else 0.0)
        if k >= n - 1:
            out[k - n + 1] = now[n]
        before, last = last, now
    return out


def dtw_path(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> list[tuple[int, int]]:
    """Optimal alignment path between two series (for DBA and tests).

    Up to ``cells`` cells come from a table of directions. A larger problem is
    split at its middle row: the column in which a best path leaves that row is
    where the forward costs of the upper half and the backward costs of the lower
    half are least together. Memory is linear in the lengths.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    path: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        if (i1 - i0) * (j1 - j0) <= cells or i1 - i0 == 1:
            part = _table_path(a[i0:i1], b[j0:j1]) if i1 - i0 > 1 else [(0, j) for j in range(j1 - j0)]
            path += [(i0 + i, j0 + j) for i, j in part]
            continue
        mid = (i0 + i1) // 2
        upper = _last_row(a[i0:mid], b[j0:j1])
        lower = _last_row(a[mid:i1][::-1], b[j0:j1][::-1])[::-1]
        straight, slant = upper + lower, upper[:-1] + lower[1:]
        j, s = int(straight.argmin()), int(slant.argmin()) if len(slant) else 0
        enter = j
        if len(slant) and slant[s] <= straight[j]:
            j, enter = s, s + 1
        stack += [(mid, i1, j0 + enter, j1), (i0, mid, j0, j0 + j + 1)]
    return path


def dtw_distance(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float(_dtw_batch(a[None], np.array([len(a)]), b[None], np.array([len(b)]))[0])


def _pad(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    L = np.array([len(s) for s in series])
    d = series[0].shape[1] if len(series) and series[0].ndim == 2 else 1
    out = np.zeros((len(series), max(L.max(initial=1), 1), d))
    for i, s in enumerate(series):
        out[i, :len(s)] = s
    return out, L


def _assembled(batches: Iterator[pa.RecordBatch], node: str) -> Iterator[tuple]:
    """``(node, series, blocks, cluster)`` of rows that are sorted by node and block; blocks are (number, positions)."""
    name, cluster, parts, blocks = None, -1, [], []
    for batch in batches:
        flat = batch.column("flat")
        values = flat.flatten().to_numpy(zero_copy_only=False)  # a missing value is nan
        ends = np.cumsum(flat.value_lengths().to_numpy()).tolist()
        rows = (batch.column(c).to_pylist() for c in (node, "block", "dims", "cluster"))
        start = 0
        for key, block, dims, cl, end in zip(*rows, ends):
            if parts and key != name:
                yield name, np.concatenate(parts), blocks, cluster
                parts, blocks = [], []
            if not parts:
                name, cluster = key, cl
            parts.append(values[start:end].reshape(-1, dims).copy())  # the batch may go
            blocks.append((block, (end - start) // dims))
            start = end
        del batch, flat, values, rows
    if parts:
        yield name, np.concatenate(parts), blocks, cluster


def _series_batches(batches: Iterator[pa.RecordBatch], node: str, least: int = 0) -> Iterator[list[tuple]]:
    """Some of ``_assembled`` at a time: at most ``PAIRS``, and ``POINTS`` points padded
    to the longest, ``least`` at least, unless one has more."""
    held, longest = [], least
    for one in _assembled(batches, node):
        if held and (len(held) == PAIRS or (len(held) + 1) * max(longest, len(one[1])) > POINTS):
            yield held
            held, longest = [], least
        held.append(one)
        longest = max(longest, len(one[1]))
    if held:
        yield held


def _by_node(series: DataFrame, node: str) -> DataFrame:
    """Rows ``node, block, dims, flat, cluster`` (-1: not known yet), the blocks of a node together and in order."""
    blocks = series if "block" in series.columns else series.withColumn("block", F.lit(0).cast("long"))
    return blocks.select(node, "block", F.size(F.get("series", F.lit(0))).alias("dims"), F.flatten("series").alias("flat"), F.lit(-1).alias("cluster")) \
        .repartition(node).sortWithinPartitions(node, "block")


def _lower_bounds(A: np.ndarray, la: np.ndarray, centroids: list[np.ndarray]) -> list[np.ndarray]:
    """``lower_bound`` of every padded series and each centroid."""
    p = np.arange(len(A))
    there = np.arange(A.shape[1]) < la[:, None]
    inside = there & (np.arange(A.shape[1]) < la[:, None] - 1)
    inside[:, 0] = False
    high = np.stack([np.where(there, x, -np.inf).max(1) for x in A.transpose(2, 0, 1)])
    low = np.stack([np.where(there, x, np.inf).min(1) for x in A.transpose(2, 0, 1)])

    def over(x: np.ndarray, top: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(x - top, floor - x), 0) ** 2

    found = []
    for c in centroids:
        first, final = ((A[:, 0] - c[0]) ** 2).sum(1), ((A[p, la - 1] - c[-1]) ** 2).sum(1)
        own, other = first + np.where(la > 1, final, 0.0), first + (final if len(c) > 1 else 0.0)
        for x, y, hi, lo in zip(A.transpose(2, 0, 1), c.T, high, low):
            own = own + np.where(inside, over(x, y.max(), y.min()), 0.0).sum(1)
            other = other + over(y[1:-1], hi[:, None], lo[:, None]).sum(1)
        found.append(np.sqrt(np.maximum(own, other)))
    return found


def _bounded(A: np.ndarray, la: np.ndarray, centroid: np.ndarray, low: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to a centroid where they may be at most ``limit`` (else infinite),
    and which pairs the lower bound ``low`` alone ruled out."""
    cost = np.full(len(A), np.inf)
    worth = low <= limit * (1 + 1e-12)
    at = np.flatnonzero(worth)
    if len(at):
        some = A if len(at) == len(A) else A[at, :la[at].max()]
        cost[at] = _dtw_batch(some, la[at], np.broadcast_to(centroid, (len(at), *centroid.shape)), np.full(len(at), len(centroid)), limit[at])
    return cost, ~worth


def _nearest(held: list[tuple], cents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every series and the distance to it, the first on ties."""
    A, la = _pad([one[1] for one in held])
    best, cluster = np.full(len(A), np.inf), np.full(len(A), -1)
    for k, (c, low) in enumerate(zip(cents, _lower_bounds(A, la, cents))):
        cost, _ = _bounded(A, la, c, low, best)
        near = (cost < best) | (cluster < 0)
        best, cluster = np.where(near, cost, best), np.where(near, k, cluster)
    return cluster.astype(np.int32), best


def _typed(it: Iterator[pa.RecordBatch], node: str, seen: list) -> Iterator[pa.RecordBatch]:
    """The batches; ``seen`` gets the Arrow type of node names."""
    for batch in it:
        seen[:] = [batch.column(node).type]
        yield batch


def _nearest_centroid_fn(centroids: list[np.ndarray], node: str):
    cents = [np.asarray(c, float) for c in centroids]

    def fn(it):
        kind = []
        for held in _series_batches(_typed(it, node, kind), node, max(map(len, cents))):
            cluster, best = _nearest(held, cents)
            yield pa.RecordBatch.from_arrays([pa.array([one[0] for one in held], kind[0]), pa.array(cluster), pa.array(best)], [node, "cluster", "dtw"])
    return fn


def _members_fn(centroids: list[np.ndarray], node: str):
    """The rows again with the nearest centroid; the first row of a node says whether that is another one than before."""
    cents = [np.asarray(c, float) for c in centroids]

    def fn(it):
        kind = []
        for held in _series_batches(_typed(it, node, kind), node, max(map(len, cents))):
            cluster, _ = _nearest(held, cents)
            times = [len(one[2]) for one in held]
            flat = np.concatenate([one[1].ravel() for one in held])
            dims = np.repeat(np.array([one[1].shape[1] for one in held], np.int32), times)
            sizes = np.array([n for one in held for _, n in one[2]]) * dims
            moved = np.zeros(len(sizes), bool)
            moved[np.cumsum([0, *times[:-1]])] = cluster != [one[3] for one in held]
            yield pa.RecordBatch.from_arrays([
                pa.array([one[0] for one in held for _ in one[2]], kind[0]), pa.array([b for one in held for b, _ in one[2]], pa.int64()), pa.array(dims),
                pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat),
                pa.array(np.repeat(cluster, times)), pa.array(moved)], [node, "block", "dims", "flat", "cluster", "moved"])
    return fn


def _nearest_node_fn(centroids: list[np.ndarray], limits: list[float], node: str):
    cents = [np.asarray(c, float) for c in centroids]

    def fn(it):
        kind = []
        limit, best = list(limits), [None] * len(cents)
        tried, ruled_out = [0] * len(cents), [0] * len(cents)
        for held in _series_batches(_typed(it, node, kind), node, max(map(len, cents))):
            A, la = _pad([one[1] for one in held])
            for k, (c, low) in enumerate(zip(cents, _lower_bounds(A, la, cents))):
                cost, out = _bounded(A, la, c, low, np.full(len(A), limit[k]))
                tried[k] += len(held)
                ruled_out[k] += int(out.sum())
                for one, x in zip(held, cost.tolist()):
                    if np.isfinite(x) and (best[k] is None or (x, one[0] is not None, one[0]) < best[k]):
                        best[k], limit[k] = (x, one[0] is not None, one[0]), min(limit[k], x)
        if kind:
            yield pa.RecordBatch.from_arrays([
                pa.array([b and b[2] for b in best], kind[0]), pa.array(range(len(cents)), pa.int32()), pa.array([b and b[0] for b in best], pa.float64()),
                pa.array(tried, pa.int64()), pa.array(ruled_out, pa.int64())], [node, "centroid", "dtw", "tried", "ruled_out"])
    return fn


def _align_fn(centroids: list[np.ndarray], node: str):
    cents = [np.asarray(c, float) for c in centroids]

    def fn(it):
        # sums per task, so a task sends k x T x d numbers whatever its series
        sums = [np.zeros_like(c) for c in cents]
        counts = [np.zeros(len(c), np.int64) for c in cents]

        def add(cl, rows, points):
            counts[cl] += np.bincount(rows, minlength=len(cents[cl]))
            for dim, x in enumerate(points.T):
                sums[cl][:, dim] += np.bincount(rows, x, len(cents[cl]))

        for held in _series_batches(it, node):
            clusters_of = np.array([one[3] for one in held])
            for cl in np.unique(clusters_of):
                c = cents[cl]
                members = [held[p][1] for p in np.flatnonzero(clusters_of == cl)]
                longest = max(map(len, members))
                if len(c) * longest > CELLS:
                    for a in members:
                        path = np.array(dtw_path(c, a))
                        add(cl, path[:, 0], a[path[:, 1]])
                else:  # some tables at a time
                    some = max(1, 16 * CELLS // (len(c) * (len(c) + longest)))
                    for p in range(0, len(members), some):
                        rows, cols, there, B = _table_steps(c, members[p:p + some])
                        of = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
                        add(cl, rows[there], B[cols[there], of[there]])
        for cl, (x, n) in enumerate(zip(sums, counts)):
            t, dd = np.nonzero(np.broadcast_to(n[:, None] > 0, x.shape))
            if len(t):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), cl, np.int32)), pa.array(t.astype(np.int32)), pa.array(dd.astype(np.int32)),
                                                  pa.array(x[t, dd]), pa.array(n[t])], ["cluster", "t", "dim", "total", "n"])
    return fn


def _collect_centroids(sums: DataFrame, k: int, old: list[np.ndarray]) -> list[np.ndarray]:
    rows = sums.collect()  # k x T x d numbers
    new = [c.copy() for c in old]
    for r in rows:
        new[r["cluster"]][r["t"], r["dim"]] = r["v"]
    return new


def first_series(series: DataFrame, k: int, node: str = "node", seed: int = 42) -> list[np.ndarray]:
    """The k series with the smallest ``md5(seed:node)``, in that order."""
    rows = series if "flat" in series.columns else _by_node(series, node)
    names = rows.select(node).distinct().orderBy(hash_key(seed, node), node).limit(k).collect()  # k names
    chosen = rows.sparkSession.createDataFrame(names, T.StructType([rows.schema[node]]))
    found = join_same(rows, F.broadcast(chosen), [node], "left_semi").toArrow()  # k series
    series_of = {name: x for name, x, *_ in _assembled(found.sort_by([(node, "ascending"), ("block", "ascending")]).to_batches(), node)}
    return [series_of[r[node]] for r in names]


def dtw_kmeans(series: DataFrame, k: int, *, node: str = "node", seed: int = 42, max_iter: int = 10,
               max_iter_barycenter: int = 30) -> tuple[DataFrame, list[np.ndarray]]:
    """Returns ``(assignments (node, cluster, dtw), centroids)``.
    Initial centroids: the k series with the smallest ``md5(seed:node)``.

    Series lie on the executors' disks, once, with the cluster of the last round;
    a task passes on what it assigns, so nothing is joined or sorted again."""
    members = kept = _by_node(series, node).persist(StorageLevel.DISK_ONLY)
    cents = first_series(members, k, node, seed)
    name = members.schema[node]
    assign_schema = T.StructType([name, T.StructField("cluster", T.IntegerType()), T.StructField("dtw", T.DoubleType())])
    member_schema = T.StructType([*members.schema.fields, T.StructField("moved", T.BooleanType())])
    align_schema = "cluster int, t int, dim int, total double, n long"
    for round_no in range(max_iter):
        assigned = members.mapInArrow(_members_fn(cents, node), member_schema).persist(StorageLevel.DISK_ONLY)
        moved = assigned.where("moved").count()  # scalar
        kept.unpersist()
        members, kept = assigned.drop("moved"), assigned
        if round_no and moved == 0:
            break
        for _b in range(max_iter_barycenter):
            al = members.mapInArrow(_align_fn(cents, node), align_schema)
            sums = al.groupBy("cluster", "t", "dim").agg((F.sum("total") / F.sum("n")).alias("v"))
            cents = _collect_centroids(sums, k, cents)
    return members.mapInArrow(_nearest_centroid_fn(cents, node), assign_schema), cents


def nearest_nodes(series: DataFrame, centroids: list[np.ndarray], node: str = "node", counts: bool = False) -> DataFrame:
    """The real node closest (DTW) to every centroid, the smallest name on ties.

    In every task the node with the least lower bound of each centroid is measured
    first; the least of these distances is the limit above which no other table is
    walked to its end. With
    ``counts`` the result says how many nodes were looked at and how many of them
    the lower bound alone ruled out. No nodes give no rows.
    """
    blocks = _by_node(series, node)
    cents = [np.asarray(c, float) for c in centroids]

    def promising(it):
        best = [None] * len(cents)
        for held in _series_batches(it, node, max(map(len, cents))):
            for k, lows in enumerate(_lower_bounds(*_pad([one[1] for one in held]), cents)):
                for one, low in zip(held, lows.tolist()):
                    if best[k] is None or low < best[k][0]:
                        best[k] = (low, one[1])
        if all(best):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cents)), pa.int32()), pa.array([dtw_distance(b[1], c) for b, c in zip(best, cents)])], ["centroid", "dtw"])

    found = blocks.mapInArrow(promising, "centroid int, dtw double").groupBy("centroid").agg(F.min("dtw").alias("limit")).collect()  # a number per centroid
    limits = {r["centroid"]: r["limit"] for r in found}
    schema = T.StructType([T.StructField(node, series.schema[node].dataType), T.StructField("centroid", T.IntegerType()), T.StructField("dtw", T.DoubleType()),
                           T.StructField("tried", T.LongType()), T.StructField("ruled_out", T.LongType())])
    d = blocks.mapInArrow(_nearest_node_fn(cents, [limits.get(k, np.inf) for k in range(len(cents))], node), schema)
    out = d.groupBy("centroid").agg(F.min(F.when(F.col("dtw").isNotNull(), F.struct("dtw", node))).alias("b"),
                                    F.sum("tried").alias("tried"), F.sum("ruled_out").alias("ruled_out"))
    out = out.where("b IS NOT NULL").select("centroid", f"b.{node}", "b.dtw", "tried", "ruled_out")
    return out if counts else out.drop("tried", "ruled_out")
