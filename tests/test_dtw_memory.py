"""What tasks of the DTW jobs hold, and NULL names among the series."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from faultlens.plans import dtw


def walks(n, seed, longest=40):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=(int(rng.integers(1, longest)), 2)).cumsum(0) + rng.normal() * 3 for _ in range(n)]


def stored(spark, xs, names, block=1000):
    rows = [(name, b, x[b * block:(b + 1) * block].tolist()) for name, x in zip(names, xs) for b in range(-(-len(x) // block))]
    return spark.createDataFrame(rows, "node string, block long, series array<array<double>>").repartition(3)


def batches(n, rows, points):
    """Rows as tasks get them: ``n`` batches of blocks, two to a node."""
    rng = np.random.default_rng(3)
    for b in range(n):
        flat = rng.normal(size=rows * points * 3)
        yield pa.RecordBatch.from_arrays([
            pa.array([f"N{b:03d}{r // 2:05d}" for r in range(rows)]), pa.array([r % 2 for r in range(rows)]), pa.array([3] * rows, pa.int32()),
            pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * points * 3, flat), pa.array([-1] * rows, pa.int32())],
            ["node", "block", "dims", "flat", "cluster"])


def test_a_task_holds_no_object_per_point():
    """Batches of a million points in 25 MB: a task holds them as they come, and a few series at a time."""
    cents = [np.zeros((4, 3)), np.ones((4, 3))]
    tracemalloc.start()
    n = sum(len(out) for out in dtw._nearest_centroid_fn(cents, "node")(batches(2, 256, 4096)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 * 128
    assert peak < 130e6  # an array to a point is 118 MB a batch, and two batches are alive while one follows the other


def test_series_lie_on_disk_once(spark):
    """No series stays in the memory of executors, and no copy is left behind."""
    def kept():
        return {i.id(): (i.memSize(), i.diskSize()) for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()}

    before = set(kept())
    xs = walks(40, 1)
    assigned, _ = dtw.dtw_kmeans(stored(spark, xs, [f"N{i}" for i in range(40)]), 3, max_iter=3, max_iter_barycenter=1)
    assert assigned.count() == 40
    new = {k: v for k, v in kept().items() if k not in before}
    assert len(new) == 1
    assert all(memory == 0 and disk > 0 for memory, disk in new.values())


def test_a_nameless_node_is_a_node(spark):
    """It may be a first centroid, as NULL comes first, and is averaged with the others."""
    xs = walks(9, 2)
    names = [None, *(f"N{i}" for i in range(1, 9))]
    one, cents = dtw.dtw_kmeans(stored(spark, xs, names, block=7), 2, max_iter=2, max_iter_barycenter=1)
    assert np.allclose(dtw.first_series(stored(spark, xs, names, block=7), 1)[0], xs[0])
    got = {r.node: r.dtw for r in one.collect()}
    assert got == {name: pytest.approx(min(dtw.dtw_distance(x, c) for c in cents)) for name, x in zip(names, xs)}
    near = dtw.nearest_nodes(stored(spark, xs, names), [xs[0], xs[4]]).orderBy("centroid").collect()
    assert [(r.node, r.dtw) for r in near] == [(None, 0.0), ("N4", 0.0)]


def test_assignments_follow_plain_rounds(spark):
    """Clusters that tasks pass on are those of assigning, averaging and assigning again."""
    xs = walks(30, 5, longest=25)
    names = [f"N{i:02d}" for i in range(30)]
    one, cents = dtw.dtw_kmeans(stored(spark, xs, names, block=6), 3, max_iter=3, max_iter_barycenter=2)
    want = dtw.first_series(stored(spark, xs, names), 3)
    last = None
    for _ in range(3):
        of = [int(np.argmin([dtw.dtw_distance(x, c) for c in want])) for x in xs]
        if of == last:
            break
        last = of
        for _b in range(2):
            sums, counts = [np.zeros_like(c) for c in want], [np.zeros(len(c)) for c in want]
            for x, k in zip(xs, of):
                for i, j in dtw._table_path(want[k], x):
                    sums[k][i] += x[j]
                    counts[k][i] += 1
            want = [np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c) for s, n, c in zip(sums, counts, want)]
    assert all(np.allclose(a, b) for a, b in zip(cents, want))
    assert {r.node: r.cluster for r in one.collect()} == {n: int(np.argmin([dtw.dtw_distance(x, c) for c in want])) for n, x in zip(names, xs)}


def test_bounds_of_many_series_are_those_of_each():
    xs = [*walks(25, 8), np.full((3, 2), np.nan), np.zeros((1, 2))]
    cents = [*walks(2, 9), np.ones((1, 2)), np.ones((2, 2))]
    A, la = dtw._pad(xs)
    for c, low in zip(cents, dtw._lower_bounds(A, la, cents)):
        assert np.allclose(low, [dtw.lower_bound(x, c) for x in xs], equal_nan=True)
