"""Near-duplicate vectors by sorted projection passes.

In every pass each vector gets a code of ``BITS`` signs of random projections,
and the vectors of a label are ordered lexicographically by code. Near vectors
share long prefixes and so stand near each other in some pass: the order is cut
into chunks of ``CHUNK`` rows, and each chunk is compared with itself and the
next one, a bounded neighbour window. The verified pairs of all passes are
united. The number of passes follows from the number of vectors to a label, so
that a pair right at the threshold is missed with a chance of at most ``MISS``.

A group that is larger than the windows fills whole chunks: where at least half
of a chunk's rows are linked to the previous chunk, the window reaches on, and
all chunks of such a run are compared with each other, in blocks. Equal vectors
are one class with a multiplicity and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.llm.graph import components, cut
from faultlens.operators.positions import ranked

BITS, CHUNK, MISS, SEED = 32, 256, 1e-5, 20240

_CHUNK_FIELDS = "pass int, part int, local int, place int, label int, size int, ids binary, vectors binary"


def passes_for(n_label: int, threshold: float) -> int:
    """Passes that miss a pair at ``threshold`` among ``n_label`` vectors with a
    chance of at most ``MISS``: the two have to agree on the leading bits that
    cut the label down to a window. That holds for vectors that point everywhere;
    where a label's vectors share a direction, or more than 256 passes would be
    needed, pairs right at the threshold are missed more often."""
    bits = max(0.0, np.log2(max(1, n_label) / CHUNK)) + 1
    hit = (1 - np.arccos(threshold) / np.pi) ** bits
    return int(min(256, max(4, np.ceil(np.log(MISS) / np.log1p(-min(hit, 0.95))))))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; their largest component
    first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codes(batches: Iterator[pa.RecordBatch], n_passes: int) -> Iterator[pa.RecordBatch]:
    """Rows (label, size, id, vector) -> (pass, label, size, code, id, vector's bytes)."""
    planes: dict[int, np.ndarray] = {}
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        for size in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == size))
            if size not in planes:
                planes[size] = np.random.default_rng([SEED, size]).normal(size=(size, n_passes * BITS))
            raw = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            code = ((_units(raw) @ planes[size]) > 0).reshape(len(raw), n_passes, BITS) @ weights
            held = pa.array([v.tobytes() for v in raw], pa.binary())
            for k in range(n_passes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(raw), k, np.int32)), part.column(0), part.column(1), pa.array(code[:, k]), part.column(2), held],
                    names=["pass", "label", "size", "code", "id", "vector"])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, pass, label, size, code, id, vector) -> a row per chunk."""
    held: list[pa.RecordBatch] = []
    n, key, local = 0, None, 0

    def chunk():
        nonlocal local
        rows = pa.Table.from_batches(held)
        local += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[3]], pa.int32()), pa.array([local], pa.int32()), pa.array([len(rows)], pa.int32()),
             pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()),
             pa.array([rows.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
             pa.array([b"".join(rows.column("vector").to_pylist())], pa.binary())],
            names=["pass", "part", "local", "place", "label", "size", "ids", "vectors"])

    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(i).to_numpy() for i in (1, 2, 3, 0)])
        cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = tuple(group[:, a].tolist())
            if held and now != key:
                yield chunk()
                held, n = [], 0
            key = now
            while a < b:
                take = min(b - a, CHUNK - n)
                held.append(batch.slice(a, take))
                n += take
                a += take
                if n == CHUNK:
                    yield chunk()
                    held, n = [], 0
    if held:
        yield chunk()


_LINKS = "x long, y long, share double, a array<long>, b array<long>"


def _links(x: int, y: int, size: int, left: tuple, right: tuple, threshold: float, dtype: str) -> pa.RecordBatch:
    """The links between two chunks ``(ids, vectors)`` as one row, with the share
    of the second's rows that have one."""
    i, j = np.frombuffer(left[0], np.int64), np.frombuffer(right[0], np.int64)
    u, v = (_units(np.frombuffer(b, dtype).reshape(-1, size)) for b in (left[1], right[1]))
    near = u @ v.T >= threshold
    if x == y:
        near &= np.arange(len(i))[:, None] < np.arange(len(j))
    a, b = np.nonzero(near)
    return pa.RecordBatch.from_arrays(
        [pa.array([x]), pa.array([y]), pa.array([float(near.any(0).mean())]), pa.array([np.minimum(i[a], j[b])], pa.list_(pa.int64())),
         pa.array([np.maximum(i[a], j[b])], pa.list_(pa.int64()))], names=["x", "y", "share", "a", "b"])


def _neighbours(batches: Iterator[pa.RecordBatch], threshold: float, dtype: str) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (key, at), each under its own number and its predecessor's:
    every chunk with itself and with the next of the same pass, label and size."""
    held = None
    for batch in batches:
        for key, at, *group, ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
            if at == key:
                held = (at, group, (ids, vectors))
                yield _links(at, at, group[2], held[2], held[2], threshold, dtype)
            elif held and held[0] == key and held[1] == group:
                yield _links(key, at, group[2], held[2], (ids, vectors), threshold, dtype)


def _pairs(batches: Iterator[pa.RecordBatch], threshold: float, dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, y, size, i, u, j, v in zip(*(c.to_pylist() for c in batch.columns)):
            yield _links(x, y, size, (i, u), (j, v), threshold, dtype)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.93) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Two vectors are linked when their labels are equal and not null, they have
    as many components, and their cosine in double precision is at least
    ``threshold``. ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the smallest id reachable.

    Null, empty and zero vectors, those with null or non-finite components,
    null labels and null ids are linked with nothing (a null id has a null
    component and is kept). Every row counts as a vector; rows that repeat an id
    share a component. Ties in a pass follow the id. An empty table gives no
    rows; other columns are not looked at.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    dtype = {"float": "f4", "double": "f8"}[kind]
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("e"),
                          F.col(label_col).cast("int").alias("label"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0)
             & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0))
    plus = F.lit(0.0).cast(kind)  # makes a negative zero an ordinary one
    rows = cut(rows.withColumn("e", F.when(F.coalesce(sound, F.lit(False)), F.transform("e", lambda x: x + plus))))
    live = rows.where("e IS NOT NULL")
    classes = cut(live.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")))
    widest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    n_passes = passes_for(widest, threshold)
    coded = classes.select("label", F.size("e").alias("size"), "rep", "e").mapInArrow(
        lambda it: _codes(it, n_passes), "pass int, label int, size int, code long, id long, vector binary")
    order = ["pass", "label", "size", "code", "id"]
    chunks = cut(coded.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), *order, "vector")
                 .mapInArrow(_chunked, _CHUNK_FIELDS))
    # A row per partition and pass: the offsets that number the chunks of the whole order.
    counts = chunks.groupBy("part").agg(F.max("local").alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    group = ["pass", "label", "size"]
    chunks = chunks.join(offsets, "part").select((F.col("o") + F.col("local")).alias("at"), *group, "ids", "vectors")

    near = chunks.select(F.explode(F.array("at", F.col("at") - 1)).alias("key"), "at", *group, "ids", "vectors")
    near = cut(near.repartition("key").sortWithinPartitions("key", "at").mapInArrow(
        lambda it: _neighbours(it, threshold, dtype), _LINKS))
    # Runs of chunks that a group fills: the gaps between full chunks number them.
    full = near.where("y = x + 1 AND share >= 0.5").select("y")
    runs = ranked(full, ["y"], "r").select("y", (F.col("y") - F.col("r")).alias("run")).groupBy("run").agg(
        F.min("y").alias("first"), F.max("y").alias("last"))
    spans = runs.select(F.explode(F.sequence(F.col("first") - 1, "last")).alias("x"), "last").select(
        "x", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("last") + 1 - F.col("x")))).alias("step"), "last").where(
        "x + step <= last + 1").select("x", (F.col("x") + F.col("step")).alias("y"))
    pair = F.explode(F.arrays_zip("a", "b")).alias("p")
    found, spans = near.select(pair), cut(spans)
    if not spans.isEmpty():
        x = chunks.select(F.col("at").alias("x"), *group, F.col("ids").alias("i"), F.col("vectors").alias("u"))
        y = chunks.select(F.col("at").alias("y"), *(F.col(c).alias(f"{c}_y") for c in group), F.col("ids").alias("j"), F.col("vectors").alias("v"))
        same = " AND ".join(f"{c} = {c}_y" for c in group)
        found = found.unionByName(spans.join(x, "x").join(y, "y").where(same).select("x", "y", "size", "i", "u", "j", "v").mapInArrow(
            lambda it: _pairs(it, threshold, dtype), _LINKS).select(pair))
    links = cut(found.select("p.a", "p.b").distinct())
    copied = classes.where("many > 1").select(F.col("rep").alias("b"), (F.col("many") - 1).alias("more"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # A hub's links are counted before any shuffle; only links to copied vectors meet these.
    direct = ends.select("a", F.lit(1).cast("long").alias("n")).unionByName(ends.join(copied, "b").select("a", F.col("more").alias("n"))).groupBy(
        F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    roots = components(links).withColumnRenamed("node", "rep")
    judged = classes.join(direct, "rep", "left").join(roots, "rep", "left").select(
        "label", "e", (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    return rows.join(judged, ["label", "e"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
