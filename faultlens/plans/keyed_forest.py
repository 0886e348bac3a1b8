"""Many random forests at once: one job for all models, no fit per node.

A model is a value of ``model``; a row may be a training row of some models and
a test row of others. All trees of all models grow together, and every choice
follows from a seed by md5, so a lost task repeats the same trees:

* Features become bins by quantiles of a bounded md5 sample of the rows.
* The weight of a row in a tree is a Poisson draw from ``md5(seed:model:row)``,
  the features that a node looks at come from ``md5(seed:model:tree:path)``.
* A split maximises the sum over both sides of (squared class counts) / size,
  ties to the smallest feature, then the smallest bin. Nodes are named by their
  path (a string of 0 and 1), so depth is not limited.

Two plans grow the same trees:

* A model of more than ``local_rows`` rows grows level by level: one grouped
  aggregation keyed by (model, tree, path, feature, bin) counts the classes, and
  its few rows decide the splits that the rows then follow.
* As soon as a model, or a node of it, has at most ``local_rows`` rows, the rest
  is grown in one task per (model, block of trees), or per node, whose memory
  that number bounds. Many small models thus cost one shuffle in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from math import exp, factorial, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from faultlens.functions.shipping import ship_by_value
from faultlens.operators.sampling import hash_key
from faultlens.session import ensure_checkpoint_dir

ship_by_value("faultlens.plans.keyed_forest")

#: Rows of a model that one task may hold, trees of a small model to a task, rows
#: that the bins come from, and splits that a join may broadcast.
LOCAL_ROWS, TREE_BLOCK, SAMPLE_ROWS, BROADCAST_SPLITS = 1_000_000, 10, 10_000, 100_000
#: Rows times trees that a task should grow of a model with few enough rows.
BLOCK_WORK = 300_000
#: Nodes of a forest that may go to every task.
SHIPPED_NODES = 100_000

#: Modulus of the draws, and the draws from which a Poisson(1) weight is 1, 2, ...
_P = (1 << 31) - 1
POISSON = [int(_P * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(8)]

_VOTES = 1_000_000  # class shares of a leaf are whole millionths, so that sums are exact
_CELLS = 1 << 22


def _settled(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


# Draws ------------------------------------------------------------------------
def _seeds(h: Column) -> list[Column]:
    return [(F.conv(F.substring(h, a, 8), 16, 10).cast("long") % _P) for a in (1, 9)]


def _draw(x, y, k):
    """The k-th draw of a pair of seeds, the same for columns and numpy arrays."""
    return (x * (2 * k + 1) + y * (((k + 1) * (k + 1)) % _P)) % _P


def _md5_seeds(text: str) -> tuple[int, int]:
    h = hashlib.md5(text.encode()).hexdigest()
    return int(h[:8], 16) % _P, int(h[8:16], 16) % _P


# Bins ---------------------------------------------------------------------------
def bin_edges(features: DataFrame, cols: Sequence[str], key: Sequence[str], bins: int = 32, seed: int = 42,
              sample_rows: int = SAMPLE_ROWS) -> list[list[float]]:
    """Per column the distinct values at ranks ``k * n / bins`` of the ``sample_rows``
    rows with the smallest md5. NULLs don't count; a column without values has no edge."""
    values = [F.col(f"`{c}`").cast("double") for c in cols]
    ranked = features.select(hash_key(seed, *key).alias("_h"), F.array(*values).alias("_v")).orderBy("_h").limit(sample_rows)
    sample = ranked.select(F.posexplode("_v").alias("feature", "value")).where(F.col("value").isNotNull())
    sorted_values = sample.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("v"))
    at = [F.get("v", F.floor(F.size("v") * k / bins).cast("int")) for k in range(1, bins)]
    found = {r["feature"]: r["edges"] for r in sorted_values.select("feature", F.array_distinct(F.array(*at)).alias("edges")).collect()}
    return [list(found.get(i, [])) for i in range(len(cols))]


def binned(cols: Sequence[str], edges: Sequence[Sequence[float]]) -> Column:
    """``array<tinyint>``: per column the number of edges below its value (NULL: 0)."""
    table = [np.array(e, float) for e in edges]

    @F.arrow_udf("array<tinyint>")
    def bins(rows: pa.Array) -> pa.Array:
        values = rows.flatten()
        x = values.to_numpy(zero_copy_only=False).reshape(len(rows), len(table))
        out = np.empty(x.shape, np.int8)
        for i, e in enumerate(table):
            out[:, i] = np.searchsorted(e, x[:, i])
        out[values.is_null().to_numpy(zero_copy_only=False).reshape(out.shape)] = 0
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(table), dtype=np.int32), out.ravel())

    return bins(F.array(*(F.col(f"`{c}`").cast("double") for c in cols)))


# In one task ----------------------------------------------------------------------
@dataclass(frozen=True)
class _Rule:
    seed: int
    trees: int
    features: int
    tried: int
    classes: int
    bins: int
    max_depth: int | None
    min_rows: int
    bootstrap: bool

    def ends(self, counts: np.ndarray, depth: int) -> np.ndarray:
        n = counts.sum(-1)
        stop = (counts.max(-1) == n) | (n < self.min_rows)
        return np.ones_like(stop) if self.max_depth is not None and depth >= self.max_depth else stop

    def looked_at(self, model: str, tree: int, paths: Sequence[str]) -> np.ndarray:
        """The features that each node tries, ascending."""
        x, y = (np.array(v, np.int64)[:, None] for v in zip(*(_md5_seeds(f"{self.seed}:{model}:{tree}:{p}") for p in paths)))
        k = np.arange(self.features, dtype=np.int64)
        if self.tried >= self.features:
            return np.broadcast_to(k, (len(paths), self.features))
        drawn = _draw(x, y, k) * self.features + k  # ties to the smaller feature
        return np.sort(np.partition(drawn, self.tried - 1, axis=1)[:, :self.tried] % self.features, axis=1)


#: Rows up to which a leaf's rows are sorted by bin instead of counted in a table
#: of bins and classes, and values sorted at a time.
_FEW, _SORTED = 32, 1 << 18


def _sort_columns(x: np.ndarray) -> None:
    """Sorts every column of ``x`` (a power of two rows) in place, by Batcher's network."""
    n, p = len(x), 1
    while p < n:
        k = p
        while k:
            for j in range(k % p, n - k, 2 * k):
                for i in range(j, min(j + k, n - k)):
                    if i // (2 * p) == (i + k) // (2 * p):
                        low = np.minimum(x[i], x[i + k])
                        np.maximum(x[i], x[i + k], out=x[i + k])
                        x[i] = low
            k //= 2
        p *= 2


def _splits_by_table(rule: _Rule, bins, label, weight, rows_of, sizes, tries) -> tuple[np.ndarray, ...]:
    """Per leaf best score (-1: none), place of its feature in ``tries`` and bin; ``rows_of``
    has the rows of one leaf after the other."""
    n_leaf, m = tries.shape
    cells = m * rule.bins * rule.classes
    score, place, cut = np.full(n_leaf, -1.0), np.zeros(n_leaf, np.int64), np.zeros(n_leaf, np.int64)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    step = max(1, _CELLS // cells)
    for a in range(0, n_leaf, step):
        b = min(a + step, n_leaf)
        rows = rows_of[edge[a]:edge[b]]
        at = np.repeat(np.arange(b - a), sizes[a:b])
        first = at * cells + label[rows]
        hist = np.zeros((b - a) * cells, np.int64)
        for r in range(0, len(rows), _CELLS // m + 1):  # a bounded number of entries at a time
            of = slice(r, r + _CELLS // m + 1)
            seen = bins[rows[of, None], tries[a + at[of]]].astype(np.int64)
            index = first[of, None] + (seen + np.arange(m) * rule.bins) * rule.classes
            hist += np.bincount(index.ravel(), np.repeat(weight[rows[of]], m), minlength=len(hist)).astype(np.int64)
        lower = hist.reshape(b - a, m, rule.bins, rule.classes).cumsum(2)
        upper = lower[:, :, -1:, :] - lower
        nl, nr = lower.sum(-1), upper.sum(-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (lower * lower).sum(-1) / nl + (upper * upper).sum(-1) / nr
        s = np.where((nl > 0) & (nr > 0), s, -1.0).reshape(b - a, -1)
        best = s.argmax(1)
        score[a:b], place[a:b], cut[a:b] = s[np.arange(b - a), best], best // rule.bins, best % rule.bins
    return score, place, cut


def _splits_by_sorting(rule: _Rule, bins, label, weight, rows, held, tries, total) -> tuple[np.ndarray, ...]:
    """The same for leaves of a few rows: ``rows`` has a line per leaf, of which ``held``
    says what is filled. Entries of a feature are sorted by bin, and the squared class
    counts of both sides follow from entry to entry, so no cell is empty work."""
    n_leaf, width = rows.shape
    m, bits = tries.shape[1], rule.classes.bit_length()
    score, place, cut = np.full(n_leaf, -1.0), np.zeros(n_leaf, np.int64), np.zeros(n_leaf, np.int64)
    step = max(1, _SORTED // (m * width))
    for a in range(0, n_leaf, step):
        r, of = rows[a:a + step].T, held[a:a + step].T  # width x leaves
        k = r.shape[1]
        low_bits = np.where(of, (label[r] << 4) | weight[r], 0).astype(np.int32)
        seen = bins[r[:, :, None], tries[a:a + step][None]].astype(np.int32)
        x = np.where(of[:, :, None], (seen << (bits + 4)) | low_bits[:, :, None], 127 << (bits + 4)).reshape(width, k * m)
        _sort_columns(x)
        w, y, bin_of = x & 15, (x >> 4) & ((1 << bits) - 1), x >> (bits + 4)
        every = np.repeat(total[a:a + step].astype(np.int32), m, 0)
        lane = np.arange(k * m, dtype=np.int64) * rule.classes
        n, rest = every.sum(1), (every * every).sum(1)
        every = every.ravel()
        low_n, low, both = (np.zeros(k * m, np.int32) for _ in range(3))  # size, squares, products with the whole
        best, at = np.full(k * m, -1.0), np.zeros(k * m, np.int32)
        for p in range(width - 1):
            before = np.zeros(k * m, np.int32)
            for i in range(p):
                before += w[i] * (y[i] == y[p])
            low_n += w[p]
            low += w[p] * (2 * before + w[p])
            both += w[p] * every[lane + y[p]]
            high = rest - 2 * both + low
            end = np.flatnonzero((bin_of[p] != bin_of[p + 1]) & (low_n < n))
            value = low[end] / low_n[end] + high[end] / (n - low_n)[end]
            more = value > best[end]
            best[end[more]], at[end[more]] = value[more], bin_of[p][end[more]]
        best, at = best.reshape(k, m), at.reshape(k, m)
        j = best.argmax(1)
        score[a:a + step], place[a:a + step], cut[a:a + step] = best[np.arange(k), j], j, at[np.arange(k), j]
    return score, place, cut


def _best_splits(rule: _Rule, bins, label, weight, leaf, tries) -> tuple[np.ndarray, ...]:
    """Per leaf: total counts, best score (-1: none), its feature, bin and left counts.
    Rows without weight only follow the splits and should not come here."""
    n_leaf, m = tries.shape
    count = lambda w: np.bincount(leaf * rule.classes + label, w, minlength=n_leaf * rule.classes).astype(np.int64).reshape(n_leaf, -1)
    total = count(weight)
    score, place, cut = np.full(n_leaf, -1.0), np.zeros(n_leaf, np.int64), np.zeros(n_leaf, np.int64)
    order = np.argsort(leaf, kind="stable")
    sizes = np.bincount(leaf, minlength=n_leaf)
    start = np.cumsum(sizes) - sizes
    by_table = sizes > _FEW
    for width in (2, 4, 8, 16, _FEW):
        some = np.flatnonzero((sizes > width // 2) & (sizes <= width)) if width > 2 else np.flatnonzero(sizes == 2)
        if not len(some):
            continue
        if len(some) * m * rule.bins * rule.classes < 300 * width * width:  # too few of them for many small steps
            by_table[some] = True
            continue
        held = np.arange(width) < sizes[some, None]
        rows = order[start[some, None] + np.where(held, np.arange(width), 0)]
        score[some], place[some], cut[some] = _splits_by_sorting(rule, bins, label, weight, rows, held, tries[some], total[some])
    many = np.flatnonzero(by_table)
    if len(many):
        rows_of = order[by_table[leaf[order]]]
        score[many], place[many], cut[many] = _splits_by_table(rule, bins, label, weight, rows_of, sizes[many], tries[many])
    feature = tries[np.arange(n_leaf), place]
    left = count(weight * (bins[np.arange(len(leaf)), feature[leaf]] <= cut[leaf]))
    return total, score, feature, cut, left


class _Output:
    """Rows for the result: nodes of trees, and votes for test rows. Of the nodes
    ``keep`` wants all, the gains of each tree by feature, or none."""

    def __init__(self, model: str, rule: _Rule, keep: str = "all") -> None:
        self.model, self.rule, self.keep = model, rule, keep
        self.nodes: list[pa.Table] = []

    def level(self, tree: int, paths: list[str], feature, cut, gain, split, counts) -> None:
        if self.keep == "votes" or not paths:
            return
        leaf = ~split
        if self.keep == "gains":  # one row to a feature, named as no node is
            if split.any():
                found, at = np.unique(feature[split], return_inverse=True)
                self._add(tree, ["*"] * len(found), found, np.zeros(len(found)), np.bincount(at, gain[split]), np.zeros(len(found), bool), None)
            elif paths == [""]:
                self._add(tree, paths, feature, cut, gain, leaf, counts)
            return
        self._add(tree, paths, feature, cut, gain, leaf, counts)

    def _add(self, tree, paths, feature, cut, gain, leaf, counts) -> None:
        k, classes = len(paths), self.rule.classes
        lists = pa.nulls(k, pa.list_(pa.int64())) if counts is None else pa.ListArray.from_arrays(
            np.arange(0, (k + 1) * classes, classes, dtype=np.int32), pa.array(counts.ravel(), pa.int64()))
        self.nodes.append(pa.Table.from_arrays([
            pa.array(np.full(k, tree), pa.int32()), pa.array(paths, pa.string()), pa.array(np.asarray(feature, np.int32), mask=leaf),
            pa.array(np.asarray(cut, np.int32), mask=leaf), pa.array(np.asarray(gain, float), mask=leaf), lists],
            names=["tree", "path", "feature", "cut", "gain", "counts"]))

    def grow(self, tree: int, path: str, bins, label, weight, test, votes) -> None:
        """The subtree of ``path``; every test row adds its leaf's shares to ``votes``."""
        rule = self.rule
        live = np.flatnonzero((weight > 0) | test)
        leaf, paths = np.zeros(len(live), np.int64), [path]
        weight = np.where(test, 0, weight)
        if not weight[live].any():
            return  # a tree that no row was drawn for says nothing
        while paths:
            depth = len(paths[0])
            tries = rule.looked_at(self.model, tree, paths)
            learns = weight[live] > 0
            known = live[learns]
            total, score, feature, cut, left = _best_splits(rule, bins[known], label[known], weight[known], leaf[learns], tries)
            final = rule.ends(total, depth) | (score < 0)
            right = total - left
            n = total.sum(1)
            self.level(tree, paths, feature, cut, score - (total * total).sum(1) / n, ~final, total)
            votes_of = np.flatnonzero(final[leaf] & test[live])
            votes[live[votes_of]] += (total[leaf[votes_of]] * _VOTES) // n[leaf[votes_of], None]
            go = ~final[leaf]
            live, leaf = live[go], leaf[go]
            low = bins[live, feature[leaf]] <= cut[leaf]
            child = 2 * leaf + ~low
            counts = np.stack([left, right], 1).reshape(-1, rule.classes)
            split = np.repeat(~final, 2)
            keep = split & ~rule.ends(counts, depth + 1)
            ends = np.flatnonzero(split & ~keep)
            self.level(tree, [paths[k // 2] + "01"[k % 2] for k in ends.tolist()] if self.keep == "all" else [], ends, ends, ends,
                       np.zeros(len(ends), bool), counts[ends])
            done = np.flatnonzero(~keep[child] & test[live])
            ended = counts[child[done]]
            votes[live[done]] += (ended * _VOTES) // ended.sum(1)[:, None]
            number = np.cumsum(keep) - 1
            stay = keep[child]
            live, leaf = live[stay], number[child[stay]]
            paths = [paths[k // 2] + "01"[k % 2] for k in np.flatnonzero(keep).tolist()]

    def table(self, ids: pa.Array, label, votes, schema: pa.Schema) -> pa.Table:
        v = len(votes)
        parts = []
        if self.nodes:
            nodes = pa.concat_tables(self.nodes)
            k = nodes.num_rows
            parts.append(pa.Table.from_arrays([pa.array([self.model], pa.string()).take(pa.array(np.zeros(k, np.int64))), *nodes.columns,
                                               pa.nulls(k, ids.type), pa.nulls(k, pa.int32())], schema=schema))
        if v or not parts:
            lists = pa.ListArray.from_arrays(np.arange(0, votes.size + 1, self.rule.classes, dtype=np.int32), pa.array(votes.ravel(), pa.int64()))
            parts.append(pa.Table.from_arrays([pa.array([self.model], pa.string()).take(pa.array(np.zeros(v, np.int64))),
                                               *(pa.nulls(v, f.type) for f in list(schema)[1:6]), lists, ids, pa.array(label, pa.int32())], schema=schema))
        return pa.concat_tables(parts).combine_chunks()


def _schema(ids: pa.DataType) -> pa.Schema:
    return pa.schema([("model", pa.string()), ("tree", pa.int32()), ("path", pa.string()), ("feature", pa.int32()), ("cut", pa.int32()),
                      ("gain", pa.float64()), ("counts", pa.list_(pa.int64())), ("id", ids), ("y", pa.int32())])


def _arrays(rows: pa.Table, features: int):
    bins = rows.column("bins").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
    label = rows.column("y").to_numpy().astype(np.int64)
    return bins, label, rows.column("test").to_numpy(zero_copy_only=False).astype(bool)


def _grow_block(rule: _Rule, keep: str = "all"):
    """All trees of a block of a small model."""

    def grow(rows: pa.Table) -> pa.Table:
        model, block, per = (rows.column(c)[0].as_py() for c in ("model", "block", "per"))
        rows = rows.take(pa.array(np.lexsort([rows.column("s1").to_numpy(), rows.column("s0").to_numpy()])))
        bins, label, test = _arrays(rows, rule.features)
        x, y = rows.column("s0").to_numpy(), rows.column("s1").to_numpy()
        out, votes = _Output(model, rule, keep), np.zeros((len(label), rule.classes), np.int64)
        for tree in range(block * per, min(rule.trees, (block + 1) * per)):
            weight = np.searchsorted(POISSON, _draw(x, y, tree), "right") if rule.bootstrap else np.ones(len(label), np.int64)
            out.grow(tree, "", bins, label, weight, test, votes)
        ids = rows.column("id").combine_chunks().filter(pa.array(test))
        return out.table(ids, label[test], votes[test], _schema(ids.type))

    return grow


def _grow_node(rule: _Rule, keep: str = "all"):
    """The subtree of one node of a large model."""

    def grow(rows: pa.Table) -> pa.Table:
        bins, label, test = _arrays(rows, rule.features)
        out, votes = _Output(rows.column("model")[0].as_py(), rule, keep), np.zeros((len(label), rule.classes), np.int64)
        out.grow(rows.column("tree")[0].as_py(), rows.column("path")[0].as_py(), bins, label, rows.column("weight").to_numpy(), test, votes)
        ids = rows.column("id").combine_chunks().filter(pa.array(test))
        return out.table(ids, label[test], votes[test], _schema(ids.type))

    return grow


# Level by level --------------------------------------------------------------------
_NODE = ["model", "tree", "path"]


def _with_node(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with what ``table`` holds for their node: broadcast while it is
    small, otherwise joined with the node's rows dealt over salted keys."""
    if table.count() <= BROADCAST_SPLITS:
        return rows.join(F.broadcast(table), _NODE)
    salt = F.explode(F.sequence(F.lit(0), F.lit(15)))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(
        table.withColumn("_salt", salt), [*_NODE, "_salt"]).drop("_salt")


def _level(rows: DataFrame, rule: _Rule, depth: int) -> DataFrame:
    """A row per node: total counts, best score, feature, cut and left counts."""
    h = _seeds(hash_key(rule.seed, *_NODE))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(rule.features - 1)), lambda k: F.struct(
        _draw(F.col("_s0"), F.col("_s1"), k.cast("long")).alias("d"), k.alias("k")))
    tries = F.array_sort(F.transform(F.slice(F.array_sort(drawn), 1, rule.tried), lambda s: s["k"]))
    nodes = _settled(rows.select(*_NODE).distinct()).withColumns({"_s0": h[0], "_s1": h[1]}).select(*_NODE, tries.alias("_tries"))
    seen = _with_node(rows.where("weight > 0"), nodes).select(*_NODE, "y", "weight", "bins", F.explode("_tries").alias("feature"))
    counts = [F.sum(F.when(F.col("y") == k, F.col("weight")).otherwise(0)).alias(f"c{k}") for k in range(rule.classes)]
    hist = seen.groupBy(*_NODE, "feature", F.get("bins", F.col("feature")).cast("int").alias("cut")).agg(*counts)
    of = Window.partitionBy(*_NODE, "feature")
    upto = of.orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [f"c{k}" for k in range(rule.classes)]
    sides = hist.select(*_NODE, "feature", "cut", F.array(*(F.sum(c).over(upto) for c in names)).alias("low"),
                        F.array(*(F.sum(c).over(of) for c in names)).alias("counts"))
    sides = sides.withColumn("high", F.zip_with("counts", "low", lambda a, b: a - b))
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    square = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x * x).cast("double")
    both = square(F.col("low")) / size(F.col("low")) + square(F.col("high")) / F.nullif(size(F.col("high")), F.lit(0))
    best = sides.withColumn("score", F.coalesce(both, F.lit(-1.0))).groupBy(*_NODE).agg(F.max(F.struct(
        "score", (-F.col("feature")).alias("f"), (-F.col("cut")).alias("c"), "low", "counts")).alias("b"))
    best = best.select(*_NODE, "b.score", (-F.col("b.f")).alias("feature"), (-F.col("b.c")).alias("cut"), "b.low", "b.counts")
    ends = lambda c, d: ((F.array_max(c) == size(c)) | (size(c) < rule.min_rows)
                         | F.lit(rule.max_depth is not None and d >= (rule.max_depth or 0)))
    high = F.zip_with("counts", "low", lambda a, b: a - b)
    best = best.withColumns({"final": ends(F.col("counts"), depth) | (F.col("score") < 0), "high": high,
                             "gain": F.col("score") - square(F.col("counts")) / size(F.col("counts"))})
    return _settled(best.withColumns({"low_ends": ends(F.col("low"), depth + 1), "high_ends": ends(F.col("high"), depth + 1)}))


def _large_models(rows: DataFrame, rule: _Rule, local_rows: int, out_schema, keep: str = "all") -> list[DataFrame]:
    """Levels of the models that no single task may hold, then their subtrees."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(rule.trees - 1)))
    draw = _draw(F.col("s0"), F.col("s1"), F.col("tree").cast("long"))
    weight = sum(((draw >= p).cast("int") for p in POISSON), F.lit(0)) if rule.bootstrap else F.lit(1)
    state = rows.select("model", tree.alias("tree"), F.lit("").alias("path"), "id", "y", "test", "bins", "s0", "s1")
    state = _settled(state.withColumn("weight", F.when(F.col("test"), 0).otherwise(weight).cast("long")).drop("s0", "s1")
                     .where(F.col("test") | (F.col("weight") > 0)))
    parts, depth = [], 0
    none = F.lit(None)
    while True:
        sizes = _settled(state.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("_n")))
        state = _with_node(state, sizes)
        ready = state.where(F.col("_n") <= local_rows).drop("_n")
        parts.append(ready.groupBy(*_NODE).applyInArrow(_grow_node(rule, keep), out_schema))
        state = state.where(F.col("_n") > local_rows).drop("_n")
        if not sizes.where(F.col("_n") > local_rows).count():
            return parts
        splits = _level(state, rule, depth)
        node = splits.select(*_NODE, *(F.when(~F.col("final"), F.col(c)).alias(c) for c in ("feature", "cut", "gain")), "counts")
        ended = [splits.where(~F.col("final") & F.col(f"{side}_ends")).select("model", "tree", F.concat("path", F.lit(bit)).alias("path"),
                 none.cast("int").alias("feature"), none.cast("int").alias("cut"), none.cast("double").alias("gain"), F.col(side).alias("counts"))
                 for side, bit in (("low", "0"), ("high", "1"))]
        moved = _with_node(state, splits)
        low = F.get("bins", F.col("feature")) <= F.col("cut")
        stop = F.col("final") | F.when(low, F.col("low_ends")).otherwise(F.col("high_ends"))
        where = F.when(F.col("final"), F.col("counts")).when(low, F.col("low")).otherwise(F.col("high"))
        moved = _settled(moved.select("model", "tree", F.concat("path", F.when(low, "0").otherwise("1")).alias("path"), "id", "y", "test", "bins",
                                      "weight", stop.alias("_stop"), F.when(stop & F.col("test"), where).alias("_counts")))
        total = F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)
        votes = moved.where(F.col("_stop") & F.col("test")).withColumn("_total", total).select(
            "model", F.transform("_counts", lambda c: F.floor(c * _VOTES / F.col("_total")).cast("long")).alias("counts"), "id", "y")
        for made in {"votes": [votes], "gains": [node, votes], "all": [node, *ended, votes]}[keep]:
            parts.append(made.select(*(F.col(f.name) if f.name in made.columns else none.cast(f.dataType).alias(f.name) for f in out_schema)))
        state = moved.where(~F.col("_stop")).drop("_stop", "_counts")
        depth += 1


# The job -----------------------------------------------------------------------------
@dataclass
class Forests:
    """Grown trees: ``nodes`` (a row per node: feature, bin and gain are NULL at
    leaves) and ``votes`` (class shares of the test rows, in parts)."""

    nodes: DataFrame
    votes: DataFrame
    classes: list[int]
    cols: list[str]
    edges: list[list[float]]

    def save(self, path: str) -> None:
        """The trees, and beside them what rows need to walk down them."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        rule = self.nodes.sparkSession.createDataFrame([(self.classes, self.cols, self.edges)], "classes array<int>, cols array<string>, edges array<array<double>>")
        rule.write.mode("overwrite").parquet(f"{path}/rule")

    def predictions(self) -> DataFrame:
        """``model, <key columns>, y, pred``: the class of the largest sum of shares,
        the smallest on ties; a test row that no tree of its model reached is left out."""
        sums = [F.sum(F.get("counts", F.lit(k))).alias(f"_v{k}") for k in range(len(self.classes))]
        votes = F.array(*(F.col(f"_v{k}") for k in range(len(self.classes))))
        names = F.array(*map(F.lit, self.classes))
        best = F.get(names, (F.array_position(votes, F.array_max(votes)) - 1).cast("int"))
        return self.votes.groupBy("model", "id", "y").agg(*sums).where(F.array_max(votes) > 0).select("model", "id.*", F.get(names, F.col("y")).alias("y"), best.alias("pred"))

    def importances(self) -> DataFrame:
        """``model, feature, importance, rank``: gains per tree scaled to 1, averaged
        over the trees that split at all, scaled to 1 again; unused features have 0."""
        used = self.nodes.where("feature IS NOT NULL").groupBy("model", "tree", "feature").agg(F.sum("gain").alias("g"))
        used = used.withColumn("g", F.try_divide("g", F.sum("g").over(Window.partitionBy("model", "tree"))))
        used = used.groupBy("model", "feature").agg(F.sum("g").alias("g"))
        used = used.withColumn("importance", F.try_divide("g", F.sum("g").over(Window.partitionBy("model")))).drop("g")
        every = F.posexplode(F.array(*map(F.lit, self.cols))).alias("feature", "name")
        full = self.nodes.select("model").distinct().select("model", every).join(used, ["model", "feature"], "left").fillna(0.0, ["importance"])
        rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("importance"), "name"))
        return full.select("model", F.col("name").alias("feature"), "importance", rank.alias("rank"))


def grow_forests(rows: DataFrame, cols: Sequence[str], *, model: Sequence[str], key: Sequence[str] = ("node", "pos"), test: str = "test",
                 label: str = "label", num_trees: int = 30, max_depth: int | None = 20, tried: int | None = None, bins: int = 32,
                 min_rows: int = 2, bootstrap: bool = True, seed: int = 42, local_rows: int = LOCAL_ROWS, edges=None, keep: str = "all") -> Forests:
    """Grow the forests of all models of ``rows`` and let them judge their test rows.

    ``rows`` has a row per (model, row): ``model`` columns name the model, ``key``
    the row, ``test`` says whether it is judged instead of learnt from.
    ``max_depth=None`` grows until nodes are pure; ``tried`` features are looked at
    per node (default: square root of their number). NULL features count as the
    lowest value, NaN as the highest. Rows with a NULL label are neither learnt
    from nor judged; a NULL model or key is an ordinary value; a model without
    training rows judges nothing. An empty table gives empty results.

    ``keep`` says what of the trees is written: ``all`` nodes, the ``gains`` by tree
    and feature that importances need, or only the ``votes``.
    """
    if not 2 <= bins <= 127:
        raise ValueError("bins must be between 2 and 127")
    cols = list(cols)
    rows = rows.where(F.col(label).isNotNull())
    classes = [r[0] for r in rows.select(F.col(label).cast("int")).distinct().orderBy(label).limit(1001).collect()]
    if len(classes) > 1000:
        raise ValueError("more than 1000 classes")
    classes = classes or [0]  # no rows, and no results
    edges = bin_edges(rows, cols, key, bins, seed) if edges is None else edges
    rule = _Rule(seed, num_trees, len(cols), tried or max(1, isqrt(len(cols))), len(classes), bins, max_depth, min_rows, bootstrap)
    name, text = _named(model), _named(key)
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("int")) - 1
    given = rows.select(name.alias("model"), F.struct(*key).alias("id"), number.cast("int").alias("y"), F.col(test).alias("test"),
                        binned(cols, edges).alias("bins"), text.alias("_text"))
    s0, s1 = _seeds(hash_key(seed, "model", "_text"))
    given = _settled(given.withColumns({"s0": s0, "s1": s1}).drop("_text"))
    grown_rows = StructType.fromDDL("model string, tree int, path string, feature int, cut int, gain double, counts array<bigint>").add(
        "id", given.schema["id"].dataType).add("y", IntegerType())
    sizes = _settled(given.groupBy("model").agg(F.count(F.lit(1)).alias("_n")))
    large = [r["model"] for r in sizes.where(F.col("_n") > local_rows).select("model").limit(10_001).collect()]
    if len(large) > 10_000:  # more large models than a list should hold: all models go level by level
        big, small = given, given.limit(0)
    else:
        big, small = given.where(F.col("model").isin(large)), given.where(~F.col("model").isin(large))
    per = F.greatest(F.lit(1), F.least(F.lit(TREE_BLOCK), F.floor(F.lit(BLOCK_WORK) / F.col("_n")))).cast("int")
    sizes = sizes.select("model", per.alias("per"), F.floor((num_trees - 1) / per).cast("int").alias("_last"))
    blocks = F.explode(F.sequence(F.lit(0), F.col("_last")))
    dealt = small.join(sizes, "model").withColumn("block", blocks).drop("_last")
    groups = sizes.agg(F.sum(F.col("_last") + 1)).first()[0] or 0  # scalar
    if groups <= 250:  # a few heavy groups, each to a task of its own if it may be
        dealt = dealt.repartition(4 * groups + 1, "model", "block")
    parts = [dealt.groupBy("model", "block").applyInArrow(_grow_block(rule, keep), grown_rows)]
    if large:
        parts += _large_models(big, rule, local_rows, grown_rows, keep)
    grown = parts[0]
    for part in parts[1:]:
        grown = grown.unionByName(part)
    grown = _settled(grown)
    return Forests(grown.where("id IS NULL").drop("id", "y"), grown.where("id IS NOT NULL").select("model", "counts", "id", "y"),
                   classes, cols, [list(e) for e in edges])


def _named(columns: Sequence[str]) -> Column:
    return F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


# Trees that are grown judge rows --------------------------------------------------
@dataclass(frozen=True)
class _Tree:
    """A subtree as arrays: children by place (leaves have none) and shares of the classes."""

    feature: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, nodes: pa.Table, root: str, classes: int) -> _Tree | None:
        paths = nodes.column("path").to_pylist()
        at = {p: i for i, p in enumerate(paths)}
        if root not in at:
            return None
        order = [at[root], *(i for i, p in enumerate(paths) if p != root)]
        number = {paths[i]: k for k, i in enumerate(order)}
        children = np.array([[number.get(paths[i] + side, -1) for side in "01"] for i in order], np.int64)
        nodes = nodes.take(pa.array(order))
        counts = nodes.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, classes)
        feature, cut = (nodes.column(c).to_numpy(zero_copy_only=False) for c in ("feature", "cut"))
        return cls(np.nan_to_num(feature).astype(np.int64), np.nan_to_num(cut).astype(np.int64), children,
                   counts * _VOTES // counts.sum(1)[:, None])

    def votes(self, bins: np.ndarray) -> np.ndarray:
        at, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(live):
            live = live[self.children[at[live], 0] >= 0]
            here = at[live]
            at[live] = self.children[here, (bins[live, self.feature[here]] > self.cut[here]).astype(np.int64)]
        return self.shares[at]


def _bins_of(rows: pa.Table | pa.RecordBatch, features: int) -> np.ndarray:
    bins = rows.column("bins")
    bins = bins.combine_chunks() if isinstance(bins, pa.ChunkedArray) else bins
    return bins.flatten().to_numpy(zero_copy_only=False).reshape(-1, features)


def _judge_group(features: int, classes: int):
    """Votes of one subtree for the rows that stand at its root."""

    def judge(key, rows: pa.Table, nodes: pa.Table) -> pa.Table:
        tree = _Tree.of(nodes, key[2].as_py(), classes) if rows.num_rows and nodes.num_rows else None
        rows = rows if tree else rows.slice(0, 0)
        votes = tree.votes(_bins_of(rows, features)) if tree else np.zeros((0, classes), np.int64)
        lists = pa.ListArray.from_arrays(np.arange(0, votes.size + 1, classes, dtype=np.int32), pa.array(votes.ravel(), pa.int64()))
        return pa.table({"model": rows.column("model"), "counts": lists, "id": rows.column("id"), "y": rows.column("y")})

    return judge


def _judged(nodes: DataFrame, given: DataFrame, features: int, classes: int, local: int) -> list[DataFrame]:
    """Votes (``model, counts, id, y``, in parts) of all trees for the rows of ``given``
    (``model, id, y, bins``). A tree, or a subtree of a larger one, of at most ``local``
    nodes meets its rows in one task per ``local`` rows; above such subtrees all rows go
    down together, a level at a time, and meet only the node they stand at."""
    given = _settled(given)
    chunks = 1 + given.count() // local
    roots = nodes.where("path = ''").groupBy("model").agg(F.collect_list("tree").alias("_trees"))
    state = given.join(roots, "model").select("model", F.explode("_trees").alias("tree"), F.lit("").alias("path"), "id", "y", "bins")
    votes, depth = [], 0
    while True:
        under = nodes.where(F.length("path") >= depth).withColumn("_root", F.substring("path", 1, depth))
        largest, trees = under.groupBy("model", "tree", "_root").count().agg(F.max("count"), F.count(F.lit(1))).first()
        if largest is None:
            return votes or [state.select("model", F.lit(None).cast("array<bigint>").alias("counts"), "id", "y").limit(0)]
        if largest <= local:
            break
        at = nodes.where(F.length("path") == depth).select(*_NODE, "feature", "cut", "counts")
        state = _settled(_with_node(state, at))
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        share = F.transform("counts", lambda c: F.floor(c * _VOTES / total).cast("long"))
        votes.append(state.where("feature IS NULL").select("model", share.alias("counts"), "id", "y"))
        low = F.get("bins", F.col("feature")) <= F.col("cut")
        state = state.where("feature IS NOT NULL").select("model", "tree", F.concat("path", F.when(low, "0").otherwise("1")).alias("path"), "id", "y", "bins")
        depth += 1
    key = ["model", "tree", "_root", "_chunk"]
    rows = state.withColumn("_chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).withColumnRenamed("path", "_root")
    under = under.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).select(*key, "path", "feature", "cut", "counts")
    if trees * chunks <= 250:  # a few heavy groups, each to a task of its own if it may be
        rows, under = (t.repartition(4 * trees * chunks + 1, *key) for t in (rows, under))
    votes_of = given.select("model", F.lit(None).cast("array<bigint>").alias("counts"), "id", "y").schema
    made = rows.groupBy(*key).cogroup(under.groupBy(*key)).applyInArrow(_judge_group(features, classes), votes_of)
    return [*votes, made]


def stays_small(forests: Forests, model: str = "all") -> bool:
    """Whether a forest goes to the tasks, so that ``predictions_of`` leaves its rows where they are."""
    return forests.nodes.where(F.col("model") == model).limit(SHIPPED_NODES + 1).count() <= SHIPPED_NODES


def predictions_of(forests: Forests, rows: DataFrame, keep: Sequence[str], label: str = "label", model: str = "all",
                   local: int = LOCAL_ROWS) -> DataFrame:
    """``keep..., y, pred`` of every row by one forest that was kept whole. A small
    forest goes to the tasks and its rows stay where they are; a large one is dealt
    over tasks by tree, and so are the rows."""
    cols, classes = forests.cols, forests.classes
    nodes = forests.nodes.where(F.col("model") == model)
    y = F.col(label).cast("int").alias("y")
    some = nodes.select("tree", "path", "feature", "cut", "counts").limit(SHIPPED_NODES + 1).toArrow()  # a bounded number
    if some.num_rows > SHIPPED_NODES:
        given = rows.select(F.lit(model).alias("model"), F.struct(*(F.col(c) for c in keep), y).alias("_r"), binned(cols, forests.edges).alias("bins"))
        given = given.select("model", F.struct(F.monotonically_increasing_id().alias("_n"), "_r").alias("id"), F.lit(None).cast("int").alias("y"), "bins")
        votes = None
        for part in _judged(nodes, given, len(cols), len(classes), local):
            votes = part if votes is None else votes.unionByName(part)
        made = Forests(nodes, votes, classes, cols, forests.edges).predictions()
        return made.select(*(F.col(f"_r.{c}") for c in keep), F.col("_r.y").alias("y"), "pred")
    trees = [_Tree.of(some.filter(pa.array(some.column("tree").to_numpy() == t)), "", len(classes)) for t in sorted(set(some.column("tree").to_pylist()))]
    names, features = np.array(classes, np.int32), len(cols)
    given = rows.select(*keep, y, binned(cols, forests.edges).alias("bins"))

    def judge(batches):
        for batch in batches:
            bins = _bins_of(batch, features)
            votes = sum((t.votes(bins) for t in trees), np.zeros((len(bins), len(names)), np.int64))
            reached = votes.max(1, initial=0) > 0
            out = batch.drop_columns(["bins"]).append_column("pred", pa.array(names[votes.argmax(1)], pa.int32()))
            yield out if reached.all() else out.filter(pa.array(reached))

    return given.mapInArrow(judge, given.drop("bins").schema.add("pred", IntegerType()))


def load(spark: SparkSession, path: str) -> Forests:
    """Saved forests (``Forests.save``), without votes."""
    rule = spark.read.parquet(f"{path}/rule").first()  # classes, columns, edges
    nodes = spark.read.parquet(f"{path}/nodes")
    votes = spark.createDataFrame([], "model string, counts array<bigint>, id struct<none: int>, y int")
    return Forests(nodes, votes, list(rule["classes"]), list(rule["cols"]), [list(e) for e in rule["edges"]])


def judge_saved(path: str, rows: DataFrame, *, model: Sequence[str], key: Sequence[str] = ("node", "pos"), label: str = "label") -> DataFrame:
    """The predictions of saved forests for ``rows``, each by the model that its
    ``model`` columns name: ``model, <key columns>, y, pred``. Rows of unknown models,
    and of labels the forests never saw, are left out.
    """
    saved = load(rows.sparkSession, path)
    classes, cols, edges = saved.classes, saved.cols, saved.edges
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("int")) - 1
    given = rows.select(_named(model).alias("model"), F.struct(*key).alias("id"), number.cast("int").alias("y"), binned(cols, edges).alias("bins"))
    all_votes = None
    for part in _judged(saved.nodes, given.where("y >= 0"), len(cols), len(classes), LOCAL_ROWS):
        all_votes = part if all_votes is None else all_votes.unionByName(part)
    return Forests(saved.nodes, all_votes, classes, cols, edges).predictions()
