"""Seeded class balancing, splits, folds and random node designs (SURVEY 2.7
M1-M12, 2.3 J4-J5).

Randomness is an ordering by ``md5(seed || ':' || key)``: the same in Spark and
in SQL, reproducible on re-execution (a lost executor recomputes the same rows),
and independent of partitioning. Contract: same class counts as the studied
samplers, without replacement.

"The first ``target`` rows of a class in hash order" are found by rank inside
the class; a class too large for one task is dealt over buckets of leading hash
bits, as many as its size asks for, and ranks are shifted by the bucket sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.operators.keys import join_same
from faultlens.operators.positions import add_positions

HASH_COL = "_h"


def hash_key(seed, *keys) -> Column:
    """``md5(seed:key1:key2...)`` as hex string (identical to SQL ``md5``)."""
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit(":"), (F.col(k) if isinstance(k, str) else k).cast("string")]
    return F.md5(F.concat(*parts))


# Targets ----------------------------------------------------------------------
def class_counts(df: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("n"))


def targets(counts: DataFrame, label: str, group: Sequence[str], strategy) -> DataFrame:
    """Target size per (group, class) from the small counts table.

    strategies: ``majority`` (largest class -> smallest class's count),
    ``not minority`` (all but the smallest -> its count), ``all``,
    ``majority_mean`` (largest -> int(mean of the others)),
    ``minority_mean`` (smallest -> int(mean of the others), clamped to its size),
    ``dict`` {label: n}, or a callable ``{label: n} -> {label: n}`` (per group).
    Ties for "largest"/"smallest" go to the smallest label.
    """
    g = list(group)
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    big_rank = F.row_number().over(wg.orderBy(F.desc("n"), label))
    small_rank = F.row_number().over(wg.orderBy("n", label))
    c = counts.withColumn("_big", big_rank == 1).withColumn("_small", small_rank == 1) \
        .withColumn("_min", F.min("n").over(wg)) \
        .withColumn("_others_mean_big", F.floor(F.try_divide(
            F.sum("n").over(wg) - F.max("n").over(wg), F.count(F.lit(1)).over(wg) - 1)).cast("long")) \
        .withColumn("_others_mean_small", F.floor(F.try_divide(
            F.sum("n").over(wg) - F.min("n").over(wg), F.count(F.lit(1)).over(wg) - 1)).cast("long"))
    n = F.col("n")
    if isinstance(strategy, dict):
        m = F.create_map(*[x for k, v in strategy.items() for x in (F.lit(k), F.lit(int(v)))])
        t = F.coalesce(m[F.col(label)], n)
    elif callable(strategy):
        # one call per group, on the workers: the counts of a group are one row per class
        def fit(pdf):
            wanted = strategy(dict(zip(pdf[label].tolist(), pdf["n"].tolist())))
            pdf["target"] = [int(wanted.get(lab, n)) for lab, n in zip(pdf[label].tolist(), pdf["n"].tolist())]
            return pdf

        return counts.groupBy(*g).applyInPandas(fit, counts.withColumn("target", F.col("n").cast("long")).schema)
    elif strategy == "majority":
        t = F.when(F.col("_big"), F.col("_min")).otherwise(n)
    elif strategy == "not minority":
        t = F.when(F.col("_small"), n).otherwise(F.least(n, F.col("_min")))
    elif strategy == "all":
        t = F.col("_min")
    elif strategy == "majority_mean":
        t = F.when(F.col("_big"), F.least(n, F.col("_others_mean_big"))).otherwise(n)
    elif strategy == "minority_mean":
        t = F.when(F.col("_small"), F.least(n, F.col("_others_mean_small"))).otherwise(n)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return c.select(*g, label, "n", t.cast("long").alias("target"))


def subsample_class_targets(counts: DataFrame, label: str, group: Sequence[str], cls: int) -> DataFrame:
    """M5: class ``cls`` -> int(mean of the counts that differ from its own count)."""
    if not 0 <= int(cls) <= 7:
        raise ValueError(f"class {cls!r} is not one of 0..7")
    g = list(group)
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    own = F.max(F.when(F.col(label) == cls, F.col("n"))).over(wg)
    c = counts.withColumn("_own", own)
    other = F.when(F.col("n") != F.col("_own"), F.col("n"))
    c = c.withColumn("_mean", F.floor(F.avg(other).over(wg)).cast("long"))
    t = F.when(F.col(label) == cls, F.least(F.col("n"), F.col("_mean"))).otherwise(F.col("n"))
    return c.select(*g, label, "n", t.cast("long").alias("target"))


# Selection --------------------------------------------------------------------
def keep_first_by_hash(df: DataFrame, tgt: DataFrame, label: str, group: Sequence[str],
                       key: Sequence[str], seed: int = 42, max_class_rows: int = 1_000_000) -> DataFrame:
    """Keep, per (group, class), the ``target`` rows with the smallest hash key.

    Rows are ranked inside their class. A class above ``max_class_rows`` that
    is cut is dealt over buckets of its leading hash bits, as many as its size
    asks for: rows are ranked inside a bucket and shifted by the sizes of the
    earlier buckets, a table of one row per bucket. The same rows either way.
    A NULL class is a class of its own.
    """
    by = [*group, label]
    t = tgt.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("n").alias("_n"), F.col("target").alias("_target"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    x = df.join(t, same).select(*df.columns, "_n", "_target", hash_key(seed, *key).alias(HASH_COL))
    cut = F.col("_target") < F.col("_n")
    if tgt.where((F.col("n") > max_class_rows) & (F.col("target") < F.col("n"))).isEmpty():
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(HASH_COL, *key))
        return x.withColumn("_rn", rank).where(~cut | (F.col("_rn") <= F.col("_target"))).select(*df.columns)
    bits = F.conv(F.substring(HASH_COL, 1, 8), 16, 10).cast("long")
    x = x.withColumn("_b", F.floor(bits * F.ceil(F.col("_n") / max_class_rows) / (1 << 32)).cast("int"))
    sizes = x.where(cut).groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_b").alias("_of_b"),
                         F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(HASH_COL, *key))
    x = x.withColumn("_rn", rank).join(sizes, [*same, F.col("_b") == F.col("_of_b")], "left")
    return x.where(~cut | (F.col("_before") + F.col("_rn") <= F.col("_target"))).select(*df.columns)


def undersample(df: DataFrame, label: str = "label", *, strategy="majority", group: Sequence[str] = (),
                key: Sequence[str] = ("node", "pos"), seed: int = 42, max_class_rows: int = 1_000_000) -> DataFrame:
    """Random undersampling (M1-M4, M6). ``group=['node']`` balances each node
    before concatenation; ``group=[]`` balances once after."""
    c = class_counts(df, label, group)
    return keep_first_by_hash(df, targets(c, label, group, strategy), label, group, key, seed, max_class_rows)


def subsample_class(df: DataFrame, cls: int, label: str = "label", *, group: Sequence[str] = (),
                    key: Sequence[str] = ("node", "pos"), seed: int = 42) -> DataFrame:
    """M5 + U4: class ``cls`` cut to the mean of the other counts; sampled rows first."""
    c = class_counts(df, label, group)
    out = keep_first_by_hash(df, subsample_class_targets(c, label, group, cls), label, group, key, seed)
    return out.withColumn("sampled_first", F.when(F.col(label) == cls, 0).otherwise(1))


# Splits and folds -------------------------------------------------------------
def node_sizes(df: DataFrame, node: Sequence[str] | str = "node") -> DataFrame:
    g = [node] if isinstance(node, str) else list(node)
    return df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))


def positional_split(df: DataFrame, *, node="node", pos="pos", num: int = 6, den: int = 10) -> DataFrame:
    """M7: first ``floor(n * num / den)`` rows of each node train (``split='train'``), rest test."""
    g = [node] if isinstance(node, str) else list(node)
    j = join_same(df, node_sizes(df, g), g)
    cut = F.floor(F.col("_n") * num / den)
    return j.withColumn("split", F.when(F.col(pos) <= cut, "train").otherwise("test")).drop("_n")


def contiguous_fold(rank, n, k: int) -> Column:
    """Fold (0-based) of 1-based ``rank`` among ``n`` rows cut in ``k`` contiguous
    folds, the first ``n % k`` one row larger (= ``ntile``, = KFold unshuffled)."""
    base = F.floor(n / k)
    extra = n % k
    big = extra * (base + 1)
    r = rank - 1
    return F.when(r < big, F.floor(r / (base + 1))).otherwise(extra + F.floor((r - big) / base)).cast("int")


def kfold(df: DataFrame, k: int = 5, *, node="node", pos="pos", shuffle: bool = False, seed: int = 42,
          fold_col: str = "fold") -> DataFrame:
    """M8 (contiguous) and M9 (seeded shuffle) k-fold per node, folds 0..k-1."""
    g = [node] if isinstance(node, str) else list(node)
    j = join_same(df, node_sizes(df, g), g)
    if shuffle:
        j = add_positions(j.withColumn("_h", hash_key(seed, *g, pos)), g, ["_h", pos], "_rank").drop("_h")
        rank = F.col("_rank")
    else:
        rank = F.col(pos)
    return j.withColumn(fold_col, contiguous_fold(rank, F.col("_n"), k)).drop("_n", "_rank")


def stratified_kfold(df: DataFrame, k: int = 5, *, label: str = "label", node="node", pos="pos",
                     fold_col: str = "fold") -> DataFrame:
    """Stratified k-fold without shuffle, same allocation rule as the
    common library: labels sorted, every k-th of the sorted labels goes to one
    fold; inside a class, rows keep position order and fill folds 0, 1, ... in turn.

    For class c with ``n_c`` rows after ``C_c`` rows of smaller classes, fold f
    receives ``#{i in [C_c, C_c + n_c): i % k == f}`` of them.
    """
    g = [node] if isinstance(node, str) else list(node)
    cnt = df.groupBy(*g, label).agg(F.count(F.lit(1)).alias("_nc"))
    wc = Window.partitionBy(*g).orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.withColumn("_C", F.coalesce(F.sum("_nc").over(wc), F.lit(0)))
    j = join_same(add_positions(df, [*g, label], [pos], "_j"), cnt, [*g, label]).withColumn("_j", F.col("_j") - 1)
    C, nc, jj = F.col("_C"), F.col("_nc"), F.col("_j")

    def alloc(f: int) -> Column:  # count of i in [C, C+nc) with i % k == f
        return F.floor((C + nc - 1 - f) / k) - F.floor((C - 1 - f) / k)

    fold = F.lit(k - 1)
    acc = F.lit(0)
    cum = []
    for f in range(k):
        acc = acc + alloc(f)
        cum.append(acc)
    for f in reversed(range(k)):
        fold = F.when(jj < cum[f], F.lit(f)).otherwise(fold)
    return j.withColumn(fold_col, fold.cast("int")).drop("_C", "_nc", "_j")


def shuffled(df: DataFrame, key: Sequence[str] = ("node", "pos"), seed: int = 42) -> DataFrame:
    """Rows in seeded random order (distributed range sort on the hash)."""
    return df.withColumn("shuffle_key", hash_key(seed, *key)).orderBy("shuffle_key", *key)


# Node designs -----------------------------------------------------------------
def random_designs(nodes: DataFrame, *, node: str = "node", node_no: str = "node_no", seed: int = 42,
                   sizes: Sequence[int] = tuple(range(1, 17)), iterations: int = 1,
                   tmin: int | None = None, tmax: int | None = None) -> DataFrame:
    """For each run ``iter`` and size ``k``, the k nodes of the pool
    (node number in ``tmin..tmax``) with the smallest ``md5(seed:iter:k:node)``.
    Output ``(iter, k, node, role)`` with role train/test for every pool node."""
    pool = nodes.select(node, node_no).distinct()
    if tmin is not None:
        pool = pool.where(F.col(node_no) >= tmin)
    if tmax is not None:
        pool = pool.where(F.col(node_no) <= tmax)
    grid = F.array(*[F.struct(F.lit(i).alias("iter"), F.lit(k).alias("k"))
                     for i in range(1, iterations + 1) for k in sizes])
    d = pool.select(node, node_no, F.explode(grid).alias("_d")).select(node, node_no, "_d.iter", "_d.k")
    w = Window.partitionBy("iter", "k").orderBy(hash_key(seed, "iter", "k", node), node)
    # the constant bound lets every task drop all but its own first max(sizes) nodes before the shuffle
    first = d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(sizes)).where(F.col("_rn") <= F.col("k"))
    train = first.select(node, "iter", "k", F.lit("train").alias("role"))
    return join_same(d, train, [node, "iter", "k"], "left").fillna("test", ["role"]).select(node, node_no, "iter", "k", "role")


def test_nodes(all_nodes: DataFrame, train: DataFrame, on: Sequence[str] = ("node",)) -> DataFrame:
    """All nodes minus training nodes (anti join)."""
    return all_nodes.join(train.select(*on).distinct(), on=list(on), how="left_anti")


def complementary_halves(train: DataFrame, node: str = "node", half: str = "half") -> DataFrame:
    """For a node with exactly one training half, the other half is tested."""
    one = train.groupBy(node).agg(F.count(F.lit(1)).alias("_c"), F.max(half).alias("_h"))
    return one.where(F.col("_c") == 1).select(node, (3 - F.col("_h")).alias(half))


def test_halves(all_nodes: DataFrame, train: DataFrame, node: str = "node", half: str = "half") -> DataFrame:
    """The whole test set: nodes that no half was trained on (``half`` 0 =
    all their rows), and the other half of nodes with exactly one training half."""
    untouched = test_nodes(all_nodes.select(node).distinct(), train, [node]).withColumn(half, F.lit(0))
    return untouched.unionByName(complementary_halves(train, node, half))
