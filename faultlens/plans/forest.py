"""Random-forest fault classification jobs.

All forests are grown by ``keyed_forest``: one model over all training rows has its
trees dealt over the tasks, jobs of many models (per node, design or fold) grow all
of them at once.

Feature columns may contain ``/``, ``.`` or ``-``; they are assembled with
``array_to_vector(array(...))`` instead of ``VectorAssembler`` (which fails on
dotted names). Scoring reduces predictions to per-node confusion counts with a
grouped count, so only K^2 rows per node ever reach the metric step.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.operators import metrics, sampling
from faultlens.plans.keyed_forest import Forests, grow_forests, load, predictions_of, stays_small
from faultlens.session import ensure_checkpoint_dir

FEATURES = "features"

# Every forest of the studied experiments has 30 trees of depth 20.
N_TREES = 30
MAX_DEPTH = 20


def settled(scores: DataFrame) -> DataFrame:
    """A table of few columns (scores, predictions) written now: later runs don't refit
    or rescore, and what they were computed from can be released."""
    ensure_checkpoint_dir(scores.sparkSession)
    return scores.checkpoint()


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def assemble(df: DataFrame, cols: Sequence[str], out: str = FEATURES) -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in cols])))


def checked(train: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Training rows; a label or value that nothing can be learnt from is an error."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    fault = F.when(~usable(F.col(label).cast("double")), F.raise_error(F.lit("Labels MUST NOT be Null or NaN"))) \
        .when(~F.forall(values, usable), F.raise_error(F.lit("Vector values MUST NOT be Null, NaN or Infinity")))
    return train.where(fault.isNull())


def fit(train: DataFrame, cols: Sequence[str], label: str = "label", seed: int = 42, *, key: Sequence[str] = ("node", "pos"),
        num_trees: int = N_TREES, max_depth: int = MAX_DEPTH, keep: str = "all", **kw) -> Forests:
    """L1: the forest of the studied experiments over all rows of ``train``, which
    ``key`` names. ``keep="gains"`` writes what importances need and no trees."""
    rows = checked(train, cols, label).select(*key, *[F.col(f"`{c}`") for c in cols], F.col(label)).persist()
    tried = len(cols) if num_trees == 1 else ceil(sqrt(len(cols)))
    grown = grow_forests(rows.withColumns({"_model": F.lit("all"), "_test": F.lit(False)}), cols, model=["_model"], key=key, test="_test", label=label,
                         num_trees=num_trees, max_depth=max_depth, tried=tried, seed=seed, keep=keep, **kw)
    rows.unpersist()
    return grown


def predict(model: Forests, df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("node",),
            label: str = "label") -> DataFrame:
    """Predictions as ``(keep..., y, pred)`` integers."""
    if list(cols) != list(model.cols):
        raise ValueError("the forest was learnt from other columns")
    return predictions_of(model, df, keep, label)


def importances(model: Forests) -> DataFrame:
    """``feature, importance, rank`` of one forest."""
    return model.importances().drop("model")


def train_test_nodes(features: DataFrame, cols: Sequence[str], train_nodes: DataFrame, *, node: str = "node", **kw) -> DataFrame:
    """L3: one forest on the training nodes, scores of all other nodes (``train_test_rows``)."""
    named = train_nodes.select(node).distinct()
    return train_test_rows(features.join(named, on=node, how="left_semi"), features.join(named, on=node, how="left_anti"), cols, node=node, **kw)


def train_test_rows(train: DataFrame, test: DataFrame, cols: Sequence[str], *, node: str = "node", label: str = "label", seed: int = 42,
                    balance_train: bool = True, balance_test: bool = True, strategy="majority", key: Sequence[str] = ("node", "pos"), **kw) -> DataFrame:
    """L3 with the rows of both sides given: one forest on the training rows (balanced
    per node before the union, as the studied job does), one ``transform`` over the
    test rows (balanced per node by default, Q11), scores per test node.

    A forest that goes to the tasks judges the test rows where they are: only keys,
    labels and predictions are written, balanced and counted, never the vectors.
    """
    if balance_train:
        train = sampling.undersample(train, label, strategy=strategy, group=[node], key=key, seed=seed)
    model = fit(train, cols, label, seed, key=key, **kw)
    if not balance_test:
        made = predict(model, test, cols, [node], label)
    elif stays_small(model):
        kept = list(dict.fromkeys([node, *key]))
        made = settled(predict(model, test.withColumn("_label", F.col(label)), cols, [*kept, "_label"], label))
        made = sampling.undersample(made, "_label", strategy=strategy, group=[node], key=key, seed=seed)
    else:  # judging deals every row to every tree: fewer rows first
        test = sampling.undersample(test, label, strategy=strategy, group=[node], key=key, seed=seed)
        made = predict(model, test, cols, [node], label)
    return metrics.class_scores(settled(metrics.confusion(made, [node])), [node])


def same_node_forests(features: DataFrame, cols: Sequence[str], nodes: Sequence | None = None, *, node: str = "node",
                      pos: str = "pos", label: str = "label", seed: int = 42, **kw) -> Forests:
    """L2: a forest per node, learnt from the first 60 % of its rows, judging the
    rest. All nodes are one job (``keyed_forest``); ``nodes`` restricts them."""
    rows = sampling.positional_split(features, node=node, pos=pos)
    rows = rows if nodes is None else rows.where(F.col(node).isin(list(nodes)))
    return grow_forests(rows.withColumn("_test", F.col("split") == "test"), cols, model=[node], key=[node, pos], test="_test", label=label, seed=seed, **kw)


def same_node_split(features: DataFrame, cols: Sequence[str], nodes: Sequence | None = None, *, node: str = "node", **kw) -> DataFrame:
    """L2: the scores of ``same_node_forests`` by node."""
    return metrics.scores(same_node_forests(features, cols, nodes, node=node, **kw).predictions(), [node])


def design_forests(features: DataFrame, cols: Sequence[str], designs: DataFrame, *, node: str = "node", pos: str = "pos",
                   label: str = "label", seed: int = 42, balance: bool = True, strategy="majority", **kw) -> Forests:
    """L4: a forest per (iter, k) design (M12), learnt from the design's training
    nodes, judging its other nodes. Rows are balanced per node once (M6), and all
    designs are one job. A design is a small table of node names."""
    if balance:
        features = sampling.undersample(features, label, strategy=strategy, group=[node], key=(node, pos), seed=seed)
    rows = features.join(designs.select(node, "iter", "k", (F.col("role") != "train").alias("_test")), node)
    return grow_forests(rows, cols, model=["iter", "k"], key=[node, pos], test="_test", label=label, seed=seed, **kw)


def random_design_runs(features: DataFrame, cols: Sequence[str], designs: DataFrame, *, node: str = "node", **kw) -> DataFrame:
    """L4: the scores of ``design_forests`` by test node, with ``iter`` and ``num_train``."""
    made = design_forests(features, cols, designs, node=node, **kw).predictions()
    run = F.split("model", ":")
    made = made.withColumns({"iter": run[0].cast("int"), "num_train": run[1].cast("int")})
    return metrics.scores(made, [node, "iter", "num_train"])


def _fold_scores(f: DataFrame, i: int, cols, node: str, pos: str, label: str, seed: int, balance: bool, zero_division: float,
                 labels, train_on: DataFrame | None = None, **kw) -> DataFrame:
    """F1 by node of fold ``i`` after a fit on the other folds (of ``train_on``'s nodes)."""
    tr, te = f.where(F.col("fold") != i), f.where(F.col("fold") == i)
    if train_on is not None:
        tr = tr.join(train_on.select(node).distinct(), node, "left_semi")
    if balance:
        tr = sampling.undersample(tr, label, group=[node], key=(node, pos), seed=seed)
        te = sampling.undersample(te, label, group=[node], key=(node, pos), seed=seed)
    m = fit(tr, cols, label, seed, key=(node, pos), **kw)
    s = metrics.scores(predict(m, te, cols, [node], label), [node], metrics=["f1"], zero_division=zero_division, labels=labels)
    return settled(s.withColumn("fold", F.lit(i)))


def folded(features: DataFrame, k: int, folds: str, label: str, node: str, pos: str, seed: int) -> DataFrame:
    """``fold`` per node: contiguous (M8), shuffled (M9) or stratified."""
    if folds == "stratified":
        return sampling.stratified_kfold(features, k, label=label, node=node, pos=pos)
    return sampling.kfold(features, k, node=node, pos=pos, shuffle=(folds == "shuffled"), seed=seed)


def cross_validate(features: DataFrame, cols: Sequence[str], *, k: int = 5, node: str = "node", pos: str = "pos",
                   label: str = "label", seed: int = 42, folds: str = "contiguous", balance: bool = True,
                   zero_division: float = 1.0, labels: Sequence[int] | None = None,
                   train_nodes: DataFrame | None = None, **kw) -> DataFrame:
    """L7, pooled: per fold one forest on the other folds of all nodes (or of
    ``train_nodes``, for k random nodes), scored by node: a row per fold (A13/A14)
    and the ``all`` row of means (A20)."""
    f = folded(features, k, folds, label, node, pos, seed).persist()
    outs = [_fold_scores(f, i, cols, node, pos, label, seed, balance, zero_division, labels, train_nodes, **kw) for i in range(k)]
    f.unpersist()
    return metrics.fold_table(union_all(outs), [node])


def node_fold_forests(features: DataFrame, cols: Sequence[str], nodes: Sequence | None = None, *, k: int = 5, node: str = "node",
                      pos: str = "pos", label: str = "label", seed: int = 42, folds: str = "contiguous", balance: bool = True, **kw) -> Forests:
    """L7, per node: for every node k forests, each learnt from k - 1 folds of the
    node and judging the last. Training and test rows are balanced apart. All
    nodes and folds are one job; models are named ``node:fold``."""
    rows = features if nodes is None else features.where(F.col(node).isin(list(nodes)))
    rows = folded(rows, k, folds, label, node, pos, seed).withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rows = rows.withColumn("_test", F.col("fold") == F.col("_run"))
    if balance:
        rows = sampling.undersample(rows, label, group=[node, "_run", "_test"], key=(node, pos), seed=seed)
    return grow_forests(rows, cols, model=[node, "_run"], key=[node, pos], test="_test", label=label, seed=seed, **kw)


def cross_validate_nodes(features: DataFrame, cols: Sequence[str], nodes: Sequence | None = None, *, node: str = "node",
                         zero_division: float = 1.0, labels: Sequence[int] | None = None, **kw) -> DataFrame:
    """L7, per node: F1 by node and fold, and the ``all`` rows of their means."""
    made = node_fold_forests(features, cols, nodes, node=node, **kw).predictions()
    made = made.withColumn("fold", F.element_at(F.split("model", ":"), -1).cast("int"))
    scored = metrics.scores(made, [node, "fold"], metrics=["f1"], zero_division=zero_division, labels=labels)
    return metrics.fold_table(settled(scored), [node])


def save(model: Forests, path: str) -> None:
    """Persist a fitted model (overwrite)."""
    model.save(path)


def score_saved_model(path: str, df: DataFrame, cols: Sequence[str], node: str = "node",
                      label: str = "label") -> DataFrame:
    """Load a saved forest and score every node of ``df``."""
    return metrics.scores(predict(load(df.sparkSession, path), df, cols, [node], label), [node])
