"""Feature ranking and selection jobs.

Each step is a distributed fit over the feature table (``pyspark.ml``,
``keyed_forest`` or ``l1_models``); the driver only keeps feature names, importances and coefficients (one number per
feature). Results are small DataFrames ``(feature, importance, rank)`` that the
feature-list writer (S9/S10) stores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators import metrics, sampling
from faultlens.plans.forest import FEATURES, assemble, fit, importances, predict
from faultlens.plans.keyed_forest import Forests, grow_forests
from faultlens.plans.l1_models import lasso_path


def _rank_table(spark: SparkSession, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    order = sorted(range(len(names)), key=lambda i: (-values[i], names[i]))
    rows = [(names[i], float(values[i]), r + 1) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


def forest_importance(features: DataFrame, cols: Sequence[str], label: str = "label", seed: int = 42,
                      **kw) -> DataFrame:
    """Forest feature importances, descending."""
    return importances(fit(features, cols, label, seed, keep="gains", **kw))


def tree_importance(features: DataFrame, cols: Sequence[str], label: str = "label", seed: int = 42,
                    max_depth: int | None = None, key: Sequence[str] = ("node", "pos")) -> DataFrame:
    """Importances of one decision tree over all rows and features, as deep as
    it gets unless ``max_depth`` says otherwise."""
    rows = features.withColumns({"_model": F.lit("all"), "_test": F.lit(False)})
    grown = grow_forests(rows, cols, model=["_model"], key=key, test="_test", label=label, num_trees=1, max_depth=max_depth,
                         tried=len(cols), bootstrap=False, seed=seed)
    return grown.importances().drop("model")


def top_n_refit(features: DataFrame, test: DataFrame, cols: Sequence[str], n: int, node: str = "node",
                label: str = "label", seed: int = 42, **kw) -> DataFrame:
    """Keep the n most important features, refit, score the test rows."""
    imp = forest_importance(features, cols, label, seed, **kw)
    keep = [r["feature"] for r in imp.orderBy("rank").limit(n).collect()]
    m = fit(features, keep, label, seed, **kw)
    return metrics.scores(predict(m, test, keep, [node], label), [node])


def _importance_of(model: Forests, cols: Sequence[str]) -> np.ndarray:
    found = {r["feature"]: r["importance"] for r in importances(model).collect()}  # a number per feature
    return np.array([found.get(c, 0.0) for c in cols])


def _step_count(step, n_features: int) -> int:
    return max(1, int(step * n_features)) if isinstance(step, float) and step < 1 else int(step)


def rfe(features: DataFrame, cols: Sequence[str], n: int, *, label: str = "label", step=1, seed: int = 42,
        **kw) -> DataFrame:
    """Recursive feature elimination down to ``n`` features; ranking like the
    common library (kept features rank 1, then by elimination round)."""
    features = features.persist()
    remaining = list(cols)
    ranks: dict[str, int] = {}
    rounds = []
    while len(remaining) > n:
        imp = _importance_of(fit(features, remaining, label, seed, keep="gains", **kw), remaining)
        k = min(_step_count(step, len(remaining)), len(remaining) - n)
        drop = [remaining[i] for i in np.argsort(imp, kind="stable")[:k]]
        rounds.append(drop)
        remaining = [c for c in remaining if c not in drop]
    for c in remaining:
        ranks[c] = 1
    for r, drop in enumerate(reversed(rounds)):
        for c in drop:
            ranks[c] = r + 2
    features.unpersist()
    rows = [(c, ranks[c], c in remaining) for c in cols]
    return features.sparkSession.createDataFrame(rows, "feature string, rank int, selected boolean")


def rfecv(features: DataFrame, cols: Sequence[str], *, k: int = 5, label: str = "label", node: str = "node",
          pos: str = "pos", step=1, min_features: int = 1, seed: int = 42, **kw) -> tuple[DataFrame, DataFrame]:
    """RFE inside stratified k-fold CV, weighted F1 per feature count; the
    smallest count with the best mean score wins. Returns (curve, selected)."""
    folds = sampling.stratified_kfold(features, k, label=label, node=node, pos=pos).persist()
    spark = features.sparkSession
    curve: dict[int, list[float]] = {}
    for i in range(k):
        tr, te = folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)
        remaining = list(cols)
        while True:
            m = fit(tr, remaining, label, seed, key=(node, pos), **kw)
            s = metrics.scores(predict(m, te, remaining, [], label), [], metrics=["f1"])
            f1 = s.where(F.col("cls") == "overall").first()["score"]
            curve.setdefault(len(remaining), []).append(float(f1 or 0.0))
            if len(remaining) <= min_features:
                break
            imp = _importance_of(m, remaining)
            kk = min(_step_count(step, len(remaining)), len(remaining) - min_features)
            drop = {remaining[j] for j in np.argsort(imp, kind="stable")[:kk]}
            remaining = [c for c in remaining if c not in drop]
    folds.unpersist()
    means = {n: float(np.mean(v)) for n, v in curve.items()}
    best = max(means.values())
    n_best = min(n for n, v in means.items() if v == best)
    curve_df = spark.createDataFrame(sorted(means.items()), "n_features int, mean_f1 double")
    return curve_df, rfe(features, cols, n_best, label=label, step=step, seed=seed, **kw)


def lasso_selection(features: DataFrame, cols: Sequence[str], label: str = "label", folds: int = 5, **kw) -> DataFrame:
    """The non-zero coefficients of the cross-validated lasso, by absolute value."""
    coefs, _ = lasso_path(features, cols, label=label, folds=folds, **kw)
    return coefs.where(F.col("coef") != 0).orderBy(F.desc(F.abs("coef")), "feature")


def l1_logistic_selection(features: DataFrame, cols: Sequence[str], label: str = "label", max_features: int = 100,
                          reg_param: float = 0.01, family: str = "multinomial") -> DataFrame:
    """Multinomial L1 logistic regression; the ``max_features`` features with
    the largest sum of |coef| over classes."""
    data = assemble(features, cols).select(FEATURES, F.col(label).cast("double").alias(label))
    m = LogisticRegression(featuresCol=FEATURES, labelCol=label, elasticNetParam=1.0, regParam=reg_param,
                           family=family, maxIter=200).fit(data)
    coef = m.coefficientMatrix.toArray()
    norm = np.abs(coef).sum(axis=0)
    tbl = _rank_table(features.sparkSession, cols, norm.tolist()).withColumnRenamed("importance", "coef_norm")
    return tbl.where(F.col("rank") <= max_features)
