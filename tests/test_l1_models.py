"""Lasso path and squared-hinge selector against their optimality conditions and
plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.plans import l1_models, selection

COLS = [f"x{i}" for i in range(8)]


def table(spark, x, y, nodes=2):
    rows = [(f"N{i % nodes}", i // nodes + 1, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "node string, pos long, " + ", ".join(f"{c} double" for c in COLS) + ", label double")


@pytest.fixture(scope="module")
def signal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)) @ np.diag([1, 3, 0.2, 1, 1, 10, 1, 1]) + 5
    x[:, 4] += 0.8 * x[:, 3]
    return x, 2 * x[:, 0] - 0.5 * x[:, 1] + x[:, 3] + rng.normal(size=400) * 0.5


def plain_folds(x, y, nodes=2, k=5):
    """Training rows (first 60 % of each node) and their contiguous folds."""
    keep, fold = [], []
    for v in range(nodes):
        rows = np.arange(v, len(y), nodes)
        rows = rows[:len(rows) * 6 // 10]
        keep += rows.tolist()
        fold += [f for f, part in enumerate(np.array_split(rows, k)) for _ in part]
    return np.array(keep), np.array(fold)


def proximal(G, c, alpha, steps=20000):
    """Plain proximal gradient."""
    w, t = np.zeros(len(c)), 1 / np.linalg.eigvalsh(G)[-1]
    for _ in range(steps):
        v = w - t * (G @ w - c)
        w = np.sign(v) * np.maximum(np.abs(v) - t * alpha, 0)
    return w


def test_path_equals_refits(spark, signal):
    x, y = signal
    coefs, curve = l1_models.lasso_path(table(spark, x, y), COLS, n_alphas=20)
    w = np.array([r.coef for r in coefs.collect()])
    curve = [(r.alpha, r.mse) for r in curve.orderBy(F.desc("alpha")).collect()]
    keep, fold = plain_folds(x, y)
    xt, yt = x[keep], y[keep]
    xc, yc = xt - xt.mean(0), yt - yt.mean()
    G, c = xc.T @ xc / len(yc), xc.T @ yc / len(yc)
    assert curve[0][0] == pytest.approx(np.abs(c).max()) and curve[-1][0] == pytest.approx(np.abs(c).max() / 1000)
    best = min(curve, key=lambda r: (r[1], -r[0]))
    assert l1_models.kkt_residual(G, c, best[0], w) < 1e-6
    assert set(np.flatnonzero(np.abs(w) > 0.05)) == {0, 1, 3}
    for alpha, mse in (curve[3], curve[12]):
        errors = []
        for f in range(5):
            a, b = fold != f, fold == f
            mx, my = xt[a].mean(0), yt[a].mean()
            z = xt[a] - mx
            v = proximal(z.T @ z / a.sum(), z.T @ (yt[a] - my) / a.sum(), alpha)
            errors.append(((yt[b] - my - (xt[b] - mx) @ v) ** 2).mean())
        assert mse == pytest.approx(np.mean(errors), rel=1e-6)


def test_lasso_on_holes_constants_and_nothing(spark, signal):
    x, y = signal
    df = table(spark, x, y).withColumn("x7", F.lit(4.0))
    holes = df.withColumn("x0", F.when(F.col("pos") % 9 == 0, None).otherwise(F.col("x0")))
    found = {r.feature for r in selection.lasso_selection(holes, COLS, n_alphas=10).collect()}
    assert {"x0", "x1", "x3"} <= found and "x7" not in found
    coefs, curve = l1_models.lasso_path(df.limit(0), COLS)
    assert [r.coef for r in coefs.collect()] == [0.0] * 8 and curve.collect() == []
    unnamed = df.withColumn("node", F.lit(None).cast("string")).withColumn("pos", F.col("pos") * 2 + (F.col("x0") > 5).cast("int"))
    assert l1_models.lasso_path(unnamed, COLS, n_alphas=5)[1].count() == 5


@pytest.fixture(scope="module")
def classes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    return x, (x[:, 0] > 0.3).astype(int) + (x[:, 1] + 0.3 * rng.normal(size=500) > 0).astype(int)


def test_squared_hinge_is_at_its_minimum(spark, classes):
    x, y = classes
    df = table(spark, x, y)
    data = l1_models._arrays(df, COLS, F.col("label").cast("int").alias("y"))
    weights, residual = l1_models.squared_hinge_weights(data, 8, 3)
    z = np.column_stack([x, np.ones(len(x))])
    for k in range(3):
        side = np.where(y == k, 1.0, -1.0)
        gap = z @ weights[k] - side
        live = side * (z @ weights[k]) < 1
        g = 2 * z[live].T @ gap[live]
        first = l1_models.hinge_residual(-2 * z.T @ side, np.zeros(9))
        assert l1_models.hinge_residual(g, weights[k]) <= 2e-6 * max(1, first)
        value = lambda w: np.abs(w).sum() + (np.maximum(0, 1 - side * (z @ w)) ** 2).sum()
        rng = np.random.default_rng(k)
        assert all(value(weights[k]) <= value(weights[k] + rng.normal(size=9) * s) for s in (1e-3, 1e-2, 0.1) for _ in range(20))
    assert (residual >= 0).all()


def test_hinge_selection(spark, classes):
    x, y = classes
    df = table(spark, x, y)
    picked = l1_models.hinge_selection(df, COLS, C=0.05)
    assert {r.feature for r in picked.where("rank <= 2").collect()} == {"x0", "x1"} and picked.count() < 8
    two = l1_models.hinge_selection(df.where("label < 2"), COLS, C=0.05).collect()  # one machine
    assert two[0].feature in {"x0", "x1"} and all(r.coef_norm >= 1e-5 for r in two)
    assert l1_models.hinge_selection(df.where("label = 1"), COLS).collect() == []
    assert l1_models.hinge_selection(df.limit(0), COLS).collect() == []
    holes = df.withColumn("x5", F.when(F.col("pos") == 1, None).otherwise(F.col("x5")))
    assert l1_models.hinge_selection(holes, COLS, C=0.05).count() < 8
