"""L1 models from small matrices: cross-validated lasso path and squared-hinge selector.

One aggregation turns the rows into second moments (a square matrix per fold or
class, as wide as there are features); the optimisation then works on these on
the driver, and no row is read again for another penalty, another fold or
another coordinate. Only numbers of that size, never rows, leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions.shipping import ship_by_value
from faultlens.operators import sampling
from faultlens.session import ensure_checkpoint_dir

ship_by_value("faultlens.plans.l1_models")

_PART = pa.schema([("part", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])
_PART_DDL = "part int, i int, row array<double>"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _emitted(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for part, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()),
                                          pa.array(m.tolist(), pa.list_(pa.float64()))], schema=_PART)


def _added(parts: DataFrame, n_parts: int, shape: tuple[int, int]) -> np.ndarray:
    """The sums over all tasks: ``n_parts`` matrices of ``shape`` on the driver."""
    cells = parts.select("part", "i", F.posexplode("row").alias("j", "v")).groupBy("part", "i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((n_parts, *shape))
    rows = cells.groupBy("part", "i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row"))  # one row of a matrix
    for r in rows.collect():
        out[r["part"], r["i"]] = [c["v"] for c in r["row"]]
    return out


def _arrays(df: DataFrame, cols: Sequence[str], *extra) -> DataFrame:
    """``x array<double>`` and the extra columns of the rows without holes, written once."""
    x = F.array(*(F.col(f"`{c}`").cast("double") for c in cols))
    whole = df.select(x.alias("x"), *extra)
    whole = whole.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))).dropna()
    ensure_checkpoint_dir(df.sparkSession)
    return whole.checkpoint()


# Lasso ---------------------------------------------------------------------------
def fold_moments(rows: DataFrame, d: int, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """``(means, M)``: ``M[f]`` sums ``z z'`` over fold f, ``z`` = (1, x - mean, y - mean)."""
    mean = rows.agg(*(F.avg(F.get("x", F.lit(i))) for i in range(d)), F.avg("y")).first()
    mean = np.array([m or 0.0 for m in mean])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            z = np.column_stack([np.ones(len(b)), np.column_stack([_matrix(b.column(0), d), b.column(1).to_numpy()]) - mean])
            fold = b.column(2).to_numpy()
            for f in np.unique(fold):
                part = z[fold == f]
                sums[int(f)] = sums.get(int(f), 0) + part.T @ part
        yield from _emitted(sums)

    return mean, _added(rows.select("x", "y", "fold").mapInArrow(partial, _PART_DDL), folds, (d + 2, d + 2))


def _centred(M: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``X'X / n`` and ``X'y / n`` about the means, and the means (x, then y)."""
    n, m = M[0, 0], M[0, 1:] / M[0, 0]
    S = M[1:, 1:] / n - np.outer(m, m)
    return S[:-1, :-1], S[:-1, -1], m


def kkt_residual(G: np.ndarray, c: np.ndarray, alpha: float, w: np.ndarray) -> float:
    """How far ``w`` is from a minimum of ``w'Gw / 2 - c'w + alpha |w|``."""
    slope = c - G @ w
    return float(np.where(w != 0, np.abs(slope - alpha * np.sign(w)), np.maximum(np.abs(slope) - alpha, 0)).max(initial=0))


def descend(G: np.ndarray, c: np.ndarray, alpha: float, w: np.ndarray, tol: float, sweeps: int = 100_000) -> np.ndarray:
    """Coordinate descent for ``w'Gw / 2 - c'w + alpha |w|_1`` from ``w``. Sweeps go
    over the non-zero coordinates until these are at rest, then over all."""
    w, q = w.copy(), G @ w
    curve = np.diag(G)
    every = np.flatnonzero(curve > 0)
    for _ in range(sweeps):
        for j in every:
            _move(G, c, alpha, curve, w, q, j)
        if kkt_residual(G, c, alpha, w) <= tol:
            break
        active = np.flatnonzero(w)
        for _ in range(1000):
            if not sum(_move(G, c, alpha, curve, w, q, j) for j in active) > tol:
                break
    return w


def _move(G, c, alpha, curve, w, q, j) -> float:
    old = w[j]
    pull = c[j] - q[j] + curve[j] * old
    new = (pull - alpha if pull > alpha else pull + alpha if pull < -alpha else 0.0) / curve[j]
    if new != old:
        q += G[:, j] * (new - old)
        w[j] = new
    return curve[j] * abs(new - old)


def lasso_path(features: DataFrame, cols: Sequence[str], *, label: str = "label", node: str = "node", pos: str = "pos",
               folds: int = 5, n_alphas: int = 100, eps: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """The lasso of the label as a number on the first 60 % of each node's
    rows, its penalty chosen by cross-validation over contiguous folds.

    The ``n_alphas`` penalties fall from the smallest that leaves no coefficient to
    ``eps`` of it. Every fold's path comes from the moments of the other folds, and
    its squared error from its own moments. The penalty with the least mean error
    (the largest on ties) is fitted to all training rows. Returns ``(feature, coef)``
    for all features and the curve ``(alpha, mse)``. Rows with a hole in a feature or
    the label are left out; a constant feature and an empty table get coefficient 0.
    """
    rows = sampling.positional_split(features, node=node, pos=pos).where("split = 'train'")
    size = rows.groupBy(node).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(node, "_node")
    rows = rows.join(size, F.col(node).eqNullSafe(F.col("_node")))
    rows = rows.withColumn("fold", sampling.contiguous_fold(F.col(pos), F.col("_n"), folds))
    data = _arrays(rows, cols, F.col(label).cast("double").alias("y"), F.col("fold"))
    d, spark = len(cols), features.sparkSession
    _, M = fold_moments(data, d, folds)
    total, w, curve = M.sum(0), np.zeros(d), []
    if total[0, 0]:
        G, c, _ = _centred(total)
        top = np.abs(c).max()
        alphas = top * eps ** (np.arange(n_alphas) / max(1, n_alphas - 1))
        tol = 1e-10 * top
        errors = [_fold_errors(total - M[f], M[f], alphas, tol) for f in range(folds) if 0 < M[f][0, 0] < total[0, 0]]
        mse = np.mean(errors, axis=0) if errors else np.zeros(n_alphas)
        best = int(mse.argmin())
        for a in alphas[:best + 1]:
            w = descend(G, c, a, w, tol)
        curve = list(zip(alphas.tolist(), mse.tolist()))
    coefs = spark.createDataFrame([(c, float(v)) for c, v in zip(cols, w)], "feature string, coef double")
    return coefs, spark.createDataFrame(curve, "alpha double, mse double")


def _fold_errors(train: np.ndarray, test: np.ndarray, alphas: np.ndarray, tol: float) -> list[float]:
    """Mean squared error on a fold, penalty by penalty, from moments alone."""
    G, c, m = _centred(train)
    n = test[0, 0]
    shift = np.eye(len(test))
    shift[1:, 0] = -m  # z about the training means
    S = (shift @ test @ shift.T)[1:, 1:]
    w, out = np.zeros(len(c)), []
    for a in alphas:
        w = descend(G, c, a, w, tol)
        r = np.append(-w, 1.0)
        out.append(float(r @ S @ r / n))
    return out


# Squared hinge -----------------------------------------------------------------------
def _hinge_sums(rows: DataFrame, d: int, weights: np.ndarray, C: float) -> np.ndarray:
    """Per class at its weights: the Hessian, and below it the gradient and the loss.
    A class is told from the rest; a row counts while its margin is below 1."""
    K = len(weights)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((d + 3, d + 1)) for k in range(K)}
        for b in batches:
            x = np.column_stack([_matrix(b.column(0), d), np.ones(len(b))])
            y = b.column(1).to_numpy()
            f = x @ weights.T
            for k in range(K):
                side = np.where(y == (k if K > 1 else 1), 1.0, -1.0)
                live = side * f[:, k] < 1
                xs, gap = x[live], f[live, k] - side[live]
                sums[k][:d + 1] += 2 * C * (xs.T @ xs)
                sums[k][d + 1] += 2 * C * (xs.T @ gap)
                sums[k][d + 2, -1] += C * float(gap @ gap)
        yield from _emitted(sums)

    return _added(rows.select("x", "y").mapInArrow(partial, _PART_DDL), K, (d + 3, d + 1))


def hinge_residual(gradient: np.ndarray, w: np.ndarray) -> float:
    """Largest entry of the shortest subgradient of ``loss + |w|_1``."""
    return float(np.where(w != 0, np.abs(gradient + np.sign(w)), np.maximum(np.abs(gradient) - 1, 0)).max(initial=0))


def squared_hinge_weights(rows: DataFrame, d: int, classes: int, C: float = 1.0, tol: float = 1e-6,
                          max_steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bias last, penalised like the others) of ``|w|_1 + C sum max(0, 1 - y f)^2``
    for every class against the rest (two classes: one machine), and the residuals.

    Proximal Newton: each step is one aggregation for all classes at their trial
    weights. A trial that lowers the objective enough becomes the next point, and
    the quadratic model there, solved by coordinate descent, gives the next trial;
    otherwise the step is halved.
    """
    K = classes if classes > 2 else 1
    point, trial = np.zeros((K, d + 1)), np.zeros((K, d + 1))
    value, step, slope = np.full(K, np.inf), np.ones(K), np.zeros(K)
    target, residual = np.zeros((K, d + 1)), np.full(K, np.inf)
    first = np.zeros(K)
    for _ in range(max_steps):
        sums = _hinge_sums(rows, d, trial, C)
        for k in range(K):
            if residual[k] <= tol * max(1.0, first[k]):
                continue
            H, g, loss = sums[k][:d + 1], sums[k][d + 1], sums[k][d + 2, -1]
            now = loss + np.abs(trial[k]).sum()
            if now > value[k] + 1e-4 * step[k] * slope[k] and step[k] > 1e-10:
                step[k] /= 2
                trial[k] = point[k] + step[k] * (target[k] - point[k])
                continue
            point[k], value[k], step[k] = trial[k], now, 1.0
            residual[k] = hinge_residual(g, point[k])
            first[k] = first[k] or residual[k]
            H = H + np.eye(d + 1) * (1e-12 * np.trace(H) / (d + 1) + 1e-300)
            target[k] = descend(H, H @ point[k] - g, 1.0, point[k], 1e-9 * max(1.0, residual[k]))
            move = target[k] - point[k]
            slope[k] = g @ move + np.abs(target[k]).sum() - np.abs(point[k]).sum()
            trial[k] = target[k]
        if (residual <= tol * np.maximum(1.0, first)).all():
            break
    return point, residual


def hinge_selection(features: DataFrame, cols: Sequence[str], *, label: str = "label", C: float = 1.0, threshold: float = 1e-5,
                    tol: float = 1e-6) -> DataFrame:
    """Features whose absolute weights, summed over the classes, reach ``threshold``:
    ``(feature, coef_norm, rank)``. Rows with a hole in a feature or the label are
    left out; fewer than two classes select nothing."""
    classes = [r[0] for r in features.select(F.col(label).cast("int")).dropna().distinct().orderBy(label).limit(1001).collect()]
    if len(classes) > 1000:
        raise ValueError("more than 1000 classes")
    norm = np.zeros(len(cols))
    if len(classes) > 1:
        number = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("int")) - 1
        data = _arrays(features, cols, number.cast("int").alias("y"))
        weights, _ = squared_hinge_weights(data, len(cols), len(classes), C, tol)
        norm = np.abs(weights[:, :-1]).sum(0)
    order = sorted(range(len(cols)), key=lambda i: (-norm[i], cols[i]))
    rows = [(cols[i], float(norm[i]), r + 1) for r, i in enumerate(order) if norm[i] >= threshold]
    return features.sparkSession.createDataFrame(rows, "feature string, coef_norm double, rank int")
