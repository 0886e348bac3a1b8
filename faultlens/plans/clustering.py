"""Training-node choice by clustering per-node summaries (SURVEY 2.9 L14-L16,
2.8 F8/F10/F11, 2.5 W18/W21, 2.1 S16).

Job: per-node filtered means (A4/A5) -> Gaussian mixture (full covariance) ->
Mahalanobis distance to the own component -> outliers -> dense renumbering ->
prototypes = candidate training nodes. All steps are DataFrame operations; the
driver only reads the k means/covariances of the fitted mixture.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions.shipping import ship_by_value
from faultlens.functions.scalar import mahalanobis, outlier_label
from faultlens.operators import compare, profile
from faultlens.operators.features import zscore_scale
from faultlens.session import ensure_checkpoint_dir

ship_by_value(__name__)


def gmm(points: DataFrame, cols: Sequence[str], k: int, seed: int = 42, node: str = "nodename",
        max_iter: int = 100) -> tuple[DataFrame, list[np.ndarray], list[np.ndarray]]:
    """Fit a full-covariance mixture, assign every point, and add the
    Mahalanobis distance to its own component (F10). Returns (table, means, covs).

    Points are written to the shared folder once: fitting reads them many times,
    and so do the steps after it."""
    ensure_checkpoint_dir(points.sparkSession)
    data = points.where(F.greatest(*[F.col(c).isNull() for c in cols]) == F.lit(False)).select(node, *cols).checkpoint() \
        .withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])))
    model = GaussianMixture(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(data)
    g = model.gaussiansDF.collect()  # k rows
    means = [np.asarray(r["mean"].toArray()) for r in g]
    covs = [np.asarray(r["cov"].toArray()) for r in g]
    inv = [np.linalg.pinv(c) for c in covs]
    out = model.transform(data).select(node, *cols, F.col("prediction").alias("cluster"))
    dist = None
    for i in range(k):
        diffs = [F.col(c) - F.lit(float(means[i][j])) for j, c in enumerate(cols)]
        e = mahalanobis(diffs, inv[i].tolist())
        dist = F.when(F.col("cluster") == i, e) if dist is None else dist.when(F.col("cluster") == i, e)
    return out.withColumn("distance", dist), means, covs


def clustering_job(table: DataFrame, cols: Sequence[str], *, k: int, node: str = "node", pos: str = "pos",
                   faults=None, apps=None, fault_col: str = "fault", app_col: str = "app",
                   halves: bool = False, threshold: float = 2.0, seed: int = 42,
                   method: str = "manual") -> dict[str, DataFrame]:
    """The whole node-choice job. ``method='pca'`` replaces the chosen
    columns by the means of 3 principal components (L15; the PCA path of Q7)."""
    if method == "pca":
        pts = pca_node_means(table, cols, node=node, faults=faults, apps=apps, fault_col=fault_col,
                             app_col=app_col)
        cols = ["pc1", "pc2", "pc3"]
        pts = pts.withColumn("nodename", F.col(node).cast("string"))
    elif halves:
        pts = profile.filtered_half_means(table, cols, node=node, pos=pos, faults=faults, apps=apps,
                                          fault_col=fault_col, app_col=app_col)
    else:
        pts = profile.filtered_node_means(table, cols, node=node, faults=faults, apps=apps,
                                          fault_col=fault_col, app_col=app_col) \
            .withColumn("nodename", F.col(node).cast("string"))
    clustered, _, _ = gmm(pts, cols, k, seed, node="nodename")
    marked = clustered.withColumn("cluster", outlier_label("cluster", "distance", threshold))
    renum = compare.renumber_clusters(marked)
    candidates = compare.prototypes(renum)
    return {"clustered": renum, "candidates": candidates}


def _components(k: int, d: int):
    """Leading eigenvectors of small covariance matrices (given by their lower
    triangles), one row per node; the largest loading of each is positive, so
    results compare across runs."""
    def fn(it):
        for batch in it:
            flat = batch.column("cov").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), d * (d + 1) // 2)  # a missing sum is nan
            c = np.zeros((len(batch), d, d))
            c[(slice(None), *np.tril_indices(d))] = np.nan_to_num(flat)
            _, vectors = np.linalg.eigh(c)  # of lower triangles
            top = vectors[:, :, ::-1][:, :, :k].transpose(0, 2, 1)
            largest = np.take_along_axis(top, np.abs(top).argmax(2)[:, :, None], 2)
            top = top * np.where(largest < 0, -1.0, 1.0)
            rows = pa.ListArray.from_arrays(np.arange(len(batch) * k + 1, dtype=np.int32) * d, top.ravel())
            found = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * k, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("_m"), found], [batch.schema.names[0], "_m", "components"])
    return fn


def pca_node_means(table: DataFrame, cols: Sequence[str], *, node: str = "node", faults=None, apps=None,
                   fault_col: str = "fault", app_col: str = "app", k: int = 3) -> DataFrame:
    """Standardise per node (F8), project on the node's own first ``k``
    principal components, filter fault/app rows, mean of each component per node.

    A node's covariance and the means of its chosen rows are one partial
    aggregation (d x d sums), only these small rows reach Python, and as
    projecting is linear, the means of the components are the components of the
    means: no row is projected.
    """
    cols, d = list(cols), len(cols)
    z = zscore_scale(table, cols, part=(node,))
    chosen = compare.run_condition(z, faults=faults, apps=apps, fault_col=fault_col, app_col=app_col)
    sums = z.groupBy(node).agg(F.array(*[F.covar_pop(a, b) for i, a in enumerate(cols) for b in cols[:i + 1]]).alias("cov"),
                               F.array(*[F.avg(F.when(chosen, F.col(c))) for c in cols]).alias("_m"), F.count_if(chosen).alias("_n"))
    sums = sums.where((F.col("_n") > 0) & F.col(node).isNotNull()).select(node, "_m", "cov")
    schema = f"{node} {table.schema[node].dataType.simpleString()}, _m array<double>, components array<array<double>>"

    def dot(i: int):
        both = F.zip_with(F.get("components", i), F.col("_m"), lambda a, b: a * b)
        return F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x)

    return sums.mapInArrow(_components(k, d), schema).select(node, *[dot(i).alias(f"pc{i + 1}") for i in range(k)])
