"""The clustering job on components: one pass over its table, sums as in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.plans import clustering

COLS = ["a", "b", "c"]


def node_rows(spark, holes=False, nodes=24, length=30):
    rng = np.random.default_rng(7)
    rows = []
    for n in range(nodes):
        x = rng.normal(size=(length, 3)) @ rng.normal(size=(3, 3))
        for p, v in enumerate(x.tolist()):
            if holes and n < 3:
                v = [None if c <= n else y for c, y in enumerate(v)]
            rows.append((f"N{n}" if not holes or n != 3 else None, p + 1, *v, p % 4))
    return spark.createDataFrame(rows, "node string, pos long, a double, b double, c double, fault int")


def test_table_is_read_for_scales_and_for_sums_alone(spark):
    """Fitting, assigning, renumbering and prototypes read saved points, not the table."""
    read = spark.sparkContext.accumulator(0)

    def counted(it):
        for pdf in it:
            read.add(len(pdf))
            yield pdf

    df = node_rows(spark)
    table = df.mapInPandas(counted, df.schema)
    res = clustering.clustering_job(table, COLS, k=2, faults=[0, 1], method="pca", threshold=5.0)
    found = res["clustered"].collect()
    assert len(found) == 24 and res["candidates"].count()
    assert read.value <= 2 * 24 * 30


@pytest.mark.parametrize("faults", [[1, 3], None])
def test_components_of_nodes_with_holes(spark, faults):
    """A column without values gives no mean, a nameless node no row, and a node
    without chosen rows none either."""
    df = node_rows(spark, holes=True).where("node IS NULL OR node <> 'N5' OR fault = 0")
    got = {r.node: [r.pc1, r.pc2, r.pc3] for r in clustering.pca_node_means(df, COLS, faults=faults).collect()}
    assert set(got) == {f"N{n}" for n in range(24)} - {"N3"} - ({"N5"} if faults else set())
    pdf = df.where("node IS NOT NULL").orderBy("node", "pos").toPandas()
    for name, g in pdf.groupby("node"):
        if name not in got:
            continue
        x = g[COLS].to_numpy(float)
        if np.isnan(x).any():
            assert got[name] == [None] * 3
            continue
        z = (x - x.mean(0)) / x.std(0)
        _, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
        top = vectors[:, ::-1].T
        top *= np.sign(top[np.arange(3), np.abs(top).argmax(1)])[:, None]
        sel = z[g["fault"].isin(faults)] if faults else z
        assert got[name] == pytest.approx((sel.mean(0) @ top.T).tolist())


def test_condition_of_runs_is_that_of_select_runs(spark):
    from faultlens.operators import compare

    df = spark.createDataFrame([(f"N{i}", i, None if i == 4 else i % 3, i % 2) for i in range(12)], "node string, node_no long, fault int, app int")
    asked = dict(faults=[0, 2], apps=[1], node_range=(1, 9))
    rows = {r.node for r in compare.select_runs(df, **asked).collect()}
    assert rows == {"N3", "N5", "N9"}
    assert df.agg(F.count_if(compare.run_condition(df, **asked))).first()[0] == 3
