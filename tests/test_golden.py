"""Golden cases rebuilt in FIXTURES.md: smoothing sums per node and half, and
the feature-list reader contract."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from faultlens.operators import profile
from faultlens.sources.featurelist import FeatureReader, feature_table

# Fixed values of the studied tests: the toy series, its labels and the expected sums.
FOO = [1, 2, 4, 8, 10, 16, 32, 64]
FAULT = [0, 0, 0, 1, 0, 1, 2, 3]
APP = [20, 20, 21, 20, 21, 21, 20, 24]


@pytest.fixture(scope="module")
def toy(spark):
    rows = []
    for node in ("N1", "N2"):
        for i, (f, fl, ap) in enumerate(zip(FOO, FAULT, APP), start=1):
            bar, zoom = (10 * f, -f) if node == "N1" else (-f, 10 * f)
            rows.append((node, i, float(f), float(bar), float(zoom), fl, ap))
    return spark.createDataFrame(rows, "node string, pos long, foo double, bar double, zoom double, "
                                       "faultLabel int, applicationLabel int")


CASES = [([0], [20], 3, 3, 0), ([0], [20, 21], 17, 7, 10), ([0, 1], [20], 11, 11, 0)]


@pytest.mark.parametrize("faults,apps,whole,h1,h2", CASES)
def test_smoothing_sums(toy, faults, apps, whole, h1, h2):
    kw = dict(faults=faults, apps=apps, fault_col="faultLabel", app_col="applicationLabel", agg="sum")
    w = {r["node"]: r for r in profile.filtered_node_means(toy, ["foo", "bar", "zoom"], **kw).collect()}
    for node in ("N1", "N2"):
        assert w[node]["foo"] == whole
    assert w["N1"]["bar"] == 10 * whole and w["N1"]["zoom"] == -whole
    assert w["N2"]["bar"] == -whole and w["N2"]["zoom"] == 10 * whole
    hv = {(r["node"], r["half"]): r["foo"] for r in
          profile.filtered_half_means(toy, ["foo"], **kw).collect()}
    for node in ("N1", "N2"):
        assert hv[(node, 1)] == h1 and hv[(node, 2)] == h2


def test_smoothing_mean_keeps_empty_nodes(toy):
    out = profile.filtered_node_means(toy.where(F.col("node") == "N1").unionByName(
        toy.where(F.col("node") == "N2").withColumn("faultLabel", F.lit(7))), ["foo"],
        faults=[0], apps=[20], fault_col="faultLabel", app_col="applicationLabel")
    got = {r["node"]: r["foo"] for r in out.collect()}
    assert got["N1"] == 1.5 and got["N2"] is None


# Fixed values of the studied tests: list file texts, sections of it and error messages.
def _write(text):
    d = tempfile.mkdtemp(prefix="fl-")
    p = os.path.join(d, "list.txt")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_feature_reader_plain(spark):
    p = _write("header\n---- column1\n---- column2\n---- column3\n")
    r = FeatureReader(spark, p, "plain")
    assert r.get_features() == ["column1", "column2", "column3"]
    assert r.get_n_features(2) == ["column1", "column2"]
    with pytest.raises(ValueError, match=r"n parameter is lower than 1 \(it is 0\)"):
        r.get_n_features(0)


def test_feature_reader_ranked(spark):
    p = _write("header\n---- column1: 0.1738919473844908\n---- column2: 0.1\n---- column3: 0.05\n")
    assert FeatureReader(spark, p, "ranked").get_n_features(2) == ["column1", "column2"]
    t = feature_table(spark, p, "ranked").orderBy("rank").collect()
    assert abs(t[0]["importance"] - 0.1738919473844908) < 1e-15


def test_feature_reader_errors(spark):
    p = _write("")
    with pytest.raises(ValueError, match="is empty"):
        FeatureReader(spark, p).get_features()
    missing = "/foo/bar.txt"
    with pytest.raises(OSError, match="/foo/bar.txt does not exist"):
        FeatureReader(spark, missing).get_features()
