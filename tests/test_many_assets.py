"""Products of blocks, principal components, spanning trees and exact quantiles against NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_portfolio import days, long, sample

from palisand.operators import factors, gram, optimize, quantiles, tree


@pytest.fixture(params=[2, 3, 256])
def size(request, monkeypatch):
    monkeypatch.setattr(gram, "ASSETS", request.param)
    monkeypatch.setattr(gram, "DAYS", 30 * request.param)


def test_covariances_are_numpys(spark, size):
    x = sample(120, 7)
    got = optimize.moments(long(spark, x)).first()
    assert list(got.assets) == [f"A{j}" for j in range(7)]
    assert np.allclose(got.mean, x.mean(axis=0) * 252, atol=1e-10) and np.allclose(got.cov, np.cov(x.T) * 252, atol=1e-12)
    two = long(spark, x).withColumn("part", (F.col("date") > F.lit(days(120)[50])).cast("int"))
    for r in optimize.moments(two, "part").collect():
        own = x[51:] if r.part else x[:51]
        assert np.allclose(r.cov, np.cov(own.T) * 252, atol=1e-12)


def test_covariances_with_gaps_are_pairwise(spark, size):
    x = sample(90, 4)
    x[np.random.default_rng(1).random(x.shape) < 0.3] = np.nan
    rows = long(spark, x).filter(~F.isnan("r"))
    got = {(r.i, r.j): r.c for r in gram.covariances(gram.products(rows)).collect()}
    want = pd.DataFrame(x, columns=[f"A{j}" for j in range(4)]).cov()
    assert len(got) == 16 and all(np.isclose(c, want.loc[i, j], atol=1e-14) for (i, j), c in got.items())
    one = gram.covariances(gram.products(rows.limit(1))).collect()
    assert [(r.c, r.m is not None) for r in one] == [(None, True)]


def test_components_are_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(gram, "ASSETS", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 30)) * 0.01 + rng.normal(size=(200, 3)) @ rng.normal(size=(3, 30)) * 0.004
    got = factors.loadings(long(spark, x), 3).toPandas()
    names = sorted(f"A{j}" for j in range(30))
    own = x[:, [int(n[1:]) for n in names]]
    v, share = factors.components(np.corrcoef(own.T), 3)
    assert got["asset"].tolist() == names * 3
    assert np.allclose(got["loading"].to_numpy().reshape(3, 30).T, v, atol=1e-8) and np.allclose(got["share"].unique(), share, atol=1e-10)


def test_components_of_an_asset_that_stands_still(spark):
    x = sample(60, 3)
    x[:, 1] = 0.0
    got = factors.loadings(long(spark, x), 2).toPandas()
    assert np.isfinite(got["loading"]).all() and np.allclose(got[got["asset"] == "A1"]["loading"], 0)


def test_tree_is_single_linkage(spark):
    x = sample(80, 9)
    d = optimize.distances(np.cov(x.T))
    want = optimize.linkage(d)
    found = optimize.asset_tree(long(spark, x))
    assert [(i, j) for i, j, _ in found.merges] == [(i, j) for i, j, _ in want] and np.allclose([m[2] for m in found.merges], [m[2] for m in want], atol=1e-9)
    assert found.order() == optimize.leaves(want, 9)
    got = {r.asset: (r.place, r.cluster) for r in optimize.asset_clusters(long(spark, x)).collect()}
    assert sorted(p for p, _ in got.values()) == list(range(9)) and {c for _, c in got.values()} == {1, 2, 3} and got["A0"][1] == 1


def test_equal_distances_merge_by_name(spark):
    pairs = spark.createDataFrame([(i, j, 0.5) for i in "abcd" for j in "abcd" if i < j], "i string, j string, d double").repartition(3)
    edges = tree.spanning(pairs)
    assert edges == [(0.5, "a", "b"), (0.5, "a", "c"), (0.5, "a", "d")]
    assert tree.linkage(list("abcd"), edges).clusters(2) == [1, 1, 1, 2]
    assert tree.spanning(pairs.limit(0)) == [] and tree.linkage(["x"], []).order() == [0]


@pytest.mark.parametrize(("few", "ranges"), [(4096, 256), (3, 4), (1, 2)])
def test_quantiles_are_percentiles(spark, monkeypatch, few, ranges):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    monkeypatch.setattr(quantiles, "ROUNDS", 60)
    rng = np.random.default_rng(6)
    rows = [("even", float(v)) for v in rng.normal(size=501)] + [("heavy", float(v)) for v in rng.standard_cauchy(400) ** 3] + [("same", 2.5)] * 300
    rows += [("ties", float(v)) for v in rng.integers(0, 4, 700)] + [("one", -1.0), ("none", None), ("huge", 1e308), ("huge", -1e308), ("huge", 0.0), ("nan", float("nan")), ("nan", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    levels = [0.0, 0.01, 0.05, 0.5, 0.77, 1.0]
    got = {(r.g, r.level): r.value for r in quantiles.quantiles(df, ["g"], "x", levels).collect()}
    clean = df.filter("x is not null and not isnan(x)")
    want = {(r.g, p): v for r in clean.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, levels))).alias("v")).collect() for p, v in zip(levels, r.v, strict=True)}
    assert got == want  # to the last bit


def test_tail_of_quantiles(spark):
    from palisand.operators import metrics

    x = long(spark, sample(300, 2)).withColumnRenamed("asset", "strategy")
    one, two = ({r.strategy: (r.var, r.cvar) for r in f(x).collect()} for f in (metrics.tail, quantiles.tail))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-15) for k in one)
