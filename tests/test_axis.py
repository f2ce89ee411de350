"""Axes, regions and inertia on a line against plain programs."""

from itertools import combinations

import numpy as np
import pytest

from loomwork.functions import kernels
from loomwork.operators import axis


def _distances(spark, m):
    n = len(m)
    rows = [(f"t{i:02}", f"t{j:02}", float(m[i, j])) for i in range(n) for j in range(n) if i != j]
    return spark.createDataFrame(rows, "i string, j string, distance double"), spark.createDataFrame([(f"t{i:02}",) for i in range(n)], "node string")


def test_axes_equal_an_eigensolver(spark):
    r = np.random.default_rng(5)
    m = r.random((14, 14)) + 0.2  # no triangle inequality, so some eigenvalues are negative
    m = m + m.T
    np.fill_diagonal(m, 0)
    want, values = kernels.classical_mds(m, 3)
    assert values[-1] < 0
    got = axis.classical_axes(*_distances(spark, m), 3).collect()
    for k in range(3):
        x = np.array([row["position"] for row in sorted((g for g in got if g["axis"] == k + 1), key=lambda g: g["node"])])
        assert x[np.abs(x).argmax()] > 0
        assert np.allclose(x * np.sign(x @ want[:, k]), want[:, k], atol=1e-7)
        assert {round(g["eigenvalue"], 8) for g in got if g["axis"] == k + 1} == {round(values[k], 8)}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_without_a_first_axis_names_give_the_order(spark, n):
    d, nodes = _distances(spark, np.zeros((n, n)))
    got = axis.classical_axes(d, nodes, 2).collect()
    assert sorted((g["axis"], g["node"], g["position"]) for g in got) == sorted((a, f"t{k:02}", float(k) if a == 1 else 0.0) for a in (1, 2) for k in range(n))


def test_regions_equal_centres_in_one_process(spark):
    r = np.random.default_rng(8)
    x, w = np.sort(r.random(40)), r.random(40) ** 3
    df = spark.createDataFrame([(f"t{k:02}", float(a), float(b)) for k, (a, b) in enumerate(zip(x, w, strict=True))], "topic string, position double, weight double")
    got = axis.centre_regions(df, [1, 2, 3, 5]).collect()
    for k in (1, 2, 3, 5):
        centres, cuts = kernels.centre_partition(x, w, k)
        rows = sorted((g for g in got if g["k"] == k), key=lambda g: g["topic"])
        assert [g["region"] for g in rows] == (np.searchsorted(cuts, x, side="right") + 1).tolist()
        assert [g["position"] for g in rows if g["is_anchor"]] == pytest.approx(sorted(set(centres)))
        assert all(g["centre"] == pytest.approx(centres[g["region"] - 1]) for g in rows)


def test_regions_of_few_weightless_and_no_points(spark):
    schema = "topic string, position double, weight double"
    same = axis.centre_regions(spark.createDataFrame([("b", 1.0, 0.0), ("a", 1.0, 0.0)], schema), [3]).collect()
    assert sorted((g["topic"], g["region"], g["is_anchor"], g["weight"]) for g in same) == [("a", 1, True, 1.0), ("b", 1, False, 1.0)]
    two = axis.centre_regions(spark.createDataFrame([("a", 0.0, 1.0), ("b", 1.0, 0.0)], schema), [2]).collect()
    assert sorted((g["topic"], g["region"]) for g in two) == [("a", 1), ("b", 2)]
    assert axis.centre_regions(spark.createDataFrame([], schema), [3]).count() == 0


def test_inertia_is_the_least_of_all_cuts(spark):
    r = np.random.default_rng(3)
    x, w = np.round(r.random(9), 2), r.random(9)
    df = spark.createDataFrame([(f"t{k}", float(a), float(b)) for k, (a, b) in enumerate(zip(x, w, strict=True))], "topic string, position double, weight double")
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order]
    cost = lambda a, b: float((w[a:b] * (x[a:b] - np.average(x[a:b], weights=w[a:b])) ** 2).sum())
    want = [min(sum(cost(a, b) for a, b in zip((0, *c), (*c, 9), strict=True)) for c in combinations(range(1, 9), k - 1)) for k in range(1, 10)]
    got = {g["k"]: g for g in axis.least_inertia(df, 11).collect()}
    assert sorted(got) == list(range(1, 10))
    assert [got[k]["inertia"] for k in range(1, 10)] == pytest.approx(want, abs=1e-9)
    assert got[1]["gain"] is None and got[3]["elbow"] == pytest.approx(want[0] - 2 * want[1] + want[2], abs=1e-9)


def test_validation_of_regions_equals_matrices(spark):
    r = np.random.default_rng(11)
    rca = np.where(r.random((8, 12)) < 0.5, r.random((8, 12)) * 3, 0.0)
    rca[7] = 0.5  # an actor without excess
    x, e = np.sort(r.random(12)), np.maximum(rca - 1, 0)
    name = lambda k: f"t{k:02}"
    spec = spark.createDataFrame([(f"a{a}", name(t), float(rca[a, t])) for a in range(8) for t in range(12)], "actor string, topic string, rca double")
    points = spark.createDataFrame([(name(t), float(x[t]), float(e[:, t].sum())) for t in range(12)], "topic string, position double, weight double")
    regions = axis.centre_regions(points, [2, 4])
    got = {g["k"]: g for g in axis.region_validation(spec, regions.withColumn("excess", regions["weight"])).collect()}
    full = e[e.sum(axis=1) > 0]
    assert 3 < len(full) < 8
    full = full / full.sum(axis=1, keepdims=True)
    upper = np.triu_indices(len(full), 1)
    for k in (2, 4):
        centres, cuts = kernels.centre_partition(x, e.sum(axis=0), k)
        region = np.searchsorted(cuts, x, side="right")
        share = full @ np.eye(k)[region]
        assert got[k]["rho"] == pytest.approx(kernels.rank_correlation(kernels.cosines(full)[upper], kernels.cosines(share)[upper]), abs=1e-9)
        assert got[k]["inertia"] == pytest.approx(float((e.sum(axis=0) * (x - centres[region]) ** 2).sum()))
        assert (got[k]["mean_dominant"], got[k]["median_dominant"]) == pytest.approx((share.max(axis=1).mean(), np.median(share.max(axis=1))))
        assert got[k]["anchored"] == pytest.approx((share.max(axis=1) >= 0.7).mean())
        assert (got[k]["least_topics"], got[k]["regions"]) == (np.bincount(region).min(), k)
        assert got[k]["least_signal"] == pytest.approx(np.bincount(region, weights=e.sum(axis=0)).min() / e.sum())
