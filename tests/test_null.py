"""Removals, separated maxima and neighbours in space against plain programs."""

import numpy as np
import pandas as pd
import pytest

from loomwork.operators import pairs, sensitivity, sequence


def proximities(x):
    """Topic by topic, of a matrix actors x topics of counts."""
    with np.errstate(divide="ignore", invalid="ignore"):
        held = x * x.sum() > x.sum(axis=1, keepdims=True) * x.sum(axis=0)
        both, size = held.T.astype(int) @ held, held.sum(axis=0)
        phi = both / np.maximum(np.maximum(size[:, None], size), 1)
    return phi[np.triu_indices(x.shape[1], 1)]


def test_greedy_removal_equals_recomputing(spark):
    r = np.random.default_rng(3)
    x = r.poisson(1.2, size=(7, 9)) * r.integers(1, 5, size=(7, 9))
    x[5], x[6] = x[4], 0
    x[6, 2] = 3
    base, left, want = proximities(x), list(range(7)), []
    while len(left) > 1:
        errors = [(-round(float(np.sqrt(np.mean((proximities(x[[a for a in left if a != out]]) - base) ** 2))), 9), f"a{out}") for out in left]
        error, name = min(errors)
        want.append((name, -error))
        left.remove(int(name[1:]))
    cube = spark.createDataFrame([(f"a{a}", f"t{t}", int(x[a, t])) for a in range(7) for t in range(9)], "actor string, topic string, x long")
    got = [(r["actor"], r["rmse"]) for r in sensitivity.greedy_removal(cube).orderBy("step").collect()]
    assert got == [(n, pytest.approx(e, abs=1e-8)) for n, e in want]
    assert sensitivity.greedy_removal(cube.limit(0)).count() == 0


def greedy_maxima(y, gap, top):
    n = len(y)
    if n < 3:
        return list(range(min(n, top)))
    offered = [k for k in range(1, n - 1) if y[k] >= y[k - 1] and y[k] >= y[k + 1]] or list(range(n))
    kept = []
    for k in sorted(offered, key=lambda k: -y[k]):
        if all(abs(k - j) >= gap for j in kept) and len(kept) < top:
            kept.append(k)
    return sorted(kept)


def test_separated_maxima_equal_a_greedy_pass(spark):
    r = np.random.default_rng(8)
    axes = {f"g{k}": r.integers(0, 6, size=n).tolist() for k, n in enumerate([1, 2, 3, 3, 40, 200, 200])}
    axes["falling"], axes["flat"], axes["rising"] = [9, 5, 4, 1], [2] * 12, [1, 2, 3, 8, 9]
    rows = spark.createDataFrame([(g, k, v) for g, y in axes.items() for k, v in enumerate(y)], "g string, k long, v long")
    for gap, top in ((1, 100), (4, 100), (7, 3)):
        got = {}
        for x in sequence.separated_maxima(rows, "v", "k", gap, top, ["g"]).collect():
            got.setdefault(x["g"], []).append(x["k"])
        assert {g: sorted(k) for g, k in got.items()} == {g: greedy_maxima(y, gap, top) for g, y in axes.items()}
    assert sorted(x["k"] for x in sequence.separated_maxima(rows.filter("g = 'g5'").drop("g"), "v", "k", 5, 9).collect()) == greedy_maxima(axes["g5"], 5, 9)


def plain_neighbours(points, k):
    z = np.round((points - points.mean(axis=0)) / np.where(points.std(axis=0) > 0, points.std(axis=0), 1), 9)
    out = []
    for i in range(len(z)):
        d = np.round(((z - z[i]) ** 2).sum(axis=1), 9)
        out.append([j for j in np.lexsort((np.arange(len(z)), d)) if j != i][:k])
    return out


@pytest.mark.parametrize(("n", "dims", "k"), [(400, 2, 7), (500, 3, 12), (30, 3, 50), (1, 2, 3)])
def test_neighbours_in_space_equal_all_pairs(spark, n, dims, k):
    r = np.random.default_rng(n)
    points = np.round(r.normal(size=(n, dims)) * np.linspace(1, 4, dims), 1)
    points[: n // 3] = points[0]  # a crowded spot
    points[-1] = 60  # and a row far from all
    df = spark.createDataFrame(pd.DataFrame({"key": range(n)} | {f"f{i}": points[:, i] for i in range(dims)}))
    got = {x["key"]: [y["key"] for y in x["near"]] for x in pairs.nearest_in_space(df, "key", [f"f{i}" for i in range(dims)], k).collect()}
    want = plain_neighbours(points, k)
    assert len(got) == n and all(got[i] == want[i] for i in range(n))
