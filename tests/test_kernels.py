"""Numerical kernels and fitted models against plain formulas."""

import itertools

import numpy as np
import pandas as pd
import pytest

from loomwork.functions import kernels
from loomwork.operators import models
from loomwork.plans.queries_more import thresholds


@pytest.fixture
def r():
    return np.random.default_rng(12)


def test_mds_keeps_distances(r):
    x = r.normal(size=(12, 3))
    distance = np.linalg.norm(x[:, None] - x[None], axis=2)
    at, values = kernels.classical_mds(distance, 3)
    assert np.linalg.norm(at[:, None] - at[None], axis=2) == pytest.approx(distance, abs=1e-8)
    assert values[3:] == pytest.approx(0, abs=1e-8) and values[:3].sum() == pytest.approx((distance**2).sum() / 24)


def test_partition_is_a_fixed_point(r):
    x, w = np.sort(r.random(40)), r.random(40) + 0.1
    centres, cuts = kernels.centre_partition(x, w, 4)
    assert set(centres.tolist()) <= set(x.tolist()) and cuts == pytest.approx((centres[1:] + centres[:-1]) / 2)
    spread = ((x[:, None] - centres) ** 2).min(axis=1)
    one, _ = kernels.centre_partition(x, w, 1)
    assert (w * spread).sum() < (w * ((x[:, None] - one) ** 2).min(axis=1)).sum()


def test_communities_find_cliques():
    w = np.zeros((9, 9))
    for k in range(0, 9, 3):
        w[k : k + 3, k : k + 3] = 1
    np.fill_diagonal(w, 0)
    w[2, 3] = w[3, 2] = w[5, 6] = w[6, 5] = 0.1
    label = kernels.communities(w)
    assert [len(set(label[k : k + 3])) for k in (0, 3, 6)] == [1, 1, 1] and len(set(label)) == 3


def test_fiedler_orders_a_path(r):
    place = r.permutation(10)
    w = np.zeros((10, 10))
    for a, b in itertools.pairwise(place):
        w[a, b] = w[b, a] = 1
    order = kernels.fiedler_order(w).tolist()
    assert order in (place.tolist(), place[::-1].tolist())


def test_ward_heights(r):
    x = r.normal(size=(9, 2))
    order, merges = kernels.ward_order(x)
    assert sorted(order.tolist()) == list(range(9))
    groups, following = {i: [i] for i in range(9)}, 9
    cost = lambda g: ((x[g] - x[g].mean(axis=0)) ** 2).sum()
    for a, b, height in merges:
        rise = {(p, q): cost(groups[p] + groups[q]) - cost(groups[p]) - cost(groups[q]) for p, q in itertools.combinations(groups, 2)}
        assert rise[tuple(sorted((a, b)))] == pytest.approx(min(rise.values())) and height == pytest.approx((2 * min(rise.values())) ** 0.5)
        groups[following] = groups.pop(a) + groups.pop(b)
        following += 1


def test_diffusion_and_distance(r):
    phi, theta = r.random((6, 6)) / 12, r.random(6)
    f = kernels.diffuse(phi, theta / theta.sum(), 0.85, 500, 1e-13)
    assert f == pytest.approx(0.85 * theta / theta.sum() @ np.linalg.inv(np.eye(6) - 0.15 * phi), abs=1e-9)
    kl, js = kernels.divergence(np.array([1.0, 1, 0]), np.array([0.0, 1, 1]))
    assert js == pytest.approx(np.log(2) ** 0.5 / 2**0.5, abs=1e-4) and kl > 10
    assert kernels.divergence(theta, theta * 3) == pytest.approx((0, 0), abs=1e-6)


def test_swaps_keep_margins_and_differ(r):
    grid = r.random((9, 12)) < 0.3
    pairs = np.argwhere(grid)
    draws = list(kernels.swap_null(pairs, 3, draws=5))
    for d in draws:
        new = np.zeros_like(grid)
        new[tuple(d.T)] = True
        assert (new.sum(axis=0) == grid.sum(axis=0)).all() and (new.sum(axis=1) == grid.sum(axis=1)).all()
    assert any({*map(tuple, d.tolist())} != {*map(tuple, pairs.tolist())} for d in draws)


def test_ridge_logit_is_the_optimum(r):
    x = r.normal(size=(60, 2)) * [3, 0.2] + 5
    y = (r.random(60) < 1 / (1 + np.exp(-(x[:, 0] - 5)))).astype(int)
    beta = kernels.ridge_logit(x, y)
    z = (x - x.mean(axis=0)) / x.std(axis=0)

    def loss(b):
        eta = b[0] + z @ b[1:]
        return np.log1p(np.exp(eta)).sum() - y @ eta + (b[1:] ** 2).sum() / 2

    for step in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3:
        assert loss(beta) < loss(beta + step)
    assert np.isfinite(kernels.ridge_logit(np.ones((4, 2)), np.array([0, 1, 0, 1]))).all()


def test_longest_path(r):
    for _ in range(20):
        edges = [(f"n{k:02d}", f"n{r.integers(k):02d}") for k in range(1, 15)]
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

        def depth(node, back, near=near):
            return 1 + max((depth(o, node) for o in near[node] if o != back), default=0)

        path = kernels.longest_path(edges)
        assert len(path) == max(depth(n, None) for n in near) and all(b in near[a] for a, b in itertools.pairwise(path))
    assert kernels.longest_path([]) == []


def test_bridging(r):
    w = np.triu(r.random((8, 8)) * (r.random((8, 8)) < 0.4), 1)
    w = w + w.T
    for v, got in enumerate(kernels.bridging(w)):
        near = np.flatnonzero(w[v])
        want = (1 / len(near)) / sum(1 / (w[u] > 0).sum() for u in near) if len(near) else 0
        assert got == pytest.approx(want)


def test_thresholds():
    assert thresholds(" 0.5,0.15, 0.5,") == [0.15, 0.5]
    for bad in ("", "0,0.5", "0.5,1"):
        with pytest.raises(ValueError):
            thresholds(bad)


@pytest.fixture
def sample(spark, r):
    x, g = r.normal(size=(200, 3)), r.integers(0, 12, 200)
    y = x @ [1.0, -2, 0.5] + r.normal(size=200) * (1 + np.abs(x[:, 0]))
    hit = (r.random(200) < 1 / (1 + np.exp(-x[:, 0] + 0.3))).astype(int)
    rows = [(float(a), float(b), float(c), float(v), int(h), int(k)) for (a, b, c), v, h, k in zip(x, y, hit, g, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, hit int, g int"), x, y, hit, g


def test_least_squares(sample):
    df, x, y, _, _ = sample
    z = np.column_stack([np.ones(200), x])
    inv = np.linalg.inv(z.T @ z)
    beta = inv @ z.T @ y
    e = y - z @ beta
    lever = np.einsum("ij,jk,ik->i", z, inv, z)
    se = np.sqrt(np.diag(inv @ (z.T * (e / (1 - lever)) ** 2) @ z @ inv))
    got = models.ols(df, "y", ["a", "b", "c"]).collect()
    assert [t["coefficient"] for t in got] == pytest.approx(beta) and [t["se"] for t in got] == pytest.approx(se)
    (p,) = models.partial_regression(df, "y", "a", ["b", "c"]).collect()
    assert p["coefficient"] == pytest.approx(beta[1]) and p["partial"] == pytest.approx(beta[1]) and p["n"] == 200


def test_logits(sample):
    df, x, _, hit, g = sample
    z = np.column_stack([np.ones(200), x[:, :2]])
    got = models.logit(df, "hit", ["a", "b"], cluster="g").collect()
    beta = np.array([t["coefficient"] for t in got])
    p = 1 / (1 + np.exp(-z @ beta))
    assert z.T @ (hit - p) == pytest.approx(np.zeros(3), abs=1e-6)
    inv = np.linalg.inv((z.T * (p * (1 - p))) @ z)
    scores = np.stack([(z[g == k] * (hit - p)[g == k, None]).sum(axis=0) for k in np.unique(g)])
    n = len(scores)
    cov = inv @ scores.T @ scores @ inv * n / (n - 1) * 199 / 197
    assert [t["se"] for t in got] == pytest.approx(np.sqrt(np.diag(cov)))
    by = {t["g"]: t for t in models.group_logits(df, ["g"], "hit", ["a", "b"]).collect()}
    both = {k for k in np.unique(g).tolist() if 0 < hit[g == k].sum() < (g == k).sum()}
    assert set(by) == both
    for k in both:
        want = kernels.ridge_logit(x[g == k][:, :2], hit[g == k])
        assert [by[k]["intercept"], by[k]["a"], by[k]["b"]] == pytest.approx(want) and by[k]["rows"] == (g == k).sum()
    assert models.group_logits(df.limit(0), ["g"], "hit", ["a", "b"]).count() == 0


def test_graph_queries_follow_the_networks(spark):
    import __spark_entry__ as entry

    sf, q = "/root/testdata/sf0.001", entry.queries()
    tree = pd.DataFrame([r.asDict() for r in q["i37_scaffold"](spark, sf).collect()])
    links = {frozenset(x) for x in tree[tree.in_tree][["i", "j"]].to_numpy().tolist()}
    path = [r["topic"] for r in q["i47_longest_path"](spark, sf).orderBy("place").collect()]
    assert all(frozenset(x) in links for x in itertools.pairwise(path)) and len(set(path)) == len(path)
    (m,) = q["j04_estimand_medians"](spark, sf).collect()
    fits = q["j02_group_logits"](spark, sf).toPandas()
    assert m["group_median"] == pytest.approx(fits.distance.median()) and m["models"] == len(fits)
    assert m["median_of_medians"] == pytest.approx(fits.groupby("period").distance.median().median())


def test_transport(r):
    """Equal masses against all assignments; masses on a line against the cumulated shares."""
    for _ in range(30):
        n = int(r.integers(1, 6))
        cost = r.random((n, n))
        least = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) / n
        assert kernels.transport(np.ones(n), np.ones(n), cost) == pytest.approx(least)
    x, y, p, q = r.random(20), r.random(15), r.random(20), r.random(15)
    z = np.sort(np.r_[x, y])
    upto = lambda at, w: np.array([w[at <= v].sum() for v in z]) / w.sum()
    assert kernels.transport(p, q, np.abs(x[:, None] - y)) == pytest.approx((np.abs(upto(x, p) - upto(y, q))[:-1] * np.diff(z)).sum())
    assert np.isnan(kernels.transport(np.zeros(2), np.ones(2), np.ones((2, 2))))


def test_selections(r):
    y = np.array([1.0, 3, 3, 2, 5, 1, 4])
    assert kernels.peaks(y, 5) == [4, 6, 1] and kernels.peaks(y, 5, apart=3) == [4, 1] and kernels.peaks(y, 1) == [4]
    x = np.arange(7) / 6
    assert kernels.best_of_bins(y, x, 2, 0.7) == [4] and kernels.best_of_bins(y, x, 2, 0.2) == [1, 4]
    liked = dict.fromkeys(range(7), 0.0)
    assert kernels.spread_selection(y, x, liked, 3, (0.5,)) == [1, 4] and len(kernels.spread_selection(y, x, liked, 3, (0.5, 0.3))) == 3
    v = r.integers(0, 5, 30).astype(float)
    assert kernels.average_ranks(v) == pytest.approx(pd.Series(v).rank().to_numpy())
    assert kernels.smooth(np.full(9, 2.0)) == pytest.approx(np.full(9, 2.0))
