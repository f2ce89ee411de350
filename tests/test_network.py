"""Components, diffusion, swap chains and folded permutations against plain programs."""

import hashlib

import numpy as np
import pytest

from loomwork.functions import kernels
from loomwork.operators import models, network, resample


def test_components_equal_a_walk(spark):
    r = np.random.default_rng(2)
    edges = [(str(a), str(b)) for a, b in r.integers(0, 60, size=(45, 2)).tolist()] + [(f"p{k}", f"p{k + 1}") for k in range(40)] + [("x", "x")]
    parent = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    df = spark.createDataFrame([("g", *e) for e in edges] + [("h", "p3", "p9")], "g string, i string, j string")
    got = {(x["g"], x["node"]): x["component"] for x in network.components(df, ["g"]).collect()}
    groups = {}
    for n in list(parent):
        groups.setdefault(root(n), set()).add(n)
    want = {("g", n): min(members) for members in groups.values() for n in members} | {("h", "p3"): "p3", ("h", "p9"): "p3"}
    assert got == want
    giant = network.giant_component(df.filter("g = 'g'").drop("g")).collect()
    most = min(groups.values(), key=lambda m: (-len(m), min(m)))
    assert {n for e in giant for n in e} == most
    assert network.components(df.limit(0)).count() == 0


def test_diffusion_equals_the_kernel(spark):
    r = np.random.default_rng(4)
    names = [f"t{k}" for k in range(9)]
    phi = np.triu(r.random((9, 9)) * (r.random((9, 9)) < 0.5), 1)
    phi = phi + phi.T
    phi[8] = phi[:, 8] = 0  # a topic without edges
    edges = spark.createDataFrame([(names[i], names[j], float(phi[i, j])) for i in range(9) for j in range(i + 1, 9) if phi[i, j]], "i string, j string, phi double")
    w = phi / np.maximum(phi.sum(axis=1, keepdims=True), 1e-300)
    thetas = {f"a{k}": np.where(r.random(9) < 0.5, r.random(9), 0) for k in range(5)} | {"lone": np.eye(9)[8]}
    thetas = {a: x / x.sum() for a, x in thetas.items()}
    starts = spark.createDataFrame([(a, n, float(v)) for a, x in thetas.items() for n, v in zip(names, x, strict=True) if v], "start string, topic string, theta double")
    for tolerance, rounds in ((1e-6, 100), (1e-2, 100), (1e-9, 3)):
        got = {(x["start"], x["topic"]): x["f"] for x in network.diffusion(starts, network.row_normalised(edges), 0.85, tolerance, rounds).collect()}
        for a, theta in thetas.items():
            assert [got.get((a, n), 0.0) for n in names] == pytest.approx(kernels.diffuse(w, theta, 0.85, rounds, tolerance), abs=1e-9)
    shares = starts.withColumnRenamed("start", "actor")
    rows = {x["actor"]: x for x in network.diffused_interests(shares, edges).collect()}
    assert set(rows) == {a for a, x in thetas.items() if (x > 0).sum() > 1} and len(rows) > 2
    alone = [kernels.diffuse(w, np.eye(9)[k], 0.85, 100, 1e-6) for k in range(9)]
    for a, x in rows.items():
        theta, f = thetas[a], kernels.diffuse(w, thetas[a], 0.85, 100, 1e-6)
        kl, js = kernels.divergence(theta, f)
        base = sum(theta[k] * -np.log(alone[k][k] + 1e-12) for k in range(9))
        assert (x["kl"], x["js"], x["kl_excess"], x["form"]) == pytest.approx((kl, js, kl - base, f @ w @ f), abs=1e-6)


def test_swap_chains_keep_margins_and_count_swaps(spark):
    r = np.random.default_rng(5)
    groups = {"u": np.argwhere(r.random((8, 12)) < 0.4), "v": np.argwhere(r.random((5, 6)) < 0.8), "full": np.argwhere(np.ones((3, 4)))}
    rows = [(g, f"a{a}", f"t{t}", "odd" if a % 2 else "even") for g, e in groups.items() for a, t in e.tolist()]
    sup = spark.createDataFrame(rows, "g string, actor string, topic string, region string")
    got = models.swap_chains(sup, ["g"], 20, chains=3, burn=3, thin=2, label="region").toPandas()
    for g, e in groups.items():
        mine = got[got.g == g]
        assert sorted(mine["draw"].unique()) == list(range(20)) and set(mine["labels"]) == {"even-even", "even-odd"} | ({"odd-odd"} if g != "full" else set())
        n = len(set(e[:, 0]))
        assert (mine.groupby("draw")["pairs"].sum() == n * (n - 1) // 2).all()
        assert ((mine["accepted"] >= 2 * len(e)) if g != "full" else (mine["accepted"] == 0) & (mine["jaccard"] == 1)).all()
    for edges, accepted in kernels.swap_walk(groups["u"], 1, 3, 2, 4):
        assert accepted >= 2 * len(edges)
        for side in (0, 1):
            assert sorted(edges[:, side]) == sorted(groups["u"][:, side])


def test_folded_permutations_equal_a_loop(spark):
    r = np.random.default_rng(7)
    rows = [(f"p{k:02}", int(k % 3 == 0), int(r.integers(2)), int(r.integers(2))) for k in range(31)]
    got = {x["attribute"]: x for x in resample.folded_permutations(spark.createDataFrame(rows, "pair string, chosen int, a int, b int"), "pair", "chosen", ["a", "b"], 150, seed=3).collect()}
    chosen = np.array([x[1] for x in rows], dtype=bool)
    gap = lambda v: v[chosen].mean() - v[~chosen].mean()
    for name, column in (("a", 2), ("b", 3)):
        values = np.array([x[column] for x in rows], dtype=float)
        drawn = [gap(values[sorted(range(31), key=lambda k: hashlib.md5(f"3:{d}:{rows[k][0]}".encode()).hexdigest())]) for d in range(1, 151)]
        p = (sum(abs(round(x, 9)) >= abs(round(gap(values), 9)) for x in drawn) + 1) / 151
        assert (got[name]["observed"], got[name]["null_mean"], got[name]["p"], got[name]["draws"]) == (pytest.approx(gap(values)), pytest.approx(np.mean(drawn)), pytest.approx(p), 150)
    none = spark.createDataFrame([("p", 1, 0)], "pair string, chosen int, a int")
    assert resample.folded_permutations(none, "pair", "chosen", ["a"], 5).count() == 0
