"""The sequential model: fits that find what data were drawn from, batches equal to single fits, simulated levels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwork.operators import dynamics


def test_batched_logits_find_the_truth_and_equal_single_fits(spark):
    r = np.random.default_rng(1)
    truth = {1: [0.3, 1.5, -2.0], 2: [-0.5, 0.0, 1.0]}
    frames = []
    for key, beta in truth.items():
        x = np.c_[np.ones(6000), r.normal(size=(6000, 2))]
        base = r.normal(size=6000)
        y = r.random(6000) < 1 / (1 + np.exp(-(x @ beta + base)))
        frames.append(pd.DataFrame({"k": key, "y": y.astype(int), "one": 1.0, "a": x[:, 1], "b": x[:, 2], "base": base}))
    rows = spark.createDataFrame(pd.concat(frames))
    found = dynamics.batched_logits(rows, ["k"], "y", ["one", "a", "b"], F.col("base"))
    for key, beta in truth.items():
        fitted, info = found[key,]
        assert np.all(np.abs(fitted - beta) < 4 * np.sqrt(np.diag(np.linalg.inv(info))))
        alone, _ = dynamics.batched_logits(rows.filter(F.col("k") == key), ["k"], "y", ["one", "a", "b"], F.col("base"))[key,]
        assert np.allclose(alone, fitted, atol=1e-9)


def test_batched_allocations_find_the_truth(spark):
    r = np.random.default_rng(2)
    truth = {"u": [1.0, -0.5], "v": [0.0, 2.0]}
    frames = []
    for key, beta in truth.items():
        for g in range(150):
            n = r.integers(1, 9)
            x, base = r.normal(size=(n, 2)), r.normal(size=n)
            w = np.exp(x @ beta + base)
            frames.append(pd.DataFrame({"k": key, "g": g, "x": r.multinomial(40, w / w.sum()), "a": x[:, 0], "b": x[:, 1], "base": base}))
    rows = pd.concat(frames)
    found = dynamics.batched_allocations(spark.createDataFrame(rows), ["k"], ["g"], "x", ["a", "b"], F.col("base"))
    for key, beta in truth.items():
        fitted, info = found[key,]
        assert np.all(np.abs(fitted - beta) < 4 * np.sqrt(np.diag(np.linalg.inv(info))))
        gradient = np.zeros(2)
        for _, g in rows[rows.k == key].groupby("g"):
            f = g[["a", "b"]].to_numpy()
            w = np.exp(f @ fitted + g["base"])
            gradient += f.T @ (g["x"] - g["x"].sum() * w / w.sum()).to_numpy()
        assert np.allclose(gradient, 0, atol=1e-6)


def small_archive(spark):
    """Twelve actors over sixteen topics and five periods; a few topics each, most of them kept."""
    r = np.random.default_rng(4)
    rows = []
    for a in range(12):
        held = set(r.choice(16, 4, replace=False).tolist())
        for t in range(5):
            held = {k for k in held if r.random() < 0.7} | {int(k) for k in np.flatnonzero(r.random(16) < 0.12)} or {a}
            rows += [(t, f"a{a:02}", f"t{k:02}", int(r.integers(1, 9))) for k in sorted(held)]
    cells = spark.createDataFrame(rows, "period int, actor string, topic string, x long")
    near = [(f"t{i:02}", f"t{j:02}", 1 / (1 + j - i)) for i in range(16) for j in range(i + 1, 16) if j - i < 5]
    return cells, spark.createDataFrame(near, "i string, j string, phi double")


def test_calibrated_levels_meet_the_observed_ones(spark):
    cells, near = small_archive(spark)
    rows = dynamics.transition_rows(cells, near)
    assert rows.filter("held = 1 and share <= 0").count() == 0 and rows.groupBy("actor", "period").agg(F.sum("share").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    coefficients, base, shifts = dynamics.calibrated(cells, near, rows, simulations=6)
    goal = rows.agg(F.sum(F.col("held") * F.col("now")), F.sum((1 - F.col("held")) * F.col("now"))).first()
    paths = dynamics.simulated(cells, near, base, coefficients, [shifts], 12, seed=9)
    runs = np.array(paths.groupBy("simulation").agg(F.sum("held"), F.sum(1 - F.col("held"))).collect(), dtype=float)[:, 1:]
    assert np.all(np.abs(runs.mean(axis=0) - goal) < 3 * runs.std(axis=0) / np.sqrt(12) + 0.06 * np.array(goal))
    mass = paths.groupBy("simulation", "period", "actor").agg(F.sum("x").alias("x")).join(cells.groupBy("period", "actor").agg(F.sum("x").alias("want")), ["period", "actor"])
    assert mass.filter("x <> want").count() == 0 and mass.count() == 12 * 4 * 12


def test_thinned_refits_equal_single_ones(spark):
    r = np.random.default_rng(6)
    facts = spark.createDataFrame([(k, int(k % 4), f"a{r.integers(9)}", f"t{r.integers(12)}") for k in range(1500)], "doc long, period int, actor string, topic string")
    cubes = dynamics.thinned_cubes(facts, "doc", ["period", "actor", "topic"], (40, 80), 2, seed=3)
    n = {(x["share"], x["replicate"]): x["n"] for x in cubes.groupBy("share", "replicate").agg(F.sum("x").alias("n")).collect()}
    assert set(n) == {(40, 1), (40, 2), (80, 1), (80, 2)} and all(abs(v / 1500 - s / 100) < 0.05 for (s, _), v in n.items())
    _, near = small_archive(spark)
    keys = ["share_", "replicate"]
    cells = cubes.withColumnRenamed("share", "share_")
    both = {tuple(x)[:4]: x["coefficient"] for x in dynamics.sequential_model(dynamics.transition_rows(cells, near, keys), keys).collect()}
    one = cells.filter("share_ = 40 and replicate = 2").drop(*keys)
    for x in dynamics.sequential_model(dynamics.transition_rows(one, near)).collect():
        assert both[40, 2, x["stage"], x["term"]] == pytest.approx(x["coefficient"], abs=1e-6)
