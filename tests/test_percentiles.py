"""Exact percentiles from places, and permutations where nothing is chosen."""

import numpy as np

from loomwork.operators import panel, resample, stats


def test_percentiles_equal_numpy(spark):
    r = np.random.default_rng(3)
    rows = [("abc"[int(r.integers(3))], float(r.integers(40)) / 4) for _ in range(500)] + [("d", 2.0), ("e", None), (None, 7.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    at = [0, 0.1, 0.5, 0.77, 1]
    got = {x["g"]: x["q"] for x in stats.exact_percentiles(df, "x", at, ["g"]).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([x for h, x in rows if h == g], at))
    assert np.allclose(stats.exact_percentiles(df, "x", at).first()["q"], np.quantile([x for _, x in rows if x is not None], at))


def test_no_task_holds_a_group_for_its_median(spark):
    plan = panel.quantile_edges(spark.range(100).selectExpr("cast(id as double) x"), "x", 4)
    assert "percentile" not in plan._jdf.queryExecution().toString().lower() and plan.first()["edges"] == [0.0, 24.75, 49.5, 74.25, 99.0]
    assert panel.quantile_edges(spark.range(0).selectExpr("cast(id as double) x"), "x", 4).first()["edges"] is None


def test_permutations_where_nothing_is_chosen(spark):
    none = spark.createDataFrame([("p", 0, 1), ("q", 0, 0)], "pair string, chosen int, a int")
    got = lambda df: [tuple(x) for x in resample.folded_permutations(df, "pair", "chosen", ["a"], 5, whole=True).collect()]
    assert got(none) == [("a", None, None, 1 / 6, 5)] and got(none.limit(0)) == [("a", None, None, 1.0, 0)]
