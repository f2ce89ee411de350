"""Hand fixtures for the core operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import kernels
from loomwork.operators import clean, cube, panel, space, stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_specialization_of_three_actors(spark):
    counts = [[4, 0, 0], [0, 4, 0], [2, 2, 4]]
    rows = [(f"a{i}", f"t{j}", x) for i, line in enumerate(counts) for j, x in enumerate(line)]
    got = {(r["actor"], r["topic"]): r for r in space.specialization(frame(spark, rows, "actor string, topic string, x long")).collect()}
    assert got["a0", "t0"]["rca"] == pytest.approx(4 / 4 / (6 / 16))
    assert got["a2", "t0"]["rca"] == pytest.approx(2 / 8 / (6 / 16))
    assert {k for k, r in got.items() if r["active"]} == {("a0", "t0"), ("a1", "t1"), ("a2", "t2")}


def test_proximity_and_shortest_path(spark):
    sup = frame(spark, [(a, t) for a, ts in (("A", "12"), ("B", "12"), ("C", "23")) for t in ts], "actor string, topic string")
    edges = space.similarity(sup)
    assert {(r["i"], r["j"]): round(r["phi"], 4) for r in edges.collect()} == {("1", "2"): 0.6667, ("2", "3"): 0.3333}
    nodes = frame(spark, [("1",), ("2",), ("3",), ("4",)], "node string")
    got = {(r["i"], r["j"]): r["distance"] for r in space.shortest_paths(edges, nodes, -F.log("phi"), rounds=2).collect()}
    assert got["1", "3"] == pytest.approx(-np.log(2 / 3) - np.log(1 / 3))
    assert got["1", "4"] == pytest.approx(1.25 * got["1", "3"])


def test_spells(spark):
    active = frame(spark, [("a", "t", 0), ("a", "t", 2), ("b", "t", 4)], "actor string, topic string, step int")
    got = sorted(tuple(r) for r in panel.spells(active, 4, 1).select("actor", "start", "duration", "event").collect())
    assert got == [("a", 0, 4, 1), ("a", 2, 2, 1), ("b", 4, 1, 0)]


def test_kaplan_meier(spark):
    rows = frame(spark, [(1, 1), (2, 1), (2, 1), (3, 0)], "duration int, event int")
    assert [(r["t"], round(r["survival"], 6)) for r in panel.kaplan_meier(rows).orderBy("t").collect()] == [(1, 0.75), (2, 0.25), (3, 0.25)]


def test_cells(spark):
    cells = frame(spark, [(" A , ,B ", "x"), ("nan", "ALL\tother"), (None, " envirom x \tALL"), ("NATION_0", "")], "a string, t string")
    got = [tuple(r) for r in cells.select(clean.split_cell(F.col("a"), ","), clean.clean_cell(F.col("t"))).collect()]
    assert got == [(["A", "B"], "x"), ([], None), ([], "environ x"), (["NATION_0"], None)]


def test_periods():
    assert cube.rolling_periods(2000, 2004, 3) == [(2000, 2002), (2001, 2003), (2002, 2004)]
    assert cube.rolling_periods(2000, 2004, 3, skip_first=True) == [(2001, 2003), (2002, 2004)]
    assert cube.block_periods(2000, 2004, 3) == [(2000, 2002), (2003, 2004)]


def test_gini(spark):
    got = stats.gini(frame(spark, [("g", 1.0), ("g", 3.0), ("g", 0.0), ("h", 2.0)], "k string, x double"), "x", ["k"]).collect()
    assert {r["k"]: r["gini"] for r in got} == {"g": pytest.approx(0.25), "h": None}


def test_empty_cube(spark):
    empty = frame(spark, [], "actor string, topic string, x long")
    assert space.specialization(empty).count() == 0 and space.similarity(space.support(empty)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=4, max_size=25, unique=True), st.integers(0, 99))
def test_swaps_keep_margins(pairs, seed):
    pairs = np.array(pairs)
    for edges in kernels.swap_null(pairs, seed, 2, 1, 2):
        assert len({tuple(e) for e in edges.tolist()}) == len(pairs)
        for side in (0, 1):
            assert sorted(edges[:, side]) == sorted(pairs[:, side])


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 6), st.data())
def test_choice_sums(n, data):
    from itertools import combinations

    m = data.draw(st.integers(1, n))
    r = np.random.default_rng(n * 10 + m)
    x, beta = r.normal(size=(n, 2)), r.normal(size=2)
    terms = [(np.exp(x[list(c)].sum(axis=0) @ beta), x[list(c)].sum(axis=0)) for c in combinations(range(n), m)]
    total = sum(w for w, _ in terms)
    mean = sum(w * v for w, v in terms) / total
    second = sum(w * np.outer(v, v) for w, v in terms) / total - np.outer(mean, mean)
    value, gradient, hessian = kernels.choice_moments(x, m, beta)
    assert value == pytest.approx(np.log(total)) and np.allclose(gradient, mean) and np.allclose(hessian, second)


def test_spanning_tree_and_centrality():
    e = [("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.1)]
    assert [(i, j) for i, j, _ in kernels.maximum_spanning_tree(e)] == [("a", "b"), ("b", "c")]
    c = kernels.centralities(kernels.matrix(["a", "b", "c"], e))
    assert c["betweenness"].tolist() == [0.0, 1.0, 0.0]
    assert len(set(kernels.communities(np.kron(np.eye(2), np.ones((3, 3)) - np.eye(3))))) == 2


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
