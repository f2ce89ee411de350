"""Queries that do the whole job, on tables where a cut would show."""

import numpy as np
import pytest

import __spark_entry__ as e


def duck(sql, folder):
    import duckdb

    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con.execute(sql).fetchall()


def both(spark, name, folder):
    """The rows of a query and of its SQL, in order."""
    rows = [tuple(r) for r in e.queries()[name](spark, str(folder)).collect()]
    return sorted(rows), sorted(duck(e.oracle_sql()[name], folder))


def test_every_pair_of_embeddings(spark, tmp_path):
    from loomwork.operators import pairs

    x = np.random.default_rng(1).normal(size=(70, 64))
    x[3] = 0
    spark.createDataFrame([(k * 3, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>").toPandas().to_parquet(tmp_path / "embeddings.parquet")
    got, want = both(spark, "i06_vector_cosine", tmp_path)
    assert len(got) == 70 * 69 // 2 and got == [pytest.approx(r, abs=1.1e-5) for r in want]
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [3.0, 0.0]), (5, [None, 1.0])], "id long, v array<double>")
    assert {(r["i"], r["j"]): r["cosine"] for r in pairs.cosine_pairs(odd, "id", "v", block=2).collect() if r["cosine"] is not None} == {(1, 4): 1.0}


def test_every_nation_is_clustered(spark, tmp_path):
    rows = [(k, k % 25, float((k * 37) % 900)) for k in range(200)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").toPandas().to_parquet(tmp_path / "customer.parquet")
    got, want = both(spark, "k10_merge_near", tmp_path)
    assert got == want and {r[0] for r in got} == set(range(25)) and sum(r[-1] for r in got) == 200


def test_draws_of_the_null_models(spark):
    sf = "/root/testdata/sf0.001"
    assert e.queries()["j11_swap_null"](spark, sf).count() == 400
    got = {r["basis"]: r for r in e.queries()["j13_null_summary"](spark, sf).collect()}
    assert set(got) == {"rpa", "presence"} and all(r["q05"] <= r["null_mean"] <= r["q95"] for r in got.values())


def test_swaps_are_accepted_ones():
    from loomwork.functions import kernels

    full = np.argwhere(np.ones((4, 5), dtype=bool))
    assert [sorted(map(tuple, x)) for x in kernels.swap_null(full, 1, draws=2)] == [sorted(map(tuple, full))] * 2
    ring = np.array([(k, k) for k in range(3)])
    odd = [sum(a > b for k, a in enumerate(p) for b in p[k + 1 :]) % 2 for p in (x[np.argsort(x[:, 0]), 1] for x in kernels.swap_null(ring, 1, 1, 1, 40))]
    assert odd == [0, 1] * 20, "three accepted swaps between draws turn an even order into an odd one"
