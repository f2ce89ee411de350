"""Whitening and nearest neighbours against plain numpy."""

import numpy as np
import pytest

from loomwork.llm import nearest, whitening


def plain_whitening(vectors, components=16):
    """Row index, component -> whitened; with n, deviations and explained shares."""
    ok = [k for k, v in enumerate(vectors) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([vectors[k] for k in ok], dtype=float)).astype(int) + 1000000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    good = e > 1e-12 * e[0]
    z = (x - s / n) @ (u / np.sqrt(np.where(good, e, 1)))
    return ok, n, ((n * x - s) ** 2).sum(axis=1), z[:, good], e[good] / np.trace(c.T @ c / n)


def embedded(spark, vectors):
    return spark.createDataFrame([(k, [k], v) for k, v in enumerate(vectors)], "vec_id long, x array<int>, embedding array<float>")


def same_up_to_sign(got, want, atol):
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, atol=atol)


@pytest.mark.parametrize(("d", "rows"), [(64, 400), (7, 90), (64, 12)])
def test_whitening_equals_numpy(spark, d, rows):
    r = np.random.default_rng(d + rows)
    vectors = np.float32(r.normal(size=(rows, d)) * np.linspace(1, 3, d)).tolist()
    vectors += [vectors[0]] * 300 + [None, [], [float("nan")] + [0.0] * (d - 1), [None] + [1.0] * (d - 1), [float("inf")] * d]
    ok, n, deviation, z, explained = plain_whitening(vectors)
    got = {(x["vec_id"], x["component"]): x for x in whitening.whiten(embedded(spark, vectors)).collect()}
    k = z.shape[1]
    assert set(got) == {(i, c + 1) for i in ok for c in range(k)}
    assert all(x["n"] == n and x["identity_error"] < 1e-9 for x in got.values())
    assert [got[i, 1]["deviation"] for i in ok] == deviation.tolist()
    assert np.allclose([got[ok[0], c + 1]["explained"] for c in range(k)], explained, rtol=1e-9)
    same_up_to_sign(np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i in ok]), z, 1e-7)


def test_lanczos_survives_equal_and_missing_eigenvalues():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.normal(size=(200, 200)))[0]
    for spectrum in (np.r_[np.full(30, 5.0), np.linspace(1, 0, 170)], np.r_[np.linspace(9, 8, 12), np.zeros(188)], np.linspace(1, 2, 200)):
        a = q @ np.diag(spectrum) @ q.T
        passes = []
        values, vectors = whitening.block_lanczos(lambda x, a=a, passes=passes: passes.append(x.shape[1]) or a @ x, 200, 16, 8)
        assert np.allclose(values, np.sort(spectrum)[::-1][:16], atol=1e-10)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-10)
        assert sum(passes) <= 200


def test_lanczos_stops_by_residual():
    a = np.diag(np.r_[2.0 ** -np.arange(16), np.full(984, 1e-9)])
    passes = []
    values, _ = whitening.block_lanczos(lambda x: passes.append(x.shape[1]) or a @ x, 1000, 16)
    assert np.allclose(values, np.diag(a)[:16], atol=1e-12) and sum(passes) < 200


def test_whitening_of_nothing_and_of_great_entries(spark):
    assert whitening.whiten(embedded(spark, [])).count() == 0
    assert whitening.whiten(embedded(spark, [[1.0, 2.0]] * 5)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (None, [0.0, 2.0]), (4, [1.0])], "vec_id long, embedding array<double>")).collect()
    assert {x["vec_id"] for x in got} == {1, 2, None} and all(x["deviation"] is None for x in got if x["vec_id"] == 1)


def all_nearest(vectors, queries, k=5):
    """Query id -> its k nearest ids and cosines, by comparing everything."""
    ok = {i: np.array(v, dtype=float) for i, v in vectors if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for i in queries & set(ok):
        pairs = [(-float(v @ ok[i] / np.sqrt(v @ v) / np.sqrt(ok[i] @ ok[i])), j) for j, v in ok.items() if j != i]
        out[i] = [(j, -s) for s, j in sorted((round(s, 12), j) for s, j in pairs)[:k]]
    return out


def searched(spark, vectors, queries, **more):
    df = spark.createDataFrame([(i, 0, v) for i, v in vectors], "vec_id long, query int, embedding array<double>")
    out = {}
    for r in sorted(nearest.nearest(df, df.filter(df.vec_id.isin(list(queries))), **more).collect()):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_small_tables_are_searched_whole(spark):
    r = np.random.default_rng(1)
    vectors = [(k, r.normal(size=20).tolist()) for k in range(300)]
    vectors += [(1000 - k, vectors[7][1]) for k in range(400)]  # a group of copies, some of them queries
    vectors += [(2000, None), (2001, [0.0] * 20), (2002, [float("nan")] * 20), (2003, [None] * 20), (None, vectors[7][1]), (2004, [1.0]), (2005, []), (2006, [2.0 * c for c in vectors[9][1]])]
    queries = {0, 7, 9, 250, 601, 900, 2000, 2001, 2006}
    got, want = searched(spark, vectors, queries), all_nearest([v for v in vectors if v[1] is None or len(v[1]) == 20], queries)
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    assert all(np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=1e-11) for i in want)


def test_lists_in_parts_and_recall(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 48)) * 1.5
    vectors = [(k, (centres[k % 12 if k % 3 else 0] + r.normal(size=48)).tolist()) for k in range(3000)]
    queries = set(range(0, 3000, 50))
    want = all_nearest(vectors, queries)
    got = searched(spark, vectors, queries, list_rows=100, part=70, sample=1000)
    found = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert all(len(x) == 5 for x in got.values()) and set(got) == set(want) and found >= 0.9 * 5 * len(want)


def test_tests_give_up_early_and_lose_little():
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 96)) + 3 * r.normal(size=(20, 96))[r.integers(0, 20, 4000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, x = x[:50], x[50:]
    turn = np.linalg.qr(r.normal(size=(96, 96)))[0]
    whole = 2 - 2 * q @ x.T
    reach = np.sort(whole, axis=1)[:, 4]
    examined = []
    a, b, d = nearest.survivors(x @ turn, q @ turn, reach, 16, 3.0, examined)
    assert np.allclose(d, whole[a, b]) and len(a) >= 0.99 * 250
    assert sum(examined) < 0.5 * len(examined) * whole.size


def test_few_or_no_candidates(spark):
    assert searched(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], {0}) == {0: [(2, pytest.approx(0.5**0.5)), (1, 0.0)]}
    assert searched(spark, [(0, [1.0, 0.0])], {0}) == {} and searched(spark, [], {0}) == {} and searched(spark, [(0, [1.0])], {5}) == {}
    assert searched(spark, [(0, [1e300, 0.0]), (1, [1e-300, 0.0]), (2, [0.0, 3.0])], {0}) == {0: [(1, 1.0), (2, 0.0)]}
