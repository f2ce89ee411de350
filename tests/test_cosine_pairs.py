"""All pairs of vectors, in strips."""

import numpy as np

from loomwork.operators import pairs


def test_strips_and_blocks_lose_no_pair(spark):
    x = np.random.default_rng(5).normal(size=(61, 8)).round(3)
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block, strip in ((100, 7), (16, 5)):
        got = {(r["i"], r["j"]): r["cosine"] for r in pairs.cosine_pairs(df, "id", "v", block, strip).collect()}
        assert len(got) == 61 * 60 // 2 and all(abs(c - unit[i] @ unit[j]) < 1.1e-5 for (i, j), c in got.items())


def test_written_pairs_pack(spark, tmp_path):
    """The result is as large as the pairs are many: it may not take their plain bytes on disk."""
    x = np.random.default_rng(6).normal(size=(1500, 64))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, v array<double>")
    pairs.cosine_pairs(df, "id", "v", 800).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 1500 * 1499 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 4 * 1500 * 1499 // 2


def test_keys_null_shared_or_none(spark):
    v = lambda k: [1.0, float(k)]
    of = lambda keys, block: sorted((r["i"], r["j"]) for r in pairs.cosine_pairs(spark.createDataFrame([(k, v(n)) for n, k in enumerate(keys)], "id long, v array<double>"), "id", "v", block, 2).collect())
    keys = [4, None, 9, 4, -7, None, 4, 2**62 + 1, 2**62]
    want = sorted((a, b) for a in keys for b in keys if a is not None and b is not None and a < b)
    assert of(keys, 2) == of(keys, 100) == want
    assert of([5] * 7, 2) == of([None], 2) == of([], 2) == []
