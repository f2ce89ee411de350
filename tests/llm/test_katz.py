"""Katz scores against a plain implementation over dictionaries."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from loomwork.llm import katz
from loomwork.llm.katz import Discounts, pack, unpack


def plain(rows):
    """{row number: (held, n_tokens, n_known, base, score)} and the model."""
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in rows]
    texts = [[*(t or "").encode().lower().split(), b"</s>"] for _, t in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for h, w in zip(held, texts, strict=True):
        if not h:
            uni.update(w)
            for a, b in zip([b"<s>", *w], w, strict=False):
                bi[a, b] += 1
                ctx[a] += 1
    total, types = sum(uni.values()), len(uni)
    first = Discounts(np.array([sum(c == r for c in uni.values()) for r in range(1, 7)]))
    second = Discounts(np.array([sum(c == r for c in bi.values()) for r in range(1, 7)]))
    of = lambda d, c, half=False: float(d(np.array([c]), half)[0])
    p1 = {w: of(first, c) * c / total for w, c in uni.items()}
    left = 1 - sum(p1.values()) if total else 1.0
    followers = {}
    for (a, b), c in bi.items():
        followers.setdefault(a, []).append((b, c))
    half = {a: all(c > katz.K for _, c in f) for a, f in followers.items()}
    p2 = {(a, b): of(second, c, half[a]) * c / ctx[a] for (a, b), c in bi.items()}
    alpha = {a: (1 - sum(p2[a, b] for b, _ in f)) / (1 - sum(p1[b] for b, _ in f)) for a, f in followers.items()}
    out = []
    for h, w in zip(held, texts, strict=True):
        score = 0.0
        for a, b in zip([b"<s>", *w], w, strict=False):
            score += log10(p2[a, b] if (a, b) in p2 else alpha.get(a, 1.0) * p1.get(b, left))
        base = sum(log10((uni[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w)
        out.append((h, len(w), sum(x in uni for x in w), base, score))
    return out, total, (p1, left, p2, alpha, followers)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    words = [f"w{k}" for k in range(80)]
    p = 1 / np.arange(1, 81)
    out = [(i, " ".join(r.choice(words, r.integers(1, 60), p=p / p.sum()))) for i in range(300)]
    return [*out, (1000, None), (1001, ""), (1002, "  \t\n"), (1003, "Never SEEN words w1 w2"), (1003, "Never SEEN words w1 w2"), (None, "w1 w2"), (1004, "w1 w2 é")]


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_model(spark, rows, monkeypatch, small):
    if small:  # many blocks, parts and hot contexts
        monkeypatch.setattr(katz, "PART_WORDS", 60)
        monkeypatch.setattr(katz, "PART_PAIRS", 500)
        monkeypatch.setattr(katz, "HOT_SHARE", 20)
    want, total, _ = plain(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    got = katz.katz_scores(df, block_tokens=700 if small else 10**6).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    expect = sorted([(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=key)
    found = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got], key=key)
    assert {r["train_tokens"] for r in got} == {total}
    for e, f in zip(expect, found, strict=True):
        assert e[:4] == f[:4]
        assert f[4:] == pytest.approx(e[4:], abs=1e-8)


def test_model_sums_to_one(rows):
    _, _, (p1, left, p2, alpha, followers) = plain(rows)
    assert sum(p1.values()) + left == pytest.approx(1)
    for a, f in followers.items():
        seen = {b for b, _ in f}
        rest = sum(p for b, p in p1.items() if b not in seen) + left
        assert sum(p2[a, b] for b in seen) + alpha[a] * rest == pytest.approx(1)


def test_discounts():
    d = Discounts(np.array([100, 40, 20, 12, 8, 5]))
    assert (d.low > 0).all() and (d.low < 1).all() and d(np.array([9]))[0] == 1
    assert np.allclose(Discounts(np.array([3, 0, 1, 0, 0, 0])).low, [(r - 0.5) / r for r in range(1, 6)])
    assert Discounts(np.zeros(6)).half and Discounts(np.zeros(6))(np.array([8]))[0] == 7.5 / 8


@pytest.mark.parametrize("x", [[], [0], [5, 2**40], list(range(300))])
def test_packing(x):
    assert unpack(pack(np.array(x, dtype=np.int64))).tolist() == x


def test_empty_table_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.katz_scores(empty).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = katz.katz_scores(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)
