"""Near-duplicates against all pairs."""

import numpy as np
import pytest

from loomwork.llm import near_dedup
from loomwork.llm.components import connected_components
from loomwork.llm.near_dedup import band_rows, least_matches, near_duplicates, words_of


def brute(rows, size, percent):
    """(id, set size, least known id of the component, kept) of every row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words_of(text or "")
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                least[root(i)] = root(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(root(i), []).extend([k] if k is not None else [])
    comp = [min(ids[root(i)], default=None) for i in range(len(rows))]
    return sorted(((rows[i][0], len(sets[i]), comp[i], rows[i][0] is not None and rows[i][0] == comp[i]) for i in range(len(rows))), key=str)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    words = np.array([f"v{k}" for k in range(3000)])
    base = r.choice(words, 240)
    out, i = [], 0
    for _ in range(90):  # copies of one text, some near enough to it, some only to each other
        w = base.copy()
        at = r.choice(240, r.integers(1, 22), replace=False)
        w[at] = r.choice(words, len(at))
        out.append((i := i + 1, " ".join(w)))
    for _ in range(30):  # a chain
        base = base.copy()
        base[r.choice(240, 4)] = r.choice(words, 4)
        out.append((i := i + 1, " ".join(base)))
    passage = " ".join(r.choice(words, 60))
    out += [(200 + k, passage + " " + " ".join(r.choice(words, 150))) for k in range(25)]
    out += [(300 + k, "The SAME text for all of them") for k in range(40)]
    out += [(400, None), (401, ""), (402, " \\t"), (403, "one"), (404, "ONE"), (405, "one two"), (406, "Two one")]
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, rows, size, percent):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, bucket int").repartition(3)
    got = near_duplicates(df, size, percent)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()), key=str) == brute(rows, size, percent)


def test_null_and_repeated_ids_take_part(spark, rows):
    """Near copies without an id are linked; an id that stands for several texts is several rows."""
    odd = [(None if i % 3 == 0 else i // 2, t) for i, t in rows]
    odd += [(2, "q r s t u v"), (2, "entirely other words stand here now"), (3, "entirely other words stand here now")]
    got = near_duplicates(spark.createDataFrame(odd, "doc_id long, text string").repartition(3), 3, 85)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()), key=str) == brute(odd, 3, 85)


def test_one_large_group(spark, monkeypatch):
    """A group in which copies are near to a few others only, cut into many tiles."""
    monkeypatch.setattr(near_dedup, "TILE", 40)
    r = np.random.default_rng(7)
    words = np.array([f"v{k}" for k in range(5000)])
    base, rows = r.choice(words, 200), []
    for k in range(400):
        w = base.copy()
        at = r.choice(200, r.integers(3, 14), replace=False)
        w[at] = r.choice(words, len(at))
        rows.append((k, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85)
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in got.collect()), key=str) == brute(rows, 3, 85)


def test_cell_links_join_what_all_pairs_join():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    sets = []
    for _ in range(150):
        s = base.copy()
        at = r.choice(300, r.integers(0, 60), replace=False)
        s[at] = r.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    signs = np.stack([near_dedup.signature(s) for s in sets])
    comps = np.arange(150)
    comps[:20] = 0
    edges = near_dedup.cell_links(comps, np.zeros(150, dtype=np.int64), signs, sets, 85)

    def labels(pairs):
        label = comps.copy()
        for i, j in pairs:
            label[label == label[j]] = label[i]
        return {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())}

    near = [(i, j) for i in range(150) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert labels(edges) == labels(near)
    assert all((i, j) in near or (j, i) in near for i, j in edges)
    assert len(edges) < 150


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (7, "a b c d e f g"), (None, "x y z"), (None, "x y z"), (9, None), (9, None), (2, "q r"), (2, "entirely other"), (3, "entirely other")]
    got = near_dedup.keep_one(spark.createDataFrame([(i, t, "s", "k") for i, t in rows], "doc_id long, text string, source string, key string"))
    assert got.columns == ["doc_id", "text", "source", "key"]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect() if r["text"]) == [(0, "x y z"), (2, "entirely other"), (2, "q r"), (5, "a b c d e f g")]
    assert got.filter("doc_id = 9").count() == 2


def test_very_long_text(spark):
    long = " ".join(f"w{k % 7001} {k}" for k in range(60_000))
    got = near_duplicates(spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (8, 8), (3, 2), (2, 1), (20, 9), (20, 9)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8), (20, 8)]


def test_bounds():
    assert band_rows(0.85) == 5 and band_rows(0.8) == 4
    assert all(0.2 * n < m < 0.85 * n for n, m in least_matches(0.85))
