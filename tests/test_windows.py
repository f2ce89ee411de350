"""Names and labels, survival at every step, lookbacks, and paths of any length."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import clean, panel, space
from loomwork.plans import queries_windows


def test_letters_are_those_of_the_decomposition(spark):
    texts = ["Ångström", "naïve café", "ＦＵＬＬ width", "ﬁne", "ß and Ø and 日本", "x²", "Ｉ…", "", None, "é à", "Łódź"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(clean.ascii_letters(F.col("t"))).collect()]
    want = [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert got == want


def wrap(text, width, lines):
    out = []
    for w in text.split():
        if out and len(out[-1]) + 1 + len(w) <= width:
            out[-1] += " " + w
        else:
            out.append(w)
    if len(out) <= lines:
        return "\n".join(out)
    last = out[lines - 1]
    if len(last) >= width - 1:
        last = last[: max(1, width - 2)].rstrip()
    return "\n".join([*out[: lines - 1], last.rstrip(".") + "..."])


def test_labels_wrap(spark):
    r = np.random.default_rng(1)
    texts = [" ".join("x" * int(n) + ("." if n % 3 == 0 else "") for n in r.integers(1, 15, size=r.integers(0, 9))) for _ in range(80)] + ["", "   ", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for width, lines in ((10, 2), (14, 3), (3, 1)):
        for x in df.select("t", clean.wrapped(F.col("t"), width, lines).alias("w")).collect():
            assert x["w"] == wrap(x["t"], width, lines)


def test_survival_at_every_step(spark):
    rows = [("g", 2, 1), ("g", 2, 0), ("g", 5, 1), ("g", 5, 0), ("h", 1, 1)]
    curve = panel.kaplan_meier(spark.createDataFrame(rows, "k string, duration int, event int"), ["k"])
    got = {(r["k"], r["t"]): (r["at_risk"], r["events"], round(r["survival"], 6)) for r in panel.every_step(curve, ["k"]).collect()}
    assert got == {
        ("g", 0): (4, 0, 1.0), ("g", 1): (4, 0, 1.0), ("g", 2): (4, 1, 0.75), ("g", 3): (2, 0, 0.75), ("g", 4): (2, 0, 0.75), ("g", 5): (2, 1, 0.375),
        ("h", 0): (1, 0, 1.0), ("h", 1): (1, 1, 0.0),
    }


def test_lookbacks_equal_single_panels(spark):
    r = np.random.default_rng(5)
    sup = spark.createDataFrame([(int(p), f"a{a}", f"t{t}") for p in (1, 2, 4, 7) for a in range(5) for t in range(6) if r.random() < 0.4], "period int, actor string, topic string")
    edges = spark.createDataFrame([(f"t{i}", f"t{j}", float(r.random())) for i in range(6) for j in range(i + 1, 6) if r.random() < 0.6], "i string, j string, phi double")
    topics = spark.createDataFrame([(f"t{k}",) for k in range(6)], "topic string")
    columns = ["prev", "period", "actor", "topic", "adopted", "closeness", "prev_diversity", "popularity"]
    both = panel.lookback_panel(sup, edges, topics, 5, (1, 2, 3, 4))
    assert both.filter("lookback > 3").count() == 0
    for lag in (1, 2, 3):
        one = panel.adoption_panel(sup, edges, topics, 5, lag)
        assert sorted(map(tuple, both.filter(F.col("lookback") == lag).select(*columns).collect())) == sorted(map(tuple, one.select(*columns).collect()))


def test_paths_of_any_length(spark):
    edges = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}", 1.0) for k in range(40)] + [("x", "y", 1.0)], "i string, j string, w double")
    nodes = spark.createDataFrame([(f"n{k:02}",) for k in range(41)] + [("x",), ("y",)], "node string")
    got = {(r["i"], r["j"]): r["distance"] for r in space.shortest_paths(edges, nodes, F.col("w")).collect()}
    assert got["n00", "n40"] == 40 and got["n03", "n20"] == 17 and got["n00", "x"] == pytest.approx(50)
    empty = space.shortest_paths(edges.limit(0), nodes, F.col("w")).collect()
    assert len(empty) == 43 * 42 and all(r["distance"] is None for r in empty)


def test_modes_have_names(spark):
    with pytest.raises(ValueError, match="no distance mode"):
        queries_windows.edges_by_mode(None, "other")
