"""Files that are broken, empty, split or oddly headed; sinks and tables built once."""

import json

import pytest

from loomwork.sources import store

TOP = "junk one\n\n\"more, junk\"\n\n"


def test_wide_years_of_many_files_and_splits(spark, tmp_path):
    folder = tmp_path / "wide"
    folder.mkdir()
    want = set()
    for k in range(3):
        years = [1999 + k, 2001 + k, 2000 + k]
        lines = []
        for n in range(400):
            cells = [f"{n}.{k}" if (n + y) % 3 else ("" if n % 2 else "..") for y in years]
            want |= {(f"Land {n}, {k}", y, float(f"{n}.{k}")) for y in years if (n + y) % 3}
            lines.append(f'"Land {n}, {k}",L{n},{cells[0]},{cells[1]},"{cells[2]}"')
        (folder / f"f{k}.csv").write_text(TOP + ("﻿" if k == 0 else "") + "Country Name,Country Code," + ",".join(map(str, years)) + "\n" + "\n".join(lines) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    got = store.wide_years(spark, str(folder))
    assert {(r["Country Name"], r["year"], r["value"]) for r in got.collect()} == want and got.count() == len(want)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    last = {r["Country Name"]: (r["year"], r["value"]) for r in store.latest_year(got, ["Country Name"]).collect()}
    assert last == {name: max((y, v) for n, y, v in want if n == name) for name in {n for n, *_ in want}}
    (tmp_path / "bare.csv").write_text(TOP + "Country Name,Country Code\nx,X\n")
    with pytest.raises(ValueError, match="no year"):
        store.wide_years(spark, str(tmp_path / "bare.csv"))


def test_first_usable_passes_over_what_cannot_be_used(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "x int, y string")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 nothing")
    (tmp_path / "broken.json").write_text("{ not json")
    (tmp_path / "empty.csv").write_text("")
    rows.limit(0).write.parquet(str(tmp_path / "none.parquet"))
    rows.select("x").write.parquet(str(tmp_path / "narrow.parquet"))
    rows.write.parquet(str(tmp_path / "good.parquet"))
    bad = [str(tmp_path / n) for n in ("missing.parquet", "broken.parquet", "broken.json", "empty.csv", "none.parquet", "narrow.parquet")]
    assert [tuple(r) for r in store.first_usable(spark, [*bad, str(tmp_path / "good.parquet")], ["x", "y"]).collect()] == [(1, "a")]
    with pytest.raises(FileNotFoundError) as error:
        store.first_usable(spark, bad, ["x", "y"])
    assert all(n in str(error.value) for n in bad) and "no column y" in str(error.value) and "no rows" in str(error.value)


def test_graph_documents_there_and_back(spark, tmp_path):
    nodes = spark.createDataFrame([("Sea_Ice", 3.0, 0.5, 1.0), ("krill  fishing", 1.0, 2.0, -1.0), ("Whales", 2.0, None, 1.0), ("Seals", 2.0, 4.0, 0.0)], "id string, volume double, x double, y double")
    links = spark.createDataFrame([("Sea_Ice", "Whales", 0.25), ("Seals", "Whales", 1.0)], "source string, target string, value double")
    store.write_json_text(store.graph_document(nodes, links), str(tmp_path / "g"))
    back, ends = store.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, back.select("id", "volume", "x", "y").collect())) == sorted(map(tuple, nodes.collect())) and sorted(map(tuple, ends.collect())) == sorted(map(tuple, links.collect()))
    topics = spark.createDataFrame([("sea ice",), ("Krill Fishing",), ("seals",), ("whales",)], "topic string")
    placed = {r["topic"]: (r["x"], r["y"]) for r in store.saved_places(back, topics).collect()}
    assert set(placed) == {"sea ice", "Krill Fishing", "seals"}
    for k in (0, 1):
        values = [p[k] for p in placed.values()]
        assert sum(values) == pytest.approx(0) and sum(v * v for v in values) == pytest.approx(3)
    assert store.saved_places(back, topics, least_share=0.8) is None
    for name, text in (("broken", "{"), ("other", json.dumps({"nodes": "x", "links": 3})), ("nameless", json.dumps({"nodes": [{"x": 1}], "links": [{"source": "a"}]})), ("empty", "")):
        (tmp_path / f"{name}.json").write_text(text)
        both = store.read_graph(spark, str(tmp_path / f"{name}.json"))
        assert [df.count() for df in both] == [0, 0]


def test_sinks_and_tables_built_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b, c")], "x int, y string")
    store.write_csv(rows, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, store.read_any(spark, str(tmp_path / "t.csv")).collect())) == [(1, "a"), (2, "b, c")]
    assert json.loads(store.metadata(rows, {"window": 3}).first()[0]) == {"rows": 2, "columns": ["x", "y"], "window": 3}
    built = []

    def build():
        built.append(1)
        return rows.select("x") if len(built) == 1 else rows

    path = str(tmp_path / "once")
    for columns, times in (((), 1), (("x",), 1), (("x", "y"), 2), (("y",), 2)):
        assert store.built_once(spark, path, build, columns).count() == 2 and len(built) == times
    assert store.tagged("out/panel.csv", "year_3") == "out/panel_year_3.csv" and store.tagged("a.csv", None) == "a.csv"
    assert store.preferred_path("d", "p", "year", 5) == ["d/p_year_5.parquet", "d/p_5.parquet", "d/p.parquet"]


def test_matrix_of_expected_labels(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",1.0,3\n1,0.5,0.25\n3.0,,0.75\n9,1,1\n")
    got = {(r["row"], r["col"]): r["value"] for r in store.matrix_cells(spark, str(tmp_path / "m.csv"), [1, 2, 3]).collect()}
    assert got == {(r, c): {(1, 1): 0.5, (1, 3): 0.25, (3, 3): 0.75}.get((r, c), 0.0) for r in (1, 2, 3) for c in (1, 2, 3)}
