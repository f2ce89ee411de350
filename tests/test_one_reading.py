"""Facts are read once in a query and lie in tasks of a bounded size."""

import __spark_entry__ as e
from loomwork.operators import clean
from loomwork.plans import facts, queries_space, registry

SF = "/root/testdata/sf0.001"


def test_a_query_reads_its_facts_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(queries_space, "activity", lambda *a: calls.append(a) or facts.activity(*a))
    for name in ("i54_block_spaces", "i22_region_shares", "i22_region_shares"):
        before = len(calls)
        assert e.queries()[name](spark, SF).count() and len(calls) == before + 1
    assert registry._WRITTEN.get() is None


def test_a_query_within_a_query_shares_its_facts(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(queries_space, "activity", lambda *a: calls.append(a) or facts.activity(*a))
    for name in ("j10_class_pairs", "j10b_class_pairs_matched"):
        before = len(calls)
        e.queries()[name](spark, SF)
        assert len(calls) == before + 1
    assert registry._WRITTEN.get() is None


def test_pairs_of_a_cell_are_not_grouped(spark):
    rows = [(1, 2000, ["A", "B", "A"], ["x", "y", "x"]), (2, 2000, [], ["x"]), (3, 2001, ["A"], None)]
    df = spark.createDataFrame(rows, "doc long, year int, a array<string>, t array<string>")
    got, want = (clean.explode_activity(df, "doc", df.a, df.t, ["year"], once=once).collect() for once in (True, False))
    assert sorted(got) == sorted(want) and len(got) == 4
    plan = e.queries()["c01_split_clean_explode"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_tasks_grow_in_number_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(facts, "TASK_LINES", 500)
    rows = facts.activity(spark, SF)
    assert rows.rdd.getNumPartitions() == 1 + facts.table(spark, SF, "lineitem").count() // 500


def test_documents_are_counted_with_their_first_fact(spark):
    rows = facts.activity(spark, SF).collect()
    got = {r["year"]: r for r in e.queries()["i57_coverage"](spark, SF).collect()}
    for year in {r["year"] for r in rows}:
        here = [r for r in rows if r["year"] == year]
        assert tuple(got[year])[1:] == (*(len({r[c] for r in here}) for c in ("doc", "actor", "topic")), len(here))
