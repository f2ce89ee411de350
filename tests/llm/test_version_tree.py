"""Reassembly of a log against a literal replay."""

import random

import pytest

from loomwork.llm import version_tree
from loomwork.llm.version_tree import epoch_digests, reassemble

SCHEMA = "id long, stream string, kind string, key long, value long"


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small tables in several parts, so that streams, transactions and keys go on in the next one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def replay(records, every):
    """Records in log order, one after the other, with an undo list for each stream."""
    open_, store, out, commits = {}, {}, [], 0

    def end(epoch):
        out.append(("state", epoch, len(store), sum(store.values())))

    for i, stream, kind, key, value in records:
        held = open_.setdefault(stream, [])
        if kind == "change":
            held.append((i, key, value))
        elif kind == "savepoint":
            held.append(None)
        elif kind == "rollback":
            while held and (top := held.pop()) is not None:
                out.append(("rollback", top[0], i, top[1]))
        else:
            for change in filter(None, held):
                if kind == "abort":
                    out.append(("abort", change[0], i, change[1]))
                elif change[2] is None:
                    store.pop(change[1], None)
                else:
                    store[change[1]] = change[2]
            open_[stream] = []
            commits += kind == "commit"
            if kind == "commit" and commits % every == 0:
                end(commits // every)
    out += [("abort", c[0], None, c[1]) for held in open_.values() for c in filter(None, held)]
    if commits % every:
        end(commits // every + 1)
    return sorted(out, key=str)


def rebuilt(spark, records, every=4):
    log = spark.createDataFrame(random.sample(records, len(records)), SCHEMA).repartition(5)
    found = reassemble(log)
    rows = [("state", *r) for r in epoch_digests(found, every).collect()]
    return sorted(rows + [tuple(r) for r in found.undone.select("kind", "id", "undoer", "key").collect()], key=str)


def made_up(seed, n, streams, weights, keys=5):
    r = random.Random(seed)
    kinds = ["commit", "abort", "savepoint", "rollback", "change"]
    rows = [(7 * k + 3, r.choice(streams), r.choices(kinds, weights)[0], r.choice([*range(keys), None]), r.choice([None, *range(9)])) for k in range(n)]
    return [row if row[2] == "change" else (*row[:3], None, None) for row in rows]


@pytest.mark.parametrize(
    ("seed", "n", "streams", "weights"),
    [
        (1, 600, ["a", "b", None, ""], (2, 1, 2, 2, 16)),
        (2, 600, ["a"], (1, 1, 40, 40, 40)),  # long transactions, deep savepoints
        (3, 400, ["a", "b"], (0, 0, 10, 30, 40)),  # never ended, more rollbacks than savepoints
        (4, 300, ["a", None], (30, 5, 1, 1, 10)),  # empty commits
    ],
)
def test_equals_a_replay(spark, seed, n, streams, weights):
    records = made_up(seed, n, streams, weights)
    assert rebuilt(spark, records) == replay(records, 4)


def test_savepoints_one_by_one(spark):
    names = {"s": "savepoint", "r": "rollback", "C": "commit", "A": "abort"}
    records = [(k, "x", names.get(c, "change"), None if c in names else k, 1) for k, c in enumerate("1s2s3rr4r5s6C7s8rC9")]
    found = reassemble(spark.createDataFrame(records, SCHEMA))
    assert sorted(r["id"] for r in found.applied.collect()) == [9, 11, 13]
    assert sorted((r["id"], r["kind"], r["undoer"]) for r in found.undone.collect()) == [(0, "rollback", 8), (2, "rollback", 6), (4, "rollback", 5), (7, "rollback", 8), (15, "rollback", 16), (18, "abort", None)]


def test_ids_that_are_null_or_repeated_and_no_records(spark):
    assert rebuilt(spark, [(1, "x", "change", 1, None)])[0][:2] == ("abort", 1)
    empty = reassemble(spark.createDataFrame([], SCHEMA))
    assert empty.undone.count() == 0 and epoch_digests(empty, 4).count() == 0
    records = [(1, "x", "change", 1, 5), (1, "x", "change", 1, 7), (2, "x", "commit", None, None), (None, "x", "change", 1, 9), (2, "x", "commit", None, None)]
    found = reassemble(spark.createDataFrame(records, SCHEMA))
    assert [tuple(r) for r in epoch_digests(found, 4).collect()] == [(1, 1, 7)]


def test_query_equals_its_sql_where_streams_span_parts(spark, tmp_path):
    import duckdb

    r = random.Random(5)
    texts = [None, "", "a b", "é ü", "x" * 5000]
    rows = [(3 * k + 1, r.choice(texts), r.choice(["hot", "hot", None, "cold"])) for k in range(700)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, source string").toPandas().to_parquet(tmp_path / "in/documents.parquet")
    spark.createDataFrame([(k, 0, k % 2) for k in range(1, 700, 5)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").toPandas().to_parquet(tmp_path / "in/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/in/{name}.parquet'")
    got = [tuple(x) for x in version_tree.op12_version_tree(spark, str(tmp_path / "in")).collect()]
    assert sorted(got, key=str) == sorted(con.execute(version_tree.ORACLE).fetchall(), key=str)
