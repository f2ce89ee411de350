"""Reassembly of interleaved transactions from a log, by a tree of versions.

Every record is a version.  Its parent is the version that it was made from:
the record before it in its stream's transaction, or for a rollback the parent
of the savepoint that it returns to (none: the transaction's start).  What a
commit keeps are its ancestors; pointer doubling marks them.  A second pointer
of each record leads to the record after it, past every savepoint that is
rolled back later; doubled, it finds the rollback, abort or commit that decides
about a change.

Streams, transactions and keys may be as long as the log.  Orders are made by
range partitions: running sums and neighbours are taken inside each partition,
and what one hands to the next is a row for each partition (and stream).  No
step gathers a stream, a transaction or a key.

Records are ordered by id, equal ids by value (null first), further ties any
way.  Records without an id have no place in the log and are left out.  A null
stream is a stream, a null key a key.  An empty log gives empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm._shared import documents, materialise

BEFORE = Window.unboundedPreceding, -1


def part() -> Column:
    """The part of a row of ``in_order``."""
    return F.shiftright("place", 33)


def in_order(rows: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """``rows`` written in order, with ``place``, which rises with it; ``place`` >> 33 names the part."""
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), label)


def running_sums(rows: DataFrame, order: Sequence[str], sums: dict[str, str], label: str) -> DataFrame:
    """``rows`` with the sums, up to and with each row, of the columns named by ``sums``, under its keys."""
    own = Window.partitionBy("_part").orderBy("place")
    ordered = in_order(rows, order, label).withColumn("_part", part())
    parts = ordered.groupBy("_part").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    before = parts.select("_part", *[F.coalesce(F.sum(f"_{name}").over(Window.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0)).alias(f"_{name}") for name in sums])
    added = ordered.withColumns({name: F.sum(c).over(own) for name, c in sums.items()}).join(before, "_part")
    return added.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_part", "place", *[f"_{name}" for name in sums])


def neighbours(rows: DataFrame, keys: Sequence[str], at: str, take: Sequence[str], label: str, after: bool = False) -> DataFrame:
    """``rows`` with ``last``: the columns ``take`` of the row before it (and ``next``, of the row after) among rows of equal keys, in the order of ``at``."""
    own = Window.partitionBy("_part").orderBy("place")
    ordered = in_order(rows, [*keys, at], label).withColumns({"_part": part(), "_row": F.struct(F.struct(*keys).alias("k"), F.struct(*take).alias("t"))})
    ends = ordered.groupBy("_part").agg(F.min_by("_row", "place").alias("first"), F.max_by("_row", "place").alias("last"))
    parts = Window.orderBy("_part")
    ends = ends.select("_part", F.lag("last").over(parts).alias("_above"), F.lead("first").over(parts).alias("_below"))
    beside = ordered.withColumns({"_last": F.lag("_row").over(own), "_next": F.lead("_row").over(own)}).join(ends, "_part")
    same = lambda c: F.when(c["k"].eqNullSafe(F.col("_row.k")), c["t"])
    beside = beside.withColumn("last", same(F.coalesce("_last", "_above")))
    if after:
        beside = beside.withColumn("next", same(F.coalesce("_next", "_below")))
    return beside.drop("place", "_part", "_row", "_last", "_next", "_above", "_below")


def versions(log: DataFrame) -> DataFrame:
    """id, stream, kind, key, value, pos, parent, to, done of every record, written.

    ``to`` leads on from a record (null: the log ends); ``done`` if the record
    there decides about it.
    """
    ends = F.col("kind").isin("commit", "abort")
    rows = log.filter(F.col("id").isNotNull()).select("id", "stream", "kind", "key", "value")
    rows = in_order(rows, ["stream", "id", "value"], "log").withColumn("part", part())
    own = Window.partitionBy("part", "stream").orderBy("place")
    step = F.when(F.col("kind") == "savepoint", 1).when(F.col("kind") == "rollback", -1).otherwise(0)
    rows = rows.withColumns({"step": step, "ended": F.coalesce(F.sum(ends.cast("int")).over(own.rowsBetween(*BEFORE)), F.lit(0)), "before": F.lag("place").over(own), "fresh": F.lag(ends).over(own)})
    piece = Window.partitionBy("part", "stream", "ended").orderBy("place")
    rows = rows.withColumn("depth", F.sum("step").over(piece)).withColumn("least", F.least(F.lit(0), F.min("depth").over(piece)))
    # what a part hands to the next one of its stream: the walk since its last end, its ends and its last record
    last = rows.groupBy("part", "stream").agg(
        F.max_by(F.struct(ends.alias("fresh"), "depth", "least", "place"), "place").alias("z"), F.sum(ends.cast("int")).alias("ends")
    )
    walk = lambda c: F.when(F.col("z.fresh"), 0).otherwise(F.col(f"z.{c}"))
    by_stream = Window.partitionBy("stream").orderBy("part")
    last = last.withColumns({"rise": walk("depth"), "dip": walk("least"), "since": F.sum((F.col("ends") > 0).cast("int")).over(by_stream)})
    since = Window.partitionBy("stream", "since").orderBy("part")
    last = last.withColumn("upto", F.sum("rise").over(since)).withColumn("low", F.min(F.col("upto") - F.col("rise") + F.col("dip")).over(since))
    out = F.col("upto") - F.least(F.lit(0), F.col("low"))
    handed = last.select(
        "part", "stream", F.coalesce(F.lag(out).over(by_stream), F.lit(0)).alias("_depth"), F.coalesce(F.sum("ends").over(by_stream.rowsBetween(*BEFORE)), F.lit(0)).alias("_ended"),
        F.lag("z.place").over(by_stream).alias("_place"), F.lag("z.fresh").over(by_stream).alias("_fresh"),
    )
    rows = rows.join(handed.withColumnRenamed("stream", "_stream").withColumnRenamed("part", "_part"), (F.col("part") == F.col("_part")) & F.col("stream").eqNullSafe(F.col("_stream")))
    start = F.when(F.col("ended") == 0, F.col("_depth")).otherwise(0)
    floor = F.least(F.lit(0), start + F.col("least"))
    first = F.coalesce("fresh", "_fresh", F.lit(True))
    rows = rows.select(
        "id", "stream", "kind", "key", "value", F.col("place").alias("pos"), (F.col("_ended") + F.col("ended")).alias("transaction"), (start + F.col("depth") - floor).alias("depth"),
        F.coalesce(F.lag(floor).over(piece), F.lit(0)).alias("floor"), floor.alias("floor_now"), F.when(~first, F.coalesce("before", "_place")).alias("previous"),
    )
    # a rollback that finds no savepoint lets the floor sink; the others meet theirs at the same level, in turn
    level = F.when(F.col("kind") == "savepoint", F.col("depth")).when((F.col("kind") == "rollback") & (F.col("floor") == F.col("floor_now")), F.col("depth") + 1)
    rows = materialise(rows.withColumn("level", level).drop("depth", "floor", "floor_now"), "log-levels")
    marks = rows.filter("level is not null").select("stream", "transaction", "level", "pos", "kind", "previous")
    marks = neighbours(marks, ["stream", "transaction", "level"], "pos", ["kind", "pos", "previous"], "log-marks", after=True)
    met = marks.select("pos", F.when(F.col("kind") == "rollback", F.col("last.previous")).alias("returns"), F.when((F.col("kind") == "savepoint") & (F.col("next.kind") == "rollback"), F.col("next.pos")).alias("rolled"))
    rows = rows.join(met, "pos", "left").withColumn("parent", F.when(F.col("kind") == "rollback", F.col("returns")).otherwise(F.col("previous")))
    rows = materialise(rows, "log-parents")
    decides = F.col("kind").isin("rollback", "commit", "abort")
    leads = rows.filter("previous is not null").select(F.col("previous").alias("pos"), F.coalesce("rolled", "pos").alias("to"), decides.alias("done"))
    return rows.select("id", "stream", "kind", "key", "value", "pos", "parent").join(leads, "pos", "left")


def doubled(tree: DataFrame) -> DataFrame:
    """pos, kept (an ancestor of a commit, or one), decider (pos of the record that decides; null: the log's end)."""
    open_ = F.col("to").isNotNull() & ~F.col("done")
    now = materialise(tree.select("pos", "parent", (F.col("kind") == "commit").alias("kept"), "to", F.coalesce("done", F.lit(True)).alias("done")), "pointers")
    while now.filter(F.col("parent").isNotNull() | open_).limit(1).count():
        jump = now.filter("parent is not null").select(F.col("pos").alias("_a"), F.col("parent").alias("_parent"))
        lead = now.select(F.col("pos").alias("_b"), F.col("to").alias("_to"), F.col("done").alias("_done"))
        marked = now.filter("kept and parent is not null").select(F.col("parent").alias("_m")).distinct()
        step = now.withColumn("_on", F.when(open_, F.col("to"))).join(jump, F.col("parent") == F.col("_a"), "left").join(lead, F.col("_on") == F.col("_b"), "left").join(marked, F.col("pos") == F.col("_m"), "left")
        going = F.col("_on").isNotNull()
        now = materialise(
            step.select(
                "pos", F.col("_parent").alias("parent"), (F.col("kept") | F.col("_m").isNotNull()).alias("kept"),
                F.when(going, F.col("_to")).otherwise(F.col("to")).alias("to"), F.when(going, F.coalesce("_done", F.lit(True))).otherwise(F.col("done")).alias("done"),
            ),
            "pointers",
        )
    return now.select("pos", "kept", F.col("to").alias("decider"))


class Reassembled(NamedTuple):
    """Tables of one log: ``commits`` (id, number from 1 in the log's order),
    ``applied`` (id, stream, key, value, commit, number) and ``undone`` (id,
    stream, key, value, kind, undoer)."""

    commits: DataFrame
    applied: DataFrame
    undone: DataFrame


def reassemble(log: DataFrame) -> Reassembled:
    """What became of every change of ``log``: id, stream, kind (commit, abort, savepoint, rollback or change), key, value.

    A change with a null value deletes its key.  A rollback undoes what its
    transaction changed since its latest savepoint (none: since its start) and
    removes that savepoint.  A transaction that the log leaves open is aborted;
    its changes have no undoer.
    """
    tree = materialise(versions(log), "versions")
    fate = doubled(tree)
    commits = running_sums(tree.filter("kind = 'commit'").select("id", "value", "pos", F.lit(1).alias("one")), ["id", "value", "pos"], {"number": "one"}, "commits").drop("one", "value")
    deciders = tree.filter("kind in ('commit', 'abort', 'rollback')").select(F.col("pos").alias("decider"), F.col("id").alias("_id"), F.col("kind").alias("_kind"))
    deciders = deciders.join(commits.select(F.col("pos").alias("decider"), "number"), "decider", "left")
    changes = tree.filter("kind = 'change'").select("id", "stream", "key", "value", "pos").join(fate, "pos").join(deciders, "decider", "left")
    changes = materialise(changes, "changes")
    applied = changes.filter("kept").select("id", "stream", "key", "value", "pos", F.col("_id").alias("commit"), "number")
    undone = changes.filter("not kept").select("id", "stream", "key", "value", F.coalesce("_kind", F.lit("abort")).alias("kind"), F.col("_id").alias("undoer"))
    return Reassembled(commits.select("id", "number"), applied, undone)


def epoch_digests(found: Reassembled, every: int) -> DataFrame:
    """epoch (from 1), keys, total: after each ``every`` commits (the last: the rest) how many keys the store holds, and the sum of their values.

    Values are whole numbers.  A key's updates count once for each epoch; the
    store is never built, its changes from epoch to epoch are added up.
    """
    epoch = F.expr(f"(number - 1) div {every} + 1")
    final = found.applied.groupBy("key", epoch.alias("epoch")).agg(F.max_by(F.struct("value"), F.struct("number", "pos")).alias("v")).select("key", "epoch", "v.value")
    moved = neighbours(final, ["key"], "epoch", ["value"], "updates")
    there = lambda c: F.col(c).isNotNull().cast("long")
    amount = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    deltas = moved.groupBy("epoch").agg(F.sum(there("value") - there("last.value")).alias("d"), F.sum(amount("value") - amount("last.value")).alias("s"))
    epochs = found.commits.select(epoch.alias("epoch")).distinct().join(deltas, "epoch", "left").fillna(0, ["d", "s"])
    return running_sums(epochs, ["epoch"], {"keys": "d", "total": "s"}, "epochs").select("epoch", "keys", "total")


def document_log(docs: DataFrame, labels: DataFrame, keys: int = 300) -> DataFrame:
    """Documents read as records, by the checksum h of their id; the value is the checksum of ``key:text``."""
    h, m = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.col("h") % 23
    kind = F.when(m <= 1, "commit").when(m == 2, "abort").when(m <= 4, "savepoint").when(m <= 6, "rollback").otherwise("change")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("stream"), F.col("text").cast("string").alias("text"), h.alias("h"))
    rows = rows.select("doc_id", "stream", kind.alias("kind"), F.expr(f"(h div 100) % {keys}").alias("key"), "text")
    rows = rows.select("doc_id", "stream", "kind", "key", F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("text")).cast("binary")).alias("value"))
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").cast("long").alias("_toxic")).distinct()
    rows = rows.join(toxic, F.col("doc_id") == F.col("_toxic"), "left")
    change = F.col("kind") == "change"
    return rows.select(F.col("doc_id").alias("id"), "stream", "kind", F.when(change, F.col("key")).alias("key"), F.when(F.col("_toxic").isNull() & change, F.col("value")).alias("value"))


def op12_version_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a log: the store after every four commits, and every undone change with what undid it."""
    found = reassemble(document_log(documents(spark, sf_dir), documents(spark, sf_dir, "labels")))
    states = epoch_digests(found, 4).select(F.lit("state").alias("kind"), F.col("epoch").cast("long").alias("id"), F.col("keys").alias("n"), F.col("total").alias("value"))
    return states.unionByName(found.undone.select("kind", "id", F.col("undoer").alias("n"), F.col("key").alias("value")))


def _checksum_sql(digits: str) -> str:
    """CRC-32 of a list of hexadecimal digits, low half of each byte first; the list is the fixed table of the polynomial for four bits."""
    table = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
    halves = f"list_transform(range(1, len({digits}) + 1), lambda k: instr('0123456789ABCDEF', {digits}[k + 2 * (k % 2) - 1]) - 1)"
    return f"CASE WHEN {digits} IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, v: xor(c >> 4, {table}[(xor(c, v) & 15) + 1])), 4294967295) END"


#: Savepoints are met by depth, and a change is undone by the first rollback whose reach covers it: no pointers.
ORACLE = f"""
WITH named AS (SELECT doc_id, source, text, string_split(hex(encode(CAST(doc_id AS VARCHAR))), '') AS digits FROM documents WHERE doc_id IS NOT NULL),
hashed AS (SELECT doc_id, source, text, {_checksum_sql("digits")} AS h FROM named),
kinds AS (
  SELECT doc_id, source, CASE WHEN h % 23 <= 1 THEN 'commit' WHEN h % 23 = 2 THEN 'abort' WHEN h % 23 <= 4 THEN 'savepoint' WHEN h % 23 <= 6 THEN 'rollback' ELSE 'change' END AS kind,
         (h // 100) % 300 AS key, text, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM hashed),
texts AS (SELECT doc_id, source, kind, key, string_split(hex(encode(CASE WHEN kind = 'change' AND NOT toxic THEN key || ':' || text END)), '') AS digits FROM kinds),
valued AS (SELECT doc_id, source, kind, key, {_checksum_sql("digits")} AS value FROM texts),
log AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, value NULLS FIRST) AS r, CAST(kind IN ('commit', 'abort') AS INTEGER) AS ends,
         CASE kind WHEN 'savepoint' THEN 1 WHEN 'rollback' THEN -1 ELSE 0 END AS step FROM valued),
tx AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY source ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM log),
walk AS (SELECT *, sum(step) OVER (PARTITION BY source, t ORDER BY r) AS s FROM tx),
floor_ AS (SELECT *, least(0, min(s) OVER (PARTITION BY source, t ORDER BY r)) AS f FROM walk),
depths AS (SELECT *, s - f AS d, coalesce(lag(f) OVER (PARTITION BY source, t ORDER BY r), 0) <> f AS bare FROM floor_),
backs AS (
  SELECT b.source, b.t, b.r, b.doc_id, coalesce(max(p.r), 0) AS since FROM depths b
  LEFT JOIN depths p ON p.source IS NOT DISTINCT FROM b.source AND p.t = b.t AND p.kind = 'savepoint' AND p.r < b.r AND NOT b.bare AND p.d = b.d + 1
  WHERE b.kind = 'rollback' GROUP BY ALL),
undone AS (
  SELECT c.r, min(b.r) AS b FROM depths c JOIN backs b ON b.source IS NOT DISTINCT FROM c.source AND b.t = c.t AND b.since < c.r AND c.r < b.r WHERE c.kind = 'change' GROUP BY c.r),
ended AS (SELECT source, t, r, doc_id, kind FROM depths WHERE ends = 1),
commits AS (SELECT r, row_number() OVER (ORDER BY r) AS number FROM ended WHERE kind = 'commit'),
fate AS (
  SELECT c.doc_id, c.key, c.value, c.r, CASE WHEN u.b IS NOT NULL THEN 'rollback' WHEN e.kind = 'commit' THEN 'commit' ELSE 'abort' END AS kind, coalesce(o.doc_id, e.doc_id) AS by_, e.r AS at_
  FROM depths c LEFT JOIN undone u ON u.r = c.r LEFT JOIN log o ON o.r = u.b LEFT JOIN ended e ON e.source IS NOT DISTINCT FROM c.source AND e.t = c.t WHERE c.kind = 'change'),
applied AS (SELECT (number - 1) // 4 + 1 AS epoch, key, value, number, f.r FROM fate f JOIN commits c ON c.r = f.at_ WHERE f.kind = 'commit'),
final AS (SELECT epoch, key, value FROM applied QUALIFY row_number() OVER (PARTITION BY key, epoch ORDER BY number DESC, r DESC) = 1),
moved AS (SELECT epoch, value, lag(value) OVER (PARTITION BY key ORDER BY epoch) AS was FROM final),
deltas AS (SELECT epoch, sum(CAST(value IS NOT NULL AS INTEGER) - CAST(was IS NOT NULL AS INTEGER)) AS d, sum(coalesce(value, 0) - coalesce(was, 0)) AS s FROM moved GROUP BY epoch),
epochs AS (SELECT DISTINCT (number - 1) // 4 + 1 AS epoch FROM commits)
SELECT 'state' AS kind, CAST(epoch AS BIGINT) AS id, CAST(sum(coalesce(d, 0)) OVER (ORDER BY epoch) AS BIGINT) AS n, CAST(sum(coalesce(s, 0)) OVER (ORDER BY epoch) AS BIGINT) AS value
FROM epochs LEFT JOIN deltas USING (epoch)
UNION ALL SELECT kind, CAST(doc_id AS BIGINT), CAST(by_ AS BIGINT), CAST(key AS BIGINT) FROM fate WHERE kind <> 'commit'
"""
