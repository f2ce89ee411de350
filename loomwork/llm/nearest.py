"""Approximate nearest neighbours by cosine: inverted lists scanned dimension by dimension.

Vectors are brought to length one and turned by a random rotation, which
spreads the distance evenly over the dimensions.  Within a probed list they are
compared block of columns by block of columns; after each block a test of the
partial distance gives up the candidates that would hardly come within the
distance already reached.  What survives all blocks is scored on the original
vectors.

The centres of the lists and the number of lists to probe are fitted to a
sample of at most ``sample`` distinct vectors: as many lists are probed as hold
``recall`` of the sample's own neighbours.  Every vector is indexed.  A list of
many rows or many queries is dealt into parts, so that no task holds more than
``part`` of either.

Equal vectors are one entry with its k + 1 smallest ids, and one query: no
answer needs more, as k of them remain without the query's own id.  Vectors
that are null, zero, empty, not of the most frequent length, or that hold a
null or a number that is not finite take no part, nor do rows without an id.
Rows that share a query's id are its own.  Ties go to the smaller id.  With
fewer candidates than k all are given; no candidates or queries give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm._shared import documents, finite_vectors, materialise


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a list column, each scaled by a power of two so that squares neither vanish nor overflow."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Lists(NamedTuple):
    """What the sample teaches: unit centres, the rotation, and how many lists a query probes."""

    centres: np.ndarray
    rotation: np.ndarray
    probes: int


def fit_lists(sample: np.ndarray, count: int, k: int, recall: float, rounds: int = 10, seed: int = 0) -> Lists:
    """``count`` centres of the unit vectors ``sample``, and the probes that find ``recall`` of 256 members' k neighbours."""
    r = np.random.default_rng(seed)
    d = sample.shape[1]
    rotation = np.linalg.qr(r.normal(size=(d, d)))[0]
    centres = sample[r.choice(len(sample), count, replace=False)]
    for _ in range(rounds if count > 1 else 0):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    asked = sample[:256]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2
    near = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    needed = np.sort(place[np.arange(len(asked))[:, None], (sample @ centres.T).argmax(axis=1)[near]].ravel())
    probes = int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1 if len(needed) else count
    return Lists(centres, rotation, probes)


def survivors(x: np.ndarray, q: np.ndarray, reach: np.ndarray, block: int, epsilon: float, examined: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) of the rotated units ``q`` and ``x`` that no block's test gives up, and their squared distances.

    After the first t of d columns a pair goes on if d / t times its partial
    squared distance is at most (1 + epsilon / sqrt t)^2 times the query's
    reach; after the last, if its distance is within the reach.  ``examined``
    gets the number of pairs compared in each block.
    """
    d = x.shape[1]
    part, a, b = None, None, None
    for start in range(0, d, block):
        xb, qb = x[:, start : start + block], q[:, start : start + block]
        t = start + xb.shape[1]
        limit = reach * (t / d) * (1 + epsilon / np.sqrt(t)) ** 2 if t < d else reach
        if examined is not None:
            examined.append(len(x) * len(q) if a is None else len(a))
        if a is None or 8 * len(a) > len(x) * len(q):
            whole = (qb * qb).sum(axis=1)[:, None] + (xb * xb).sum(axis=1) - 2 * (qb @ xb.T)
            step = whole.ravel() if a is None else whole[a, b]
        else:
            step = np.concatenate([((qb[a[i : i + 65536]] - xb[b[i : i + 65536]]) ** 2).sum(axis=1) for i in range(0, len(a), 65536)] or [np.zeros(0)])
        if a is None:
            a, b = np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
            part = step
        else:
            part = part + step
        kept = part <= limit[a] + 1e-9
        a, b, part = a[kept], b[kept], part[kept]
    return a, b, part


def _first_of_each(group: np.ndarray, count: int) -> np.ndarray:
    """Of sorted groups the places of the first ``count`` members."""
    start = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, dtype=bool)
    place = np.arange(len(group)) - np.maximum.accumulate(np.where(start, np.arange(len(group)), 0)) if len(group) else np.zeros(0, dtype=int)
    return place < count


def scan(rows: pa.Table, asked: pa.Table, rotation: np.ndarray, k: int, block: int, epsilon: float, chunk: int = 512) -> pa.Table:
    """query, vec_id, score: the k best entries of one part of a list for each query, of those that the tests leave."""
    none = pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not rows.num_rows or not asked.num_rows:
        return none
    own, wanted = _matrix(rows["v"]), _matrix(asked["v"])
    x, q = _units(own) @ rotation, _units(wanted) @ rotation
    reach = asked["reach"].to_numpy().copy()
    found = []
    for lo in range(0, len(q), chunk):
        pairs = []
        for start in range(0, len(x), 2 * chunk):
            at = slice(lo, lo + chunk)
            a, b, d = survivors(x[start : start + 2 * chunk], q[at], reach[at], block, epsilon)
            pairs.append((a + lo, b + start, d))
            a, b, d = (np.concatenate(z) for z in zip(*pairs, strict=True))
            order = np.lexsort((d, a))
            a, b, d = a[order], b[order], d[order]
            last = _first_of_each(a, k) & ~_first_of_each(a, k - 1)
            reach[a[last]] = np.minimum(reach[a[last]], d[last])
            kept = d <= reach[a] + 1e-9
            pairs = [(a[kept], b[kept], d[kept])]
        found += pairs
    a, b, _ = (np.concatenate(z) for z in zip(*found, strict=True))
    score = (wanted[a] * own[b]).sum(axis=1) / (np.sqrt((wanted * wanted).sum(axis=1))[a] * np.sqrt((own * own).sum(axis=1))[b])
    ids = rows["ids"].combine_chunks()
    size = np.diff(ids.offsets.to_numpy())
    starts = ids.offsets.to_numpy()[:-1]
    each = np.repeat(np.arange(len(a)), size[b])
    within = np.arange(len(each)) - np.repeat(np.cumsum(size[b]) - size[b], size[b])
    names = ids.values.to_numpy()[np.repeat(starts[b], size[b]) + within]
    a, score = a[each], score[each]
    order = np.lexsort((names, -score, a))
    order = order[_first_of_each(a[order], k)]
    return pa.table({"query": asked["query"].to_numpy()[a[order]], "vec_id": names[order], "score": score[order]})


def _probed(df: DataFrame, lists: Lists, name: str, most: int) -> DataFrame:
    """``df`` with ``name``: the ``most`` lists whose centres are nearest to v, nearest first."""
    schema = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _units(_matrix(batch.column("v"))) @ lists.centres.T
                first = np.argsort(-near, axis=1, kind="stable")[:, :most].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(first.ravel()), first.shape[1]).cast(schema)], names=[*batch.schema.names, name])

    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, {name} array<int>")


def _scanned(index: DataFrame, asked: DataFrame, lists: Lists, k: int, block: int, epsilon: float, part: int) -> DataFrame:
    """The best entries of every (query, list) of ``asked``; lists are dealt into parts of rows and of queries."""
    rows, wanted = index.groupBy("list").count(), asked.groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    share = lambda c: F.ceil(F.col(c) / part).cast("int")
    parts = F.broadcast(rows.join(wanted, "list").select("list", share("count").alias("_rows"), share("asked").alias("_asked")))  # a row for each list, of which there are at most max_lists
    own, others = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(parts, "list").select("list", "ids", "v", own("key", "_rows").alias("rp"), others("_asked").alias("qp"))
    right = asked.join(parts, "list").select("list", "query", "v", "reach", own("query", "_asked").alias("qp"), others("_rows").alias("rp"))
    by = ("list", "rp", "qp")
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by))
    rotation = lists.rotation
    return pairs.applyInArrow(lambda a, b: scan(a, b, rotation, k, block, epsilon), "query long, vec_id long, score double")


def nearest(
    candidates: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.97, epsilon: float = 3.0, block: int = 16,
    sample: int = 16384, max_lists: int = 1024, list_rows: int = 512, part: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows of ``candidates`` by cosine, as far as found."""
    spark = candidates.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = lambda df: finite_vectors(df, id_col, vector_col).filter(F.col("id").isNotNull() & F.exists("v", lambda c: c != 0))
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    entries = usable(candidates).withColumn("_r", rank).filter(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    entries = materialise(entries.withColumn("key", F.monotonically_increasing_id()), "entries")
    asked = usable(queries)
    heads = materialise(asked.select("v").dropDuplicates().withColumn("query", F.monotonically_increasing_id()), "heads")
    n = entries.count()
    chosen = entries.orderBy(F.xxhash64("v", F.lit(11)), "key").limit(sample).select("v").toArrow()
    if not n or heads.isEmpty():
        return nothing
    learnt = _units(_matrix(chosen["v"]))
    if heads.select(F.size("v")).first()[0] != learnt.shape[1]:
        return nothing
    lists = fit_lists(learnt, max(1, min(max_lists, n // list_rows, len(learnt) // 8)), k, recall)
    index = materialise(_probed(entries, lists, "near", 1).select("key", "ids", "v", F.col("near")[0].alias("list")), "index")
    probed = materialise(_probed(heads, lists, "near", lists.probes), "probed")
    home = probed.select("query", "v", F.col("near")[0].alias("list"), F.lit(float("inf")).alias("reach"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    found = materialise(ranked(_scanned(index, home, lists, k + 1, block, epsilon, part)), "found-home")
    if lists.probes > 1:
        reach = found.groupBy("query").agg(F.min(F.when(F.col("_r") == k + 1, 2 - 2 * F.col("score"))).alias("reach"))
        rest = probed.join(reach, "query", "left").select("query", "v", F.explode(F.slice("near", 2, lists.probes)).alias("list"), F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        found = ranked(found.drop("_r").unionByName(_scanned(index, rest, lists, k + 1, block, epsilon, part)))
    answers = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))).alias("best"))
    named = asked.dropDuplicates().join(heads, "v").select("id", "query").join(answers, "query")
    others = F.slice(F.filter("best", lambda e: e["vec_id"] != F.col("id")), 1, k)
    return named.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "e")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest embeddings of every one whose id is divisible by 50."""
    rows = documents(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))


#: The whole search; one list holds all rows of a small table, and its tests give up no neighbour there.
ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
QUALIFY rank <= 5
"""
