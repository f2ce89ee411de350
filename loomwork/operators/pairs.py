"""Pairs and triples of entities: overlap, coverage, distance, and matched nulls."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.sources.store import cut


def pair_overlap(sup: DataFrame, by: tuple[str, ...] = (), entity: str = "actor", category: str = "topic") -> DataFrame:
    """a < b over all entities with a portfolio: k_a, k_b, shared, union and jaccard.

    Only pairs that share a category meet in the join; the others are the rest
    of the pairs of entities and get 0.
    """
    by_ = list(by)
    size = sup.groupBy(*by_, entity).agg(F.count(F.lit(1)).alias("k"))
    a, b = (size.select(*by_, F.col(entity).alias(c), F.col("k").alias(f"k_{c}")) for c in "ab")
    pairs = (a.join(b, by_) if by_ else a.crossJoin(b)).filter("a < b")
    left, right = (sup.select(*by_, category, F.col(entity).alias(c)) for c in "ab")
    shared = left.join(right, [*by_, category]).filter("a < b").groupBy(*by_, "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(shared, [*by_, "a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
    out = out.withColumn("union", F.col("k_a") + F.col("k_b") - F.col("shared"))
    return out.withColumn("jaccard", F.col("shared") / F.col("union"))


def collaboration(facts: DataFrame, doc: str = "doc", entity: str = "actor", by: tuple[str, ...] = ()) -> DataFrame:
    """a < b and the number of documents both stand on."""
    people = facts.groupBy(doc, *by).agg(F.array_sort(F.collect_set(entity)).alias("_who"))
    pairs = F.flatten(F.transform("_who", lambda x, k: F.transform(F.slice("_who", k + 2, F.size("_who")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return people.select(*by, F.inline(pairs)).groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("documents"))


def triple_coverage(sup: DataFrame, entity: str = "actor", category: str = "topic") -> DataFrame:
    """a < b < c with union, sum, efficiency, uniquely held categories, mean pair overlap and sorted sizes, by inclusion and exclusion."""
    sets = sup.groupBy(entity).agg(F.array_sort(F.collect_set(category)).alias("s"))
    a, b, c = (sets.select(F.col(entity).alias(x), F.col("s").alias(f"s{x}")) for x in "abc")
    t = a.join(b, F.col("a") < F.col("b")).join(c, F.col("b") < F.col("c"))
    n = lambda x: F.size(f"s{x}")
    both = lambda x, y: F.size(F.array_intersect(f"s{x}", f"s{y}"))
    t = t.withColumns({"ab": both("a", "b"), "ac": both("a", "c"), "bc": both("b", "c"), "abc": F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("sc")))})
    t = t.withColumn("sum_support", n("a") + n("b") + n("c"))
    t = t.withColumn("union_topics", F.col("sum_support") - F.col("ab") - F.col("ac") - F.col("bc") + F.col("abc"))
    jac = lambda x, y: F.col(x + y) / (n(x) + n(y) - F.col(x + y))
    sizes = F.array_sort(F.array(n("a"), n("b"), n("c")))
    return t.select(
        "a", "b", "c", sizes[0].alias("k_small"), sizes[1].alias("k_mid"), sizes[2].alias("k_large"), "union_topics", "sum_support",
        (F.col("union_topics") / F.col("sum_support")).alias("coverage_efficiency"),
        (F.col("sum_support") - 2 * (F.col("ab") + F.col("ac") + F.col("bc")) + 3 * F.col("abc")).alias("unique_topics"),
        ((jac("a", "b") + jac("a", "c") + jac("b", "c")) / 3).alias("mean_pairwise_overlap"),
    )


def exclusive_proximity(sup: DataFrame, directed_edges: DataFrame, entity: str = "actor", category: str = "topic", weight: str = "phi") -> DataFrame:
    """a < b: mean over both sides' unshared categories of the greatest weight to the other's unshared ones (0 without a link)."""
    sets = sup.groupBy(entity).agg(F.collect_set(category).alias("s"))
    a, b = (sets.select(F.col(entity).alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    pairs = a.join(b, F.col("a") < F.col("b")).select("a", "b", F.array_except("sa", "sb").alias("oa"), F.array_except("sb", "sa").alias("ob"))
    way = lambda x, y, k: pairs.select("a", "b", F.lit(k).alias("way"), F.explode(x).alias("i"), F.col(y).alias("_to"))
    both = way("oa", "ob", 1).unionByName(way("ob", "oa", 2))
    ends = both.select("a", "b", "way", "i", F.explode_outer("_to").alias("j")).join(directed_edges.select("i", "j", weight), ["i", "j"], "left")
    best = ends.groupBy("a", "b", "way", "i").agg(F.coalesce(F.max(weight), F.lit(0.0)).alias("best"))
    return best.groupBy("a", "b").agg(F.avg("best").alias("exclusive_proximity"), F.count(F.lit(1)).alias("exclusive"))


def emd_1d(shares: DataFrame, positions: DataFrame, entity: str = "actor", category: str = "topic", share: str = "share") -> DataFrame:
    """a < b: sum of |cumulated share difference| x gap along the ordered categories (category, position)."""
    w = Window.orderBy("position")
    axis = positions.withColumn("gap", F.coalesce(F.lead("position").over(w) - F.col("position"), F.lit(0.0)))
    people = shares.select(entity).distinct()
    grid = people.crossJoin(axis).join(shares, [entity, category], "left").withColumn(share, F.coalesce(share, F.lit(0.0)))
    upto = grid.withColumn("cum", F.sum(share).over(Window.partitionBy(entity).orderBy("position")))
    a, b = (upto.select(category, F.col(entity).alias(x), F.col("cum").alias(f"c{x}"), *(["gap"] if x == "a" else [])) for x in "ab")
    return a.join(b, category).filter("a < b").groupBy("a", "b").agg(F.sum(F.abs(F.col("ca") - F.col("cb")) * F.col("gap")).alias("emd"))


def nearest_in_space(df: DataFrame, key: str, features: list[str], k: int, value: str | None = None) -> DataFrame:
    """key, value, near: the k nearest other rows in z-scored ``features``, as an array of (distance, key, value), nearest first; equal distances by key.

    Exact, by grids of cells whose width doubles from level to level.  A row
    looks for its neighbours on the first level where its cell and the cells
    around it hold k + 1 rows: none of these is farther than twice a cell's
    diagonal, which tells how many cells around can hold anything nearer.
    Rows on one spot are one query, and only the k + 1 first keys of a spot can
    be anyone's neighbours, so that neither a crowded spot nor the number of
    rows multiplies with itself.  z-scores and squared distances are rounded to
    nine digits.  Keys are unique.
    """
    from loomwork.operators.stats import z_score

    scaled = df.select(F.col(key).alias("_k"), (F.col(value) if value else F.lit(None).cast("double")).alias("_v"), *features)
    for f in features:
        scaled = z_score(scaled, f).withColumnRenamed("z", f"_z_{f}")
    zs = [f"_z_{f}" for f in features]
    # 0.0 is added so that no spot is at minus zero
    rows = cut(scaled.select("_k", "_v", F.array(*[F.round(F.col(z), 9) + 0.0 for z in zs]).alias("_at")), "spots")
    dims = len(features)
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("_at")[i]).alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.min, F.max)]).first()
    span = max([(ends[f"max{i}"] - ends[f"min{i}"]) if ends["n"] else 0.0 for i in range(dims)] + [1e-9])
    bins = max(1, int((ends["n"] * 3**dims / (4 * (k + 1))) ** (1 / dims)))
    levels = bins.bit_length() + 1
    width = span / bins
    cell = lambda level: F.transform("_at", lambda x: F.floor(x / (width * 2**level)).cast("long"))
    every = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), cell(level).alias("cell")) for level in range(levels)]))
    first = F.row_number().over(Window.partitionBy("_at").orderBy("_k"))
    candidates = cut(rows.withColumn("_r", first).filter(F.col("_r") <= k + 1).drop("_r").select("_k", "_v", "_at", every.alias("c")).select("_k", "_v", "_at", "c.*"), "candidates")
    spots = candidates.select("_at", "level", "cell").distinct()
    held = candidates.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("rows"))

    def around(cells: DataFrame, reach: int) -> DataFrame:
        """level, cell and every cell ``near`` it that holds rows."""
        steps = F.array(*map(F.lit, range(-reach, reach + 1)))
        near = cells
        for i in range(dims):
            near = near.withColumn(f"_s{i}", F.explode(steps))
        near = near.select(*cells.columns, F.array(*[F.col("cell")[i] + F.col(f"_s{i}") for i in range(dims)]).alias("near"))
        return near.join(held.withColumnRenamed("cell", "near"), ["level", "near"])

    crowded = around(held.select("level", "cell"), 1).groupBy("level", "cell").agg(F.sum("rows").alias("rows"))
    enough = (F.col("rows") > k) | (F.col("level") == levels - 1)
    own = spots.join(crowded, ["level", "cell"]).filter(enough).groupBy("_at").agg(F.min_by(F.struct("level", "cell"), "level").alias("c")).select(F.col("_at").alias("_q"), "c.*")
    own = cut(own, "levels")
    # the last level is as wide as everything, so its ring of one holds all
    reach = int(2 * dims**0.5) + 1
    pairs = around(own.select("level", "cell").distinct(), reach).select("level", "cell", "near")
    found = own.join(pairs, ["level", "cell"]).join(candidates.withColumnRenamed("cell", "near"), ["level", "near"])
    gap = sum(((F.col("_at")[i] - F.col("_q")[i]) ** 2 for i in range(1, dims)), (F.col("_at")[0] - F.col("_q")[0]) ** 2)
    ranked = found.select("_q", F.round(gap, 9).alias("distance"), "_k", "_v").withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_k"))).filter(F.col("_r") <= k + 1)
    lists = ranked.groupBy(F.col("_q").alias("_at")).agg(F.array_sort(F.collect_list(F.struct("distance", F.col("_k").alias("key"), F.col("_v").alias("value")))).alias("_near"))
    others = F.slice(F.filter("_near", lambda x: x["key"] != F.col("_k")), 1, k)
    return rows.join(lists, "_at").select(F.col("_k").alias(key), F.col("_v").alias(value or "value"), others.alias("near"))


def matched_residual(df: DataFrame, key: str, features: list[str], value: str, neighbours: int) -> DataFrame:
    """``value`` less its mean over the nearest rows (other than itself) in z-scored ``features``; ties by key."""
    near = nearest_in_space(df, key, features, neighbours, value).filter(F.size("near") > 0)
    mean = F.aggregate("near", F.lit(0.0), lambda s, x: s + x["value"]) / F.size("near")
    return near.select(key, value, mean.alias("expected")).withColumn("residual", F.col(value) - F.col("expected"))


def cosine_pairs(df: DataFrame, key: str, vector: str, block: int = 7168, strip: int = 128) -> DataFrame:
    """i < j over all rows and the cosine of their vectors to five digits; a norm of 0 counts as 1.

    Rows fall into blocks of neighbouring keys; each pair of blocks is one
    task's matrix product, made and returned ``strip`` rows at a time.  A row is
    sent once for each block, so large blocks keep the shuffle small.  The
    pairs are the bulk of the disk, so their order lets columnar files pack
    them: by i within a strip of j, where i comes in runs and the js repeat.
    The first strip of a task comes by cosine instead, so that files which look
    at the first values to decide (Parquet) find that these repeat and number
    them; a block is as large as one row group holds of its pairs.  Null
    vectors, vectors with a null and vectors of unequal length give null; null
    keys and equal keys are no pair.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull())
    blocks = max(1, -(-rows.count() // block))
    inner = [k / blocks for k in range(1, blocks)]
    ends = rows.agg(F.percentile_approx("id", inner, max(10_000, 100 * blocks))).first()[0] if inner else []
    own = rows.withColumn("own", F.size(F.filter(F.lit(ends).cast("array<long>"), lambda end: end < F.col("id"))))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = dealt.select("id", "v", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def side(g: pd.DataFrame):
        g = g.sort_values("id")
        size = np.array([-1 if v is None else len(v) for v in g["v"]])
        x = np.zeros((len(g), max(size.max(initial=0), 1)))
        for k, v in enumerate(g["v"]):
            if size[k] > 0:
                x[k, : size[k]] = np.array(v, dtype=float)
        size = np.where(np.isnan(x).any(axis=1), -1, size)
        norm = np.sqrt((x * x).sum(axis=1))
        return g["id"].to_numpy(), x, np.where(norm == 0, 1, norm), size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        for (p, q), cell in pd.concat(parts, ignore_index=True).groupby(["p", "q"]) if parts else ():
            (a, x, nx, sx), (b, y, ny, sy) = side(cell[cell["own"] == p]), side(cell[cell["own"] == q])
            wide = min(x.shape[1], y.shape[1])
            for end in range(len(b), 0, -strip):  # the last js have most of the pairs that a block has within itself
                s = slice(max(end - strip, 0), end)
                cosine = np.round(x[:, :wide] @ y[s, :wide].T / (nx[:, None] * ny[s]), 5) + 0.0
                cosine[(sx[:, None] != sy[s]) | (sx[:, None] < 0)] = np.nan
                m, n = np.nonzero(a[:, None] < b[s])
                pairs = pd.DataFrame({"i": a[m], "j": b[s][n], "cosine": cosine[m, n]})
                yield pairs if end < len(b) else pairs.sort_values("cosine", key=lambda c: (c - c.median()).abs())

    out = cells.repartitionById(blocks * (blocks + 1) // 2, (F.expr("q * (q + 1) div 2 + p")).cast("int")).mapInPandas(run, "i long, j long, cosine double")
    return out.withColumn("cosine", F.nanvl("cosine", F.lit(None).cast("double")))
