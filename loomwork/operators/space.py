"""Specialization, proximity between categories, and distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.sources.store import cut

Names = Sequence[str]


def margins(cube: DataFrame, by: Names = (), entity: str = "actor", category: str = "topic", value: str = "x") -> DataFrame:
    """The cube with the sums c (of the entity), p (of the category) and t (of all), within ``by``.

    Each margin is aggregated on its own and joined, so no window holds all
    rows in one task.
    """
    by = list(by)
    c = cube.groupBy(*by, entity).agg(F.sum(value).alias("c"))
    p = cube.groupBy(*by, category).agg(F.sum(value).alias("p"))
    t = cube.groupBy(*by).agg(F.sum(value).alias("t"))
    out = cube.join(c, [*by, entity]).join(p, [*by, category])
    return out.join(t, by) if by else out.crossJoin(t)


def above_one(strict: bool = True) -> Column:
    """Whether the index is above 1 (or at least 1), decided in whole numbers."""
    left, right = (F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)") for a, b in (("x", "t"), ("c", "p")))
    return left > right if strict else left >= right


def specialization(cube: DataFrame, by: Names = (), strict: bool = True, entity: str = "actor", category: str = "topic") -> DataFrame:
    """The cube with rca = (x / c) / (p / t), 0 where a sum is 0, and ``active``."""
    m = margins(cube, by, entity, category)
    ratio = F.coalesce(F.try_divide(F.try_divide(F.col("x").cast("double"), F.col("c")), F.try_divide(F.col("p").cast("double"), F.col("t"))), F.lit(0.0))
    return m.withColumn("rca", ratio).withColumn("active", above_one(strict) & (F.col("x") > 0))


def support(cube: DataFrame, by: Names = (), strict: bool = True, entity: str = "actor", category: str = "topic") -> DataFrame:
    """The (entity, category) pairs whose index passes the threshold 1."""
    return specialization(cube, by, strict, entity, category).filter("active").select(*by, entity, category)


def cooccurrence(sup: DataFrame, by: Names = (), entity: str = "actor", category: str = "topic") -> DataFrame:
    """i < j and the number n of entities that hold both, within ``by``.

    Each entity's categories are gathered and its pairs are made there, so no
    row is sent twice to meet itself; a portfolio is no larger than the
    category universe.
    """
    held = sup.groupBy(*by, entity).agg(F.array_sort(F.collect_set(category)).alias("_held"))
    pairs = F.explode(
        F.flatten(F.transform("_held", lambda a, k: F.transform(F.slice("_held", k + 2, F.size("_held")), lambda b: F.struct(a.alias("i"), b.alias("j")))))
    )
    return held.select(*by, pairs.alias("_p")).groupBy(*by, F.col("_p.i").alias("i"), F.col("_p.j").alias("j")).agg(F.count(F.lit(1)).alias("n"))


def similarity(sup: DataFrame, by: Names = (), entity: str = "actor", category: str = "topic") -> DataFrame:
    """Edges i < j that share an entity: n, ui, uj, phi, cosine and jaccard."""
    by = list(by)
    u = sup.groupBy(*by, category).agg(F.count(F.lit(1)).alias("u"))
    side = lambda k: u.select(*by, F.col(category).alias(k), F.col("u").alias(f"u{k}"))
    out = cooccurrence(sup, by, entity, category).join(side("i"), [*by, "i"]).join(side("j"), [*by, "j"])
    n = F.col("n").cast("double")
    return out.withColumns(
        {
            "phi": n / F.greatest("ui", "uj"),
            "cosine": F.least(F.lit(1.0), n / F.sqrt(F.col("ui") * F.col("uj"))),
            "jaccard": n / (F.col("ui") + F.col("uj") - F.col("n")),
        }
    )


def both_ways(edges: DataFrame, *weights: str) -> DataFrame:
    """Each edge in both directions."""
    kept = [c for c in edges.columns if c not in ("i", "j", "ui", "uj") and (not weights or c in weights)]
    return edges.select("i", "j", *kept).unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), *kept))


def shortest_paths(edges: DataFrame, nodes: DataFrame, weight: Column, fill_factor: float = 1.25, rounds: int | None = None) -> DataFrame:
    """i, j, distance over all ordered pairs of different nodes: least sums of ``weight``.

    Min-plus squaring: after k rounds paths of 2^k edges are covered; it ends
    when a round shortens nothing, or after ``rounds``.  Pairs that no path joins get ``fill_factor`` times the greatest distance.
    ``nodes`` is the category universe, column ``node``.
    """
    d = cut(both_ways(edges.withColumn("d", weight), "d"))
    state, done = None, 0
    while rounds is None or done < rounds:
        done += 1
        via = d.select(F.col("i"), F.col("j").alias("_v"), "d").join(d.select(F.col("i").alias("_v"), "j", F.col("d").alias("_e")), "_v")
        d = d.unionByName(via.filter("i <> j").select("i", "j", (F.col("d") + F.col("_e")).alias("d"))).groupBy("i", "j").agg(F.min("d").alias("d"))
        d = cut(d)
        # to nine digits: the order of a sum does not count as a change
        before, state = state, tuple(d.agg(F.count(F.lit(1)), F.sum(F.round("d", 9).cast("decimal(38,9)"))).first())
        if state == before or not state[0]:
            break
    grid = nodes.select(F.col("node").alias("i")).crossJoin(nodes.select(F.col("node").alias("j"))).filter("i <> j")
    most = d.agg(F.max("d").alias("_most"))
    return grid.join(d, ["i", "j"], "left").crossJoin(most).select("i", "j", F.coalesce("d", F.col("_most") * fill_factor).alias("distance"))


def portfolio_proximity(at_risk: DataFrame, held: DataFrame, edges: DataFrame, by: Names = (), entity: str = "actor", category: str = "topic", weight: str = "phi", edges_by: Names = ()) -> DataFrame:
    """``at_risk`` with ``closeness``: the greatest weight to any *other* held category of the entity (null if none).

    The least distance 1 - w is 1 - closeness.
    """
    by = list(by)
    near = both_ways(edges, weight, *edges_by).select(*edges_by, F.col("i").alias(category), F.col("j").alias("_other"), weight)
    own = held.select(*by, entity, F.col(category).alias("_other"))
    best = own.join(near, [*edges_by, "_other"]).groupBy(*by, entity, category).agg(F.max(weight).alias("closeness"))
    return at_risk.join(best, [*by, entity, category], "left")


def top_neighbours(edges: DataFrame, k: int, weight: str = "phi", by: Names = ()) -> DataFrame:
    """The edges that are among the k heaviest of one of their ends; ties by neighbour."""
    rank = F.row_number().over(Window.partitionBy(*by, "i").orderBy(F.desc(weight), "j"))
    chosen = both_ways(edges, weight, *by).withColumn("_r", rank).filter(F.col("_r") <= k)
    return chosen.select(*by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), weight).distinct()


def disparity_backbone(edges: DataFrame, alpha: float, weight: str = "phi") -> DataFrame:
    """The edges significant from both ends: alpha_k = (1 - w / strength)^(degree - 1) below ``alpha``."""
    ends = both_ways(edges, weight).groupBy("i").agg(F.sum(weight).alias("_s"), F.count(F.lit(1)).alias("_k"))
    side = lambda c: ends.select(F.col("i").alias(c), F.col("_s").alias(f"_s{c}"), F.col("_k").alias(f"_k{c}"))
    at = lambda c: F.pow(1 - F.col(weight) / F.col(f"_s{c}"), F.col(f"_k{c}") - 1)
    out = edges.select("i", "j", weight).join(side("i"), "i").join(side("j"), "j").withColumn("alpha", F.greatest(at("i"), at("j")))
    return out.filter(F.col("alpha") < alpha).select("i", "j", weight, "alpha")


def excess(spec: DataFrame, by: Names) -> DataFrame:
    """Sum of what the index has above 1."""
    return spec.groupBy(*by).agg(F.sum(F.greatest(F.col("rca") - 1, F.lit(0.0))).alias("excess"))


def region_shares(spec: DataFrame, regions: DataFrame, by: Names = ("actor",), weight: str = "rca", category: str = "topic") -> DataFrame:
    """Each region's share of the weight of ``by``, 0 where there is none, and whether it is dominant (ties: least region)."""
    sums = spec.join(regions, category).groupBy(*by, "region").agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*by)
    share = F.coalesce(F.try_divide("w", F.sum("w").over(w)), F.lit(0.0))
    return sums.withColumn("share", share).withColumn("dominant", F.row_number().over(w.orderBy(F.desc("w"), "region")) == 1).drop("w")
