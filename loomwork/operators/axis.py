"""Axes of a space of categories, and its regions: scaling and centres on a line, by joins over tables keyed by category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators.stats import spearman
from loomwork.sources.store import cut


def centred(distances: DataFrame, nodes: DataFrame) -> DataFrame:
    """i, j, b: minus half of the squared distances, centred by row, by column and as a whole; with the diagonal.

    ``distances``: i, j, distance over all ordered pairs of different nodes, symmetric.  ``nodes``: column node.
    """
    own = nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.0).alias("s"))
    squares = cut(distances.filter("i <> j").select("i", "j", (F.col("distance") * F.col("distance")).alias("s")).unionByName(own), "squares")
    means = cut(squares.groupBy("i").agg(F.avg("s").alias("m")), "means")
    whole = means.agg(F.avg("m").alias("_w"))
    rows = squares.join(means, "i").join(means.select(F.col("i").alias("j"), F.col("m").alias("_m")), "j").crossJoin(whole)
    return rows.select("i", "j", (-0.5 * (F.col("s") - F.col("m") - F.col("_m") + F.col("_w"))).alias("b"))


def leading(matrix: DataFrame, rounds: int = 40, tolerance: float = 1e-13) -> DataFrame:
    """i, v: the unit eigenvector of the greatest eigenvalue of a symmetric matrix (i, j, b).

    The matrix is shifted by the bound of its discs, so that no eigenvalue is
    negative, and squared until it is a projector: the sum of its squared
    entries, its trace being 1, is then 1.  A squaring is one join; their number
    grows with the logarithm of what power iteration would need.  The entry of
    greatest size (to nine digits, ties: least name) is positive.  A matrix
    without a positive entry on its shifted diagonal gives no rows.  Where the
    greatest eigenvalue is a multiple one, it ends after ``rounds`` with a vector
    of that space.
    """
    disc = matrix.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), -F.col("b")).otherwise(F.abs("b"))).alias("s"))
    shift = disc.agg(F.greatest(F.max("s"), F.lit(0.0)).alias("_shift"))
    diagonal = F.col("i") == F.col("j")
    p = cut(matrix.crossJoin(shift).select("i", "j", (F.col("b") + F.when(diagonal, F.col("_shift")).otherwise(0.0)).alias("p")), "shifted")
    for _ in range(rounds):
        trace, squares = p.agg(F.sum(F.when(diagonal, F.col("p"))), F.sum(F.col("p") * F.col("p"))).first()
        if not trace or trace <= 0:
            return matrix.select("i", F.lit(0.0).alias("v")).limit(0)
        p = p.select("i", "j", (F.col("p") / F.lit(trace)).alias("p"))
        if squares / trace**2 >= 1 - tolerance:
            break
        left, right = p.select("i", F.col("j").alias("_k"), "p"), p.select(F.col("i").alias("_k"), "j", F.col("p").alias("_q"))
        p = cut(left.join(right, "_k").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("_q")).alias("p")), "squared")
    best = p.filter(diagonal).agg(F.min_by(F.struct("i", "p"), F.struct(-F.round("p", 9), F.col("i"))).alias("_b"))
    best = best.select(F.col("_b.i").alias("j"), F.col("_b.p").alias("_d"))
    return p.join(best, "j").select("i", (F.col("p") / F.sqrt("_d")).alias("v"))


def classical_axes(distances: DataFrame, nodes: DataFrame, axes: int = 1) -> DataFrame:
    """node, axis (from 1), eigenvalue, position: classical scaling of all pairs' distances.

    A position is the eigenvector's entry times the root of the eigenvalue, 0
    where that is negative.  Without a positive first eigenvalue (one node, or
    all at one spot) the first axis is the order of the names, from 0.
    """
    b, out = cut(centred(distances, nodes), "centred"), None
    for axis in range(1, axes + 1):
        v = cut(leading(b), "leading")
        both = b.join(v, "i").join(v.select(F.col("i").alias("j"), F.col("v").alias("_u")), "j")
        value = cut(both.agg(F.coalesce(F.sum(F.col("b") * F.col("v") * F.col("_u")), F.lit(0.0)).alias("eigenvalue")), "eigenvalue")
        place = F.row_number().over(Window.orderBy("node")) - 1.0 if axis == 1 else F.lit(0.0)
        at = F.coalesce("v", F.lit(0.0)) * F.sqrt(F.greatest("eigenvalue", F.lit(0.0)))
        rows = nodes.join(v.withColumnRenamed("i", "node"), "node", "left").crossJoin(value)
        rows = rows.select("node", F.lit(axis).alias("axis"), "eigenvalue", F.when(F.col("eigenvalue") > 1e-12, at).otherwise(place).alias("position"))
        out = rows if out is None else out.unionByName(rows)
        if axis < axes:
            left = b.join(v, "i", "left").join(v.select(F.col("i").alias("j"), F.col("v").alias("_u")), "j", "left").crossJoin(value)
            b = cut(left.select("i", "j", (F.col("b") - F.coalesce(F.col("eigenvalue") * F.col("v") * F.col("_u"), F.lit(0.0))).alias("b")), "deflated")
    return out


def _nearest(x: str, centres: Column) -> Column:
    """The place, from 1, of the nearest of an array of centres; of equally near ones the first."""
    apart = F.transform(centres, lambda y: F.abs(F.col(x) - y))
    return F.array_position(apart, F.array_min(apart))


def _arrays(values: dict[int, list[float]]) -> Column:
    """The array of the row's k."""
    return F.element_at(F.create_map(*[c for k, v in values.items() for c in (F.lit(k), F.array(*map(F.lit, v)).cast("array<double>"))]), F.col("k"))


def centre_regions(points: DataFrame, ks: Sequence[int], key: str = "topic", x: str = "position", weight: str = "weight", rounds: int = 50) -> DataFrame:
    """k, key, x, weight, region (from 1), is_anchor, centre: contiguous regions of points on a line, for each number of centres.

    Evenly spaced centres move to the weighted mean of their nearest points (a
    centre without weight stays) until all stand still or ``rounds`` are over;
    each is then snapped to the nearest point (ties: lesser x, then key), equal
    ones become one, and regions part half way between neighbours; a point half
    way belongs to the upper one.  If no point has weight, all weigh 1.  A round
    is one job for all ``ks``; only the centres come to the driver.
    """
    lo, hi, total = points.agg(F.min(x), F.max(x), F.sum(weight)).first()
    weighed = points.select(key, x, (F.col(weight) if total and total > 0 else F.lit(1.0)).cast("double").alias(weight))
    rows = weighed.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    if lo is None:
        return rows.select("k", key, x, weight, F.lit(1).alias("region"), F.lit(False).alias("is_anchor"), F.col(x).alias("centre"))
    centres = {k: [lo + (hi - lo) * c / max(k - 1, 1) for c in range(k)] for k in ks}
    for _ in range(rounds):
        sums = rows.groupBy("k", _nearest(x, _arrays(centres)).alias("_c")).agg(F.sum(F.col(weight) * F.col(x)).alias("_s"), F.sum(weight).alias("_w"))
        moved = {k: list(c) for k, c in centres.items()}
        for k, c, s, w in sums.collect():
            if w > 0:
                moved[k][c - 1] = s / w
        still = all(abs(a - b) <= 1e-12 * (hi - lo) for k in ks for a, b in zip(moved[k], centres[k], strict=True))
        centres = moved
        if still:
            break
    each = rows.select("k", key, x, F.posexplode(_arrays(centres)).alias("_n", "_y"))
    snapped = each.groupBy("k", "_n").agg(F.min(F.struct(F.abs(F.col(x) - F.col("_y")), F.col(x).alias("x"), F.col(key).alias("key"))).alias("_s")).select("k", "_s.x", "_s.key").distinct().collect()
    anchors = {k: sorted({(a, name) for n, a, name in snapped if n == k}) for k in ks}
    spots = {k: sorted({a for a, _ in found}) for k, found in anchors.items()}
    cuts = {k: [(a + b) / 2 for a, b in zip(v, v[1:])] for k, v in spots.items()}  # noqa: B905
    region = (F.size(F.filter(_arrays(cuts), lambda y: y <= F.col(x))) + 1).alias("region")
    names = F.element_at(F.create_map(*[c for k, v in anchors.items() for c in (F.lit(k), F.array(*[F.lit(name) for _, name in v]))]), F.col("k"))
    marked = rows.select("k", key, x, weight, region, F.array_contains(names, F.col(key)).alias("is_anchor"))
    return marked.withColumn("centre", F.element_at(_arrays(spots), F.col("region")))


def least_inertia(points: DataFrame, most: int, key: str = "topic", x: str = "position", weight: str = "weight", floor: float = 1e-9) -> DataFrame:
    """k, inertia, gain, relative_gain, elbow: the least weighted sum of squares around k centres on a line, for k up to ``most``.

    Exact: the best clusters of points on a line are runs of neighbours.  A
    run's cost comes from running sums, the best k runs up to a point from the
    best k - 1 up to an earlier one, so k is a join.  The runs are all pairs of
    places of the category universe.  ``elbow`` is the gain before less the gain;
    k beyond the number of points gives no row.
    """
    spot = lambda n: F.sum(F.greatest(F.col(weight), F.lit(floor)) * F.pow(x, F.lit(float(n)))).over(Window.orderBy(x, key).rowsBetween(Window.unboundedPreceding, 0))
    sums = points.select(F.row_number().over(Window.orderBy(x, key)).alias("n"), *[spot(n).alias(f"s{n}") for n in range(3)])
    start = points.limit(1).select(F.lit(0).alias("n"), *[F.lit(0.0).alias(f"s{n}") for n in range(3)])
    sums = cut(sums.unionByName(start), "running")
    a, b = (sums.select([F.col(c).alias(f"{c}_{s}") for c in sums.columns]) for s in "ab")
    w, wx, wxx = (F.col(f"s{n}_b") - F.col(f"s{n}_a") for n in range(3))
    spans = cut(a.join(b, F.col("n_a") < F.col("n_b")).select(F.col("n_a").alias("a"), F.col("n_b").alias("b"), F.greatest(wxx - wx * wx / w, F.lit(0.0)).alias("cost")), "spans")
    last = points.agg(F.count(F.lit(1)).alias("b"))
    best, out = spans.filter("a = 0").select("b", F.col("cost").alias("inertia")), None
    for k in range(1, most + 1):
        if k > 1:
            best = best.select(F.col("b").alias("a"), "inertia").join(spans, "a").groupBy("b").agg(F.min(F.col("inertia") + F.col("cost")).alias("inertia"))
        found = best.join(last, "b").select(F.lit(k).alias("k"), "inertia")
        out = found if out is None else out.unionByName(found)
    by = Window.orderBy("k")
    gained = out.withColumn("gain", F.lag("inertia").over(by) - F.col("inertia"))
    return gained.withColumns({"relative_gain": F.try_divide("gain", F.lag("inertia").over(by)), "elbow": F.lag("gain").over(by) - F.col("gain")})


def _pair_cosines(rows: DataFrame, by: Sequence[str], feature: str, value: str) -> DataFrame:
    """by, a, b, cosine of the actors a < b that share a feature; an actor's pairs are those of the entity universe."""
    by = list(by)
    size = rows.groupBy(*by, "actor").agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_n"))
    unit = rows.join(size, [*by, "actor"]).select(*by, feature, "actor", (F.col(value) / F.col("_n")).alias("u"))
    other = unit.select(*by, feature, F.col("actor").alias("b"), F.col("u").alias("_u"))
    both = unit.withColumnRenamed("actor", "a").join(other, [*by, feature]).filter("a < b")
    return both.groupBy(*by, "a", "b").agg(F.sum(F.col("u") * F.col("_u")).alias("cosine"))


def region_validation(spec: DataFrame, regions: DataFrame, anchored: float = 0.7) -> DataFrame:
    """k and how well its regions stand for the portfolios: one row for each number of centres.

    ``spec``: actor, topic, rca.  ``regions``: what ``centre_regions`` gives, with
    each topic's unsmoothed ``excess``.  inertia: weighted squares around the
    centres; rho: rank correlation, over all pairs of actors, of the cosines of
    their excess by topic and by region (to nine digits); mean_dominant,
    median_dominant, anchored: of the actors' greatest shares, and how many reach
    ``anchored``; least_topics, least_signal: of the smallest region; regions: how
    many are left.  Actors without excess take no part.
    """
    over = cut(spec.filter("rca > 1").select("actor", "topic", (F.col("rca") - 1).alias("e")), "over")
    mass = over.join(regions.select("k", "topic", "region"), "topic").groupBy("k", "actor", "region").agg(F.sum("e").alias("m"))
    total = over.groupBy("actor").agg(F.sum("e").alias("_t"))
    share = cut(mass.join(total, "actor").select("k", "actor", "region", (F.col("m") / F.col("_t")).alias("share")), "shares")
    actors = total.select("actor")
    pairs = actors.select(F.col("actor").alias("a")).join(actors.select(F.col("actor").alias("b")), F.col("a") < F.col("b"))
    grid = pairs.crossJoin(regions.select("k").distinct())
    by_topic = _pair_cosines(over, [], "topic", "e").withColumnRenamed("cosine", "full")
    both = grid.join(by_topic, ["a", "b"], "left").join(_pair_cosines(share, ["k"], "region", "share"), ["k", "a", "b"], "left")
    nine = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c)
    rho = spearman(both.select("k", nine("full"), nine("cosine")), "full", "cosine", ["k"]).select("k", "rho")
    most = share.groupBy("k", "actor").agg(F.max("share").alias("s")).groupBy("k").agg(
        F.avg("s").alias("mean_dominant"), F.median("s").alias("median_dominant"), F.avg((F.round("s", 9) >= anchored).cast("double")).alias("anchored")
    )
    sizes = regions.groupBy("k", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("excess").alias("x")).groupBy("k").agg(
        F.min("n").alias("least_topics"), F.try_divide(F.min("x"), F.sum("x")).alias("least_signal"), F.count(F.lit(1)).alias("regions")
    )
    apart = regions.groupBy("k").agg(F.sum(F.col("weight") * F.pow(F.col("position") - F.col("centre"), F.lit(2.0))).alias("inertia"))
    return apart.join(sizes, "k").join(most, "k", "left").join(rho, "k", "left")
