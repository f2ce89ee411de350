"""Operators along an ordered axis: emergence, rolling means, runs, transitions, smoothing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.sources.store import cut


def emergence(volume: DataFrame, percents: Sequence[int], least_volume: int = 10, key: str = "topic", time: str = "year", value: str = "n") -> DataFrame:
    """For each share (in per cent) the first time at which a key's running sum reaches it; keys of small volume are left out."""
    upto = Window.partitionBy(key).orderBy(time)
    rows = volume.withColumns({"upto": F.sum(value).over(upto), "total": F.sum(value).over(Window.partitionBy(key))}).filter(F.col("total") >= least_volume)
    at = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    return rows.select(key, time, "upto", "total", at).filter(F.col("upto") * 100 >= F.col("percent") * F.col("total")).groupBy(key, "percent").agg(F.min(time).alias("emergence"), F.max("total").alias("total"))


def rolling_mean(df: DataFrame, value: str, order: str, reach: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the rows up to ``reach`` before and after; fewer at the ends."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn("mean", F.avg(value).over(w))


def elbow(df: DataFrame, order: str, value: str) -> DataFrame:
    """The gains over the step before, their differences, and the step of the greatest loss of gain."""
    w = Window.orderBy(order)
    out = df.withColumn("gain", F.lag(value).over(w) - F.col(value))
    out = out.withColumn("bend", F.col("gain") - F.lead("gain").over(w))
    best = out.agg(F.max_by(order, F.struct("bend", -F.col(order))).alias("elbow")).select("elbow")
    return out.crossJoin(best)


def longest_run(df: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """The longest run of equal labels along consecutive rows; the first of equals."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.coalesce((F.lag(label).over(w) != F.col(label)).cast("int"), F.lit(1))
    runs = df.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w)).groupBy(key, "_run", label).agg(F.count(F.lit(1)).alias("length"), F.min(order).alias("start"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("length"), "start"))
    return runs.withColumn("_b", best).filter("_b = 1").select(key, label, "length", "start")


def flows(sup: DataFrame, period: str = "period", entity: str = "actor", category: str = "topic", with_entities: bool = False) -> DataFrame:
    """Between consecutive periods the mass from each category to each: 1 / (n0 n1) for every held pair of an entity, and the entities.

    ``with_entities`` lists them too, as held_by.
    """
    w = Window.orderBy(period)
    steps = sup.select(period).distinct().withColumn("following", F.lead(period).over(w)).dropna()
    sized = sup.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(period, entity)))
    a = sized.join(steps, period).select(F.col(period).alias("prev"), F.col("following").alias("next"), entity, F.col(category).alias("source"), F.col("n").alias("n0"))
    b = sized.select(F.col(period).alias("next"), entity, F.col(category).alias("target"), F.col("n").alias("n1"))
    mass = F.sum(F.lit(1.0) / (F.col("n0") * F.col("n1")))
    listed = [F.sort_array(F.collect_list(entity)).alias("held_by")] if with_entities else []
    return a.join(b, ["next", entity]).groupBy("prev", "next", "source", "target").agg(mass.alias("mass"), F.count(F.lit(1)).alias("entities"), *listed)


def turnover(sup: DataFrame, period: str = "period", entity: str = "actor", category: str = "topic") -> DataFrame:
    """Kept, entered and left categories of each entity between consecutive periods in which either side holds any."""
    steps = sup.select(period).distinct().withColumn("following", F.lead(period).over(Window.orderBy(period))).dropna()
    a = sup.join(steps, period).select(F.col(period).alias("prev"), F.col("following").alias("next"), entity, category, F.lit(1).alias("was"))
    b = sup.join(steps.select(F.col(period).alias("prev"), F.col("following").alias(period)), period).select("prev", F.col(period).alias("next"), entity, category, F.lit(1).alias("is"))
    both = a.join(b, ["prev", "next", entity, category], "full")
    one = lambda c: F.count(F.when(c, 1))
    return both.groupBy("prev", "next", entity).agg(
        one(F.col("was").isNotNull() & F.col("is").isNotNull()).alias("kept"), one(F.col("was").isNull()).alias("entered"), one(F.col("is").isNull()).alias("gone")
    )


def gaussian_smooth(df: DataFrame, value: str, order: str, sigma: float, radius: int, by: Sequence[str] = ()) -> DataFrame:
    """Weighted sum over neighbours in order; places past an end take the end's value."""
    w = Window.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = [exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    ends = F.first(value).over(whole), F.last(value).over(whole)

    def at(k: int) -> Column:
        near = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
        return F.coalesce(near, ends[0] if k < 0 else ends[1])

    terms = [at(k) * (g / sum(weights)) for k, g in zip(range(-radius, radius + 1), weights, strict=True)]
    return df.withColumn("smooth", reduce(lambda a, b: a + b, terms))


def merge_near(df: DataFrame, position: str, gap: float, weight: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Joins neighbours no further apart than ``gap``: weighted mean position, total weight and the heaviest label."""
    w = Window.partitionBy(*by).orderBy(position)
    new = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("int"), F.lit(1))
    grouped = df.withColumn("_n", new).withColumn("cluster", F.sum("_n").over(w)).groupBy(*by, "cluster")
    return grouped.agg(
        F.try_divide(F.sum(F.col(position) * F.col(weight)), F.sum(weight)).alias(position), F.sum(weight).alias(weight),
        F.max_by(label, F.struct(F.col(weight), F.col(label))).alias(label), F.count(F.lit(1)).alias("members"),
    )


def separated_maxima(df: DataFrame, value: str, order: str, gap: int, top: int, by: Sequence[str] = ()) -> DataFrame:
    """The highest local maxima that stand at least ``gap`` places apart, ``top`` of each group at most; equal heights by place.

    ``order`` is a whole number for each row of a group.  A maximum is no lower
    than the rows before and after it, and neither end is one; a group without
    any offers all its rows, one of fewer than three rows its first ``top``.
    What a greedy pass in falling height would take is found in rounds: a
    maximum stays if none that is left within its reach is higher, and those
    that it covers go.  A round looks at strips of ``gap`` places, so no task
    holds a whole axis.
    """
    by = list(by)
    beside = lambda k: df.select(*by, (F.col(order) + k).alias(order), F.col(value).alias(f"_v{k}"))
    sized = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")) if by else df.agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    rows = df.select(*by, order, value)
    rows = rows.join(sized, by) if by else rows.crossJoin(sized)
    rows = rows.join(beside(1), [*by, order], "left").join(beside(-1), [*by, order], "left")
    rows = cut(rows.withColumn("_peak", (F.col(value) >= F.col("_v1")) & (F.col(value) >= F.col("_v-1"))).drop("_v1", "_v-1"), "maxima")
    found = rows.groupBy(*by).agg(F.max(F.coalesce("_peak", F.lit(False))).alias("_any"))
    rows = rows.join(found, by) if by else rows.crossJoin(found)
    few = F.col("_n") < 3
    short = rows.filter(few).filter(F.col(order) < F.col("_first") + top).select(*by, order, value)
    left = rows.filter(~few & (F.col("_peak") | ~F.col("_any"))).select(*by, order, value)
    kept, strip = None, F.floor(F.col(order) / gap)
    left = cut(left, "maxima-left")
    while left.limit(1).count():
        near = Window.partitionBy(*by, "_strip").orderBy(order).rangeBetween(-gap + 1, gap - 1)
        best = F.max(F.struct(F.col(value), -F.col(order))).over(near)
        wide = left.withColumn("_strip", F.explode(F.array(strip - 1, strip, strip + 1))).withColumn("_best", best).filter(F.col("_strip") == strip)
        wide = wide.withColumn("_wins", F.struct(F.col(value), -F.col(order)) == F.col("_best"))
        # whoever wins covers all within its reach; a second pass over the strips marks the covered
        marked = cut(wide.drop("_strip", "_best"), "maxima-round")
        covers = F.max(F.col("_wins")).over(near)
        left = marked.withColumn("_strip", F.explode(F.array(strip - 1, strip, strip + 1))).withColumn("_covered", covers).filter((F.col("_strip") == strip) & ~F.col("_covered")).select(*by, order, value)
        left = cut(left, "maxima-left")
        won = marked.filter("_wins").select(*by, order, value)
        kept = won if kept is None else kept.unionByName(won)
    if kept is None:
        return short
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), order))
    return short.unionByName(kept.withColumn("_r", place).filter(F.col("_r") <= top).drop("_r"))
