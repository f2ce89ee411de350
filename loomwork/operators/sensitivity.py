"""How far the space moves when entities are taken away one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.space import above_one, cooccurrence, margins, similarity
from loomwork.sources.store import cut


def _across(a: Column, b: Column) -> Column:
    """Every pair of a member of ``a`` with one of ``b``, in order."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j")))))


def _within(a: Column) -> Column:
    """Every pair of members of ``a``."""
    return F.flatten(F.transform(a, lambda x, k: F.transform(F.slice(a, k + 2, F.size(a)), lambda y: F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j")))))


def _moves(remaining: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For every entity ``out`` that could go: the change of co-counts (out, i, j, d) and of ubiquities (out, topic, d).

    The entity's own pairs go.  The margins that shrink with it flip cells of
    the others; only pairs that touch a flipped cell are counted anew.
    """
    m = margins(remaining).withColumn("active", above_one())
    candidates = remaining.groupBy(F.col("actor").alias("out")).agg(F.sum("x").alias("_c"))
    own = remaining.select(F.col("actor").alias("out"), "topic", F.col("x").alias("_x"))
    trial = m.join(candidates, F.col("actor") != F.col("out")).join(own, ["out", "topic"], "left")
    big = lambda c: c.cast("decimal(19,0)")
    after = big(F.col("x")) * big(F.col("t") - F.col("_c")) > big(F.col("c")) * big(F.col("p") - F.coalesce("_x", F.lit(0)))
    flips = cut(trial.withColumn("after", after).filter("after <> active").select("out", "actor", "topic", "after"), "flips")
    held = m.filter("active").groupBy("actor").agg(F.array_sort(F.collect_set("topic")).alias("held"))
    sets = flips.groupBy("out", "actor").agg(F.array_sort(F.collect_set(F.when(F.col("after"), F.col("topic")))).alias("won"), F.array_sort(F.collect_set(F.when(~F.col("after"), F.col("topic")))).alias("lost"))
    sets = sets.join(held, "actor", "left").withColumn("kept", F.coalesce(F.array_except("held", "lost"), F.array().cast("array<string>")))
    pairs = lambda df, p, d: df.select("out", F.inline(p)).select("out", "i", "j", F.lit(d).alias("d"))
    touched = lambda c: F.concat(_across(F.col(c), F.col("kept")), _within(F.col(c)))
    gone = held.select(F.col("actor").alias("out"), "held")
    edges = pairs(sets, touched("won"), 1).unionByName(pairs(sets, touched("lost"), -1)).unionByName(pairs(gone, _within(F.col("held")), -1))
    ends = flips.select("out", "topic", F.when(F.col("after"), 1).otherwise(-1).alias("d")).unionByName(gone.select("out", F.explode("held").alias("topic"), F.lit(-1).alias("d")))
    return edges, ends


def greedy_removal(cube: DataFrame, steps: int | None = None) -> DataFrame:
    """step, actor, rmse: at each step the entity without which the proximities differ most from those of the whole cube, which then goes.

    One entity stays; ``steps`` ends it sooner.  The error is taken over all
    pairs of the whole cube's categories; equal errors (to nine digits) go by
    name.  A step scores all candidates in one pass: co-counts and ubiquities
    of the step before, and what changes in them without each candidate.
    """
    spark = cube.sparkSession
    cells = cut(cube.select("actor", "topic", "x").filter("x > 0"), "cells")
    sup = margins(cells).filter(above_one()).select("actor", "topic")
    base = cut(similarity(sup).select("i", "j", "phi"), "base")
    n = cooccurrence(sup)
    u = sup.groupBy("topic").agg(F.count(F.lit(1)).alias("u"))
    topics, actors = cells.agg(F.count_distinct("topic"), F.count_distinct("actor")).first()
    pairs, removed, out = max(topics * (topics - 1) / 2, 1), [], []
    for step in range(1, min(actors, (steps or actors) + 1)):
        remaining = cells.filter(~F.col("actor").isin(removed)) if removed else cells
        candidates = remaining.select(F.col("actor").alias("out")).distinct()
        edges, ends = _moves(remaining)
        n = candidates.crossJoin(n.select("i", "j", F.col("n").alias("d"))).unionByName(edges).groupBy("out", "i", "j").agg(F.sum("d").alias("n")).filter("n > 0")
        u = candidates.crossJoin(u.select("topic", F.col("u").alias("d"))).unionByName(ends).groupBy("out", "topic").agg(F.sum("d").alias("u")).filter("u > 0")
        n, u = cut(n, "cocounts"), cut(u, "ubiquities")
        end = lambda c, u=u: u.select("out", F.col("topic").alias(c), F.col("u").alias(f"u{c}"))
        phi = n.join(end("i"), ["out", "i"]).join(end("j"), ["out", "j"]).select("out", "i", "j", (F.col("n") / F.greatest("ui", "uj")).alias("d"))
        gap = phi.unionByName(candidates.crossJoin(base.select("i", "j", (-F.col("phi")).alias("d")))).groupBy("out", "i", "j").agg(F.sum("d").alias("d"))
        scored = gap.groupBy("out").agg(F.round(F.sqrt(F.sum(F.col("d") * F.col("d")) / pairs), 9).alias("rmse"))
        best = candidates.join(scored, "out", "left").fillna(0.0, ["rmse"]).orderBy(F.desc("rmse"), "out").first()
        removed.append(best["out"])
        out.append((step, best["out"], float(best["rmse"])))
        n, u = n.filter(F.col("out") == best["out"]).drop("out"), u.filter(F.col("out") == best["out"]).drop("out")
    return spark.createDataFrame(out, "step int, actor string, rmse double")
