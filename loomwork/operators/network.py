"""Networks as edge tables: components and diffusion, by joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators.space import both_ways
from loomwork.sources.store import cut


def components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, node, component (the least node that paths reach) for every end of ``edges`` (by, i, j).

    Large and small stars in turn: every node's greater neighbours, then its
    lesser ones, are tied to the least node it knows, until nothing changes;
    the rounds grow with the logarithm of the nodes.  Loops and repeated edges
    do no harm.
    """
    by = list(by)
    key = lambda *c: [*by, *c]
    loops = edges.filter("i = j").select(*key(F.col("i").alias("node"), F.col("i").alias("component")))
    now = cut(edges.filter("i <> j").select(*key(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"))).distinct(), "stars")
    size = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*key("i", "j")).cast("decimal(38,0)"))).first())
    before, state = None, size(now)
    while state != before and state[0]:
        both = now.unionByName(now.select(*key(F.col("j").alias("i"), F.col("i").alias("j"))))
        least = both.groupBy(*key("i")).agg(F.least(F.first("i"), F.min("j")).alias("m"))
        large = both.join(least, key("i")).filter("j > i").select(*key(F.col("j").alias("i"), F.col("m").alias("j"))).distinct()
        least = large.groupBy(*key("i")).agg(F.min("j").alias("m"))
        own = large.join(least, key("i"))
        small = own.select(*key("i", F.col("m").alias("j"))).unionByName(own.filter("j <> m").select(*key(F.col("j").alias("i"), F.col("m").alias("j"))))
        now = cut(small.distinct(), "stars")
        before, state = state, size(now)
    found = now.select(*key(F.col("i").alias("node"), F.col("j").alias("component"))).unionByName(now.select(*key(F.col("j").alias("node"), F.col("j").alias("component")))).unionByName(loops)
    return found.groupBy(*key("node")).agg(F.min("component").alias("component"))


def giant_component(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The edges of the component with most nodes; of equal ones that with the least node."""
    by = list(by)
    found = components(edges, by)
    sizes = found.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("s")).select(*by, F.col("s.component").alias("component"))
    members = found.join(largest, [*by, "component"]).select(*by, F.col("node").alias("i"))
    return edges.join(members, [*by, "i"], "left_semi")


def row_normalised(edges: DataFrame, weight: str = "phi") -> DataFrame:
    """Each edge in both directions, its weight divided by the sum of those that leave ``i``."""
    ways = both_ways(edges, weight)
    out = ways.groupBy("i").agg(F.sum(weight).alias("_s"))
    return ways.join(out, "i").select("i", "j", (F.col(weight) / F.col("_s")).alias(weight))


def diffusion(starts: DataFrame, ways: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, weight: str = "phi") -> DataFrame:
    """start, topic, f: alpha theta + (1 - alpha) f W iterated from theta, for all starts at once.

    ``starts``: start, topic, theta.  ``ways``: directed i, j, weight.  A round
    is one join over the edges.  A start whose sum of changes falls under
    ``tolerance`` stops there, with what it had before that round, and takes no
    part in later ones.
    """
    starts = cut(starts.select("start", "topic", F.col("theta").cast("double").alias("theta")), "starts")
    open_, out = starts.withColumnRenamed("theta", "f"), None
    for _ in range(rounds):
        sent = open_.join(ways.select(F.col("i").alias("topic"), "j", weight), "topic").groupBy("start", F.col("j").alias("topic")).agg(F.sum(F.col("f") * F.col(weight)).alias("_sent"))
        zero = F.lit(0.0)
        running = starts.join(open_.select("start").distinct(), "start", "left_semi")
        parts = (
            running.select("start", "topic", (alpha * F.col("theta")).alias("new"), zero.alias("old"))
            .unionByName(sent.select("start", "topic", ((1 - alpha) * F.col("_sent")).alias("new"), zero.alias("old")))
            .unionByName(open_.select("start", "topic", zero.alias("new"), F.col("f").alias("old")))
        )
        step = parts.groupBy("start", "topic").agg(F.sum("new").alias("new"), F.sum("old").alias("old"))
        moved = F.sum(F.abs(F.col("new") - F.col("old"))).over(Window.partitionBy("start"))
        step = cut(step.withColumn("done", moved < tolerance), "diffusion")
        ended = step.filter("done").select("start", "topic", F.col("old").alias("f"))
        out = ended if out is None else out.unionByName(ended)
        open_ = step.filter("not done").select("start", "topic", F.col("new").alias("f"))
        if not open_.limit(1).count():
            return out.filter("f <> 0")
    return (open_ if out is None else out.unionByName(open_)).filter("f <> 0")


def _smoothed(p: Column, start: Sequence[str]) -> Column:
    """A nonnegative value with 1e-12 added, scaled so that those of its start add up to 1."""
    return (p + 1e-12) / F.sum(p + 1e-12).over(Window.partitionBy(*start))


def divergences(profiles: DataFrame, start: Sequence[str] = ("start",)) -> DataFrame:
    """start, kl (of theta from f), js (distance), e (entropy of theta), from every topic's theta and f."""
    rows = profiles.withColumns({"p": _smoothed(F.col("theta"), start), "q": _smoothed(F.col("f"), start)})
    middle = (F.col("p") + F.col("q")) / 2
    kl = lambda a, b: F.sum(a * F.log(a / b))
    found = rows.groupBy(*start).agg(
        kl(F.col("p"), F.col("q")).alias("kl"), ((kl(F.col("p"), middle) + kl(F.col("q"), middle)) / 2).alias("_js"), (-F.sum(F.col("p") * F.log("p"))).alias("e")
    )
    return found.select(*start, "kl", F.sqrt(F.greatest("_js", F.lit(0.0))).alias("js"), "e")


def diffused_interests(shares: DataFrame, edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """actor, kl, js, kl_norm, baseline_kl, kl_excess, baseline_js, js_excess, form, e.

    ``shares``: actor, topic, theta (adding up to 1 for each actor).  The
    baselines are what single topics, diffused alone, lose: an actor's mean of
    -ln f(t) at t itself and of the distance of t alone from its diffusion.
    Weights are normalised by row, so that the iteration converges.  An actor of
    a single topic, without entropy, is left out.
    """
    ways = cut(row_normalised(edges), "ways")
    topics = cut(shares.select("topic").union(ways.select("i")).distinct(), "topics")
    held = shares.filter("theta > 0")
    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")).alias("start")
    starts = cut(held.select(kind("actor", "actor"), "topic", "theta").unionByName(topics.select(kind("topic", "topic"), "topic", F.lit(1.0).alias("theta"))), "starts")
    f = cut(diffusion(starts, ways, alpha, tolerance, rounds), "diffused")
    dense = starts.select("start").distinct().crossJoin(topics).join(starts, ["start", "topic"], "left").join(f, ["start", "topic"], "left").fillna(0.0, ["theta", "f"])
    losses = cut(divergences(dense), "losses")
    alone = losses.filter("start.kind = 'topic'").select(F.col("start.name").alias("topic"), F.col("js").alias("_js"))
    stays = f.filter("start.kind = 'topic' and start.name = topic").select("topic", (-F.log(F.col("f") + 1e-12)).alias("_kl"))
    base = held.join(alone, "topic").join(stays, "topic").groupBy("actor").agg(F.sum(F.col("theta") * F.col("_kl")).alias("baseline_kl"), F.sum(F.col("theta") * F.col("_js")).alias("baseline_js"))
    own = f.filter("start.kind = 'actor'").select(F.col("start.name").alias("actor"), "topic", "f")
    form = own.withColumnRenamed("topic", "i").join(ways, "i").join(own.select("actor", F.col("topic").alias("j"), F.col("f").alias("g")), ["actor", "j"]).groupBy("actor").agg(F.sum(F.col("f") * F.col("phi") * F.col("g")).alias("form"))
    rows = losses.filter("start.kind = 'actor' and e > 1e-8").select(F.col("start.name").alias("actor"), "kl", "js", "e").join(base, "actor").join(form, "actor", "left")
    return rows.select(
        "actor", "kl", "js", (F.col("kl") / F.col("e")).alias("kl_norm"), "baseline_kl", (F.col("kl") - F.col("baseline_kl")).alias("kl_excess"), "baseline_js",
        (F.col("js") - F.col("baseline_js")).alias("js_excess"), F.coalesce("form", F.lit(0.0)).alias("form"), "e",
    )
