"""Validation of regions, triplets and pairs by region, transport between profiles, flags, spread selections and the ribbon document."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions import kernels
from loomwork.operators import pairs, resample, sequence, space, stats
from loomwork.plans.facts import SQL, activity, table
from loomwork.plans.queries_models import coordinates, space_matrix
from loomwork.plans.queries_pairs import PAIRS, held, overlap
from loomwork.plans.queries_panel import held as held_yearly
from loomwork.plans.queries_sequence import FLOWS
from loomwork.plans.queries_space import REGIONS, counts, rounded, shares
from loomwork.plans.registry import ORACLES, QUERIES, query

DRAWS = 200
#: Fixed values of the label selection: how many, bonuses of peaks and of bins' best, floor, bins, candidates, gap and its least.
TARGET, PEAK_BONUS, BIN_BONUS, FLOOR, BINS, CANDIDATES, GAP, LEAST_GAP = 16, 0.14, 0.08, 0.2, 14, 36, 0.028, 0.01


def profiles(spark, d):
    """Topics in the order of the first axis, their places on it from 0 to 1, actors, and the excess of every actor (row) and topic.

    As large as the universes of actors and topics.
    """
    labels, x, _ = coordinates(spark, d)
    order = np.argsort(x[:, 0], kind="stable")
    topics = [labels[k] for k in order]
    place = x[order, 0] - x[:, 0].min()
    spec = space.specialization(counts(spark, d)).select("actor", "topic", F.greatest(F.col("rca") - 1, F.lit(0.0)).alias("v")).filter("v > 0").collect()
    actors = sorted({r["actor"] for r in spec})
    at, who = {t: k for k, t in enumerate(topics)}, {a: k for k, a in enumerate(actors)}
    out = np.zeros((len(actors), len(topics)))
    for r in spec:
        out[who[r["actor"]], at[r["topic"]]] = r["v"]
    return topics, place / max(place.max(initial=0), 1e-12), actors, out


def region_weights(excess: np.ndarray, region: np.ndarray, k: int) -> np.ndarray:
    """Each actor's share of its excess in each of k regions."""
    w = excess @ np.eye(k)[region]
    return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)


def partition(place: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The centres and the region of every place, from 0."""
    centres, cuts = kernels.centre_partition(place, weight, k)
    return centres, np.searchsorted(cuts, place, side="right")


@query("i24_region_counts")
def i24(spark, d):
    """How well 2 to 6 regions keep what portfolios tell: inertia, rank correlation of pair similarities, anchoring, least sizes, gains."""
    _, place, _, excess = profiles(spark, d)
    signal = excess.sum(axis=0)
    weight = kernels.smooth(signal)
    upper = np.triu_indices(len(excess), 1)
    whole = kernels.cosines(excess)[upper]
    out = []
    for k in range(2, 7):
        centres, region = partition(place, weight, k)
        share = region_weights(excess, region, k)
        top = share.max(axis=1)
        out.append((
            k, float((weight * (place - centres[region]) ** 2).sum()), kernels.rank_correlation(whole, kernels.cosines(share)[upper]), float(top.mean()), float(np.median(top)),
            float((top >= 0.7).mean()), int(np.bincount(region, minlength=k).min()), float(np.bincount(region, weights=signal, minlength=k).min() / max(signal.sum(), 1e-12)),
        ))
    rows = spark.createDataFrame(out, "k int, inertia double, similarity_rho double, mean_dominant double, median_dominant double, anchored double, least_topics int, least_signal double")
    w = Window.orderBy("k")
    return rows.withColumns({
        "inertia_gain": F.lag("inertia").over(w) - F.col("inertia"), "rho_gain": F.col("similarity_rho") - F.lag("similarity_rho").over(w), "dominant_drop": F.lag("mean_dominant").over(w) - F.col("mean_dominant"),
    })


@query("i26_partition_agreement")
def i26(spark, d):
    """For 3 and 4 regions: topics that change region where all topics weigh the same, and the share of actors that keep their dominant region."""
    _, place, _, excess = profiles(spark, d)
    out = []
    for k in (3, 4):
        a, b = (partition(place, w, k)[1] for w in (kernels.smooth(excess.sum(axis=0)), np.ones(len(place))))
        same = region_weights(excess, a, k).argmax(axis=1) == region_weights(excess, b, k).argmax(axis=1)
        out.append((k, int((a != b).sum()), float(same.mean())))
    return spark.createDataFrame(out, "k int, topics_changed int, dominant_agreement double")


TRIPLET_SHARES = REGIONS + PAIRS[len(SQL):] + """, ks AS (SELECT actor, list(topic) AS s FROM sup GROUP BY actor),
pv AS (SELECT actor, coalesce(sum(share) FILTER (region = 1), 0) AS s1, coalesce(sum(share) FILTER (region = 2), 0) AS s2, coalesce(sum(share) FILTER (region = 3), 0) AS s3 FROM sh GROUP BY actor),
ts AS (SELECT x.actor AS a, y.actor AS b, z.actor AS c, (p.s1 + q.s1 + r.s1) / 3 AS m1, (p.s2 + q.s2 + r.s2) / 3 AS m2, (p.s3 + q.s3 + r.s3) / 3 AS m3, len(list_distinct(x.s || y.s || z.s)) * 1.0 / (len(x.s) + len(y.s) + len(z.s)) AS coverage
  FROM ks x JOIN ks y ON x.actor < y.actor JOIN ks z ON y.actor < z.actor JOIN pv p ON p.actor = x.actor JOIN pv q ON q.actor = y.actor JOIN pv r ON r.actor = z.actor)
"""  # fmt: skip


def triplet_shares(spark, d):
    """Every triplet's coverage and its members' mean share of each region."""
    wide = shares(spark, d).groupBy("actor").agg(*[F.sum(F.when(F.col("region") == k, F.col("share")).otherwise(0.0)).alias(f"s{k}") for k in (1, 2, 3)])
    rows = pairs.triple_coverage(held(spark, d)).select("a", "b", "c", F.col("coverage_efficiency").alias("coverage"))
    for x in "abc":
        rows = rows.join(wide.toDF(x, *[f"{x}{k}" for k in (1, 2, 3)]), x)
    return rows.select("a", "b", "c", "coverage", *[((F.col(f"a{k}") + F.col(f"b{k}") + F.col(f"c{k}")) / 3).alias(f"m{k}") for k in (1, 2, 3)])


@query("i32_triplet_shares", TRIPLET_SHARES + "SELECT a, b, c, round(m1, 6) AS share_1, round(m2, 6) AS share_2, round(m3, 6) AS share_3 FROM ts")
def i32(spark, d):
    return triplet_shares(spark, d).select("a", "b", "c", *[F.round(f"m{k}", 6).alias(f"share_{k}") for k in (1, 2, 3)])


@query("i32b_share_lines", TRIPLET_SHARES + """, l AS (SELECT region, CASE region WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE m3 END AS x, coverage AS y FROM ts, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS region)),
r AS (SELECT *, rank() OVER (PARTITION BY region ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY region, round(x, 9)) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY region ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY region, round(y, 9)) - 1) / 2.0 AS ry FROM l)
SELECT region, round(corr(rx, ry), 6) AS rho, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS n FROM r GROUP BY region""")
def i32b(spark, d):
    """Rank correlation and line of a triplet's coverage on its mean share of each region; coverage as it is, not less that of triplets alike in size."""
    rows = triplet_shares(spark, d).unpivot(["a", "b", "c", "coverage"], ["m1", "m2", "m3"], "region", "x")
    rows = rows.select(F.substring("region", 2, 1).cast("int").alias("region"), "x", F.col("coverage").alias("y"), F.round("x", 9).alias("rx"), F.round("coverage", 9).alias("ry"))
    rho = stats.spearman(rows, "rx", "ry", ["region"]).select("region", *rounded("rho"))
    return rho.join(stats.line_fit(rows, "x", "y", ["region"]).select("region", *rounded("slope", "intercept"), "n"), "region")


@query("i34_transport")
def i34(spark, d):
    """The least cost of moving one actor's excess onto another's over the gaps of the three axes, a pair at a time on the executors."""
    labels, x, _ = coordinates(spark, d)
    cost = spark.sparkContext.broadcast(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)))
    at = {t: k for k, t in enumerate(labels)}
    spec = space.specialization(counts(spark, d)).select("actor", "topic", F.greatest(F.col("rca") - 1, F.lit(0.0)).alias("v")).filter("v > 0")
    own = spec.groupBy("actor").agg(F.map_from_entries(F.collect_list(F.struct("topic", "v"))).alias("m"))
    both = own.toDF("a", "m").join(own.toDF("b", "n"), F.col("a") < F.col("b")).repartition("a", "b")

    def run(batches):
        for pdf in batches:
            found = []
            for m, n in zip(pdf["m"], pdf["n"], strict=True):
                i, j = (np.array([at[t] for t in v], dtype=int) for v in (m, n))
                found.append(kernels.transport(np.array(list(m.values())), np.array(list(n.values())), cost.value[np.ix_(i, j)]))
            yield pdf[["a", "b"]].assign(emd=found)

    return both.mapInPandas(run, "a string, b string, emd double")


@query("i44_topic_communities")
def i44(spark, d):
    """Communities of topics by greedy modularity, numbered from the largest; ties by the first topic."""
    labels, w = space_matrix(spark, d)
    member = kernels.communities(w)
    groups = sorted((np.flatnonzero(member == c).tolist() for c in np.unique(member)), key=lambda g: (-len(g), g[0]))
    return spark.createDataFrame([(labels[i], k + 1, len(g)) for k, g in enumerate(groups) for i in g], "topic string, community int, size int")


def _fitted(x: str, y: str) -> str:
    """CTEs that turn pt (actor, x, y) into fit: the quadratic by the part of the square that the line leaves over."""
    return f""", u AS (SELECT *, {x} - avg({x}) OVER () AS u FROM pt), sm AS (SELECT avg(u * u) AS s2, sum(u * u * u) / sum(u * u) AS s3 FROM u), o AS (SELECT u.*, u * u - s2 - s3 * u AS q FROM u, sm),
fc AS (SELECT avg({y}) AS a, sum(u * {y}) / sum(u * u) AS b, sum(q * {y}) / sum(q * q) AS c FROM o), fit AS (SELECT o.*, {y} - (a + b * u + c * q) AS residual FROM o, fc)"""


@query("i56_flags", "WITH pt AS (SELECT actor, CAST(topics_adopted AS DOUBLE) AS x, pioneer_index AS y FROM (" + ORACLES["l03_pioneer_index"] + "))" + _fitted("x", "y") + """,
z AS (SELECT actor, residual, (x - avg(x) OVER ()) / stddev_pop(x) OVER () + (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS z FROM fit),
k AS (SELECT actor, row_number() OVER (ORDER BY round(z, 6) DESC, actor) <= 7 AS top_right, row_number() OVER (ORDER BY round(residual, 6) DESC, actor) <= 4 AS above, row_number() OVER (ORDER BY round(residual, 6), actor) <= 4 AS below FROM z)
SELECT * FROM k WHERE top_right OR above OR below""")  # fmt: skip
def i56(spark, d):
    """Actors to flag: seven of the highest sum of z-scores, four farthest above the quadratic of breadth, four farthest below; the limits are the feature."""
    rows = QUERIES["l03_pioneer_index"](spark, d).select("actor", F.col("topics_adopted").cast("double").alias("x"), F.col("pioneer_index").alias("y"))
    curve = stats.quadratic_fit(rows, "x", "y")
    scaled = stats.z_score(stats.z_score(rows, "x").withColumnRenamed("z", "zx"), "y").withColumnRenamed("z", "zy")
    each = scaled.crossJoin(curve).select("actor", F.round(F.col("zx") + F.col("zy"), 6).alias("z"), F.round(F.col("y") - F.expr("c0 + c1 * x + c2 * x * x"), 6).alias("residual"))
    among = lambda order, n: F.row_number().over(Window.orderBy(order, "actor")) <= n
    return each.select("actor", among(F.desc("z"), 7).alias("top_right"), among(F.desc("residual"), 4).alias("above"), among(F.col("residual"), 4).alias("below")).filter("top_right or above or below")


@query("j10_class_pairs", REGIONS + PAIRS[len(SQL):] + ", cl AS (" + ORACLES["c20_fuzzy_class"][len(REGIONS):] + """), f AS (SELECT a, b, a || '-' || b AS pair, least(k_a, k_b) AS lo, greatest(k_a, k_b) AS hi, jaccard AS v FROM po),
z AS (SELECT *, round((lo - avg(lo) OVER ()) / stddev_pop(lo) OVER (), 9) AS z1, round((hi - avg(hi) OVER ()) / stddev_pop(hi) OVER (), 9) AS z2 FROM f),
n AS (SELECT q.a, q.b, q.v, r.v AS w, row_number() OVER (PARTITION BY q.pair ORDER BY round(pow(q.z1 - r.z1, 2) + pow(q.z2 - r.z2, 2), 9), r.pair) AS k FROM z q JOIN z r ON q.pair <> r.pair),
rd AS (SELECT a, b, any_value(v) AS v, any_value(v) - avg(w) AS residual FROM n WHERE k <= 25 GROUP BY a, b), dr AS (SELECT CAST(unnest(range(1, 201)) AS INTEGER) AS draw), lb AS (SELECT actor, class, row_number() OVER (ORDER BY actor) AS place FROM cl),
sf AS (SELECT draw, actor, row_number() OVER (PARTITION BY draw ORDER BY md5('10:' || draw || ':' || actor), actor) AS place FROM lb, dr), pl AS (SELECT draw, sf.actor, class FROM sf JOIN lb USING (place) UNION ALL SELECT 0, actor, class FROM cl),
m AS (SELECT x.draw, least(x.class, y.class) || '|' || greatest(x.class, y.class) AS classes, avg(residual) AS m, avg(v) AS v, count(*) AS n FROM rd JOIN pl x ON x.actor = a JOIN pl y ON y.actor = b AND y.draw = x.draw GROUP BY ALL),
s AS (SELECT classes, m AS observed, v, n FROM m WHERE draw = 0)
SELECT classes, round(any_value(s.v), 6) AS overlap, round(any_value(observed), 6) AS residual, any_value(s.n) AS n, round(avg(m) FILTER (draw > 0), 6) AS null_mean,
  round((count(*) FILTER (draw > 0 AND abs(round(m, 9)) >= abs(round(observed, 9))) + 1) / (count(*) FILTER (draw > 0) + 1.0), 6) AS p FROM s JOIN m USING (classes) GROUP BY classes""")  # fmt: skip
def j10(spark, d):
    """Mean overlap of each pair of classes, less that of pairs alike in breadth, against classes dealt anew to the actors; p is two-sided, add-one."""
    rows = overlap(spark, d).select("a", "b", F.concat_ws("-", "a", "b").alias("pair"), F.least("k_a", "k_b").alias("lo"), F.greatest("k_a", "k_b").alias("hi"), "jaccard")
    left = rows.select("a", "b", "pair").join(pairs.matched_residual(rows, "pair", ["lo", "hi"], "jaccard", 25), "pair")
    own = QUERIES["c20_fuzzy_class"](spark, d)
    place = own.select("class", F.row_number().over(Window.orderBy("actor")).alias("place"))
    dealt = resample.draws(own.select("actor"), DRAWS).withColumn("place", F.row_number().over(Window.partitionBy("draw").orderBy(resample.draw_key(10, "draw", "actor"), "actor")))
    dealt = dealt.join(place, "place").select("draw", "actor", "class").unionByName(own.select(F.lit(0).alias("draw"), "actor", "class"))
    both = left.join(dealt.toDF("draw", "a", "x"), "a").join(dealt.toDF("draw", "b", "y"), ["draw", "b"])
    classes = F.concat_ws("|", F.least("x", "y"), F.greatest("x", "y")).alias("classes")
    means = both.groupBy("draw", classes).agg(F.avg("residual").alias("m"), F.avg("jaccard").alias("overlap"), F.count(F.lit(1)).alias("n"))
    seen = means.filter("draw = 0").select("classes", F.col("m").alias("residual"), "overlap", "n")
    null = means.filter("draw > 0").select("classes", "m")
    far = F.abs(F.round("m", 9)) >= F.abs(F.round("residual", 9))
    out = seen.join(null, "classes", "left").groupBy("classes", "overlap", "residual", "n").agg(F.avg("m").alias("null_mean"), ((F.count(F.when(far, 1)) + 1) / (F.count("m") + 1)).alias("p"))
    return out.select("classes", *rounded("overlap", "residual"), "n", *rounded("null_mean", "p"))


@query("k09_spread_labels")
def k09(spark, d):
    """Topics to label: strong ones, peaks and the best of bins first, that keep a gap on the first axis; the gap shrinks twice."""
    topics, place, _, excess = profiles(spark, d)
    signal = kernels.smooth(excess.sum(axis=0))
    signal = signal / max(signal.max(initial=0), 1e-12)
    liked = dict.fromkeys(np.argsort(-signal, kind="stable")[:CANDIDATES].tolist(), 0.0)
    for found, bonus in ((kernels.peaks(signal, TARGET), PEAK_BONUS), (kernels.best_of_bins(signal, place, BINS, FLOOR), BIN_BONUS)):
        for k in found:
            liked[k] = liked.get(k, 0.0) + bonus
    taken = kernels.spread_selection(signal, place, liked, TARGET, tuple(max(GAP * s, LEAST_GAP) for s in (1, 0.82, 0.66)))
    return spark.createDataFrame([(k + 1, topics[t], float(place[t]), float(signal[t])) for k, t in enumerate(taken)], "number int, topic string, place double, score double")


@query("b05_ribbon_json", FLOWS + """, tp AS (SELECT p_name AS topic, min(p_type) AS theme FROM part GROUP BY 1), sp AS (SELECT topic, min(year) AS f, max(year) AS l FROM ysup GROUP BY topic),
nd AS (SELECT year, topic, any_value(theme) AS theme, count(*) AS n, bool_or(year = f) AS first, bool_or(year = l) AS last, list(actor ORDER BY actor) AS actors FROM ysup JOIN sp USING (topic) JOIN tp USING (topic) GROUP BY year, topic),
ln AS (SELECT prev, a.topic AS source, next, b.topic AS target, CAST(round(1000000 * round(sum(1.0 / (a.n * b.n)), 6)) AS BIGINT) AS support, list(a.actor ORDER BY a.actor) AS actors FROM sz a JOIN st ON a.year = prev JOIN sz b ON b.year = next AND b.actor = a.actor GROUP BY ALL)
SELECT 'node' AS kind, year || '::' || topic AS id, CAST(to_json({'period': year, 'topic': topic, 'theme': theme, 'count': n, 'is_start': first, 'is_end': last, 'actors': actors}) AS VARCHAR) AS json FROM nd
UNION ALL SELECT 'link', prev || '::' || source || '-->' || next || '::' || target, CAST(to_json({'source': prev || '::' || source, 'target': next || '::' || target, 'value': len(actors), 'support_millionths': support, 'actors': actors}) AS VARCHAR) FROM ln
UNION ALL SELECT 'path', actor, CAST(to_json(list({'period': year, 'topic': topic} ORDER BY year, topic)) AS VARCHAR) FROM ysup GROUP BY actor
UNION ALL SELECT 'theme', theme, CAST(to_json({'nodes': count(*), 'topics': count(DISTINCT topic)}) AS VARCHAR) FROM nd GROUP BY theme""")
def b05(spark, d):
    """The ribbon document, an element a row: nodes by period and topic, links between consecutive periods, each actor's path, counts by theme."""
    sup = held_yearly(spark, d)
    name = lambda p, t: F.concat_ws("::", F.col(p).cast("string"), F.col(t))
    theme = table(spark, d, "part").groupBy(F.col("p_name").alias("topic")).agg(F.min("p_type").alias("theme"))
    span = sup.groupBy("topic").agg(F.min("period").alias("f"), F.max("period").alias("l"))
    actors = F.sort_array(F.collect_list("actor")).alias("actors")
    node = sup.groupBy("period", "topic").agg(F.count(F.lit(1)).alias("count"), actors).join(span, "topic").join(theme, "topic")
    node = node.withColumns({"is_start": F.col("period") == F.col("f"), "is_end": F.col("period") == F.col("l")})
    link = sequence.flows(sup, with_entities=True).select(name("prev", "source").alias("source"), name("next", "target").alias("target"), F.col("entities").alias("value"), F.round(1000000 * F.round("mass", 6)).cast("long").alias("support_millionths"), F.col("held_by").alias("actors"))
    path = sup.groupBy("actor").agg(F.sort_array(F.collect_list(F.struct("period", "topic"))).alias("path"))
    counted = node.groupBy("theme").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("topic").alias("topics"))
    row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), key.alias("id"), F.to_json(value).alias("json"))
    out = row(node, "node", name("period", "topic"), F.struct("period", "topic", "theme", "count", "is_start", "is_end", "actors"))
    out = out.unionByName(row(link, "link", F.concat_ws("-->", "source", "target"), F.struct("source", "target", "value", "support_millionths", "actors")))
    return out.unionByName(row(path, "path", F.col("actor"), F.col("path"))).unionByName(row(counted, "theme", F.col("theme"), F.struct("nodes", "topics")))
