"""Pair attributes, region pairs, trajectories, lookbacks, replicates, group models and small table operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions import kernels
from loomwork.operators import cube, models, pairs, panel, resample, space, stats
from loomwork.plans.facts import SQL, activity, table
from loomwork.plans.queries_pairs import PAIRS, distances, held, overlap, places
from loomwork.plans.queries_panel import PANEL, adoption, edges_in, held_in, written
from loomwork.plans.queries_space import REGIONS, counts, edges, regions, rounded, yearly
from loomwork.plans.registry import query

ATTRIBUTES = ("mixed", "both", "one_of", "same_bloc")
PAIR_SQL = PAIRS + """, mb AS (SELECT n_name AS actor, n_nationkey % 2 AS member, CAST(n_nationkey % 3 = 0 AS INTEGER) AS gate, n_regionkey AS bloc FROM nation),
pt AS (SELECT a || '-' || b AS pair, CAST(x.member <> y.member AS INTEGER) AS mixed, CAST(x.member = 1 AND y.member = 1 AS INTEGER) AS "both", CAST(x.gate + y.gate = 1 AS INTEGER) AS one_of,
  CAST(x.bloc = y.bloc AS INTEGER) AS same_bloc, CASE WHEN least(k_a, k_b) * 2 > greatest(k_a, k_b) THEN 'alike' ELSE 'other' END AS label FROM po JOIN mb x ON x.actor = a JOIN mb y ON y.actor = b)
"""


def pair_attributes(spark, d):
    """What the two members of each pair are: mixed or both members, one gateway, same bloc; label: whether their breadths are alike."""
    k = F.col("n_nationkey")
    own = table(spark, d, "nation").select(F.col("n_name").alias("actor"), (k % 2).alias("member"), (k % 3 == 0).cast("int").alias("gate"), F.col("n_regionkey").alias("bloc"))
    x, y = (own.select([F.col(c).alias(f"{c}_{s}") for c in own.columns]) for s in "ab")
    rows = overlap(spark, d).join(x, F.col("a") == F.col("actor_a")).join(y, F.col("b") == F.col("actor_b"))
    flag = lambda c: c.cast("int")
    return rows.select(
        F.concat_ws("-", "a", "b").alias("pair"), flag(F.col("member_a") != F.col("member_b")).alias("mixed"), flag((F.col("member_a") == 1) & (F.col("member_b") == 1)).alias("both"),
        flag(F.col("gate_a") + F.col("gate_b") == 1).alias("one_of"), flag(F.col("bloc_a") == F.col("bloc_b")).alias("same_bloc"),
        F.when(F.least("k_a", "k_b") * 2 > F.greatest("k_a", "k_b"), "alike").otherwise("other").alias("label"),
    )


@query("j15_pair_attributes", PAIR_SQL + 'SELECT pair, mixed, "both", one_of, same_bloc, label FROM pt')
def j15(spark, d):
    return pair_attributes(spark, d)


def _permuted(attribute: str) -> str:
    return f"""SELECT '{attribute}' AS attribute, label, round(any_value(observed), 6) AS observed, any_value(n) AS n, round(avg(m), 6) AS null_mean, round((count(*) FILTER (abs(round(m - a, 9)) >= abs(round(observed - a, 9))) + 1) / 201.0, 6) AS p
FROM (SELECT label, draw, avg(sh."{attribute}") AS m FROM sh JOIN nb USING (place) GROUP BY ALL) JOIN (SELECT label, avg("{attribute}") AS observed, count(*) AS n FROM pt GROUP BY label) USING (label), (SELECT avg("{attribute}") AS a FROM pt) GROUP BY label"""


@query("j09_attribute_permutation", PAIR_SQL + """, nb AS (SELECT label, row_number() OVER (ORDER BY pair) AS place FROM pt), dr AS (SELECT CAST(unnest(range(1, 201)) AS INTEGER) AS draw),
sh AS (SELECT draw, mixed, "both", one_of, same_bloc, row_number() OVER (PARTITION BY draw ORDER BY md5('9:' || draw || ':' || pair), pair) AS place FROM pt, dr)
""" + " UNION ALL ".join(map(_permuted, ATTRIBUTES)))  # fmt: skip
def j09(spark, d):
    """The share of pairs with an attribute among those alike in breadth and the others, against labels dealt anew."""
    rows = pair_attributes(spark, d)
    one = lambda a: resample.label_permutation(rows, "pair", "label", a, 200, seed=9).select(F.lit(a).alias("attribute"), "label", *rounded("observed"), "n", *rounded("null_mean", "p"))
    return reduce(DataFrame.unionByName, map(one, ATTRIBUTES))


@query("j14_region_pairs", PAIRS + """, dr AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS draw), w AS (SELECT topic, count(*) AS w FROM sup GROUP BY topic),
rk AS (SELECT draw, k.actor, topic, k, row_number() OVER (PARTITION BY draw, k.actor ORDER BY round(-ln((CAST('0x' || substring(md5('14:' || draw || ':' || k.actor || ':' || topic), 1, 8) AS BIGINT) + 0.5) / 4294967296.0) / w, 12), topic) AS r FROM k, w, dr),
nl AS (SELECT draw, actor, topic FROM rk WHERE r <= k UNION ALL SELECT 0, actor, topic FROM sup), ns AS (SELECT draw, actor, list(topic) AS s FROM nl GROUP BY ALL),
np AS (SELECT x.draw, least(g.bloc, h.bloc) || '-' || greatest(g.bloc, h.bloc) AS pair, len(list_intersect(x.s, y.s)) * 1.0 / len(list_distinct(x.s || y.s)) AS jaccard FROM ns x JOIN ns y ON x.draw = y.draw AND x.actor < y.actor JOIN geo g ON g.actor = x.actor JOIN geo h ON h.actor = y.actor),
nm AS (SELECT draw, pair, avg(jaccard) AS m, count(*) AS n FROM np GROUP BY ALL)
SELECT pair, round(any_value(m) FILTER (draw = 0), 6) AS observed, any_value(n) AS n, round(avg(m) FILTER (draw > 0), 6) AS null_mean, round(any_value(m) FILTER (draw = 0) - avg(m) FILTER (draw > 0), 6) AS gap FROM nm GROUP BY pair""")
def j14(spark, d):
    """Mean overlap by pair of blocs, against portfolios drawn by popularity."""
    sup = held(spark, d).select("actor", "topic")
    null = resample.weighted_row_null(sup, 5, seed=14).unionByName(sup.select(F.lit(0).alias("draw"), "actor", "topic"))
    bloc = places(spark, d).select("actor", "bloc")
    rows = pairs.pair_overlap(null, ("draw",)).join(bloc.toDF("a", "x"), "a").join(bloc.toDF("b", "y"), "b")
    mean = rows.groupBy("draw", F.concat_ws("-", F.least("x", "y"), F.greatest("x", "y")).alias("pair")).agg(F.avg("jaccard").alias("m"), F.count(F.lit(1)).alias("n"))
    out = mean.groupBy("pair").agg(F.max(F.when(F.col("draw") == 0, F.col("m"))).alias("observed"), F.max("n").alias("n"), F.avg(F.when(F.col("draw") > 0, F.col("m"))).alias("null_mean"))
    return out.select("pair", *rounded("observed"), "n", *rounded("null_mean"), F.round(F.col("observed") - F.col("null_mean"), 6).alias("gap"))


@query("l06_entry_rank", PANEL + """, rk AS (SELECT period, actor, topic, adopted, rank() OVER w AS r, count(*) OVER (PARTITION BY period, actor) AS n, count(*) OVER (PARTITION BY period, actor, round(closeness, 9)) AS ties
  FROM panel WINDOW w AS (PARTITION BY period, actor ORDER BY round(closeness, 9)))
SELECT period, round(avg((r - 1 + (ties - 1) / 2.0) / (n - 1)), 6) AS entry_rank, count(*) AS entries FROM rk WHERE adopted = 1 AND n > 1 GROUP BY period""")
def l06(spark, d):
    """Where the topics that an actor enters stand among all that it could enter, by fit: 0 the least, 1 the best; ties share a rank."""
    who = ("period", "actor")
    fit = F.round("closeness", 9)
    rows = adoption(spark, d).withColumns({
        "r": F.rank().over(Window.partitionBy(*who).orderBy(fit)), "n": F.count(F.lit(1)).over(Window.partitionBy(*who)), "ties": F.count(F.lit(1)).over(Window.partitionBy(*who, fit)),
    })
    rank = (F.col("r") - 1 + (F.col("ties") - 1) / 2.0) / (F.col("n") - 1)
    return rows.filter("adopted = 1 and n > 1").groupBy("period").agg(F.round(F.avg(rank), 6).alias("entry_rank"), F.count(F.lit(1)).alias("entries"))


@query("l09_trajectories", REGIONS + """, wc AS (SELECT w.year AS period, actor, topic, CAST(sum(x) AS BIGINT) AS x FROM years w JOIN ycube y ON y.year BETWEEN w.year - 2 AND w.year GROUP BY ALL),
wm AS (SELECT *, CAST(sum(x) OVER (PARTITION BY period, actor) AS BIGINT) AS c, CAST(sum(x) OVER (PARTITION BY period, topic) AS BIGINT) AS p, CAST(sum(x) OVER (PARTITION BY period) AS BIGINT) AS t FROM wc),
wr AS (SELECT *, (x * 1.0 / c) / (p * 1.0 / t) AS rca FROM wm WHERE CAST(x AS HUGEINT) * t > CAST(c AS HUGEINT) * p), ps AS (SELECT topic, region, row_number() OVER (ORDER BY topic) AS position FROM reg)
SELECT period, actor, round(sum(rca * position) / sum(rca), 6) AS position, round(coalesce(sum(rca) FILTER (region = 1), 0) / sum(rca), 6) AS share_1, round(coalesce(sum(rca) FILTER (region = 2), 0) / sum(rca), 6) AS share_2,
round(coalesce(sum(rca) FILTER (region = 3), 0) / sum(rca), 6) AS share_3 FROM wr JOIN ps USING (topic) GROUP BY ALL""")
def l09(spark, d):
    """Each actor's weighted position and region shares in windows of three years."""
    rows = yearly(spark, d)
    ends = rows.select(F.col("year").alias("period")).distinct()
    wide = rows.withColumn("period", F.explode(F.sequence(F.col("year"), F.col("year") + 2))).join(ends, "period", "left_semi")
    spec = space.specialization(wide.groupBy("period", "actor", "topic").agg(F.sum("x").alias("x")), ["period"])
    at = regions(spark, d).withColumn("position", F.row_number().over(Window.orderBy("topic")))
    active = spec.filter("active").join(at, "topic")
    share = lambda k: F.round(F.sum(F.when(F.col("region") == k, F.col("rca")).otherwise(0.0)) / F.sum("rca"), 6).alias(f"share_{k}")
    return active.groupBy("period", "actor").agg(F.round(F.sum(F.col("rca") * F.col("position")) / F.sum("rca"), 6).alias("position"), *map(share, (1, 2, 3)))


def _lookback(lag: int) -> str:
    panel_sql = PANEL.replace("lag(year) OVER", f"lag(year, {lag}) OVER")
    return f"SELECT * FROM ({panel_sql} SELECT {lag} AS lookback, prev, period, actor, topic, adopted, round(closeness, 6) AS closeness, prev_diversity, round(ln(closeness), 6) AS log_phi FROM panel WHERE closeness > 0)"


@query("i13b_lookback_lags", " UNION ALL ".join(_lookback(k) for k in range(1, 7)))
def i13b(spark, d):
    """Lookbacks of one to six years, from one reading of the facts."""
    cells = written(spark, d)
    entities = cells.agg(F.count_distinct("actor")).first()[0]
    rows = panel.lookback_panel(held_in(cells), edges_in(cells), cube.distinct_values(cells, "topic"), entities, range(1, 7)).filter("closeness > 0")
    return rows.select("lookback", "prev", "period", "actor", "topic", "adopted", *rounded("closeness"), "prev_diversity", F.round(F.log("closeness"), 6).alias("log_phi"))


@query("g18_mean_weights", REGIONS + """, yw AS (SELECT year, actor, region, sum(rca) AS w FROM yrca JOIN reg USING (topic) GROUP BY ALL), ys AS (SELECT *, w / sum(w) OVER (PARTITION BY year, actor) AS share FROM yw)
SELECT actor, region, round(avg(share), 6) AS mean_share, count(*) AS years FROM ys GROUP BY ALL""")
def g18(spark, d):
    """Each actor's mean share of a region over the years in which it has any of it."""
    spec = space.specialization(yearly(spark, d), ["year"])
    shares = space.region_shares(spec, regions(spark, d), ("year", "actor"))
    return shares.groupBy("actor", "region").agg(F.round(F.avg("share"), 6).alias("mean_share"), F.count(F.lit(1)).alias("years"))


@query("g19_replicates", """WITH o AS (SELECT o_orderkey AS doc, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS v FROM orders), f AS (SELECT unnest([40, 60, 80, 100]) AS keep), r AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS replicate),
k AS (SELECT keep, replicate, v, row_number() OVER (PARTITION BY keep, replicate, year ORDER BY md5('19:' || replicate || ':' || doc), doc) AS k, count(*) OVER (PARTITION BY keep, replicate, year) AS n FROM o, f, r WHERE keep < 100 OR replicate = 1),
m AS (SELECT keep, replicate, avg(v) AS mean, stddev_samp(v) AS spread FROM k WHERE k * 100 <= n * keep GROUP BY ALL), u AS (SELECT keep, replicate, 'mean' AS measure, mean AS value FROM m UNION ALL SELECT keep, replicate, 'spread', spread FROM m)
SELECT CAST(keep AS INTEGER) AS keep, measure, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, count(*) AS replicates FROM u GROUP BY ALL""")
def g19(spark, d):
    """Mean and deviation over replicates of thinned data, stacked by measure, with the full data as one row each.

    Every document is ranked once for each replicate and counts for all shares side by side; no document is copied.
    """
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v"))
    year = Window.partitionBy("year")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(year))
    for r in range(1, 6):
        rows = rows.withColumn(f"k{r}", F.row_number().over(year.orderBy(resample.draw_key(19, F.lit(r), "doc"), "doc")))
    kept = lambda share, r: F.when(F.col(f"k{r}") * 100 <= F.col("n") * share, F.col("v"))
    cells = [(share, r) for share in (40, 60, 80, 100) for r in range(1, 6) if share < 100 or r == 1]
    wide = rows.agg(*[f(kept(share, r)).alias(f"{name}_{share}_{r}") for share, r in cells for name, f in (("mean", F.avg), ("spread", F.stddev_samp))])
    long = wide.unpivot([], [c for c in wide.columns], "name", "value").withColumn("part", F.split("name", "_")).select(F.col("part")[1].cast("int").alias("keep"), F.col("part")[0].alias("measure"), "value")
    return long.groupBy("keep", "measure").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("sd"), F.count(F.lit(1)).alias("replicates"))


@query("i45_fixed_regions", SQL + """SELECT topic, coalesce(r, 'core') AS region, n FROM (SELECT topic, count(*) AS n FROM fact GROUP BY topic)
LEFT JOIN (SELECT topic, CASE WHEN k <= 10 THEN 'first' WHEN k > n - 10 THEN 'last' END AS r FROM (SELECT topic, row_number() OVER (ORDER BY topic) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT topic FROM fact))) USING (topic)""")
def i45(spark, d):
    """Regions from lists of names; topics on no list are the core."""
    counted = activity(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    place = Window.orderBy("topic")
    listed = counted.select("topic", F.row_number().over(place).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("all"))
    names = listed.select("topic", F.when(F.col("k") <= 10, "first").when(F.col("k") > F.col("all") - 10, "last").alias("r")).filter("r is not null")
    return counted.join(names, "topic", "left").select("topic", F.coalesce("r", F.lit("core")).alias("region"), "n")


@query("i46_dominant_theme", REGIONS + """, th AS (SELECT region, p_type AS theme, count(*) AS n FROM reg JOIN part ON p_name = topic GROUP BY ALL)
SELECT region, theme, n FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, theme) AS r FROM th) WHERE r = 1""")
def i46(spark, d):
    """The theme that most parts of a region have; ties: the first by name."""
    rows = regions(spark, d).join(table(spark, d, "part").select(F.col("p_name").alias("topic"), F.col("p_type").alias("theme")), "topic")
    counted = rows.groupBy("region", "theme").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("n"), "theme"))
    return counted.withColumn("r", first).filter("r = 1").drop("r")


@query("f15_nearest_point", """WITH g AS (SELECT n_name AS actor, n_nationkey * 7 % 120 - 60 AS lat, n_nationkey * 37 % 360 - 180 AS lon FROM nation), t AS (SELECT y * 30 AS lat, x * 30 AS lon FROM (SELECT unnest(range(-2, 3)) AS y), (SELECT unnest(range(-6, 7)) AS x)),
n AS (SELECT actor, CAST(t.lat AS INTEGER) AS lat, CAST(t.lon AS INTEGER) AS lon, row_number() OVER (PARTITION BY actor ORDER BY (g.lat - t.lat) * (g.lat - t.lat) + (g.lon - t.lon) * (g.lon - t.lon), t.lat, t.lon) AS r FROM g, t) SELECT actor, lat, lon FROM n WHERE r = 1""")
def f15(spark, d):
    """Actors moved to the nearest of a fixed set of 65 points; ties: the least point."""
    points = spark.createDataFrame([(y, x) for y in range(-60, 61, 30) for x in range(-180, 181, 30)], "y int, x int")
    gap = (F.col("lat") - F.col("y")) * (F.col("lat") - F.col("y")) + (F.col("lon") - F.col("x")) * (F.col("lon") - F.col("x"))
    near = places(spark, d).crossJoin(F.broadcast(points)).groupBy("actor").agg(F.min(F.struct(gap.alias("gap"), "y", "x")).alias("p"))
    return near.select("actor", F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))


@query("k05_custom_order", REGIONS + """, dm AS (SELECT topic, max(rca) AS top, count(*) FILTER (active) AS run, any_value(region) AS region FROM rca JOIN reg USING (topic) GROUP BY topic)
SELECT topic, CAST(row_number() OVER (ORDER BY region, run DESC, round(top, 9) DESC, topic) AS INTEGER) AS place FROM dm""")
def k05(spark, d):
    """Topics by region, then falling run, then falling strength, then name; the universe of topics is ranked, not the facts."""
    spec = space.specialization(counts(spark, d)).join(regions(spark, d), "topic")
    each = spec.groupBy("topic").agg(F.first("region").alias("region"), F.count(F.when(F.col("active"), 1)).alias("run"), F.round(F.max("rca"), 9).alias("top"))
    return each.select("topic", F.row_number().over(Window.orderBy("region", F.desc("run"), F.desc("top"), "topic")).alias("place"))


@query("k06_first_transitions", PANEL + "SELECT prev, period, count(*) AS rows, sum(adopted) AS adopted FROM panel WHERE period IN (SELECT period FROM (SELECT period, row_number() OVER (ORDER BY period) AS k FROM (SELECT DISTINCT period FROM panel)) WHERE k <= 2) GROUP BY ALL")
def k06(spark, d):
    """Only the first two transitions: the limit is the feature."""
    rows = adoption(spark, d)
    first = rows.select("period").distinct().orderBy("period").limit(2)
    return rows.join(first, "period", "left_semi").groupBy("prev", "period").agg(F.count(F.lit(1)).alias("rows"), F.sum("adopted").alias("adopted"))


def thresholds(text: str) -> list[float]:
    """The distinct numbers of a comma-separated list, in order; each must lie strictly between 0 and 1."""
    values = sorted({float(x) for x in text.split(",") if x.strip()})
    if not values or values[0] <= 0 or values[-1] >= 1:
        raise ValueError(f"thresholds must lie between 0 and 1: {text}")
    return values


@query("c28_thresholds", SQL + """, v AS (SELECT year, count(*) AS n FROM fact GROUP BY year), c AS (SELECT year, sum(n) OVER (ORDER BY year) * 1.0 / sum(n) OVER () AS part FROM v), t AS (SELECT DISTINCT unnest([0.5, 0.15, 0.9, 0.15]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, min(year) AS year FROM t JOIN c ON part >= threshold GROUP BY 1""")
def c28(spark, d):
    """The year in which each threshold of a list is reached."""
    wanted = spark.createDataFrame([(x,) for x in thresholds("0.5, 0.15,0.9,0.15")], "threshold double")
    v = activity(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    part = F.sum("n").over(Window.orderBy("year")) / F.sum("n").over(Window.partitionBy())
    return v.select("year", part.alias("part")).join(wanted, F.col("part") >= F.col("threshold")).groupBy("threshold").agg(F.min("year").alias("year"))


@query("d06_finite", """WITH v AS (SELECT c_mktsegment AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'nan'::DOUBLE WHEN c_custkey % 11 = 0 THEN 'inf'::DOUBLE ELSE c_acctbal END AS x FROM customer)
SELECT k, count(*) AS rows, count(*) FILTER (x IS NOT NULL AND isfinite(x)) AS finite, round(avg(x) FILTER (x IS NOT NULL AND isfinite(x)), 4) AS mean FROM v GROUP BY k""")
def d06(spark, d):
    """Counts and means of what is neither null, nan nor infinite."""
    c = F.col("c_custkey")
    x = F.when(c % 7 == 0, F.lit(None)).when(c % 5 == 0, F.lit(float("nan"))).when(c % 11 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal"))
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("k"), x.alias("x"))
    finite = stats.is_finite("x")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(finite, 1)).alias("finite"), F.round(F.avg(F.when(finite, F.col("x"))), 4).alias("mean"))


@query("j02_group_logits")
def j02(spark, d):
    """A ridge logit of adoption on standardised distance and popularity for every actor and period that has both outcomes."""
    rows = adoption(spark, d).withColumn("distance", 1 - F.col("closeness"))
    return models.group_logits(rows, ["actor", "period"], "adopted", ["distance", "popularity"])


@query("j04_estimand_medians")
def j04(spark, d):
    """The pooled coefficient of distance beside the median over all groups and the median of the periods' medians."""
    rows = adoption(spark, d).withColumn("distance", 1 - F.col("closeness"))
    fits = models.group_logits(rows, ["actor", "period"], "adopted", ["distance", "popularity"])
    periods = fits.groupBy("period").agg(F.median("distance").alias("m"))
    pooled = models.logit(rows, "adopted", ["distance", "popularity"]).filter("term = 'distance'").select(F.col("coefficient").alias("pooled"), F.col("se").alias("pooled_se"))
    return pooled.crossJoin(fits.agg(F.median("distance").alias("group_median"), F.count(F.lit(1)).alias("models"))).crossJoin(periods.agg(F.median("m").alias("median_of_medians"), F.count(F.lit(1)).alias("periods")))


@query("j06_ols_dummies")
def j06(spark, d):
    """Overlap on distance with bloc dummies, and the same coefficient from the residuals of both (Frisch-Waugh)."""
    blocs = places(spark, d).select("actor", "bloc")
    rows = overlap(spark, d).join(distances(spark, d), ["a", "b"]).join(blocs.toDF("a", "x"), "a").withColumn("log_km", F.log(F.greatest("km", F.lit(1.0))))
    rows = rows.select("jaccard", "log_km", "k_a", *[(F.col("x") == k).cast("double").alias(f"bloc_{k}") for k in range(1, 5)])
    return models.partial_regression(rows, "jaccard", "log_km", ["k_a", *[f"bloc_{k}" for k in range(1, 5)]])


@query("i47_longest_path")
def i47(spark, d):
    """The longest path between leaves of the maximum spanning tree."""
    e = [tuple(r) for r in edges(spark, d).select("i", "j", "phi").collect()]
    path = kernels.longest_path([(i, j) for i, j, _ in kernels.maximum_spanning_tree(e)])
    return spark.createDataFrame(list(enumerate(path)), "place int, topic string")


@query("i41_bridging")
def i41(spark, d):
    """Betweenness times the bridging coefficient of every topic."""
    labels = sorted(r[0] for r in yearly(spark, d).select("topic").distinct().collect())
    w = kernels.matrix(labels, [tuple(r) for r in edges(spark, d).select("i", "j", "phi").collect()])
    value = kernels.centralities(w)["betweenness"] * kernels.bridging(w)
    return spark.createDataFrame([(t, float(v)) for t, v in zip(labels, np.asarray(value), strict=True)], "topic string, bridging double")
