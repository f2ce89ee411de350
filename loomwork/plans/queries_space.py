"""Specialization, proximity, distances and networks in SQL reach."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators import cube, space
from loomwork.plans.facts import SQL, activity, lines
from loomwork.plans.registry import once, query
from loomwork.sources.store import cut


def counts(spark, d):
    return yearly(spark, d).groupBy("actor", "topic").agg(F.sum("x").alias("x"))


def yearly(spark, d):
    """The facts of a year, actor and topic; the facts are read once in a query."""
    return once(("yearly", d), lambda: cut(cube.count_cube(activity(spark, d), ["year", "actor", "topic"]), "yearly"))


def edges(spark, d):
    return space.similarity(space.support(counts(spark, d)))


def rounded(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


@query("i01_rca", SQL + "SELECT actor, topic, x, round(rca, 6) AS rca, active FROM rca")
def i01(spark, d):
    return space.specialization(counts(spark, d)).select("actor", "topic", "x", *rounded("rca"), "active")


@query("i02_support_both_rules", SQL + """SELECT actor, topic, active AS above, CAST(x AS HUGEINT) * t >= CAST(c AS HUGEINT) * p AS at_least FROM rca""")
def i02(spark, d):
    m = space.margins(counts(spark, d))
    return m.select("actor", "topic", space.above_one().alias("above"), space.above_one(strict=False).alias("at_least"))


@query("i03_proximity", SQL + "SELECT i, j, n, ui, uj, round(phi, 6) AS phi FROM phi")
def i03(spark, d):
    return edges(spark, d).select("i", "j", "n", "ui", "uj", *rounded("phi"))


@query("i04_cosine", SQL + "SELECT i, j, round(least(1.0, n / sqrt(ui * uj)), 6) AS cosine FROM phi")
def i04(spark, d):
    return edges(spark, d).select("i", "j", *rounded("cosine"))


@query("i05_jaccard", SQL + "SELECT i, j, round(n * 1.0 / (ui + uj - n), 6) AS jaccard, round(1 - n * 1.0 / (ui + uj - n), 6) AS distance FROM phi")
def i05(spark, d):
    return edges(spark, d).select("i", "j", *rounded("jaccard"), F.round(1 - F.col("jaccard"), 6).alias("distance"))


@query("l11_zero_share", SQL + """, u AS (SELECT count(*) AS k FROM (SELECT DISTINCT topic FROM fact))
SELECT k * (k - 1) // 2 AS pairs, k * (k - 1) // 2 - (SELECT count(*) FROM phi) AS zero, round(1 - (SELECT count(*) FROM phi) / (k * (k - 1) / 2), 6) AS share FROM u""")
def l11(spark, d):
    rows = counts(spark, d)
    k = rows.agg(F.count_distinct("topic").alias("k"))
    linked = edges(spark, d).agg(F.count(F.lit(1)).alias("linked"))
    pairs = (F.col("k") * (F.col("k") - 1) / 2).cast("long")
    return k.crossJoin(linked).select(pairs.alias("pairs"), (pairs - F.col("linked")).alias("zero"), F.round(1 - F.col("linked") / pairs, 6).alias("share"))


@query("h06_rolling_rca", SQL + """, w AS (
  SELECT CAST(e AS INTEGER) AS year, actor, topic, count(*) AS x FROM fact, unnest(range(year, year + 3)) AS u(e)
  WHERE e BETWEEN (SELECT min(year) + 3 FROM fact) AND (SELECT max(year) FROM fact) GROUP BY ALL)
SELECT year, actor, topic, round((x * 1.0 / sum(x) OVER (PARTITION BY year, actor)) / (sum(x) OVER (PARTITION BY year, topic) * 1.0 / sum(x) OVER (PARTITION BY year)), 6) AS rca FROM w""")
def h06(spark, d):
    rows = yearly(spark, d)
    first, last = rows.agg(F.min("year"), F.max("year")).first()
    windows = cube.assign_rolling(rows, "year", 3, (first or 0) + 3, last or 0, "end").drop("year").withColumnRenamed("end", "year")
    return space.specialization(windows.groupBy("year", "actor", "topic").agg(F.sum("x").alias("x")), ["year"]).select("year", "actor", "topic", *rounded("rca"))


@query("i03b_yearly_proximity", SQL + """, yu AS (SELECT year, topic, count(*) AS u FROM ysup GROUP BY ALL),
yc AS (SELECT a.year, a.topic AS i, b.topic AS j, count(*) AS n FROM ysup a JOIN ysup b ON a.year = b.year AND a.actor = b.actor AND a.topic < b.topic GROUP BY ALL)
SELECT yc.year, i, j, n, round(n * 1.0 / greatest(p.u, q.u), 6) AS phi FROM yc JOIN yu p ON p.year = yc.year AND p.topic = i JOIN yu q ON q.year = yc.year AND q.topic = j""")
def i03b(spark, d):
    return space.similarity(space.support(yearly(spark, d), ["year"]), ["year"]).select("year", "i", "j", "n", *rounded("phi"))


@query("i38_sparsify", SQL + """, both_ AS (SELECT i, j, phi FROM phi UNION ALL SELECT j, i, phi FROM phi),
cut AS (SELECT quantile_cont(phi, 0.75) AS q FROM phi),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY phi DESC, j) AS k FROM both_)
SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, round(phi, 6) AS phi FROM r, cut WHERE k <= 3 AND phi >= q""")
def i38(spark, d):
    e = edges(spark, d)
    cut = e.agg(F.percentile("phi", 0.75).alias("q"))
    return space.top_neighbours(e, 3).crossJoin(cut).filter("phi >= q").select("i", "j", *rounded("phi"))


@query("i42_disparity", SQL + """, b AS (SELECT i, j, phi FROM phi UNION ALL SELECT j, i, phi FROM phi), s AS (SELECT i AS k, sum(phi) AS s, count(*) AS deg FROM b GROUP BY i),
a AS (SELECT i, j, phi, greatest(pow(1 - phi / a.s, a.deg - 1), pow(1 - phi / c.s, c.deg - 1)) AS alpha FROM phi JOIN s a ON a.k = i JOIN s c ON c.k = j)
SELECT i, j, round(phi, 6) AS phi, round(alpha, 6) AS alpha FROM a WHERE alpha < 0.3""")
def i42(spark, d):
    return space.disparity_backbone(edges(spark, d), 0.3).select("i", "j", *rounded("phi", "alpha"))


@query("i39_degree", SQL + """, b AS (SELECT i, phi FROM phi UNION ALL SELECT j, phi FROM phi)
SELECT i AS topic, count(*) AS degree, round(sum(phi), 6) AS strength, round(count(*) * 1.0 / ((SELECT count(*) FROM ubi) - 1), 6) AS centrality FROM b GROUP BY i""")
def i39(spark, d):
    sup = space.support(counts(spark, d))
    n = sup.agg(F.count_distinct("topic").alias("_n"))
    ends = space.both_ways(space.similarity(sup), "phi").groupBy(F.col("i").alias("topic")).agg(F.count(F.lit(1)).alias("degree"), F.sum("phi").alias("strength"))
    return ends.crossJoin(n).select("topic", "degree", *rounded("strength"), F.round(F.col("degree") / (F.col("_n") - 1), 6).alias("centrality"))


PATHS = SQL + """, u AS (SELECT DISTINCT topic FROM fact), e0 AS (SELECT i, j, -ln(phi) AS d FROM phi UNION ALL SELECT j, i, -ln(phi) FROM phi),
""" + ",\n".join(
    f"e{k} AS (SELECT i, j, min(d) AS d FROM (SELECT i, j, d FROM e{k - 1} UNION ALL SELECT a.i, b.j, a.d + b.d FROM e{k - 1} a JOIN e{k - 1} b ON a.j = b.i WHERE a.i <> b.j) GROUP BY i, j)" for k in range(1, 7)
) + """
"""


@query("i08_shortest_path", PATHS + """SELECT a.topic AS i, b.topic AS j, round(coalesce(d, 1.25 * (SELECT max(d) FROM e6)), 6) AS distance FROM u a JOIN u b ON a.topic <> b.topic LEFT JOIN e6 ON i = a.topic AND j = b.topic""")
def i08(spark, d):
    nodes = cube.distinct_values(yearly(spark, d), "topic").withColumnRenamed("topic", "node")
    return space.shortest_paths(edges(spark, d), nodes, -F.log("phi")).select("i", "j", *rounded("distance"))


@query("i21_excess", SQL + "SELECT topic, round(sum(greatest(rca - 1, 0)), 6) AS excess FROM rca GROUP BY topic")
def i21(spark, d):
    return space.excess(space.specialization(counts(spark, d)), ["topic"]).select("topic", *rounded("excess"))


REGIONS = SQL + """, reg AS (SELECT topic, CAST(ntile(3) OVER (ORDER BY topic) AS INTEGER) AS region FROM (SELECT DISTINCT topic FROM fact)),
rs AS (SELECT actor, region, sum(rca) AS w FROM rca JOIN reg USING (topic) GROUP BY ALL),
sh AS (SELECT actor, region, w / sum(w) OVER (PARTITION BY actor) AS share, row_number() OVER (PARTITION BY actor ORDER BY w DESC, region) = 1 AS dominant FROM rs)
"""


def regions(spark, d):
    """Three blocks of the topics in the order of their names; the universe of topics is ranked, not the facts."""
    topics = cube.distinct_values(yearly(spark, d), "topic")
    return topics.withColumn("region", F.ntile(3).over(Window.orderBy("topic")).cast("int"))


def shares(spark, d):
    return space.region_shares(space.specialization(counts(spark, d)), regions(spark, d))


@query("i22_region_shares", REGIONS + "SELECT actor, region, round(share, 6) AS share, dominant FROM sh")
def i22(spark, d):
    return shares(spark, d).select("actor", "region", *rounded("share"), "dominant")


@query("c20_fuzzy_class", REGIONS + """SELECT actor, coalesce(nullif(string_agg(CASE WHEN round(share, 9) >= 0.34 THEN CAST(region AS VARCHAR) END, '+' ORDER BY region), ''), CAST(max(region) FILTER (dominant) AS VARCHAR)) AS class FROM sh GROUP BY actor""")
def c20(spark, d):
    passed = F.array_sort(F.collect_list(F.when(F.round("share", 9) >= 0.34, F.col("region").cast("string"))))
    return shares(spark, d).groupBy("actor").agg(F.coalesce(F.nullif(F.array_join(passed, "+"), F.lit("")), F.max(F.when(F.col("dominant"), F.col("region").cast("string")))).alias("class"))


@query("l08_fractional", SQL + """, n AS (SELECT doc, count(DISTINCT actor) AS k FROM fact GROUP BY doc)
SELECT actor, topic, round(sum(1.0 / k), 6) AS x FROM fact JOIN n USING (doc) GROUP BY ALL""")
def l08(spark, d):
    """A document's facts are gathered, counted and spread again in one reading; equal shares are counted before they are added."""
    docs = lines(spark, d).groupBy("doc").agg(F.collect_set(F.struct("year", "actor", "topic")).alias("_facts"))
    k = F.size(F.array_distinct(F.filter(F.col("_facts.actor"), lambda a: a.isNotNull()))).alias("k")
    shares_ = docs.select(k, F.inline("_facts")).groupBy("actor", "topic", "k").agg(F.count(F.lit(1)).alias("n"))
    return shares_.groupBy("actor", "topic").agg(F.round(F.sum(F.try_divide("n", "k")), 6).alias("x"))


LEFT_OUT = """, o AS (SELECT DISTINCT actor AS out FROM fact), k AS (SELECT out, actor, topic, x FROM cube, o WHERE actor <> out),
km AS (SELECT *, sum(x) OVER (PARTITION BY out, actor) AS c, sum(x) OVER (PARTITION BY out, topic) AS p, sum(x) OVER (PARTITION BY out) AS t FROM k),
ks AS (SELECT out, actor, topic FROM km WHERE CAST(x AS HUGEINT) * t > CAST(c AS HUGEINT) * p), ku AS (SELECT out, topic, count(*) AS u FROM ks GROUP BY ALL),
kc AS (SELECT a.out, a.topic AS i, b.topic AS j, count(*) AS n FROM ks a JOIN ks b ON a.out = b.out AND a.actor = b.actor AND a.topic < b.topic GROUP BY ALL),
kp AS (SELECT kc.out, i, j, n * 1.0 / greatest(p.u, q.u) AS phi FROM kc JOIN ku p ON p.out = kc.out AND p.topic = i JOIN ku q ON q.out = kc.out AND q.topic = j),
gr AS (SELECT a.topic AS i, b.topic AS j FROM (SELECT DISTINCT topic FROM fact) a JOIN (SELECT DISTINCT topic FROM fact) b ON a.topic < b.topic)
"""


@query("l07_leave_one_out", SQL + LEFT_OUT + """SELECT out AS actor, round(sqrt(avg(pow(coalesce(kp.phi, 0) - coalesce(b.phi, 0), 2))), 6) AS rmse
FROM gr CROSS JOIN o LEFT JOIN kp ON kp.out = o.out AND kp.i = gr.i AND kp.j = gr.j LEFT JOIN phi b ON b.i = gr.i AND b.j = gr.j GROUP BY o.out""".replace("SELECT out AS actor", "SELECT o.out AS actor"))
def l07(spark, d):
    return removal_errors(counts(spark, d)).select("actor", *rounded("rmse"))


def removal_errors(rows):
    """How far the space moves when one actor is left out: root mean square over all topic pairs.

    The left-out actor is a key, so all spaces are made in one job; pairs
    without an edge add nothing and only count in the mean.
    """
    out = rows.select(F.col("actor").alias("out")).distinct()
    left = space.similarity(space.support(rows.join(out, F.col("actor") != F.col("out")), ["out"]), ["out"]).select("out", "i", "j", F.col("phi").alias("a"))
    base = space.similarity(space.support(rows)).select("i", "j", F.col("phi").alias("b"))
    both = left.join(out.crossJoin(base), ["out", "i", "j"], "full")
    pairs = rows.agg((F.count_distinct("topic") * (F.count_distinct("topic") - 1) / 2).alias("pairs"))
    gap = F.pow(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), 2)
    return both.groupBy("out").agg(F.sum(gap).alias("s")).crossJoin(pairs).select(F.col("out").alias("actor"), F.sqrt(F.col("s") / F.col("pairs")).alias("rmse"))


@query("i36_removal_step", SQL + LEFT_OUT + """, rm AS (SELECT o.out AS actor, round(sqrt(avg(pow(coalesce(kp.phi, 0) - coalesce(b.phi, 0), 2))), 9) AS rmse
FROM gr CROSS JOIN o LEFT JOIN kp ON kp.out = o.out AND kp.i = gr.i AND kp.j = gr.j LEFT JOIN phi b ON b.i = gr.i AND b.j = gr.j GROUP BY o.out)
SELECT actor, round(rmse, 6) AS rmse FROM rm ORDER BY rm.rmse DESC, actor LIMIT 1""")
def i36(spark, d):
    errors = removal_errors(counts(spark, d)).select("actor", F.round("rmse", 9).alias("rmse"))
    return errors.orderBy(F.desc("rmse"), "actor").limit(1).select("actor", *rounded("rmse"))


@query("i53_topic_subset", SQL + """, s AS (SELECT topic FROM cube GROUP BY topic ORDER BY topic LIMIT 5), k AS (SELECT * FROM cube JOIN s USING (topic)),
m AS (SELECT *, sum(x) OVER (PARTITION BY actor) AS cc, sum(x) OVER (PARTITION BY topic) AS pp, sum(x) OVER () AS tt FROM k)
SELECT actor, topic, x, round((x * 1.0 / cc) / (pp * 1.0 / tt), 6) AS rca, CAST(count(*) OVER (PARTITION BY actor) AS BIGINT) = (SELECT count(*) FROM s) AS holds_all FROM m""")
def i53(spark, d):
    rows = counts(spark, d)
    chosen = rows.select("topic").distinct().orderBy("topic").limit(5)
    spec = space.specialization(rows.join(chosen, "topic"))
    held = F.count(F.lit(1)).over(Window.partitionBy("actor"))
    n = chosen.agg(F.count(F.lit(1)).alias("_n"))
    return spec.withColumn("_h", held).crossJoin(n).select("actor", "topic", "x", *rounded("rca"), (F.col("_h") == F.col("_n")).alias("holds_all"))


@query("i52_two_topic_groups", SQL + """, two AS (SELECT topic, row_number() OVER (ORDER BY topic) AS k FROM (SELECT DISTINCT topic FROM fact)),
g AS (SELECT actor, sum(x) FILTER (k = 1) AS a, sum(x) FILTER (k = 2) AS b FROM cube JOIN two USING (topic) WHERE k <= 2 GROUP BY actor)
SELECT actor, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'a only' ELSE 'b only' END AS side, CAST(coalesce(a, 0) + coalesce(b, 0) AS BIGINT) AS strength FROM g""")
def i52(spark, d):
    rows = counts(spark, d)
    two = rows.select("topic").distinct().orderBy("topic").limit(2).withColumn("k", F.row_number().over(Window.orderBy("topic")))
    g = rows.join(two, "topic").groupBy("actor").agg(*[F.sum(F.when(F.col("k") == k, F.col("x"))).alias(n) for k, n in ((1, "a"), (2, "b"))])
    side = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "a only").otherwise("b only")
    return g.select("actor", side.alias("side"), (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("strength"))


@query("i54_block_spaces", SQL + """, f AS (SELECT *, year - (year - (SELECT min(year) FROM fact)) % 3 AS s FROM fact), k AS (SELECT s, actor, topic, count(*) AS x FROM f GROUP BY ALL),
km AS (SELECT *, sum(x) OVER (PARTITION BY s, actor) AS c, sum(x) OVER (PARTITION BY s, topic) AS p, sum(x) OVER (PARTITION BY s) AS t FROM k),
ks AS (SELECT s, actor, topic FROM km WHERE CAST(x AS HUGEINT) * t > CAST(c AS HUGEINT) * p), ku AS (SELECT s, topic, count(*) AS u FROM ks GROUP BY ALL),
kc AS (SELECT a.s, a.topic AS i, b.topic AS j, count(*) AS n FROM ks a JOIN ks b ON a.s = b.s AND a.actor = b.actor AND a.topic < b.topic GROUP BY ALL),
kp AS (SELECT kc.s, i, j, n * 1.0 / greatest(p.u, q.u) AS phi FROM kc JOIN ku p ON p.s = kc.s AND p.topic = i JOIN ku q ON q.s = kc.s AND q.topic = j),
sc AS (SELECT i, j FROM phi WHERE phi >= (SELECT quantile_cont(phi, 0.95) FROM phi))
SELECT CAST(b.s AS INTEGER) AS period_start, sc.i, sc.j, round(coalesce(phi, 0), 6) AS phi FROM (SELECT DISTINCT s FROM f) b CROSS JOIN sc LEFT JOIN kp ON kp.s = b.s AND kp.i = sc.i AND kp.j = sc.j""")
def i54(spark, d):
    rows = yearly(spark, d)
    first, last = rows.agg(F.min("year"), F.max("year")).first()
    blocks = cube.assign_blocks(rows, "year", 3, first or 0, last or 0).groupBy("period_start", "actor", "topic").agg(F.sum("x").alias("x"))
    whole = edges(spark, d)
    scaffold = whole.crossJoin(whole.agg(F.percentile("phi", 0.95).alias("q"))).filter("phi >= q").select("i", "j")
    per = space.similarity(space.support(blocks, ["period_start"]), ["period_start"]).select("period_start", "i", "j", "phi")
    grid = blocks.select("period_start").distinct().crossJoin(scaffold)
    return grid.join(per, ["period_start", "i", "j"], "left").select("period_start", "i", "j", F.round(F.coalesce("phi", F.lit(0.0)), 6).alias("phi"))
