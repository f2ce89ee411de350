"""Adoption, persistence, curves, spells and survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import cube, panel, space, stats
from loomwork.plans.facts import SQL, activity
from loomwork.plans.queries_space import rounded, yearly
from loomwork.plans.registry import query
from loomwork.sources.store import cut

PANEL = SQL + """, steps AS (SELECT year AS period, lag(year) OVER (ORDER BY year) AS prev FROM (SELECT DISTINCT year FROM ysup)),
prior AS (SELECT prev, period, actor, topic FROM ysup JOIN steps ON ysup.year = prev),
size AS (SELECT prev, period, actor, count(*) AS prev_diversity FROM prior GROUP BY ALL),
risk AS (SELECT s.*, u.topic FROM size s CROSS JOIN (SELECT DISTINCT topic FROM fact) u ANTI JOIN prior p ON p.prev = s.prev AND p.period = s.period AND p.actor = s.actor AND p.topic = u.topic),
near AS (SELECT i AS topic, j AS held, phi FROM phi UNION ALL SELECT j, i, phi FROM phi),
best AS (SELECT prev, period, actor, n.topic, max(phi) AS closeness FROM prior p JOIN near n ON n.held = p.topic GROUP BY ALL),
pop AS (SELECT year AS prev, topic, count(*) * 1.0 / (SELECT count(DISTINCT actor) FROM fact) AS popularity FROM ysup GROUP BY ALL),
panel AS (
  SELECT r.prev, r.period, r.actor, r.topic, CAST(s.actor IS NOT NULL AS INTEGER) AS adopted, coalesce(closeness, 0) AS closeness, prev_diversity, coalesce(popularity, 0) AS popularity
  FROM risk r LEFT JOIN best b USING (prev, period, actor, topic) LEFT JOIN ysup s ON s.year = r.period AND s.actor = r.actor AND s.topic = r.topic
  LEFT JOIN pop USING (prev, topic))
"""


def written(spark, d):
    """The yearly cube, written once: a row for each year, actor and topic, from which all parts of a panel follow."""
    return cut(yearly(spark, d), "yearly")


def held_in(cells):
    return space.support(cells, ["year"]).withColumnRenamed("year", "period")


def edges_in(cells):
    """The proximities over all years; every document has one year, so that its cells add up."""
    return space.similarity(space.support(cells.groupBy("actor", "topic").agg(F.sum("x").alias("x"))))


def held(spark, d):
    return held_in(yearly(spark, d))


def adoption(spark, d, lag=1):
    cells = written(spark, d)
    entities = cells.agg(F.count_distinct("actor")).first()[0]
    return panel.adoption_panel(held_in(cells), edges_in(cells), cube.distinct_values(cells, "topic"), entities, lag)


COLUMNS = "prev, period, actor, topic, adopted, round(closeness, 6) AS closeness, prev_diversity, round(popularity, 6) AS popularity"


@query("i11_adoption_panel", PANEL + f"SELECT {COLUMNS} FROM panel")
def i11(spark, d):
    return adoption(spark, d).select("prev", "period", "actor", "topic", "adopted", *rounded("closeness"), "prev_diversity", *rounded("popularity"))


@query("i13_lookback_panel", PANEL.replace("lag(year) OVER", "lag(year, 2) OVER") + f"SELECT 2 AS lookback, {COLUMNS}, round(ln(closeness), 6) AS log_phi FROM panel WHERE closeness > 0")
def i13(spark, d):
    rows = adoption(spark, d, lag=2).filter("closeness > 0")
    return rows.select(F.lit(2).alias("lookback"), "prev", "period", "actor", "topic", "adopted", *rounded("closeness"), "prev_diversity", *rounded("popularity"), F.round(F.log("closeness"), 6).alias("log_phi"))


@query("i14_choice_sets", PANEL + """SELECT actor || '::' || period AS "group", actor, period, topic, adopted, round(1 - closeness, 6) AS distance, round(popularity, 6) AS popularity
FROM panel WHERE (actor, period) IN (SELECT (actor, period) FROM panel WHERE adopted = 1)""")
def i14(spark, d):
    return panel.with_choice(adoption(spark, d)).select("group", "actor", "period", "topic", "adopted", F.round(1 - F.col("closeness"), 6).alias("distance"), *rounded("popularity"))


@query("i12_persistence_panel", PANEL + """, ob AS (SELECT p.prev, p.period, p.actor, p.topic, max(phi) AS closeness FROM prior p JOIN prior o ON o.prev = p.prev AND o.period = p.period AND o.actor = p.actor AND o.topic <> p.topic
  JOIN near n ON n.topic = p.topic AND n.held = o.topic GROUP BY ALL)
SELECT p.prev, p.period, p.actor, p.topic, CAST(s.actor IS NOT NULL AS INTEGER) AS persisted, round(closeness, 6) AS closeness, prev_diversity
FROM prior p JOIN size USING (prev, period, actor) LEFT JOIN ob USING (prev, period, actor, topic) LEFT JOIN ysup s ON s.year = p.period AND s.actor = p.actor AND s.topic = p.topic""")
def i12(spark, d):
    cells = written(spark, d)
    return panel.persistence_panel(held_in(cells), edges_in(cells)).select("prev", "period", "actor", "topic", "persisted", *rounded("closeness"), "prev_diversity")


CUMULATIVE = """, firsts AS (SELECT actor, topic, min(year) AS f FROM ycube GROUP BY ALL),
ccube AS (SELECT y.year, k.actor, k.topic, sum(coalesce(x, 0)) OVER (PARTITION BY k.actor, k.topic ORDER BY y.year) AS x
  FROM firsts k JOIN years y ON y.year >= f LEFT JOIN ycube c ON c.year = y.year AND c.actor = k.actor AND c.topic = k.topic),
cm AS (SELECT *, sum(x) OVER (PARTITION BY year, actor) AS c, sum(x) OVER (PARTITION BY year, topic) AS p, sum(x) OVER (PARTITION BY year) AS t FROM ccube),
cs AS (SELECT year, actor, topic FROM cm WHERE CAST(x AS HUGEINT) * CAST(t AS HUGEINT) > CAST(c AS HUGEINT) * CAST(p AS HUGEINT)), cu AS (SELECT year, topic, count(*) AS u FROM cs GROUP BY ALL),
cc AS (SELECT a.year, a.topic AS i, b.topic AS j, count(*) AS n FROM cs a JOIN cs b ON a.year = b.year AND a.actor = b.actor AND a.topic < b.topic GROUP BY ALL),
cphi AS (SELECT cc.year, i, j, n * 1.0 / greatest(p.u, q.u) AS phi FROM cc JOIN cu p ON p.year = cc.year AND p.topic = i JOIN cu q ON q.year = cc.year AND q.topic = j),
cnear AS (SELECT year AS prev, i AS topic, j AS held, phi FROM cphi UNION ALL SELECT year, j, i, phi FROM cphi),
cbest AS (SELECT p.prev, period, actor, n.topic, max(phi) AS closeness FROM prior p JOIN cnear n ON n.held = p.topic AND n.prev = p.prev GROUP BY ALL)
"""


@query("i12b_cumulative_lagged_distance", PANEL + CUMULATIVE + """SELECT r.prev, r.period, r.actor, r.topic, round(1 - coalesce(closeness, 0), 6) AS distance FROM risk r LEFT JOIN cbest USING (prev, period, actor, topic)""")
def i12b(spark, d):
    rows = activity(spark, d)
    years = rows.select("year").distinct()
    history = cube.cumulative_cube(yearly(spark, d), "year", ["actor", "topic"], years)
    lagged = space.similarity(space.support(history, ["year"]), ["year"]).select("year", "i", "j", "phi")
    entities = rows.agg(F.count_distinct("actor")).first()[0]
    out = panel.adoption_panel(held(spark, d), lagged, cube.distinct_values(rows, "topic"), entities, edges_by="year")
    return out.select("prev", "period", "actor", "topic", F.round(1 - F.col("closeness"), 6).alias("distance"))


@query("i15_popularity", PANEL + "SELECT prev AS period, topic, round(popularity, 6) AS popularity FROM pop")
def i15(spark, d):
    entities = yearly(spark, d).agg(F.count_distinct("actor")).first()[0]
    return panel.popularity(held(spark, d), F.lit(entities)).select("period", "topic", *rounded("popularity"))


@query("i16_equal_width_curve", PANEL + """, r AS (SELECT round(1 - closeness, 9) AS x, adopted FROM panel), e AS (SELECT min(x) AS lo, max(x) AS hi FROM r),
b AS (SELECT CAST(least(18, greatest(1, ceil((x - lo) / ((hi - lo) / 18)))) AS INTEGER) AS bin, adopted, lo, hi FROM r, e)
SELECT bin, count(*) AS n, CAST(sum(adopted) AS BIGINT) AS hits, round(min(lo) + (bin - 0.5) * ((min(hi) - min(lo)) / 18), 6) AS center, round(sum(adopted) * 1.0 / count(*), 6) AS rate FROM b GROUP BY bin""")
def i16(spark, d):
    rows = adoption(spark, d).select(F.round(1 - F.col("closeness"), 9).alias("x"), "adopted")
    return panel.equal_width_rate(rows, "x", "adopted", 18).select("bin", "n", "hits", *rounded("center", "rate"))


@query("i17_quantile_curve_wilson", PANEL + """, r AS (SELECT round(1 - closeness, 9) AS x, adopted FROM panel), e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(x, [k / 12.0 for k in range(13)]), lambda v: round(v, 9)))) AS edges FROM r),
b AS (SELECT CAST(greatest(1, len(list_filter(edges, lambda v: v < x))) AS INTEGER) AS bin, adopted FROM r, e),
g AS (SELECT bin, count(*) AS n, CAST(sum(adopted) AS BIGINT) AS hits FROM b GROUP BY bin),
z AS (SELECT *, hits * 1.0 / n AS p, 1.959963984540054 AS z FROM g)
SELECT bin, n, hits, round(p, 6) AS rate, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low,
round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM z""")
def i17(spark, d):
    rows = adoption(spark, d).select(F.round(1 - F.col("closeness"), 9).alias("x"), "adopted")
    edges_of = panel.quantile_edges(rows, "x", 12).select(F.array_sort(F.array_distinct(F.transform("edges", lambda e: F.round(e, 9)))).alias("edges"))
    binned = rows.crossJoin(edges_of).withColumn("bin", panel.quantile_bin(F.col("x"), F.col("edges")))
    g = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("adopted").cast("long")).alias("hits"))
    low, high = panel.wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return g.select("bin", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("i18_binned_median", """WITH r AS (SELECT o_totalprice AS x, c_acctbal AS y FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.25, 0.5, 0.75, 1]))) AS edges FROM r),
b AS (SELECT CAST(greatest(1, len(list_filter(edges, lambda v: v < x))) AS INTEGER) AS bin, x, y FROM r, e)
SELECT bin, count(*) AS n, round(median(x), 4) AS x, round(median(y), 4) AS y FROM b GROUP BY bin""")
def i18(spark, d):
    from loomwork.plans.facts import table

    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_totalprice").alias("x"), F.col("c_acctbal").alias("y"))
    rows = cut(rows, "rows")
    binned = rows.crossJoin(cut(panel.quantile_edges(rows, "x", 4), "edges")).withColumn("bin", panel.quantile_bin(F.col("x"), F.col("edges")))
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    for c in "xy":
        out = out.join(stats.exact_percentiles(binned, c, [0.5], ["bin"]).select("bin", F.round(F.col("q")[0], 4).alias(c)), "bin", "left")
    return out


SPELLS = SQL + """, a AS (SELECT actor, topic, CAST(year - (SELECT min(year) FROM fact) AS INTEGER) AS s FROM ysup), m AS (SELECT CAST(max(year) - min(year) AS INTEGER) AS e FROM fact),
o AS (SELECT *, lag(s) OVER w AS b, lead(s) OVER w AS n FROM a WINDOW w AS (PARTITION BY actor, topic ORDER BY s)),
starts AS (SELECT actor, topic, s FROM o WHERE b IS NULL OR b < s - 1), gaps AS (SELECT unnest([1, 2, 3, 4, 5]) AS gap),
stops AS (SELECT actor, topic, s, gap FROM o, gaps, m WHERE coalesce(n, e + 1 + gap + 1) - s > gap + 1),
sp AS (SELECT t.gap, t.actor, t.topic, t.s, min(x.s) AS z FROM (SELECT * FROM starts, gaps) t JOIN stops x ON x.actor = t.actor AND x.topic = t.topic AND x.gap = t.gap AND x.s >= t.s GROUP BY ALL),
spell AS (SELECT gap, actor, topic, CAST(s AS INTEGER) AS start, CAST(CASE WHEN z + gap + 1 <= e THEN z + gap + 1 - s ELSE e + 1 - s END AS INTEGER) AS duration, CAST(z + gap + 1 <= e AS INTEGER) AS event FROM sp, m)
"""


def all_spells(spark, d):
    cells = written(spark, d)
    first, last = cells.agg(F.min("year"), F.max("year")).first()
    active = cut(held_in(cells).select("actor", "topic", (F.col("period") - (first or 0)).alias("step")), "active")
    out = None
    for gap in range(1, 6):
        part = panel.spells(active, (last or 0) - (first or 0), gap).withColumn("gap", F.lit(gap))
        out = part if out is None else out.unionByName(part)
    return out


@query("h08_spells", SPELLS + "SELECT gap, actor, topic, start, duration, event FROM spell")
def h08(spark, d):
    return all_spells(spark, d).select("gap", "actor", "topic", "start", "duration", "event")


@query("i19_kaplan_meier", SPELLS + """, g AS (SELECT gap, duration AS t, count(*) AS leaving, sum(event) AS events FROM spell GROUP BY ALL),
r AS (SELECT *, sum(leaving) OVER (PARTITION BY gap ORDER BY t DESC) AS at_risk FROM g)
SELECT gap, t, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events,
round(CASE WHEN min(at_risk - events) OVER (PARTITION BY gap ORDER BY t) = 0 THEN 0 ELSE exp(sum(ln(nullif(at_risk - events, 0) * 1.0 / at_risk)) OVER (PARTITION BY gap ORDER BY t)) END, 6) AS survival FROM r""")
def i19(spark, d):
    return panel.kaplan_meier(all_spells(spark, d), ["gap"]).select("gap", "t", "at_risk", "events", *rounded("survival"))


@query("c16_wilson", """WITH g AS (SELECT o_orderpriority AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS h, 1.959963984540054 AS z FROM orders GROUP BY 1), p AS (SELECT *, h * 1.0 / n AS p FROM g)
SELECT k, n, h, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low,
round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM p""")
def c16(spark, d):
    from loomwork.plans.facts import table

    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("h"))
    low, high = panel.wilson(F.col("h").cast("double"), F.col("n").cast("double"))
    return g.select("k", "n", "h", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
