"""Emergence, runs, transitions and regions over time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators import cube, sequence, space
from loomwork.plans.facts import SQL, activity
from loomwork.plans.queries_panel import held
from loomwork.plans.queries_space import REGIONS, regions, rounded, yearly
from loomwork.plans.registry import ORACLES, query

VOLUME = SQL + """, v AS (SELECT topic, year, count(*) AS n FROM fact GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY topic ORDER BY year) AS upto, sum(n) OVER (PARTITION BY topic) AS total FROM v),
em AS (SELECT topic, CAST(p AS INTEGER) AS percent, min(year) AS emergence, CAST(max(total) AS BIGINT) AS total FROM r, (SELECT unnest([5, 10, 15, 25, 50]) AS p) WHERE total >= 10 AND upto * 100 >= p * total GROUP BY ALL)
"""


def volume(spark, d):
    return activity(spark, d).groupBy("topic", "year").agg(F.count(F.lit(1)).alias("n"))


@query("h01_emergence_year", VOLUME + "SELECT topic, emergence, total FROM em WHERE percent = 15")
def h01(spark, d):
    return sequence.emergence(volume(spark, d), [15]).select("topic", "emergence", "total")


@query("h02_threshold_sweep", VOLUME + """SELECT percent, count(*) AS topics, round(median(abs(e.emergence - b.emergence)), 6) AS median_shift, round(quantile_cont(abs(e.emergence - b.emergence), 0.75), 6) AS q75_shift
FROM em e JOIN (SELECT topic, emergence FROM em WHERE percent = 15) b USING (topic) GROUP BY percent""")
def h02(spark, d):
    swept = sequence.emergence(volume(spark, d), [5, 10, 15, 25, 50])
    base = swept.filter("percent = 15").select("topic", F.col("emergence").alias("base"))
    shift = F.abs(F.col("emergence") - F.col("base"))
    return swept.join(base, "topic").groupBy("percent").agg(F.count(F.lit(1)).alias("topics"), F.round(F.median(shift), 6).alias("median_shift"), F.round(F.percentile(shift, 0.75), 6).alias("q75_shift"))


@query("h03_centered_rolling_mean", SQL + "SELECT year, count(*) AS n, round(avg(count(*)) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM fact GROUP BY year")
def h03(spark, d):
    per_year = activity(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return sequence.rolling_mean(per_year, "n", "year").select("year", "n", *rounded("mean"))


@query("h04_gain_elbow", SQL + """, n AS (SELECT year, count(*) AS n FROM fact GROUP BY year), g AS (SELECT *, lag(n) OVER (ORDER BY year) - n AS gain FROM n), b AS (SELECT *, gain - lead(gain) OVER (ORDER BY year) AS bend FROM g)
SELECT year, n, gain, bend, (SELECT year FROM b WHERE bend IS NOT NULL ORDER BY bend DESC, year LIMIT 1) AS elbow FROM b""")
def h04(spark, d):
    per_year = activity(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return sequence.elbow(per_year, "year", "n").select("year", "n", "gain", "bend", "elbow")


@query("h09_longest_run", SQL + """, top AS (SELECT topic, year, actor AS label FROM (SELECT *, row_number() OVER (PARTITION BY topic, year ORDER BY x DESC, actor) AS k FROM ycube) WHERE k = 1),
c AS (SELECT *, coalesce(CAST(lag(label) OVER w <> label AS INTEGER), 1) AS ch FROM top WINDOW w AS (PARTITION BY topic ORDER BY year)), r AS (SELECT *, sum(ch) OVER (PARTITION BY topic ORDER BY year) AS run FROM c),
g AS (SELECT topic, run, label, count(*) AS length, min(year) AS start FROM r GROUP BY ALL)
SELECT topic, label, length, start FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY length DESC, start) AS k FROM g) WHERE k = 1""")
def h09(spark, d):
    top = yearly(spark, d).groupBy("topic", "year").agg(F.max("x").alias("m"))
    best = yearly(spark, d).join(top, ["topic", "year"]).filter("x = m").groupBy("topic", "year").agg(F.min("actor").alias("label"))
    return sequence.longest_run(best, "topic", "year", "label")


FLOWS = SQL + """, st AS (SELECT year AS prev, lead(year) OVER (ORDER BY year) AS next FROM (SELECT DISTINCT year FROM ysup)), sz AS (SELECT *, count(*) OVER (PARTITION BY year, actor) AS n FROM ysup),
fl AS (SELECT prev, next, a.topic AS source, b.topic AS target, sum(1.0 / (a.n * b.n)) AS mass, count(*) AS entities
  FROM sz a JOIN st ON a.year = prev JOIN sz b ON b.year = next AND b.actor = a.actor GROUP BY ALL)
"""


@query("h12_ribbon_flows", FLOWS + "SELECT prev, next, source, target, round(mass, 6) AS mass, entities FROM fl")
def h12(spark, d):
    return sequence.flows(held(spark, d)).select("prev", "next", "source", "target", *rounded("mass"), "entities")


@query("k04_top_flows_per_pair", FLOWS + """SELECT prev, next, source, target, round(mass, 6) AS mass, same FROM (SELECT *, source = target AS same, row_number() OVER (PARTITION BY prev, next, source = target ORDER BY round(mass, 9) DESC, source, target) AS k FROM fl WHERE entities >= 2)
WHERE k <= CASE WHEN same THEN 20 ELSE 35 END""")
def k04(spark, d):
    rows = sequence.flows(held(spark, d)).filter("entities >= 2").withColumn("same", F.col("source") == F.col("target"))
    rank = F.row_number().over(Window.partitionBy("prev", "next", "same").orderBy(F.desc(F.round("mass", 9)), "source", "target"))
    return rows.withColumn("_k", rank).filter(F.col("_k") <= F.when(F.col("same"), 20).otherwise(35)).select("prev", "next", "source", "target", *rounded("mass"), "same")


@query("h14_entries_exits", FLOWS + """, a AS (SELECT prev, next, actor, topic FROM ysup JOIN st ON year = prev WHERE next IS NOT NULL), b AS (SELECT prev, next, actor, topic FROM ysup JOIN st ON year = next)
SELECT prev, next, actor, count(*) FILTER (w AND i) AS kept, count(*) FILTER (NOT w) AS entered, count(*) FILTER (NOT i) AS gone
FROM (SELECT coalesce(a.prev, b.prev) AS prev, coalesce(a.next, b.next) AS next, coalesce(a.actor, b.actor) AS actor, a.actor IS NOT NULL AS w, b.actor IS NOT NULL AS i
  FROM a FULL JOIN b ON a.prev = b.prev AND a.next = b.next AND a.actor = b.actor AND a.topic = b.topic) GROUP BY ALL""")
def h14(spark, d):
    return sequence.turnover(held(spark, d))


@query("h10_tenure", SQL + "SELECT actor, min(year) AS first, max(year) AS last, count(DISTINCT year) AS years, count(DISTINCT topic) AS topics FROM fact GROUP BY actor")
def h10(spark, d):
    return activity(spark, d).groupBy("actor").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count_distinct("year").alias("years"), F.count_distinct("topic").alias("topics"))


@query("h15_gaussian_smooth", SQL + """, s AS (SELECT topic, sum(greatest(rca - 1, 0)) AS v, row_number() OVER (ORDER BY topic) AS k FROM rca GROUP BY topic), m AS (SELECT max(k) AS m FROM s),
o AS (SELECT unnest(range(-3, 4)) AS o), w AS (SELECT o, exp(-o * o / (2 * 1.15 * 1.15)) AS w FROM o)
SELECT s.topic, round(sum(w * t.v) / sum(w), 6) AS smooth FROM s, w, m, s t WHERE t.k = greatest(1, least(m, s.k + o)) GROUP BY s.topic""")
def h15(spark, d):
    signal = space.excess(space.specialization(yearly(spark, d).groupBy("actor", "topic").agg(F.sum("x").alias("x"))), ["topic"])
    return sequence.gaussian_smooth(signal, "excess", "topic", 1.15, 3).select("topic", *rounded("smooth"))


@query("k10_merge_near", """WITH c AS (SELECT c_nationkey AS g, c_acctbal AS x, c_custkey AS id FROM customer), n AS (SELECT *, coalesce(CAST(x - lag(x) OVER (PARTITION BY g ORDER BY x) > 40 AS INTEGER), 1) AS s FROM c),
k AS (SELECT *, sum(s) OVER (PARTITION BY g ORDER BY x) AS cluster FROM n)
SELECT g, CAST(cluster AS BIGINT) AS cluster, round(sum(x * id) / nullif(sum(id), 0), 4) AS position, CAST(sum(id) AS BIGINT) AS weight, CAST(max(id) AS BIGINT) AS label, count(*) AS members FROM k GROUP BY ALL""")
def k10(spark, d):
    from loomwork.plans.facts import table

    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("weight"))
    out = sequence.merge_near(rows, "x", 40, "weight", "id", ["g"])
    return out.select("g", "cluster", F.round("x", 4).alias("position"), "weight", F.col("id").alias("label"), "members")


WINDOW_SHARES = REGIONS + """, ys AS (SELECT year, actor, region, sum(rca) AS w, count(*) AS k FROM yrca JOIN reg USING (topic) WHERE active GROUP BY ALL),
dm AS (SELECT year, actor, region FROM (SELECT *, row_number() OVER (PARTITION BY year, actor ORDER BY round(w, 9) DESC, region) AS r, sum(k) OVER (PARTITION BY year, actor) AS held FROM ys) WHERE r = 1 AND held >= 3)
"""


def modes(spark, d):
    """year, actor, region: the region with most of the actor's index above the threshold, for portfolios of three at least."""
    spec = space.specialization(yearly(spark, d), ["year"]).filter("active").join(regions(spark, d), "topic")
    sums = spec.groupBy("year", "actor", "region").agg(F.round(F.sum("rca"), 9).alias("w"), F.count(F.lit(1)).alias("k"))
    return sums.groupBy("year", "actor").agg(F.max_by("region", F.struct("w", -F.col("region"))).alias("region"), F.sum("k").alias("held")).filter("held >= 3").drop("held")


@query("l02_mode_transitions", WINDOW_SHARES + """, t AS (SELECT a.region AS source, b.region AS target, count(*) AS n FROM dm a JOIN dm b ON b.actor = a.actor AND b.year = a.year + 1 GROUP BY ALL)
SELECT source, target, n, round(n * 1.0 / sum(n) OVER (PARTITION BY source), 6) AS share FROM t""")
def l02(spark, d):
    m = modes(spark, d)
    later = m.select((F.col("year") - 1).alias("year"), "actor", F.col("region").alias("target"))
    t = m.withColumnRenamed("region", "source").join(later, ["year", "actor"]).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query("l02b_mode_rates", WINDOW_SHARES + """SELECT count(*) AS n, round(avg(CAST(a.region = b.region AS INTEGER)), 6) AS same, round(avg(CAST(abs(a.region - b.region) <= 1 AS INTEGER)), 6) AS near, round(avg(CAST(abs(a.region - b.region) > 1 AS INTEGER)), 6) AS far
FROM dm a JOIN dm b ON b.actor = a.actor AND b.year = a.year + 1""")
def l02b(spark, d):
    m = modes(spark, d)
    gap = F.abs(F.col("region") - F.col("target"))
    t = m.join(m.select((F.col("year") - 1).alias("year"), "actor", F.col("region").alias("target")), ["year", "actor"])
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return t.agg(F.count(F.lit(1)).alias("n"), share(gap == 0, "same"), share(gap <= 1, "near"), share(gap > 1, "far"))


@query("l03_pioneer_index", VOLUME + """, w AS (SELECT CAST(e AS INTEGER) AS year, actor, topic, count(*) AS x FROM fact, unnest(range(year, year + 3)) AS u(e) WHERE e BETWEEN (SELECT min(year) + 2 FROM fact) AND (SELECT max(year) FROM fact) GROUP BY ALL),
wm AS (SELECT *, sum(x) OVER (PARTITION BY year, actor) AS c, sum(x) OVER (PARTITION BY year, topic) AS p, sum(x) OVER (PARTITION BY year) AS t FROM w),
en AS (SELECT actor, topic, min(year) AS entry FROM wm WHERE CAST(x AS HUGEINT) * CAST(t AS HUGEINT) >= CAST(c AS HUGEINT) * CAST(p AS HUGEINT) GROUP BY ALL), fa AS (SELECT actor, min(year) AS f FROM fact GROUP BY actor)
SELECT actor, count(*) AS topics_adopted, round(-avg(entry - greatest(emergence, f)), 6) AS pioneer_index FROM en JOIN (SELECT * FROM em WHERE percent = 15) USING (topic) JOIN fa USING (actor) GROUP BY actor""")
def l03(spark, d):
    rows = activity(spark, d)
    first, last = rows.agg(F.min("year"), F.max("year")).first()
    windows = cube.assign_rolling(rows, "year", 3, (first or 0) + 2, last or 0, "end").drop("year").withColumnRenamed("end", "year")
    entry = space.support(cube.count_cube(windows, ["year", "actor", "topic"]), ["year"], strict=False).groupBy("actor", "topic").agg(F.min("year").alias("entry"))
    began = rows.groupBy("actor").agg(F.min("year").alias("f"))
    lag = F.col("entry") - F.greatest("emergence", "f")
    emerged = sequence.emergence(volume(spark, d), [15]).select("topic", "emergence")
    return entry.join(emerged, "topic").join(began, "actor").groupBy("actor").agg(F.count(F.lit(1)).alias("topics_adopted"), F.round(-F.avg(lag), 6).alias("pioneer_index"))


@query("l05_balanced_thinning", "SELECT doc, year FROM (SELECT o_orderkey AS doc, CAST(year(o_orderdate) AS INTEGER) AS year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY md5('1:' || o_orderkey), o_orderkey) AS k, count(*) OVER (PARTITION BY year(o_orderdate)) AS n FROM orders) WHERE k * 10 <= n * 6")
def l05(spark, d):
    from loomwork.operators.resample import thin_by
    from loomwork.plans.facts import table

    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.year("o_orderdate").alias("year"))
    return thin_by(rows, ["year"], "doc", 6, 10, seed=1)


@query("i50_dominant_actor", SQL + """SELECT year, topic, actor, round(share, 6) AS share FROM (SELECT year, topic, actor, x * 1.0 / sum(x) OVER (PARTITION BY year, topic) AS share, row_number() OVER (PARTITION BY year, topic ORDER BY x DESC, actor) AS k FROM ycube) WHERE k = 1""")
def i50(spark, d):
    w = Window.partitionBy("year", "topic")
    rows = yearly(spark, d).withColumns({"share": F.round(F.col("x") / F.sum("x").over(w), 6), "_k": F.row_number().over(w.orderBy(F.desc("x"), "actor"))})
    return rows.filter("_k = 1").select("year", "topic", "actor", "share")


@query("g16_competition", SQL + """SELECT year, topic, count(*) FILTER (CAST(x AS HUGEINT) * t >= CAST(c AS HUGEINT) * p) AS specialized, round(count(*) FILTER (CAST(x AS HUGEINT) * t >= CAST(c AS HUGEINT) * p) * 1.0 / (SELECT count(DISTINCT actor) FROM fact), 6) AS share FROM ymarg GROUP BY ALL""")
def g16(spark, d):
    spec = space.specialization(yearly(spark, d), ["year"], strict=False)
    n = activity(spark, d).agg(F.count_distinct("actor").alias("_n"))
    counted = spec.groupBy("year", "topic").agg(F.count(F.when(F.col("active"), 1)).alias("specialized")).crossJoin(n)
    return counted.select("year", "topic", "specialized", F.round(F.col("specialized") / F.col("_n"), 6).alias("share"))
