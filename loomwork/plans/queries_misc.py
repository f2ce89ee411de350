"""Scalar functions, filters, joins, sorts and limits in the reference's inventory."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators import clean, cube, space, stats
from loomwork.plans.facts import SQL, activity, table
from loomwork.plans.queries_panel import held as held_yearly
from loomwork.plans.queries_space import REGIONS, counts, edges, regions, rounded, shares, yearly
from loomwork.plans.registry import query


@query("c17_odds", "SELECT c_custkey AS id, round(exp(c_acctbal / 10000), 6) AS odds_ratio, round(exp(c_acctbal / 10000 - 1.96 * 0.1), 6) AS low, round(exp(c_acctbal / 10000 + 1.96 * 0.1), 6) AS high FROM customer")
def c17(spark, d):
    o = stats.odds(F.col("c_acctbal") / 10000, F.lit(0.1))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *[F.round(v, 6).alias(k) for k, v in o.items()])


@query("c18_stars", "SELECT l_orderkey AS doc, CAST(l_linenumber AS INTEGER) AS line, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE '' END AS stars FROM lineitem")
def c18(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("line"), stats.stars(F.col("l_discount")).alias("stars"))


@query("c19_quadrants", """WITH c AS (SELECT c_custkey AS id, c_acctbal AS x, coalesce(sum(o_totalprice), 0) AS y FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL), m AS (SELECT median(x) AS mx, median(y) AS my FROM c)
SELECT CASE WHEN x >= mx AND y >= my THEN 'both' WHEN x >= mx THEN 'x only' WHEN y >= my THEN 'y only' ELSE 'none' END AS quadrant, count(*) AS n FROM c, m GROUP BY 1""")
def c19(spark, d):
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("y"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x")).join(spent, "id", "left").fillna(0.0, ["y"])
    m = c.agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    x, y = F.col("x") >= F.col("mx"), F.col("y") >= F.col("my")
    return c.crossJoin(m).groupBy(F.when(x & y, "both").when(x, "x only").when(y, "y only").otherwise("none").alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))


@query("c21_pair_codes", "SELECT array_to_string(list_sort([o_orderstatus, o_orderpriority]), '-') AS code, count(*) AS n FROM orders GROUP BY 1")
def c21(spark, d):
    return table(spark, d, "orders").groupBy(clean.canonical_code(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("c22_node_ids", SQL + "SELECT year || '::' || topic AS node, actor || '::' || year AS \"group\", x FROM ycube")
def c22(spark, d):
    return yearly(spark, d).select(F.concat_ws("::", F.col("year").cast("string"), "topic").alias("node"), F.concat_ws("::", "actor", F.col("year").cast("string")).alias("group"), "x")


@query("c23_theme_default", SQL + ", th AS (SELECT p_name AS topic, min(p_type) AS theme FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT coalesce(theme, 'none') AS theme, CAST(sum(x) AS BIGINT) AS x FROM cube LEFT JOIN th USING (topic) GROUP BY 1")
def c23(spark, d):
    themes = table(spark, d, "part").filter(F.pmod("p_partkey", F.lit(2)) == 0).groupBy(F.col("p_name").alias("topic")).agg(F.min("p_type").alias("theme"))
    return counts(spark, d).join(themes, "topic", "left").groupBy(F.coalesce("theme", F.lit("none")).alias("theme")).agg(F.sum("x").alias("x"))


@query("c25_row_shares", SQL + "SELECT actor, topic, round(x * 1.0 / c, 6) AS share FROM marg")
def c25(spark, d):
    w = Window.partitionBy("actor")
    return counts(spark, d).select("actor", "topic", F.round(F.coalesce(F.try_divide("x", F.sum("x").over(w)), F.lit(0.0)), 6).alias("share"))


@query("c26_ternary", REGIONS + """SELECT actor, round(coalesce(sum(share) FILTER (region = 2), 0) + 0.5 * coalesce(sum(share) FILTER (region = 3), 0), 6) AS x, round(sqrt(3) / 2 * coalesce(sum(share) FILTER (region = 3), 0), 6) AS y FROM sh GROUP BY actor""")
def c26(spark, d):
    s = {k: F.coalesce(F.sum(F.when(F.col("region") == k, F.col("share"))), F.lit(0.0)) for k in (2, 3)}
    return shares(spark, d).groupBy("actor").agg(F.round(s[2] + 0.5 * s[3], 6).alias("x"), F.round(F.sqrt(F.lit(3.0)) / 2 * s[3], 6).alias("y"))


@query("c27_membership_flags", "SELECT n_name AS actor, CAST(n_nationkey % 2 = 0 AS INTEGER) AS member, CAST(n_nationkey % 3 = 0 AS INTEGER) AS gateway, CAST(n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 AS INTEGER) AS both FROM nation")
def c27(spark, d):
    k = F.col("n_nationkey")
    two, three = F.pmod(k, F.lit(2)) == 0, F.pmod(k, F.lit(3)) == 0
    return table(spark, d, "nation").select(F.col("n_name").alias("actor"), two.cast("int").alias("member"), three.cast("int").alias("gateway"), (two & three).cast("int").alias("both"))


@query("d05_minimum_support", REGIONS + ", k AS (SELECT actor, count(*) AS k FROM sup GROUP BY actor) SELECT actor, k, round(share, 6) AS share FROM sh JOIN k USING (actor) WHERE dominant AND k >= 5 AND round(share, 9) >= 0.34")
def d05(spark, d):
    k = space.support(counts(spark, d)).groupBy("actor").agg(F.count(F.lit(1)).alias("k"))
    return shares(spark, d).filter("dominant and round(share, 9) >= 0.34").join(k.filter("k >= 5"), "actor").select("actor", "k", *rounded("share"))


@query("f05_semi_anti", "SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer")
def f05(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return c.join(o, "id", "left_semi").withColumn("buys", F.lit(True)).unionByName(c.join(o, "id", "left_anti").withColumn("buys", F.lit(False)))


@query("f11_lagged_support", SQL + "SELECT k.k AS lag, count(*) AS held, count(b.actor) AS still FROM ysup a CROSS JOIN (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS k) k LEFT JOIN ysup b ON b.year = a.year + k.k AND b.actor = a.actor AND b.topic = a.topic GROUP BY 1")
def f11(spark, d):
    sup = held_yearly(spark, d)
    each = sup.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("later", F.col("period") + F.col("lag"))
    later = sup.select(F.col("period").alias("later"), "actor", "topic", F.lit(1).alias("there"))
    return each.join(later, ["later", "actor", "topic"], "left").groupBy("lag").agg(F.count(F.lit(1)).alias("held"), F.count("there").alias("still"))


@query("f13_interval_lookup", "SELECT CAST(CASE WHEN c_acctbal >= 6000 THEN 3 WHEN c_acctbal >= 2000 THEN 2 ELSE 1 END AS INTEGER) AS region, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer GROUP BY 1")
def f13(spark, d):
    cuts = F.array(F.lit(2000.0), F.lit(6000.0))
    region = (F.size(F.filter(cuts, lambda b: b <= F.col("c_acctbal"))) + 1).cast("int")
    return table(spark, d, "customer").groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("ids"))


@query("f14_nearest_by_size", SQL + """, s AS (SELECT actor, count(*) AS k FROM sup GROUP BY actor), n AS (SELECT a.actor, b.actor AS near, row_number() OVER (PARTITION BY a.actor ORDER BY abs(a.k - b.k), b.actor) AS place FROM s a JOIN s b ON a.actor <> b.actor)
SELECT actor, near, CAST(place AS INTEGER) AS place FROM n WHERE place <= 5""")
def f14(spark, d):
    s = space.support(counts(spark, d)).groupBy("actor").agg(F.count(F.lit(1)).alias("k"))
    near = s.join(s.select(F.col("actor").alias("near"), F.col("k").alias("m")), F.col("actor") != F.col("near"))
    place = F.row_number().over(Window.partitionBy("actor").orderBy(F.abs(F.col("k") - F.col("m")), "near")).cast("int")
    return near.withColumn("place", place).filter("place <= 5").select("actor", "near", "place")


@query("g05_first_mode", "SELECT actor, arg_max(topic, (x, topic)) AS top_topic, min(topic) AS first_topic FROM (" + SQL + "SELECT actor, topic, x FROM cube) GROUP BY actor")
def g05(spark, d):
    return counts(spark, d).groupBy("actor").agg(F.max_by("topic", F.struct("x", "topic")).alias("top_topic"), F.min("topic").alias("first_topic"))


@query("g08_weighted_centroid", REGIONS + "SELECT actor, round(sum(rca * region) / sum(rca), 6) AS centroid, round(sum(rca), 6) AS weight FROM rca JOIN reg USING (topic) GROUP BY actor")
def g08(spark, d):
    rows = space.specialization(counts(spark, d)).join(regions(spark, d), "topic")
    return rows.groupBy("actor").agg(F.round(F.sum(F.col("rca") * F.col("region")) / F.sum("rca"), 6).alias("centroid"), F.round(F.sum("rca"), 6).alias("weight"))


@query("g09_sorted_lists", SQL + "SELECT year, actor, array_to_string(list_sort(list(topic)), ',') AS topics FROM ysup GROUP BY ALL")
def g09(spark, d):
    return held_yearly(spark, d).groupBy(F.col("period").alias("year"), "actor").agg(F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics"))


@query("g10_value_counts", SQL + "SELECT topic, count(*) AS n FROM fact GROUP BY topic ORDER BY n DESC, topic LIMIT 8")
def g10(spark, d):
    return activity(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(8)


@query("g11_predicate_share", "SELECT o_orderpriority AS k, round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) AS share FROM orders GROUP BY 1")
def g11(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("share"))


@query("g21_theme_counts", SQL + ", th AS (SELECT p_name AS topic, min(p_type) AS theme FROM part GROUP BY 1) SELECT year, theme, count(*) AS n FROM fact JOIN th USING (topic) GROUP BY ALL")
def g21(spark, d):
    themes = table(spark, d, "part").groupBy(F.col("p_name").alias("topic")).agg(F.min("p_type").alias("theme"))
    return activity(spark, d).join(themes, "topic").groupBy("year", "theme").agg(F.count(F.lit(1)).alias("n"))


@query("h07_entries", SQL + "SELECT a.year, a.actor, a.topic FROM ysup a LEFT JOIN ysup b ON b.year = a.year - 1 AND b.actor = a.actor AND b.topic = a.topic WHERE b.actor IS NULL AND a.year > (SELECT min(year) FROM fact)")
def h07(spark, d):
    sup = held_yearly(spark, d).withColumnRenamed("period", "year")
    first = activity(spark, d).agg(F.min("year").alias("_first"))
    before = sup.select((F.col("year") + 1).alias("year"), "actor", "topic")
    return sup.join(before, ["year", "actor", "topic"], "left_anti").crossJoin(first).filter("year > _first").select("year", "actor", "topic")


@query("h11_first_last_flags", SQL + "SELECT year, topic, year = min(year) OVER (PARTITION BY topic) AS is_first, year = max(year) OVER (PARTITION BY topic) AS is_last FROM (SELECT DISTINCT year, topic FROM ysup)")
def h11(spark, d):
    w = Window.partitionBy("topic")
    rows = held_yearly(spark, d).select(F.col("period").alias("year"), "topic").distinct()
    return rows.select("year", "topic", (F.col("year") == F.min("year").over(w)).alias("is_first"), (F.col("year") == F.max("year").over(w)).alias("is_last"))


@query("h13_top_flows", SQL + """, top AS (SELECT actor, year, topic FROM (SELECT *, row_number() OVER (PARTITION BY actor, year ORDER BY round(rca, 9) DESC, topic) AS k FROM yrca) WHERE k = 1)
SELECT year AS prev, topic AS source, nt AS target, count(*) AS actors FROM (SELECT *, lead(topic) OVER w AS nt, lead(year) OVER w AS ny FROM top WINDOW w AS (PARTITION BY actor ORDER BY year)) WHERE ny = year + 1 GROUP BY ALL""")
def h13(spark, d):
    spec = space.specialization(yearly(spark, d), ["year"])
    top = spec.withColumn("_k", F.row_number().over(Window.partitionBy("actor", "year").orderBy(F.desc(F.round("rca", 9)), "topic"))).filter("_k = 1")
    w = Window.partitionBy("actor").orderBy("year")
    step = top.select(F.col("year").alias("prev"), F.col("topic").alias("source"), F.lead("topic").over(w).alias("target"), F.lead("year").over(w).alias("_n"))
    return step.filter("_n = prev + 1").groupBy("prev", "source", "target").agg(F.count(F.lit(1)).alias("actors"))


@query("h19_relative_delta", SQL + ", v AS (SELECT topic, year, count(*) AS n FROM fact GROUP BY ALL) SELECT v.topic, v.year, v.n - b.n AS delta FROM v JOIN v b ON b.topic = v.topic AND b.year = (SELECT min(year) FROM fact)")
def h19(spark, d):
    v = activity(spark, d).groupBy("topic", "year").agg(F.count(F.lit(1)).alias("n"))
    first = v.agg(F.min("year").alias("year"))
    base = v.join(first, "year").select("topic", F.col("n").alias("b"))
    return v.join(base, "topic").select("topic", "year", (F.col("n") - F.col("b")).alias("delta"))


@query("i55_exemplars", REGIONS + """, k AS (SELECT actor, count(*) AS k FROM sup GROUP BY actor)
SELECT region, actor, CAST(place AS INTEGER) AS place FROM (SELECT region, actor, row_number() OVER (PARTITION BY region ORDER BY CAST(round(share, 9) >= 0.4 AS INTEGER) DESC, k DESC, round(share, 9) DESC, actor) AS place FROM sh JOIN k USING (actor) WHERE dominant) WHERE place <= 6""")
def i55(spark, d):
    k = space.support(counts(spark, d)).groupBy("actor").agg(F.count(F.lit(1)).alias("k"))
    rows = shares(spark, d).filter("dominant").withColumn("s", F.round("share", 9)).join(k, "actor")
    place = F.row_number().over(Window.partitionBy("region").orderBy(F.desc((F.col("s") >= 0.4).cast("int")), F.desc("k"), F.desc("s"), "actor")).cast("int")
    return rows.withColumn("place", place).filter("place <= 6").select("region", "actor", "place")


@query("k07_set_operations", SQL + "SELECT i AS topic FROM phi WHERE phi >= 0.5 UNION SELECT j FROM phi WHERE phi >= 0.5")
def k07(spark, d):
    strong = edges(spark, d).filter("phi >= 0.5")
    return strong.select(F.col("i").alias("topic")).union(strong.select("j")).distinct()


@query("m_stream_cube", "SELECT CAST(user_id % 10 AS BIGINT) AS actor, event_type AS topic, count(*) AS x FROM events GROUP BY ALL")
def stream_cube(spark, d):
    """The count cube of the event stream; ``loomwork.streaming`` keeps the same one up to date."""
    return cube.count_cube(table(spark, d, "events").select(F.pmod("user_id", F.lit(10)).alias("actor"), F.col("event_type").alias("topic")), ["actor", "topic"])


@query("h16_local_maxima", SQL + """, v AS (SELECT topic, count(*) AS n FROM fact GROUP BY topic), l AS (SELECT *, lag(n) OVER (ORDER BY topic) AS a, lead(n) OVER (ORDER BY topic) AS b FROM v)
SELECT topic, n FROM l WHERE n > coalesce(a, -1) AND n >= coalesce(b, -1)""")
def h16(spark, d):
    w = Window.orderBy("topic")
    v = activity(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).withColumns({"a": F.lag("n").over(w), "b": F.lead("n").over(w)})
    return v.filter((F.col("n") > F.coalesce("a", F.lit(-1))) & (F.col("n") >= F.coalesce("b", F.lit(-1)))).select("topic", "n")


@query("h17_best_per_bin", """WITH s AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(floor(c_acctbal / 1000) AS BIGINT) AS bin, count(*) OVER (ORDER BY c_acctbal RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS score FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY score DESC, id) AS r, max(score) OVER () AS most FROM s) SELECT bin, id AS best, score FROM k WHERE r = 1 AND score * 2 >= most""")
def h17(spark, d):
    """The customer with the most others within 100 of its balance, for each bin of 1,000; bins under half of the highest score have none."""
    x, strip = F.col("x"), F.floor(F.col("x") / 100)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    # each row goes to its own strip of 100 and the two beside it, so that no window holds more than three strips
    wide = rows.withColumn("near", F.explode(F.array(strip - 1, strip, strip + 1)))
    score = F.count(F.lit(1)).over(Window.partitionBy("near").orderBy("x").rangeBetween(-100, 100))
    rows = wide.withColumn("score", score).filter(F.col("near") == strip).select("id", F.floor(x / 1000).alias("bin"), "score")
    best = rows.groupBy("bin").agg(F.min(F.struct((-F.col("score")).alias("n"), "id")).alias("b")).select("bin", F.col("b.id").alias("best"), (-F.col("b.n")).alias("score"))
    return best.crossJoin(best.agg(F.max("score").alias("most"))).filter("score * 2 >= most").drop("most")
