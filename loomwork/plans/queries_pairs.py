"""Pairs, triples, statistics and permutation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import cube, models, pairs, resample, space, stats
from loomwork.plans.facts import SQL, activity, table
from loomwork.plans.queries_space import counts, edges, rounded, yearly
from loomwork.plans.registry import ORACLES, query
from loomwork.sources.store import cut

PAIRS = SQL + """, k AS (SELECT actor, count(*) AS k FROM sup GROUP BY actor), shd AS (SELECT a.actor AS a, b.actor AS b, count(*) AS n FROM sup a JOIN sup b ON a.topic = b.topic AND a.actor < b.actor GROUP BY ALL),
po AS (SELECT x.actor AS a, y.actor AS b, x.k AS k_a, y.k AS k_b, coalesce(n, 0) AS shared, x.k + y.k - coalesce(n, 0) AS "union", coalesce(n, 0) * 1.0 / (x.k + y.k - coalesce(n, 0)) AS jaccard
  FROM k x JOIN k y ON x.actor < y.actor LEFT JOIN shd ON shd.a = x.actor AND shd.b = y.actor),
geo AS (SELECT n_name AS actor, n_nationkey * 7 % 120 - 60 AS lat, n_nationkey * 37 % 360 - 180 AS lon, n_regionkey AS bloc FROM nation),
km AS (SELECT x.actor AS a, y.actor AS b, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) AS km
  FROM geo x JOIN geo y ON x.actor < y.actor)
"""


def held(spark, d):
    return space.support(counts(spark, d))


def overlap(spark, d):
    return pairs.pair_overlap(held(spark, d))


def places(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.col("n_name").alias("actor"), (F.pmod(k * 7, F.lit(120)) - 60).alias("lat"), (F.pmod(k * 37, F.lit(360)) - 180).alias("lon"), F.col("n_regionkey").alias("bloc"))


def distances(spark, d):
    a, b = (places(spark, d).select(F.col("actor").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}")) for x in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", stats.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("km"))


@query("g17_pair_overlap", PAIRS + """SELECT a, b, k_a, k_b, shared, "union", round(jaccard, 6) AS jaccard FROM po""")
def g17(spark, d):
    return overlap(spark, d).select("a", "b", "k_a", "k_b", "shared", "union", *rounded("jaccard"))


@query("i27_overlap_vs_distance", PAIRS + "SELECT a, b, round(jaccard, 6) AS jaccard, round(km, 3) AS km, round(ln(greatest(km, 1)), 6) AS log_km FROM po JOIN km USING (a, b)")
def i27(spark, d):
    return overlap(spark, d).join(distances(spark, d), ["a", "b"]).select("a", "b", *rounded("jaccard"), F.round("km", 3).alias("km"), F.round(F.log(F.greatest("km", F.lit(1.0))), 6).alias("log_km"))


@query("f08_collaboration", SQL + "SELECT x.actor AS a, y.actor AS b, count(DISTINCT x.doc) AS documents FROM fact x JOIN fact y ON x.doc = y.doc AND x.actor < y.actor GROUP BY ALL")
def f08(spark, d):
    return pairs.collaboration(activity(spark, d))


@query("i28_collaboration_overlap", SQL + """, cl AS (SELECT x.year, x.actor AS a, y.actor AS b, count(DISTINCT x.doc) AS n FROM fact x JOIN fact y ON x.doc = y.doc AND x.actor < y.actor GROUP BY ALL),
k AS (SELECT year, actor, count(*) AS k FROM ysup GROUP BY ALL), sh AS (SELECT x.year, x.actor AS a, y.actor AS b, count(*) AS n FROM ysup x JOIN ysup y ON x.year = y.year AND x.topic = y.topic AND x.actor < y.actor GROUP BY ALL)
SELECT p.year, p.actor AS a, q.actor AS b, coalesce(cl.n, 0) AS documents, round(coalesce(sh.n, 0) * 1.0 / (p.k + q.k - coalesce(sh.n, 0)), 6) AS jaccard
FROM k p JOIN k q ON p.year = q.year AND p.actor < q.actor LEFT JOIN cl ON cl.year = p.year AND cl.a = p.actor AND cl.b = q.actor LEFT JOIN sh ON sh.year = p.year AND sh.a = p.actor AND sh.b = q.actor""")
def i28(spark, d):
    both = pairs.pair_overlap(space.support(yearly(spark, d), ["year"]), ("year",))
    together = pairs.collaboration(activity(spark, d), by=("year",))
    return both.join(together, ["year", "a", "b"], "left").select("year", "a", "b", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"), *rounded("jaccard"))


@query("i29_exclusive_proximity", PAIRS + """, ex AS (SELECT x.a, x.b, s.topic, 1 AS way FROM po x JOIN sup s ON s.actor = x.a WHERE s.topic NOT IN (SELECT topic FROM sup t WHERE t.actor = x.b)
  UNION ALL SELECT x.a, x.b, s.topic, 2 FROM po x JOIN sup s ON s.actor = x.b WHERE s.topic NOT IN (SELECT topic FROM sup t WHERE t.actor = x.a)),
nr AS (SELECT i, j, phi FROM phi UNION ALL SELECT j, i, phi FROM phi),
bs AS (SELECT e.a, e.b, e.way, e.topic, coalesce(max(phi), 0) AS best FROM ex e LEFT JOIN ex o ON o.a = e.a AND o.b = e.b AND o.way <> e.way LEFT JOIN nr ON i = e.topic AND j = o.topic GROUP BY ALL)
SELECT a, b, round(avg(best), 6) AS exclusive_proximity, count(*) AS exclusive FROM bs GROUP BY ALL""")
def i29(spark, d):
    return pairs.exclusive_proximity(held(spark, d), space.both_ways(edges(spark, d), "phi")).select("a", "b", *rounded("exclusive_proximity"), "exclusive")


TRIPLES = SQL + """, k AS (SELECT actor, list(topic) AS s FROM sup GROUP BY actor),
t AS (SELECT x.actor AS a, y.actor AS b, z.actor AS c, len(x.s) AS na, len(y.s) AS nb, len(z.s) AS nc, len(list_intersect(x.s, y.s)) AS ab, len(list_intersect(x.s, z.s)) AS ac, len(list_intersect(y.s, z.s)) AS bc,
  len(list_distinct(x.s || y.s || z.s)) AS u FROM k x JOIN k y ON x.actor < y.actor JOIN k z ON y.actor < z.actor),
tc AS (SELECT a, b, c, CAST(list_sort([na, nb, nc])[1] AS INTEGER) AS k_small, CAST(list_sort([na, nb, nc])[2] AS INTEGER) AS k_mid, CAST(list_sort([na, nb, nc])[3] AS INTEGER) AS k_large, CAST(u AS INTEGER) AS union_topics, CAST(na + nb + nc AS INTEGER) AS sum_support,
  u * 1.0 / (na + nb + nc) AS eff, (ab * 1.0 / (na + nb - ab) + ac * 1.0 / (na + nc - ac) + bc * 1.0 / (nb + nc - bc)) / 3 AS ov,
  CAST(na + nb + nc - 2 * (ab + ac + bc) + 3 * (u - na - nb - nc + ab + ac + bc) AS INTEGER) AS unique_topics FROM t)
"""


@query("i30_triplet_coverage", TRIPLES + "SELECT a, b, c, k_small, k_mid, k_large, union_topics, sum_support, round(eff, 6) AS coverage_efficiency, unique_topics, round(ov, 6) AS mean_pairwise_overlap FROM tc")
def i30(spark, d):
    return pairs.triple_coverage(held(spark, d)).select("a", "b", "c", "k_small", "k_mid", "k_large", "union_topics", "sum_support", *rounded("coverage_efficiency"), "unique_topics", *rounded("mean_pairwise_overlap"))


@query("i31_matched_null", PAIRS + """, f AS (SELECT a || '-' || b AS pair, least(k_a, k_b) AS lo, greatest(k_a, k_b) AS hi, jaccard AS v FROM po),
z AS (SELECT *, round((lo - avg(lo) OVER ()) / stddev_pop(lo) OVER (), 9) AS z1, round((hi - avg(hi) OVER ()) / stddev_pop(hi) OVER (), 9) AS z2 FROM f),
n AS (SELECT q.pair, q.v, r.v AS w, row_number() OVER (PARTITION BY q.pair ORDER BY round(pow(q.z1 - r.z1, 2) + pow(q.z2 - r.z2, 2), 9), r.pair) AS k FROM z q JOIN z r ON q.pair <> r.pair)
SELECT pair, round(any_value(v), 6) AS jaccard, round(avg(w), 6) AS expected, round(any_value(v) - avg(w), 6) AS residual FROM n WHERE k <= 25 GROUP BY pair""")
def i31(spark, d):
    rows = overlap(spark, d).select(F.concat_ws("-", "a", "b").alias("pair"), F.least("k_a", "k_b").alias("lo"), F.greatest("k_a", "k_b").alias("hi"), "jaccard")
    return pairs.matched_residual(rows, "pair", ["lo", "hi"], "jaccard", 25).select("pair", *rounded("jaccard", "expected", "residual"))


@query("i33_emd_1d", SQL + """, s AS (SELECT actor, topic, x * 1.0 / c AS share FROM marg), ax AS (SELECT topic, row_number() OVER (ORDER BY topic) AS position, CASE WHEN lead(topic) OVER (ORDER BY topic) IS NULL THEN 0 ELSE 1 END AS gap FROM (SELECT DISTINCT topic FROM fact)),
g AS (SELECT a.actor, ax.position, gap, sum(coalesce(share, 0)) OVER (PARTITION BY a.actor ORDER BY ax.position) AS cum FROM (SELECT DISTINCT actor FROM fact) a CROSS JOIN ax LEFT JOIN s ON s.actor = a.actor AND s.topic = ax.topic)
SELECT x.actor AS a, y.actor AS b, round(sum(abs(x.cum - y.cum) * x.gap), 6) AS emd FROM g x JOIN g y ON x.position = y.position AND x.actor < y.actor GROUP BY ALL""")
def i33(spark, d):
    from pyspark.sql.window import Window

    rows = counts(spark, d)
    shares = rows.withColumn("share", F.col("x") / F.sum("x").over(Window.partitionBy("actor"))).select("actor", "topic", "share")
    axis = cube.distinct_values(rows, "topic").withColumn("position", F.row_number().over(Window.orderBy("topic")).cast("double"))
    return pairs.emd_1d(shares, axis).select("a", "b", *rounded("emd"))


@query("g14_spearman", PAIRS + """, j AS (SELECT jaccard AS x, km AS y FROM po JOIN km USING (a, b)), r AS (SELECT rank() OVER (ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY round(x, 9)) - 1) / 2.0 AS rx, rank() OVER (ORDER BY round(y, 6)) + (count(*) OVER (PARTITION BY round(y, 6)) - 1) / 2.0 AS ry FROM j)
SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r""")
def g14(spark, d):
    rows = overlap(spark, d).join(distances(spark, d), ["a", "b"]).select(F.round("jaccard", 9).alias("x"), F.round("km", 6).alias("y"))
    return stats.spearman(rows, "x", "y").select(*rounded("rho"), "n")


@query("g15_gini", SQL + """SELECT year, topic, n, CASE WHEN n > 1 THEN round((2.0 * s / t - n - 1) / n, 6) END AS gini FROM (SELECT year, topic, count(*) AS n, sum(k * x) AS s, sum(x) AS t FROM (SELECT *, row_number() OVER (PARTITION BY year, topic ORDER BY x) AS k FROM ycube) GROUP BY ALL)""")
def g15(spark, d):
    return stats.gini(yearly(spark, d), "x", ["year", "topic"]).select("year", "topic", "n", *rounded("gini"))


@query("g22_regression", "SELECT c_nationkey AS k, round(regr_slope(o_totalprice, c_acctbal), 6) AS slope, round(regr_intercept(o_totalprice, c_acctbal), 3) AS intercept, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def g22(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("o_totalprice").alias("y"))
    return stats.line_fit(rows, "x", "y", ["k"]).select("k", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), "n")


@query("g13_pearson", "SELECT count(*) AS n, round(corr(o_totalprice, c_acctbal), 6) AS r, round(corr(ln(o_totalprice), c_acctbal), 6) AS r_log FROM orders JOIN customer ON o_custkey = c_custkey")
def g13(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("o_totalprice", "c_acctbal"), 6).alias("r"), F.round(F.corr(F.log("o_totalprice"), F.col("c_acctbal")), 6).alias("r_log"))


@query("g20_tukey", """WITH q AS (SELECT c_nationkey AS k, quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]) AS q FROM customer GROUP BY 1)
SELECT k, round(any_value(q)[1], 4) AS least, round(any_value(q)[2], 4) AS q25, round(any_value(q)[3], 4) AS median, round(any_value(q)[4], 4) AS q75, round(any_value(q)[5], 4) AS most,
CAST(count(*) FILTER (c_acctbal < q[2] - 1.5 * (q[4] - q[2]) OR c_acctbal > q[4] + 1.5 * (q[4] - q[2])) AS INTEGER) AS outliers FROM customer JOIN q ON k = c_nationkey GROUP BY k""")
def g20(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal")
    return stats.tukey(rows, "c_acctbal", ["k"]).select("k", *rounded("least", "q25", "median", "q75", "most", digits=4), F.size("outliers").alias("outliers"))


@query("g04_spread", "SELECT c_mktsegment AS k, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd1, round(stddev_pop(c_acctbal), 4) AS sd0, round(median(c_acctbal), 4) AS median, round(quantile_cont(c_acctbal, 0.9), 4) AS q90 FROM customer GROUP BY 1")
def g04(spark, d):
    x = "c_acctbal"
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("k")).agg(*[F.round(f, 4).alias(n) for f, n in ((F.avg(x), "mean"), (F.stddev_samp(x), "sd1"), (F.stddev_pop(x), "sd0"), (F.median(x), "median"), (F.percentile(x, 0.9), "q90"))])


@query("c24_scaling", "SELECT n_name AS actor, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS z, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS scaled FROM (SELECT n_name, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def c24(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("actor")).agg(F.avg("c_acctbal").alias("v"))
    return stats.min_max(stats.z_score(rows, "v"), "v").select("actor", *rounded("z", "scaled"))


@query("j07_label_permutation", PAIRS + """, f AS (SELECT a || '-' || b AS pair, jaccard AS v, CASE WHEN x.bloc = y.bloc THEN 'same' ELSE 'mixed' END AS label FROM po JOIN geo x ON x.actor = a JOIN geo y ON y.actor = b),
nb AS (SELECT *, row_number() OVER (ORDER BY pair) AS place FROM f), dr AS (SELECT CAST(unnest(range(1, 101)) AS INTEGER) AS draw),
sh AS (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY md5('3:' || draw || ':' || pair), pair) AS place FROM f, dr),
ms AS (SELECT label, draw, avg(sh.v) AS m FROM sh JOIN nb USING (place) GROUP BY ALL), ob AS (SELECT label, avg(v) AS observed, count(*) AS n FROM f GROUP BY label), al AS (SELECT avg(v) AS a FROM f)
SELECT label, round(any_value(observed), 6) AS observed, any_value(n) AS n, round(avg(m), 6) AS null_mean, round((count(*) FILTER (abs(round(m - a, 9)) >= abs(round(observed - a, 9))) + 1) / 101.0, 6) AS p FROM ms JOIN ob USING (label), al GROUP BY label""")
def j07(spark, d):
    return permuted_labels(spark, d, 100)


def permuted_labels(spark, d, count):
    p = places(spark, d)
    blocs = overlap(spark, d).join(p.select(F.col("actor").alias("a"), F.col("bloc").alias("x")), "a").join(p.select(F.col("actor").alias("b"), F.col("bloc").alias("y")), "b")
    rows = blocs.select(F.concat_ws("-", "a", "b").alias("pair"), F.when(F.col("x") == F.col("y"), "same").otherwise("mixed").alias("label"), "jaccard")
    return resample.label_permutation(rows, "pair", "label", "jaccard", count, seed=3).select("label", *rounded("observed"), "n", *rounded("null_mean", "p"))


@query("j08_subset_permutation", PAIRS + """, mem AS (SELECT actor FROM geo WHERE bloc = 1 AND actor IN (SELECT actor FROM fact)), en AS (SELECT DISTINCT actor FROM fact), dr AS (SELECT CAST(unnest(range(1, 101)) AS INTEGER) AS draw),
rk AS (SELECT draw, actor, row_number() OVER (PARTITION BY draw ORDER BY md5('5:' || draw || ':' || actor), actor) AS k FROM en, dr),
st AS (SELECT draw, list(actor) AS s FROM (SELECT draw, actor FROM rk WHERE k <= (SELECT count(*) FROM mem) UNION ALL SELECT 0, actor FROM mem) GROUP BY draw),
gp AS (SELECT draw, avg(jaccard) FILTER (list_contains(s, a) AND list_contains(s, b)) - avg(jaccard) FILTER (NOT (list_contains(s, a) AND list_contains(s, b))) AS gap FROM st, po GROUP BY draw), o AS (SELECT round(gap, 9) AS o FROM gp WHERE draw = 0)
SELECT round(any_value(o), 6) AS observed, round(avg(gap), 6) AS null_mean, round((count(*) FILTER (abs(round(gap, 9)) >= abs(o)) + 1) / 101.0, 6) AS p FROM gp, o WHERE draw > 0""")
def j08(spark, d):
    return permuted_members(spark, d, 100)


def permuted_members(spark, d, count):
    present = activity(spark, d).select("actor").distinct()
    members = places(spark, d).filter("bloc = 1").select("actor").join(present, "actor", "left_semi")
    return resample.subset_permutation(overlap(spark, d), present, members, "jaccard", count, seed=5).select(*rounded("observed", "null_mean", "p"))


def more_draws(name, count):
    """The SQL of a query of 100 draws, with ``count``."""
    return ORACLES[name].replace("range(1, 101)", f"range(1, {count + 1})").replace("/ 101.0", f"/ {count + 1}.0")


@query("j07b_label_permutation_2000", more_draws("j07_label_permutation", 2000))
def j07b(spark, d):
    return permuted_labels(spark, d, 2000)


@query("j08b_subset_permutation_5000", more_draws("j08_subset_permutation", 5000))
def j08b(spark, d):
    return permuted_members(spark, d, 5000)


@query("j12_weighted_row_null", SQL + """, w AS (SELECT topic, count(*) AS w FROM sup GROUP BY topic), k AS (SELECT actor, count(*) AS k FROM sup GROUP BY actor), dr AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS draw),
rk AS (SELECT draw, actor, topic, k, row_number() OVER (PARTITION BY draw, actor ORDER BY round(-ln((CAST('0x' || substring(md5('7:' || draw || ':' || actor || ':' || topic), 1, 8) AS BIGINT) + 0.5) / 4294967296.0) / w, 12), topic) AS r FROM k, w, dr)
SELECT draw, actor, topic FROM rk WHERE r <= k""")
def j12(spark, d):
    return resample.weighted_row_null(held(spark, d), 5, seed=7)


def both_bases(spark, d):
    """start, end, basis, actor, topic: what actors hold in every block of ten years, by support (rpa) and by any activity (presence)."""
    facts = yearly(spark, d)
    first, last = facts.agg(F.min("year"), F.max("year")).first()
    by = ["period_start", "period_end"]
    x = cut(cube.assign_blocks(facts, "year", 10, first or 0, last or 0).groupBy(*by, "actor", "topic").agg(F.sum("x").alias("x")), "blocks")
    of = lambda sup, basis: sup.select(F.col("period_start").alias("start"), F.col("period_end").alias("end"), F.lit(basis).alias("basis"), "actor", "topic")
    return of(space.support(x, by), "rpa").unionByName(of(x, "presence"))


@query("j13_null_summary", None)
def j13(spark, d):
    """By block of ten years and basis (support, any activity), against 400 tables with both margins kept."""
    by = ("start", "end", "basis")
    sup = both_bases(spark, d)
    seen = pairs.pair_overlap(sup, by).groupBy(*by).agg(F.avg("jaccard").alias("jaccard"))
    return resample.null_summary(models.swap_chains(sup, by, 400).select(*by, "jaccard"), seen, "jaccard", by)


@query("i06_vector_cosine", """WITH e AS (SELECT vec_id, embedding AS v FROM embeddings), p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_sum(list_transform(range(1, 65), lambda k: CAST(a.v[k] AS DOUBLE) * b.v[k])) AS d,
sqrt(list_sum(list_transform(a.v, lambda x: CAST(x AS DOUBLE) * x))) AS na, sqrt(list_sum(list_transform(b.v, lambda x: CAST(x AS DOUBLE) * x))) AS nb FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT i, j, round(d / (coalesce(nullif(na, 0), 1) * coalesce(nullif(nb, 0), 1)), 5) + 0.0 AS cosine FROM p""")
def i06(spark, d):
    """Every pair of embeddings, in blocks."""
    return pairs.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding").select("i", "j", "cosine")
