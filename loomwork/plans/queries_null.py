"""Sensitivity to removals, separated maxima, and neighbours alike in size."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators import pairs, sensitivity, sequence, stats
from loomwork.plans.facts import SQL
from loomwork.plans.queries_pairs import PAIRS, TRIPLES, held, overlap
from loomwork.plans.queries_regions import TRIPLET_SHARES, triplet_shares
from loomwork.plans.queries_space import counts, rounded
from loomwork.plans.registry import query


def _removal(step: int) -> str:
    """CTEs that make every space without the actors removed before and one more, and take the one that differs most."""
    gone = "".join(f" AND {{0}} <> (SELECT actor FROM r{k})" for k in range(1, step))
    s = str(step)
    return f""", o{s} AS (SELECT DISTINCT actor AS out FROM fact WHERE true{gone.format("actor")}), k{s} AS (SELECT out, actor, topic, x FROM cube, o{s} WHERE actor <> out{gone.format("actor")}),
m{s} AS (SELECT *, sum(x) OVER (PARTITION BY out, actor) AS c, sum(x) OVER (PARTITION BY out, topic) AS p, sum(x) OVER (PARTITION BY out) AS t FROM k{s}),
s{s} AS (SELECT out, actor, topic FROM m{s} WHERE CAST(x AS HUGEINT) * t > CAST(c AS HUGEINT) * p), u{s} AS (SELECT out, topic, count(*) AS u FROM s{s} GROUP BY ALL),
c{s} AS (SELECT a.out, a.topic AS i, b.topic AS j, count(*) AS n FROM s{s} a JOIN s{s} b ON a.out = b.out AND a.actor = b.actor AND a.topic < b.topic GROUP BY ALL),
p{s} AS (SELECT c{s}.out, i, j, n * 1.0 / greatest(p.u, q.u) AS phi FROM c{s} JOIN u{s} p ON p.out = c{s}.out AND p.topic = i JOIN u{s} q ON q.out = c{s}.out AND q.topic = j),
e{s} AS (SELECT o.out AS actor, round(sqrt(avg(pow(coalesce(kp.phi, 0) - coalesce(b.phi, 0), 2))), 9) AS rmse FROM gr CROSS JOIN o{s} o LEFT JOIN p{s} kp ON kp.out = o.out AND kp.i = gr.i AND kp.j = gr.j LEFT JOIN phi b ON b.i = gr.i AND b.j = gr.j GROUP BY o.out),
r{s} AS (SELECT {s} AS step, actor, rmse FROM e{s} ORDER BY rmse DESC, actor LIMIT 1)"""


GRID = ", gr AS (SELECT a.topic AS i, b.topic AS j FROM (SELECT DISTINCT topic FROM fact) a JOIN (SELECT DISTINCT topic FROM fact) b ON a.topic < b.topic)"


@query("i36b_first_removals", SQL + GRID + _removal(1) + _removal(2) + " SELECT step, actor, round(rmse, 6) AS rmse FROM r1 UNION ALL SELECT step, actor, round(rmse, 6) FROM r2")
def i36b(spark, d):
    """The first two removals of the greedy sequence; the limit is the feature."""
    return sensitivity.greedy_removal(counts(spark, d), 2).select("step", "actor", *rounded("rmse"))


@query("i36c_greedy_removal")
def i36c(spark, d):
    """Actors in the order in which they are removed, each time the one that the space misses most; one stays."""
    return sensitivity.greedy_removal(counts(spark, d)).select("step", "actor", *rounded("rmse"))


@query("h16b_separated_maxima", SQL + """, v AS (SELECT actor, topic, x, row_number() OVER (PARTITION BY actor ORDER BY topic) AS k, count(*) OVER (PARTITION BY actor) AS n FROM cube),
l AS (SELECT *, x >= lag(x) OVER w AND x >= lead(x) OVER w AS peak FROM v WINDOW w AS (PARTITION BY actor ORDER BY k)), g AS (SELECT *, bool_or(coalesce(peak, false)) OVER (PARTITION BY actor) AS has_peak FROM l),
c AS (SELECT actor, list([k] ORDER BY x DESC, k) AS ks FROM g WHERE n >= 3 AND (peak OR NOT has_peak) GROUP BY actor),
t AS (SELECT actor, list_reduce(ks, lambda a, b: CASE WHEN len(list_filter(a, lambda z: abs(z - b[1]) < 4)) = 0 THEN list_concat(a, b) ELSE a END)[1:5] AS kept FROM c)
SELECT v.actor, v.topic, v.x FROM v JOIN t USING (actor) WHERE list_contains(kept, k) UNION ALL SELECT actor, topic, x FROM v WHERE n < 3""")
def h16b(spark, d):
    """Each actor's five highest topics along the names that are peaks and at least four places apart."""
    rows = counts(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("actor").orderBy("topic")))
    return sequence.separated_maxima(rows, "x", "k", 4, 5, ["actor"]).join(rows.select("actor", "k", "topic"), ["actor", "k"]).select("actor", "topic", "x")


def sized_pairs(spark, d):
    return overlap(spark, d).select(F.concat_ws("-", "a", "b").alias("pair"), F.least("k_a", "k_b").alias("lo"), F.greatest("k_a", "k_b").alias("hi"), "jaccard")


@query("f14b_nearest_in_plane", PAIRS + """, f AS (SELECT a || '-' || b AS pair, least(k_a, k_b) AS lo, greatest(k_a, k_b) AS hi FROM po),
z AS (SELECT *, round((lo - avg(lo) OVER ()) / stddev_pop(lo) OVER (), 9) AS z1, round((hi - avg(hi) OVER ()) / stddev_pop(hi) OVER (), 9) AS z2 FROM f),
n AS (SELECT q.pair, r.pair AS near, row_number() OVER (PARTITION BY q.pair ORDER BY round(pow(q.z1 - r.z1, 2) + pow(q.z2 - r.z2, 2), 9), r.pair) AS place FROM z q JOIN z r ON q.pair <> r.pair)
SELECT pair, near, CAST(place AS INTEGER) AS place FROM n WHERE place <= 250""")
def f14b(spark, d):
    """The 250 pairs of actors most alike in both breadths, for each pair."""
    near = pairs.nearest_in_space(sized_pairs(spark, d), "pair", ["lo", "hi"], 250)
    return near.select("pair", F.posexplode("near").alias("p", "n")).select("pair", F.col("n.key").alias("near"), (F.col("p") + 1).alias("place"))


TRIPLE_RESIDUALS = TRIPLES + """, tf AS (SELECT a || '-' || b || '-' || c AS triplet, a, b, c, k_small, k_mid, k_large, eff, ov FROM tc),
tz AS (SELECT *, round((k_small - avg(k_small) OVER ()) / stddev_pop(k_small) OVER (), 9) AS z1, round((k_mid - avg(k_mid) OVER ()) / stddev_pop(k_mid) OVER (), 9) AS z2, round((k_large - avg(k_large) OVER ()) / stddev_pop(k_large) OVER (), 9) AS z3 FROM tf),
tn AS (SELECT q.triplet, q.eff AS e0, q.ov AS o0, r.eff, r.ov, row_number() OVER (PARTITION BY q.triplet ORDER BY round(pow(q.z1 - r.z1, 2) + pow(q.z2 - r.z2, 2) + pow(q.z3 - r.z3, 2), 9), r.triplet) AS k FROM tz q JOIN tz r ON q.triplet <> r.triplet),
tr AS (SELECT triplet, any_value(e0) AS coverage, any_value(e0) - avg(eff) AS coverage_residual, any_value(o0) - avg(ov) AS overlap_residual FROM tn WHERE k <= 250 GROUP BY triplet)
"""


def triple_residuals(spark, d):
    """Coverage and overlap of every triple of actors less the means of the 250 triples most alike in sizes."""
    rows = pairs.triple_coverage(held(spark, d)).select(F.concat_ws("-", "a", "b", "c").alias("triplet"), "k_small", "k_mid", "k_large", F.struct("coverage_efficiency", "mean_pairwise_overlap").alias("v"))
    near = pairs.nearest_in_space(rows, "triplet", ["k_small", "k_mid", "k_large"], 250, "v").filter(F.size("near") > 0)
    mean = lambda c: F.aggregate("near", F.lit(0.0), lambda s, x: s + x["value"][c]) / F.size("near")
    of = lambda c: F.col(f"v.{c}") - mean(c)
    return near.select("triplet", F.col("v.coverage_efficiency").alias("coverage"), of("coverage_efficiency").alias("coverage_residual"), of("mean_pairwise_overlap").alias("overlap_residual"))


@query("i32c_triplet_residuals", TRIPLE_RESIDUALS + "SELECT triplet, round(coverage, 6) AS coverage, round(coverage_residual, 6) AS coverage_residual, round(overlap_residual, 6) AS overlap_residual FROM tr")
def i32c(spark, d):
    return triple_residuals(spark, d).select("triplet", *rounded("coverage", "coverage_residual", "overlap_residual"))


@query("i32d_residual_lines", TRIPLET_SHARES + ", tr AS (" + TRIPLE_RESIDUALS + "SELECT * FROM tr)" + """, l AS (SELECT measure, x, y FROM (SELECT m2 AS x, coverage_residual, overlap_residual FROM ts JOIN tr ON triplet = ts.a || '-' || ts.b || '-' || ts.c), LATERAL (SELECT unnest(['coverage', 'overlap']) AS measure, unnest([coverage_residual, overlap_residual]) AS y)),
r AS (SELECT *, rank() OVER (PARTITION BY measure ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY measure, round(x, 9)) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY measure ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY measure, round(y, 9)) - 1) / 2.0 AS ry FROM l)
SELECT measure, round(corr(rx, ry), 6) AS rho, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS n FROM r GROUP BY measure""")
def i32d(spark, d):
    """Rank correlation and line of the size-matched residuals of triples on their mean share of the middle region."""
    shares = triplet_shares(spark, d).select(F.concat_ws("-", "a", "b", "c").alias("triplet"), F.col("m2").alias("x"))
    rows = shares.join(triple_residuals(spark, d).drop("coverage"), "triplet")
    long = rows.select("triplet", "x", F.col("coverage_residual").alias("coverage"), F.col("overlap_residual").alias("overlap"))
    long = long.unpivot(["triplet", "x"], ["coverage", "overlap"], "measure", "y").withColumns({"rx": F.round("x", 9), "ry": F.round("y", 9)})
    rho = stats.spearman(long, "rx", "ry", ["measure"]).select("measure", *rounded("rho"))
    return rho.join(stats.line_fit(long, "x", "y", ["measure"]).select("measure", *rounded("slope", "intercept"), "n"), "measure")
