"""The sequential model of portfolios, its calibration, and its refits on thinned data."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import dynamics, space
from loomwork.plans.facts import SQL, activity
from loomwork.plans.queries_panel import edges_in, written
from loomwork.plans.queries_space import rounded
from loomwork.plans.registry import query
from loomwork.sources.store import cut

SHARES, REPLICATES = (40, 60, 80), 5

TRANSITIONS = SQL + """, tc AS (SELECT year AS period, actor, topic, x FROM ycube), st AS (SELECT period, lag(period) OVER (ORDER BY period) AS prev FROM (SELECT DISTINCT period FROM tc)),
pr AS (SELECT st.prev, st.period, actor, topic, x AS px FROM tc JOIN st ON tc.period = st.prev),
ac AS (SELECT a.*, b.budget FROM (SELECT prev, period, actor, sum(px) AS mass, count(*) AS breadth FROM pr GROUP BY ALL) a JOIN (SELECT period, actor, sum(x) AS budget FROM tc GROUP BY ALL) b USING (period, actor)),
ev AS (SELECT prev, count(DISTINCT actor) AS actors FROM pr GROUP BY prev), ho AS (SELECT prev, topic, count(*) AS holders FROM pr GROUP BY ALL),
nb AS (SELECT i, j, phi FROM phi UNION ALL SELECT j, i, phi FROM phi), ft AS (SELECT prev, period, actor, i AS topic, sum(phi) AS s FROM pr JOIN nb ON j = pr.topic GROUP BY ALL),
tr AS (SELECT ac.prev, ac.period, ac.actor, u.topic, CAST(px IS NOT NULL AS INTEGER) AS held, CAST(tc.x IS NOT NULL AS INTEGER) AS now, CAST(coalesce(tc.x, 0) AS BIGINT) AS x, coalesce(px, 0) * 1.0 / mass AS share, coalesce(s, 0) / breadth AS fit,
  coalesce(holders, 0) * 1.0 / actors AS popularity FROM ac CROSS JOIN (SELECT DISTINCT topic FROM tc) u JOIN ev ON ev.prev = ac.prev LEFT JOIN pr ON pr.prev = ac.prev AND pr.actor = ac.actor AND pr.topic = u.topic
  LEFT JOIN tc ON tc.period = ac.period AND tc.actor = ac.actor AND tc.topic = u.topic LEFT JOIN ft ON ft.prev = ac.prev AND ft.actor = ac.actor AND ft.topic = u.topic LEFT JOIN ho ON ho.prev = ac.prev AND ho.topic = u.topic)
"""


def cells_of(spark, d):
    return written(spark, d).withColumnRenamed("year", "period")


def space_of(cells):
    return edges_in(cells).select("i", "j", "phi")


@query("l04c_transition_rows", TRANSITIONS + "SELECT prev, period, actor, topic, held, now, x, round(share, 6) AS share, round(fit, 6) AS fit, round(popularity, 6) AS popularity FROM tr")
def l04c(spark, d):
    """What the model is fitted to: every topic of every actor that is active in two consecutive years."""
    cells = cells_of(spark, d)
    return dynamics.transition_rows(cells, space_of(cells)).select("prev", "period", "actor", "topic", "held", "now", "x", *rounded("share", "fit", "popularity"))


@query("l04d_baselines", TRANSITIONS + """SELECT topic, round(ln((count(*) FILTER (held = 1 AND now = 1) + 0.5) / (count(*) FILTER (held = 1 AND now = 0) + 0.5)), 6) AS retain,
round(ln((count(*) FILTER (held = 0 AND now = 1) + 0.5) / (count(*) FILTER (held = 0 AND now = 0) + 0.5)), 6) AS enter, round(ln(sum(x) + 0.5), 6) AS allocate FROM tr GROUP BY topic""")
def l04d(spark, d):
    """The topics' intercepts of the three stages, from pooled frequencies and mass."""
    cells = cells_of(spark, d)
    return dynamics.baselines(dynamics.transition_rows(cells, space_of(cells))).select("topic", *rounded("retain", "enter", "allocate"))


@query("l04e_sequential_model")
def l04e(spark, d):
    """Coefficients of keeping, entering and allocating, with 95 % intervals."""
    cells = cells_of(spark, d)
    found = dynamics.sequential_model(dynamics.transition_rows(cells, space_of(cells)))
    return found.withColumns({"low": F.col("coefficient") - 1.96 * F.col("se"), "high": F.col("coefficient") + 1.96 * F.col("se")})


@query("l04f_calibrated_simulation")
def l04f(spark, d):
    """By year the observed breadth of actors and popularity of topics beside 16 simulated paths of the calibrated model."""
    cells = cells_of(spark, d)
    near = cut(space_of(cells), "space")
    rows = cut(dynamics.transition_rows(cells, near), "transitions")
    coefficients, base, shifts = dynamics.calibrated(cells, near, rows)
    paths = dynamics.simulated(cells, near, base, coefficients, [shifts], 16, seed=1)
    seen = rows.filter("now = 1").select(F.lit(-1).cast("long").alias("simulation"), "period", "actor", "topic")
    both = seen if paths is None else seen.unionByName(paths.select("simulation", "period", "actor", "topic"))
    n = F.count(F.lit(1))
    each = both.groupBy("simulation", "period").agg((n / F.count_distinct("actor")).alias("breadth"), (n / F.count_distinct("topic")).alias("popularity"))
    long = each.unpivot(["simulation", "period"], ["breadth", "popularity"], "measure", "value")
    drawn = F.when(F.col("simulation") >= 0, F.col("value"))
    return long.groupBy("period", "measure").agg(
        F.max(F.when(F.col("simulation") < 0, F.col("value"))).alias("observed"), F.avg(drawn).alias("simulated"), F.percentile(drawn, 0.05).alias("low"), F.percentile(drawn, 0.95).alias("high")
    )


@query("l05b_thinned_cubes", SQL + f""", s AS (SELECT unnest({list(SHARES)}) AS share), r AS (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate),
u AS (SELECT year, actor, topic, replicate, floor((CAST('0x' || substring(md5('5:' || replicate || ':' || doc), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 * 100) AS u FROM fact, r)
SELECT CAST(share AS INTEGER) AS share, CAST(replicate AS INTEGER) AS replicate, year, actor, topic, count(*) AS x FROM u JOIN s ON u < share GROUP BY ALL""")
def l05b(spark, d):
    """The yearly cube of five replicates of each share of the documents."""
    return dynamics.thinned_cubes(activity(spark, d), "doc", ["year", "actor", "topic"], SHARES, REPLICATES, seed=5)


@query("l05c_thinned_fits")
def l05c(spark, d):
    """Mean and deviation of every coefficient of the sequential model over the replicates of each share; all models are fitted together, each on its own network."""
    by = ["share", "replicate"]
    facts = activity(spark, d)
    thinned = dynamics.thinned_cubes(facts, "doc", ["year", "actor", "topic"], SHARES, REPLICATES, seed=5)
    whole = facts.groupBy("year", "actor", "topic").agg(F.count(F.lit(1)).alias("x")).select(F.lit(100).alias("share"), F.lit(1).alias("replicate"), "year", "actor", "topic", "x")
    cells = cut(thinned.unionByName(whole).withColumnRenamed("year", "period").withColumnsRenamed({"share": "kept"}), "thinned")
    keys = ["kept", "replicate"]
    near = space.similarity(space.support(cells.groupBy(*keys, "actor", "topic").agg(F.sum("x").alias("x")), keys), keys).select(*keys, "i", "j", "phi")
    fits = dynamics.sequential_model(dynamics.transition_rows(cells, near, keys), keys)
    return fits.groupBy(F.col("kept").alias(by[0]), "stage", "term").agg(F.avg("coefficient").alias("mean"), F.stddev_samp("coefficient").alias("sd"), F.count(F.lit(1)).alias("replicates"))
