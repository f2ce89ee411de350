"""Distance modes, lookbacks by meeting, survival at every step, wider windows, blocs as communities, curves of positive values."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators import clean, cube, models, panel, space, stats
from loomwork.plans.facts import SQL, activity, lines, table
from loomwork.plans.queries_panel import CUMULATIVE, PANEL, SPELLS, adoption, all_spells, edges_in, held_in, written
from loomwork.plans.queries_pairs import places
from loomwork.plans.queries_space import REGIONS, regions, rounded
from loomwork.plans.registry import query
from loomwork.sources.store import cut

MODES = ("aggregate", "instantaneous", "cumulative_lagged")


def edges_by_mode(cells, mode: str):
    """The network a transition is measured in: of all years, of the earlier year alone, or of all years up to it; and the column of its year."""
    if mode == "aggregate":
        return edges_in(cells).select("i", "j", "phi"), None
    if mode == "instantaneous":
        history = cells
    elif mode == "cumulative_lagged":
        history = cube.cumulative_cube(cells, "year", ["actor", "topic"], cells.select("year").distinct())
    else:
        raise ValueError(f"no distance mode {mode}; there are {', '.join(MODES)}")
    return space.similarity(space.support(history, ["year"]), ["year"]).select("year", "i", "j", "phi"), "year"


@query("i09_distance_modes", PANEL + CUMULATIVE.rstrip() + """, iu AS (SELECT year, topic, count(*) AS u FROM ysup GROUP BY ALL),
ic AS (SELECT a.year, a.topic AS i, b.topic AS j, count(*) AS n FROM ysup a JOIN ysup b ON a.year = b.year AND a.actor = b.actor AND a.topic < b.topic GROUP BY ALL),
ip AS (SELECT ic.year, i, j, n * 1.0 / greatest(p.u, q.u) AS phi FROM ic JOIN iu p ON p.year = ic.year AND p.topic = i JOIN iu q ON q.year = ic.year AND q.topic = j),
inear AS (SELECT year AS prev, i AS topic, j AS held, phi FROM ip UNION ALL SELECT year, j, i, phi FROM ip),
ibest AS (SELECT p.prev, period, actor, n.topic, max(phi) AS closeness FROM prior p JOIN inear n ON n.held = p.topic AND n.prev = p.prev GROUP BY ALL)
SELECT 'aggregate' AS mode, r.prev, r.period, r.actor, r.topic, round(1 - coalesce(closeness, 0), 6) AS distance FROM risk r LEFT JOIN best USING (prev, period, actor, topic)
UNION ALL SELECT 'instantaneous', r.prev, r.period, r.actor, r.topic, round(1 - coalesce(closeness, 0), 6) FROM risk r LEFT JOIN ibest USING (prev, period, actor, topic)
UNION ALL SELECT 'cumulative_lagged', r.prev, r.period, r.actor, r.topic, round(1 - coalesce(closeness, 0), 6) FROM risk r LEFT JOIN cbest USING (prev, period, actor, topic)""")
def i09(spark, d):
    """The distance of every topic at risk in each of the three modes."""
    cells = written(spark, d)
    entities = cells.agg(F.count_distinct("actor")).first()[0]
    out = None
    for mode in MODES:
        near, year = edges_by_mode(cells, mode)
        rows = panel.adoption_panel(held_in(cells), near, cube.distinct_values(cells, "topic"), entities, edges_by=year)
        rows = rows.select(F.lit(mode).alias("mode"), "prev", "period", "actor", "topic", F.round(1 - F.col("closeness"), 6).alias("distance"))
        out = rows if out is None else out.unionByName(rows)
    return out


PATHS = ",\n".join(
    f"e{k} AS (SELECT i, j, min(d) AS d FROM (SELECT i, j, d FROM e{k - 1} UNION ALL SELECT a.i, b.j, a.d + b.d FROM e{k - 1} a JOIN e{k - 1} b ON a.j = b.i WHERE a.i <> b.j) GROUP BY i, j)" for k in range(1, 6)
)


@query("i13c_lookback_meetings", SQL + """, mt AS (SELECT year, quarter, CAST(row_number() OVER (ORDER BY year, quarter) AS INTEGER) AS meeting FROM (SELECT DISTINCT year, quarter FROM lines)),
mc AS (SELECT meeting, actor, topic, count(*) AS x FROM (SELECT DISTINCT doc, meeting, actor, topic FROM lines JOIN mt USING (year, quarter)) GROUP BY ALL),
mm AS (SELECT *, CAST(sum(x) OVER (PARTITION BY meeting, actor) AS BIGINT) AS c, CAST(sum(x) OVER (PARTITION BY meeting, topic) AS BIGINT) AS p, CAST(sum(x) OVER (PARTITION BY meeting) AS BIGINT) AS t FROM mc),
ms AS (SELECT meeting, actor, topic FROM mm WHERE CAST(x AS HUGEINT) * t > CAST(c AS HUGEINT) * p),
pl AS (SELECT meeting, row_number() OVER (ORDER BY meeting) AS n FROM (SELECT DISTINCT meeting FROM ms)), st AS (SELECT lookback, a.meeting AS prev, b.meeting AS period FROM (SELECT CAST(unnest([1, 2, 3, 4, 5, 6]) AS INTEGER) AS lookback) JOIN pl a ON true JOIN pl b ON b.n = a.n + lookback),
e0 AS (SELECT i, j, -ln(phi) AS d FROM phi UNION ALL SELECT j, i, -ln(phi) FROM phi), """ + PATHS + """,
bp AS (SELECT meeting AS prev, actor, i AS topic, min(d) AS distance FROM ms JOIN e5 ON j = topic GROUP BY ALL), hd AS (SELECT meeting AS prev, actor, count(*) AS prev_diversity FROM ms GROUP BY ALL),
rk AS (SELECT hd.*, u.topic FROM hd CROSS JOIN (SELECT DISTINCT topic FROM mc) u ANTI JOIN ms ON ms.meeting = hd.prev AND ms.actor = hd.actor AND ms.topic = u.topic)
SELECT lookback, rk.prev, st.period, rk.actor, rk.topic, CAST(ms.actor IS NOT NULL AS INTEGER) AS adopted, round(-bp.distance, 6) AS log_phi, round(exp(-bp.distance), 6) AS phi_best_path, prev_diversity
FROM rk JOIN st ON st.prev = rk.prev JOIN bp ON bp.prev = rk.prev AND bp.actor = rk.actor AND bp.topic = rk.topic LEFT JOIN ms ON ms.meeting = st.period AND ms.actor = rk.actor AND ms.topic = rk.topic""")
def i13c(spark, d):
    """Lookbacks of one to six meetings (quarters); closeness is the product of proximities along the best path."""
    rows = cube.ordinal_time(lines(spark, d), ["year", "quarter"], "meeting").select("doc", "meeting", "actor", "topic").distinct()
    cells = cut(cube.count_cube(rows, ["meeting", "actor", "topic"]), "meetings")
    whole = space.similarity(space.support(cells.groupBy("actor", "topic").agg(F.sum("x").alias("x"))))
    topics = cube.distinct_values(cells, "topic")
    ways = space.shortest_paths(whole, topics.withColumnRenamed("topic", "node"), -F.log("phi"), fill_factor=float("inf"))
    best = ways.filter(F.col("distance") < float("inf")).filter("i < j").select("i", "j", F.exp(-F.col("distance")).alias("phi"))
    sup = cut(space.support(cells, ["meeting"]).withColumnRenamed("meeting", "period"), "held")
    entities = cells.agg(F.count_distinct("actor")).first()[0]
    out = panel.lookback_panel(sup, best, topics, entities, range(1, 7)).filter("closeness > 0")
    return out.select("lookback", "prev", "period", "actor", "topic", "adopted", F.round(F.log("closeness"), 6).alias("log_phi"), F.round("closeness", 6).alias("phi_best_path"), "prev_diversity")


@query("i19b_survival_every_step", SPELLS + """, n AS (SELECT gap, CAST(unnest(range(0, m + 1)) AS INTEGER) AS t FROM (SELECT gap, max(duration) AS m FROM spell GROUP BY gap)),
r AS (SELECT n.gap, n.t, count(*) FILTER (duration >= n.t) AS at_risk, count(*) FILTER (duration = n.t AND event = 1) AS events FROM n JOIN spell USING (gap) GROUP BY ALL)
SELECT gap, t, at_risk, events, round(CASE WHEN min(at_risk - events) OVER w = 0 THEN 0 ELSE exp(sum(ln(nullif(at_risk - events, 0) * 1.0 / at_risk)) OVER w) END, 6) AS survival FROM r WINDOW w AS (PARTITION BY gap ORDER BY t)""")
def i19b(spark, d):
    """The survival of spells at every step from 0 on."""
    return panel.every_step(panel.kaplan_meier(all_spells(spark, d), ["gap"]), ["gap"]).select("gap", "t", "at_risk", "events", *rounded("survival"))


FIVE = REGIONS + """, wc AS (SELECT CAST(e AS INTEGER) AS period, actor, topic, count(*) AS x FROM fact, unnest(range(year, year + 5)) AS u(e) WHERE e BETWEEN (SELECT min(year) + 4 FROM fact) AND (SELECT max(year) FROM fact) GROUP BY ALL),
wm AS (SELECT *, CAST(sum(x) OVER (PARTITION BY period, actor) AS BIGINT) AS c, CAST(sum(x) OVER (PARTITION BY period, topic) AS BIGINT) AS p, CAST(sum(x) OVER (PARTITION BY period) AS BIGINT) AS t FROM wc),
ws AS (SELECT period, actor, region, sum((x * 1.0 / c) / (p * 1.0 / t)) AS w, count(*) AS k FROM wm JOIN reg USING (topic) WHERE CAST(x AS HUGEINT) * t > CAST(c AS HUGEINT) * p GROUP BY ALL),
dm AS (SELECT period, actor, region FROM (SELECT *, row_number() OVER (PARTITION BY period, actor ORDER BY round(w, 9) DESC, region) AS r, sum(k) OVER (PARTITION BY period, actor) AS held FROM ws) WHERE r = 1 AND held >= 3),
mv AS (SELECT a.region AS source, b.region AS target FROM dm a JOIN dm b ON b.actor = a.actor AND b.period = a.period + 1)
"""


@query("l02c_five_year_windows", FIVE + """, g AS (SELECT s.region AS source, t.region AS target FROM (SELECT DISTINCT region FROM reg) s CROSS JOIN (SELECT DISTINCT region FROM reg) t), n AS (SELECT source, target, count(*) AS n FROM mv GROUP BY ALL)
SELECT g.source, g.target, coalesce(n, 0) AS n, round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g.source), 0), 6) AS share,
(SELECT round(avg(CAST(source = target AS INTEGER)), 6) FROM mv) AS same, (SELECT round(avg(CAST(abs(source - target) <= 1 AS INTEGER)), 6) FROM mv) AS near, (SELECT round(avg(CAST(abs(source - target) > 1 AS INTEGER)), 6) FROM mv) AS far
FROM g LEFT JOIN n ON n.source = g.source AND n.target = g.target""")
def l02c(spark, d):
    """The whole matrix of moves between dominant regions from one window of five years to the next, absent moves as 0, with the rates of all moves."""
    facts = activity(spark, d)
    first, last = facts.agg(F.min("year"), F.max("year")).first()
    windows = cube.assign_rolling(facts, "year", 5, (first or 0) + 4, last or 0, "period").drop("year")
    at = regions(spark, d)
    spec = space.specialization(cube.count_cube(windows, ["period", "actor", "topic"]), ["period"]).filter("active").join(at, "topic")
    sums = spec.groupBy("period", "actor", "region").agg(F.round(F.sum("rca"), 9).alias("w"), F.count(F.lit(1)).alias("k"))
    modes = cut(sums.groupBy("period", "actor").agg(F.max_by("region", F.struct("w", -F.col("region"))).alias("source"), F.sum("k").alias("held")).filter("held >= 3").drop("held"), "modes")
    moves = modes.join(modes.select((F.col("period") - 1).alias("period"), "actor", F.col("source").alias("target")), ["period", "actor"])
    gap = F.abs(F.col("source") - F.col("target"))
    rate = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    rates = moves.agg(rate(gap == 0, "same"), rate(gap <= 1, "near"), rate(gap > 1, "far"))
    names = at.select("region").distinct()
    grid = names.withColumnRenamed("region", "source").crossJoin(names.withColumnRenamed("region", "target"))
    counted = grid.join(moves.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")), ["source", "target"], "left").fillna(0, ["n"])
    share = F.round(F.try_divide("n", F.sum("n").over(Window.partitionBy("source"))), 6)
    return counted.withColumn("share", share).crossJoin(rates).select("source", "target", "n", "share", "same", "near", "far")


@query("i50b_bloc_specialization", SQL + """, bl AS (SELECT n_name AS actor, CAST(n_regionkey AS INTEGER) AS bloc FROM nation), bc AS (SELECT year, topic, bloc, count(*) AS x FROM (SELECT DISTINCT doc, year, topic, bloc FROM fact JOIN bl USING (actor)) GROUP BY ALL),
bm AS (SELECT *, sum(x) OVER (PARTITION BY year, bloc) AS c, sum(x) OVER (PARTITION BY year, topic) AS p, sum(x) OVER (PARTITION BY year) AS t FROM bc), br AS (SELECT year, topic, bloc, x * 1.0 / p AS share, (x * 1.0 / c) / (p * 1.0 / t) AS rca FROM bm)
SELECT year, topic, bloc AS dominant, round(share, 6) AS share, round(CASE WHEN rca >= 1 - 1e-12 THEN rca ELSE 0 END, 6) AS rca FROM br QUALIFY row_number() OVER (PARTITION BY year, topic ORDER BY CASE WHEN round(rca, 9) >= 1 THEN round(rca, 9) ELSE 0 END DESC, bloc) = 1""")
def i50b(spark, d):
    """Documents recoded to blocs: for each year and topic the bloc most specialized in it (none at 1 or above: the least bloc), its share and its index."""
    blocs = places(spark, d).select("actor", F.col("bloc").cast("int").alias("bloc"))
    rows = lines(spark, d).join(blocs, "actor").select("doc", "year", "topic", "bloc").distinct()
    spec = space.specialization(cut(cube.count_cube(rows, ["year", "topic", "bloc"]), "blocs"), ["year"], entity="bloc")
    index = F.round("rca", 9)
    level = F.when(index >= 1, index).otherwise(0.0)
    first = F.row_number().over(Window.partitionBy("year", "topic").orderBy(F.desc(level), "bloc"))
    return spec.withColumn("_r", first).filter("_r = 1").select("year", "topic", F.col("bloc").alias("dominant"), F.round(F.col("x") / F.col("p"), 6).alias("share"), F.round(F.when(index >= 1, F.col("rca")).otherwise(0.0), 6).alias("rca"))


@query("i18b_positive_curve", """WITH r AS (SELECT ln(1 + c_acctbal) AS x, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0), e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(x, [0, 1/7, 2/7, 3/7, 4/7, 5/7, 6/7, 1]), lambda v: round(v, 9)))) AS edges FROM r),
b AS (SELECT CAST(least(len(edges) - 1, len(list_filter(edges, lambda v: v <= round(x, 9)))) AS INTEGER) AS bin, x, y FROM r, e WHERE len(edges) >= 3)
SELECT bin, count(*) AS n, round(median(x), 6) AS x, round(median(y), 4) AS y FROM b GROUP BY bin HAVING count(*) >= 20""")
def i18b(spark, d):
    """Medians of order value by balance: positive balances only, on the scale ln(1 + x), in seven bins of equal numbers closed on the left (the last on both sides) with at least 20 orders."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter("c_acctbal > 0").select(F.log1p("c_acctbal").alias("x"), F.col("o_totalprice").alias("y"))
    edges_of = panel.quantile_edges(rows, "x", 7).select(F.array_sort(F.array_distinct(F.transform("edges", lambda e: F.round(e, 9)))).alias("edges")).filter(F.size("edges") >= 3)
    place = F.least(F.size("edges") - 1, F.size(F.filter("edges", lambda e: e <= F.round("x", 9))))
    binned = rows.crossJoin(edges_of).withColumn("bin", place.cast("int"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("x"), 6).alias("x"), F.round(F.median("y"), 4).alias("y")).filter("n >= 20")


@query("j03b_standardised_glm")
def j03b(spark, d):
    """The pooled logit of adoption on distance and popularity, raw and with both standardised, errors clustered by actor."""
    rows = cut(adoption(spark, d).withColumn("distance", 1 - F.col("closeness")).select("actor", "adopted", "distance", "popularity"), "pooled")
    scaled = rows
    for c in ("distance", "popularity"):
        scaled = stats.z_score(scaled, c).drop(c).withColumnRenamed("z", c)
    fit = lambda df, scale: models.logit(df, "adopted", ["distance", "popularity"], cluster="actor").withColumn("scale", F.lit(scale))
    return fit(rows, "raw").unionByName(fit(scaled, "standardised"))


@query("c12b_wrapped_labels", """WITH p AS (SELECT DISTINCT p_type || ' of ' || p_name || ' by ' || p_brand || ' and others' AS label FROM part), w AS (SELECT label, string_split(label, ' ') AS ws FROM p),
f AS (SELECT label, list_reduce(list_transform(ws, lambda x: [x]), lambda a, b: CASE WHEN length(a[-1] || ' ' || b[1]) <= 14 THEN list_concat(a[:len(a) - 1], [a[-1] || ' ' || b[1]]) ELSE list_concat(a, b) END) AS ls FROM w)
SELECT label, CASE WHEN len(ls) <= 2 THEN array_to_string(ls, chr(10)) ELSE ls[1] || chr(10) || regexp_replace(CASE WHEN length(ls[2]) >= 13 THEN rtrim(substring(ls[2], 1, 12)) ELSE ls[2] END, '\\.+$', '') || '...' END AS wrapped FROM f""")
def c12b(spark, d):
    """Long labels in two lines of fourteen characters."""
    p = table(spark, d, "part")
    label = F.concat(F.col("p_type"), F.lit(" of "), F.col("p_name"), F.lit(" by "), F.col("p_brand"), F.lit(" and others"))
    return p.select(label.alias("label")).distinct().select("label", clean.wrapped(F.col("label"), 14, 2).alias("wrapped"))
