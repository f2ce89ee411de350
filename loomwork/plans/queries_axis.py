"""The first axes of the space, its three regions and what actors hold of them, without a matrix on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators import axis, cube, sequence, space
from loomwork.plans.queries_space import PATHS, counts, edges, rounded, yearly
from loomwork.plans.registry import query
from loomwork.sources.store import cut

AXES, SQUARINGS, REGIONS, MOST, LEAST = 3, 16, 3, 7, 3


def _axis_sql(k: int) -> str:
    squared = ",\n".join(
        f"q{k}_{t} AS MATERIALIZED (SELECT i, j, p / sum(p) FILTER (i = j) OVER () AS p FROM (SELECT x.i, y.j, sum(x.p * y.p) AS p FROM q{k}_{t - 1} x JOIN q{k}_{t - 1} y ON x.j = y.i GROUP BY x.i, y.j))" for t in range(1, SQUARINGS + 1)
    )
    return f"""h{k} AS (SELECT greatest(0, max(s)) AS s FROM (SELECT i, sum(CASE WHEN i <> j THEN abs(b) ELSE -b END) AS s FROM b{k} GROUP BY i)),
q{k}_0 AS MATERIALIZED (SELECT i, j, p / sum(p) FILTER (i = j) OVER () AS p FROM (SELECT i, j, b + CASE WHEN i = j THEN s ELSE 0 END AS p FROM b{k}, h{k})),
{squared},
v{k} AS MATERIALIZED (SELECT i, p / sqrt(d) AS v FROM q{k}_{SQUARINGS} JOIN (SELECT i AS j, p AS d FROM q{k}_{SQUARINGS} WHERE i = j ORDER BY round(p, 9) DESC, i LIMIT 1) USING (j)),
l{k} AS MATERIALIZED (SELECT sum(b * x.v * y.v) AS l FROM b{k} JOIN v{k} x USING (i) JOIN v{k} y ON y.i = b{k}.j),
b{k + 1} AS MATERIALIZED (SELECT b{k}.i, b{k}.j, b - l * x.v * y.v AS b FROM b{k} JOIN v{k} x USING (i) JOIN v{k} y ON y.i = b{k}.j, l{k})"""


CENTRED = PATHS + """, sq AS MATERIALIZED (SELECT a.topic AS i, b.topic AS j, pow(CASE WHEN a.topic = b.topic THEN 0 ELSE coalesce(d, 1.05 * (SELECT max(d) FROM e6)) END, 2) AS s FROM u a CROSS JOIN u b LEFT JOIN e6 ON i = a.topic AND j = b.topic),
b1 AS MATERIALIZED (SELECT i, j, -0.5 * (s - avg(s) OVER (PARTITION BY i) - avg(s) OVER (PARTITION BY j) + avg(s) OVER ()) AS b FROM sq),
"""


def axes(spark, d, count: int) -> DataFrame:
    """The first axes of the whole space: paths of -ln phi, unreachable pairs at 1.05 of the longest."""
    nodes = cut(cube.distinct_values(counts(spark, d), "topic").withColumnRenamed("topic", "node"), "nodes")
    paths = space.shortest_paths(cut(edges(spark, d), "edges"), nodes, -F.log("phi"), fill_factor=1.05)
    return axis.classical_axes(paths, nodes, count).withColumnRenamed("node", "topic")


@query("i35b_axes", CENTRED + ",\n".join(_axis_sql(k) for k in range(1, AXES + 1)) + " " + " UNION ALL ".join(
    f"SELECT i AS topic, {k} AS axis, round(l, 6) AS eigenvalue, round(v * sqrt(greatest(l, 0)), 6) + 0.0 AS position FROM v{k}, l{k}" for k in range(1, AXES + 1)
))
def i35b(spark, d):
    """Positions of all topics on the first three axes of classical scaling, and the axes' eigenvalues."""
    return axes(spark, d, AXES).select("topic", "axis", *rounded("eigenvalue"), (F.round("position", 6) + 0.0).alias("position"))


PLACED = CENTRED.replace("WITH lines", "WITH RECURSIVE lines", 1) + _axis_sql(1) + f""", px AS (SELECT i AS topic, v * sqrt(greatest(l, 0)) AS position FROM v1, l1),
pl AS (SELECT topic, (position - min(position) OVER ()) / (max(position) OVER () - min(position) OVER ()) AS x, row_number() OVER (ORDER BY round(position, 9), topic) AS k, sg FROM px JOIN (SELECT topic, sum(greatest(rca - 1, 0)) AS sg FROM rca GROUP BY topic) USING (topic)),
ow AS (SELECT o, exp(-o * o / (2 * 1.15 * 1.15)) AS g FROM (SELECT unnest(range(-3, 4)) AS o)),
sm AS MATERIALIZED (SELECT s.topic, any_value(s.x) AS x, any_value(s.k) AS k, any_value(s.sg) AS excess, sum(g * t.sg) / sum(g) AS weight FROM pl s, ow, (SELECT max(k) AS m FROM pl) mm, pl t WHERE t.k = greatest(1, least(mm.m, s.k + o)) GROUP BY s.topic),
pt AS (SELECT list(struct_pack(x := x, w := weight) ORDER BY x, topic) AS ps FROM sm),
ll AS (SELECT 0 AS r, list_transform(range(0, {REGIONS}), lambda c: c * 1.0 / {REGIONS - 1}) AS cs UNION ALL
  SELECT r + 1, list_transform(range(1, {REGIONS + 1}), lambda c: coalesce(list_sum(list_transform(list_filter(ps, lambda p: list_position(list_transform(cs, lambda y: abs(p.x - y)), list_min(list_transform(cs, lambda y: abs(p.x - y)))) = c), lambda p: p.x * p.w))
    / nullif(list_sum(list_transform(list_filter(ps, lambda p: list_position(list_transform(cs, lambda y: abs(p.x - y)), list_min(list_transform(cs, lambda y: abs(p.x - y)))) = c), lambda p: p.w)), 0), cs[c])) FROM ll, pt WHERE r < 50),
an AS MATERIALIZED (SELECT DISTINCT a.topic, a.x FROM (SELECT arg_min(struct_pack(topic := topic, x := x), (abs(x - c), x, topic)) AS a FROM sm, (SELECT unnest(cs) AS c FROM ll WHERE r = 50) GROUP BY c)),
ct AS (SELECT (x + lag(x) OVER (ORDER BY x)) / 2 AS cut FROM an),
tr AS MATERIALIZED (SELECT topic, x, k, excess, weight, CAST((SELECT count(*) FROM ct WHERE cut <= x) + 1 AS INTEGER) AS region, topic IN (SELECT topic FROM an) AS is_anchor FROM sm),
"""


def smoothed_places(spark, d) -> DataFrame:
    """topic, x (from 0 to 1 on the first axis), place (from 1), excess, weight (the excess smoothed along the axis)."""
    at = axes(spark, d, 1)
    ends = at.agg(F.min("position").alias("_lo"), F.max("position").alias("_hi"))
    x = F.coalesce(F.try_divide(F.col("position") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    excess = space.excess(space.specialization(counts(spark, d)), ["topic"])
    rows = at.crossJoin(ends).withColumns({"x": x, "place": F.row_number().over(Window.orderBy(F.round("position", 9), "topic"))}).join(excess, "topic", "left").fillna(0.0, ["excess"])
    return cut(sequence.gaussian_smooth(rows, "excess", "place", 1.15, 3).select("topic", "x", "place", "excess", F.col("smooth").alias("weight")), "places")


def placed_regions(spark, d) -> DataFrame:
    """topic, x, place, excess, weight, region, is_anchor, centre of the three regions of the first axis."""
    places = smoothed_places(spark, d)
    found = axis.centre_regions(places, [REGIONS], x="x").select("topic", "region", "is_anchor", "centre")
    return cut(places.join(found, "topic"), "regions")


@query("l01d_topic_summary", PLACED.rstrip(",\n") + " SELECT topic, CAST(k - 1 AS INTEGER) AS topic_order, round(x, 6) AS x_plot, round(excess, 6) AS signal, round(weight, 6) AS signal_smooth, region, is_anchor FROM tr")
def l01d(spark, d):
    """Each topic's place on the first axis, its excess there and smoothed, its region, and whether a region's centre is snapped to it."""
    return placed_regions(spark, d).select("topic", (F.col("place") - 1).alias("topic_order"), F.round("x", 6).alias("x_plot"), F.round("excess", 6).alias("signal"), F.round("weight", 6).alias("signal_smooth"), "region", "is_anchor")


@query("l01e_region_bounds", PLACED + """ac AS (SELECT region, x, topic FROM tr WHERE is_anchor), bs AS (SELECT region, x, topic, lag(x) OVER w AS px, lead(x) OVER w AS nx FROM ac WINDOW w AS (ORDER BY region))
SELECT region, topic AS anchor, round(coalesce((x + px) / 2, 0), 6) AS boundary_left, round(coalesce((x + nx) / 2, 1), 6) AS boundary_right, count(*) AS topics, round(sum(t.excess), 6) AS excess FROM bs JOIN (SELECT region, excess FROM tr) t USING (region) GROUP BY ALL""")
def l01e(spark, d):
    """The regions of the first axis: the topic their centre is snapped to, the boundaries half way between these, their topics and excess."""
    rows = placed_regions(spark, d)
    w = Window.orderBy("region")
    anchors = rows.filter("is_anchor").select("region", F.col("topic").alias("anchor"), "x", F.lag("x").over(w).alias("_p"), F.lead("x").over(w).alias("_n"))
    sums = rows.groupBy("region").agg(F.count(F.lit(1)).alias("topics"), F.sum("excess").alias("excess"))
    left, right = F.coalesce((F.col("x") + F.col("_p")) / 2, F.lit(0.0)), F.coalesce((F.col("x") + F.col("_n")) / 2, F.lit(1.0))
    return anchors.join(sums, "region").select("region", "anchor", F.round(left, 6).alias("boundary_left"), F.round(right, 6).alias("boundary_right"), "topics", *rounded("excess"))


def _shares_sql(by: str, source: str) -> str:
    parts = ", ".join(f"coalesce(sum(greatest(rca - 1, 0)) FILTER (region = {r}), 0) / sum(greatest(rca - 1, 0)) AS share_{r}" for r in range(1, REGIONS + 1))
    return f"SELECT {by}, {parts}, count(*) FILTER (active) AS k_active, sum(rca * x) / sum(rca) AS centroid, sum(rca) AS support FROM {source} JOIN tr USING (topic) GROUP BY {by} HAVING count(*) FILTER (active) >= {LEAST}"


def region_profile(spec: DataFrame, placed: DataFrame, by: list[str]) -> DataFrame:
    """by, share_1.. (of the excess in each region), k_active, centroid (by the index), support; only of who is above 1 in three topics or more."""
    over = F.greatest(F.col("rca") - 1, F.lit(0.0))
    rows = spec.drop("x").join(placed.select("topic", "x", "region"), "topic")
    share = lambda r: F.try_divide(F.sum(F.when(F.col("region") == r, over).otherwise(0.0)), F.sum(over)).alias(f"share_{r}")
    out = rows.groupBy(*by).agg(
        *map(share, range(1, REGIONS + 1)), F.count(F.when(F.col("active"), 1)).alias("k_active"), F.try_divide(F.sum(F.col("rca") * F.col("x")), F.sum("rca")).alias("centroid"), F.sum("rca").alias("support")
    )
    return out.filter(F.col("k_active") >= LEAST)


SHARES = [f"share_{r}" for r in range(1, REGIONS + 1)]
SHARES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in SHARES)


@query("l01f_actor_regions", PLACED + f"ap AS ({_shares_sql('actor', '(SELECT actor, topic, rca, active FROM rca)')}) SELECT actor, k_active, {SHARES_SQL}, CAST(list_position([{', '.join(f'round({c}, 9)' for c in SHARES)}], greatest({', '.join(f'round({c}, 9)' for c in SHARES)})) AS INTEGER) AS dominant_region, round(greatest({', '.join(SHARES)}), 6) AS dominant_region_share, round(centroid, 6) AS centroid, round(support, 6) AS support FROM ap")
def l01f(spark, d):
    """Each actor's shares of its excess in the regions of the first axis, the dominant one (ties: the first), its breadth, centroid and summed index."""
    out = region_profile(space.specialization(counts(spark, d)), placed_regions(spark, d), ["actor"])
    nine = F.array(*[F.round(c, 9) for c in SHARES])
    best = F.array_position(nine, F.array_max(nine)).cast("int").alias("dominant_region")
    return out.select("actor", "k_active", *rounded(*SHARES), best, F.round(F.greatest(*SHARES), 6).alias("dominant_region_share"), *rounded("centroid", "support"))


SPAN = 5


@query("l09b_axis_trajectories", PLACED + f"""wc AS (SELECT w.year AS period, actor, topic, CAST(sum(x) AS BIGINT) AS x FROM years w JOIN ycube y ON y.year BETWEEN w.year - {SPAN - 1} AND w.year GROUP BY ALL),
wm AS (SELECT *, CAST(sum(x) OVER (PARTITION BY period, actor) AS BIGINT) AS c, CAST(sum(x) OVER (PARTITION BY period, topic) AS BIGINT) AS p, CAST(sum(x) OVER (PARTITION BY period) AS BIGINT) AS t FROM wc),
wr AS (SELECT period, actor, topic, (x * 1.0 / c) / (p * 1.0 / t) AS rca, CAST(x AS HUGEINT) * t > CAST(c AS HUGEINT) * p AS active FROM wm), wp AS ({_shares_sql('period, actor', 'wr')}), ax AS (SELECT {', '.join(f'max(x) FILTER (region = {r}) AS a{r}' for r in range(1, REGIONS + 1))} FROM tr WHERE is_anchor)
SELECT period, actor, k_active, {SHARES_SQL}, round({' + '.join(f'coalesce(share_{r} * a{r}, 0)' for r in range(1, REGIONS + 1))}, 6) AS position, round(centroid, 6) AS centroid FROM wp, ax""")
def l09b(spark, d):
    """In windows of five years: each actor's shares of its excess in the regions of the first axis and its position, the regions' anchors weighed by these."""
    rows = cut(yearly(spark, d), "yearly")
    ends = rows.select(F.col("year").alias("period")).distinct()
    wide = rows.withColumn("period", F.explode(F.sequence(F.col("year"), F.col("year") + SPAN - 1))).join(ends, "period", "left_semi")
    spec = space.specialization(wide.groupBy("period", "actor", "topic").agg(F.sum("x").alias("x")), ["period"])
    placed = placed_regions(spark, d)
    anchors = placed.filter("is_anchor").agg(*[F.max(F.when(F.col("region") == r, F.col("x"))).alias(f"_a{r}") for r in range(1, REGIONS + 1)])
    out = region_profile(spec, placed, ["period", "actor"]).crossJoin(anchors)
    position = sum((F.coalesce(F.col(f"share_{r}") * F.col(f"_a{r}"), F.lit(0.0)) for r in range(1, REGIONS + 1)), F.lit(0.0))
    return out.select("period", "actor", "k_active", *rounded(*SHARES), F.round(position, 6).alias("position"), *rounded("centroid"))


INERTIA = PLACED + """rn AS MATERIALIZED (SELECT row_number() OVER o AS n, sum(w) OVER o AS s0, sum(w * x) OVER o AS s1, sum(w * x * x) OVER o AS s2 FROM (SELECT x, topic, greatest(weight, 1e-9) AS w FROM sm) WINDOW o AS (ORDER BY x, topic ROWS UNBOUNDED PRECEDING) UNION ALL SELECT 0, 0, 0, 0),
sp AS MATERIALIZED (SELECT a.n AS a, b.n AS b, greatest(0, b.s2 - a.s2 - pow(b.s1 - a.s1, 2) / (b.s0 - a.s0)) AS cost FROM rn a JOIN rn b ON a.n < b.n), k1 AS MATERIALIZED (SELECT b, cost FROM sp WHERE a = 0),
""" + ",\n".join(f"k{k} AS MATERIALIZED (SELECT sp.b, min(k{k - 1}.cost + sp.cost) AS cost FROM k{k - 1} JOIN sp ON sp.a = k{k - 1}.b GROUP BY sp.b)" for k in range(2, MOST + 1)) + ", ki AS (" + " UNION ALL ".join(
    f"SELECT {k} AS k, cost AS inertia FROM k{k} WHERE b = (SELECT max(n) FROM rn)" for k in range(1, MOST + 1)
) + """), kg AS (SELECT k, inertia, lag(inertia) OVER (ORDER BY k) AS before FROM ki)
SELECT k, round(inertia, 6) AS inertia, round(before - inertia, 6) AS gain, round((before - inertia) / before, 6) AS relative_gain, round(lag(before - inertia) OVER (ORDER BY k) - (before - inertia), 6) AS elbow FROM kg"""


@query("i25b_weighted_inertia", INERTIA)
def i25b(spark, d):
    """The least weighted inertia of 1 to 7 centres on the first axis, topics weighing their smoothed excess; gains and elbow scores."""
    return axis.least_inertia(smoothed_places(spark, d), MOST, x="x").select("k", *rounded("inertia", "gain", "relative_gain", "elbow"))


KS = range(2, 7)
CLOSEST = "list_position(list_transform(cs, lambda y: abs(p.x - y)), list_min(list_transform(cs, lambda y: abs(p.x - y)))) = c"


@query("i24b_region_validation", PLACED[: PLACED.index("ll AS")] + f"""lk AS (SELECT k, 0 AS r, list_transform(range(0, k), lambda c: c * 1.0 / (k - 1)) AS cs FROM (SELECT unnest(range({KS[0]}, {KS[-1] + 1})) AS k) UNION ALL
  SELECT k, r + 1, list_transform(range(1, k + 1), lambda c: coalesce(list_sum(list_transform(list_filter(ps, lambda p: {CLOSEST}), lambda p: p.x * p.w)) / nullif(list_sum(list_transform(list_filter(ps, lambda p: {CLOSEST}), lambda p: p.w)), 0), cs[c])) FROM lk, pt WHERE r < 50),
ak AS MATERIALIZED (SELECT DISTINCT k, a.topic, a.x FROM (SELECT ck.k, arg_min(struct_pack(topic := topic, x := x), (abs(x - c), x, topic)) AS a FROM sm, (SELECT k, unnest(cs) AS c FROM lk WHERE r = 50) ck GROUP BY ck.k, c)),
cc AS (SELECT k, x AS centre, row_number() OVER (PARTITION BY k ORDER BY x) AS region FROM ak), cu AS (SELECT k, (x + lag(x) OVER (PARTITION BY k ORDER BY x)) / 2 AS cut FROM ak),
tk AS MATERIALIZED (SELECT ks.k, sm.topic, any_value(x) AS x, any_value(excess) AS excess, any_value(weight) AS weight, count(*) FILTER (cut <= x) + 1 AS region FROM sm, (SELECT DISTINCT k FROM ak) ks JOIN cu ON cu.k = ks.k GROUP BY ks.k, sm.topic),
ov AS (SELECT actor, topic, rca - 1 AS e FROM rca WHERE rca > 1), ms AS (SELECT k, actor, region, sum(e) / sum(sum(e)) OVER (PARTITION BY k, actor) AS s FROM ov JOIN tk USING (topic) GROUP BY k, actor, region),
fu AS (SELECT a.actor AS a, b.actor AS b, sum(a.u * b.u) AS c FROM (SELECT *, e / sqrt(sum(e * e) OVER (PARTITION BY actor)) AS u FROM ov) a JOIN (SELECT *, e / sqrt(sum(e * e) OVER (PARTITION BY actor)) AS u FROM ov) b USING (topic) WHERE a.actor < b.actor GROUP BY ALL),
mu AS (SELECT *, s / sqrt(sum(s * s) OVER (PARTITION BY k, actor)) AS u FROM ms), rc AS (SELECT k, a.actor AS a, b.actor AS b, sum(a.u * b.u) AS c FROM mu a JOIN mu b USING (k, region) WHERE a.actor < b.actor GROUP BY ALL),
pg AS (SELECT k, x.actor AS a, y.actor AS b FROM (SELECT DISTINCT actor FROM ov) x JOIN (SELECT DISTINCT actor FROM ov) y ON x.actor < y.actor, (SELECT DISTINCT k FROM ak)),
pc AS (SELECT pg.k, round(coalesce(fu.c, 0), 9) AS f, round(coalesce(rc.c, 0), 9) AS g FROM pg LEFT JOIN fu ON fu.a = pg.a AND fu.b = pg.b LEFT JOIN rc ON rc.k = pg.k AND rc.a = pg.a AND rc.b = pg.b),
rk AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY f) + (count(*) OVER (PARTITION BY k, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY k ORDER BY g) + (count(*) OVER (PARTITION BY k, g) - 1) / 2.0 AS rg FROM pc),
dm AS (SELECT k, avg(s) AS me, median(s) AS md, avg(CASE WHEN round(s, 9) >= 0.7 THEN 1.0 ELSE 0 END) AS an FROM (SELECT k, actor, max(s) AS s FROM ms GROUP BY ALL) GROUP BY k),
sz AS (SELECT k, min(n) AS n, min(x) / sum(x) AS x, count(*) AS m FROM (SELECT k, region, count(*) AS n, sum(excess) AS x FROM tk GROUP BY ALL) GROUP BY k)
SELECT CAST(q.k AS INTEGER) AS k, round(q.inertia, 6) AS inertia, round(z.rho, 6) AS rho, round(me, 6) AS mean_dominant, round(md, 6) AS median_dominant, round(an, 6) AS anchored, sz.n AS least_topics, round(sz.x, 6) AS least_signal, m AS regions
FROM (SELECT k, sum(weight * pow(x - centre, 2)) AS inertia FROM tk JOIN cc USING (k, region) GROUP BY k) q JOIN dm USING (k) JOIN sz USING (k) JOIN (SELECT k, corr(rf, rg) AS rho FROM rk GROUP BY k) z USING (k)""")
def i24b(spark, d):
    """How two to six regions of the first axis stand for the portfolios: inertia, rank correlation of the similarities, anchoring, sizes."""
    places = smoothed_places(spark, d)
    found = cut(axis.centre_regions(places.withColumnRenamed("x", "position"), list(KS)).join(places.select("topic", "excess"), "topic"), "regions")
    out = axis.region_validation(space.specialization(counts(spark, d)), found)
    return out.select("k", *rounded("inertia", "rho", "mean_dominant", "median_dominant", "anchored"), "least_topics", *rounded("least_signal"), "regions")
