"""Class pairs under size-matched nulls, and the summary tables and documents of actors and regions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators import pairs, resample, space
from loomwork.plans.facts import SQL, table
from loomwork.plans.queries_files import written_graph
from loomwork.plans.queries_null import sized_pairs
from loomwork.plans.queries_pairs import PAIRS, overlap
from loomwork.plans.queries_space import REGIONS, counts, regions, rounded
from loomwork.plans.registry import ORACLES, QUERIES, query
from loomwork.sources import store

MATCHED, DRAWS = 250, 2000


@query("j10b_class_pairs_matched", REGIONS + PAIRS[len(SQL) :] + ", cl AS (" + ORACLES["c20_fuzzy_class"][len(REGIONS) :] + f"""), f AS (SELECT a, b, a || '-' || b AS pair, least(k_a, k_b) AS lo, greatest(k_a, k_b) AS hi, jaccard AS v, "union" * 1.0 / (k_a + k_b) AS e FROM po),
z AS (SELECT *, round((lo - avg(lo) OVER ()) / stddev_pop(lo) OVER (), 9) AS z1, round((hi - avg(hi) OVER ()) / stddev_pop(hi) OVER (), 9) AS z2 FROM f),
n AS (SELECT q.a, q.b, q.v, q.e, r.v AS rv, r.e AS re, row_number() OVER (PARTITION BY q.pair ORDER BY round(pow(q.z1 - r.z1, 2) + pow(q.z2 - r.z2, 2), 9), r.pair) AS k FROM z q JOIN z r ON q.pair <> r.pair),
rd AS (SELECT a, b, any_value(v) - avg(rv) AS ov, any_value(e) - avg(re) AS di FROM n WHERE k <= {MATCHED} GROUP BY a, b), dr AS (SELECT unnest(range(1, {DRAWS + 1})) AS draw), lb AS (SELECT actor, class, row_number() OVER (ORDER BY actor) AS place FROM cl),
sf AS (SELECT draw, actor, row_number() OVER (PARTITION BY draw ORDER BY md5('15:' || draw || ':' || actor), actor) AS place FROM lb, dr), pl AS (SELECT draw, sf.actor, class FROM sf JOIN lb USING (place) UNION ALL SELECT 0, actor, class FROM cl),
m AS (SELECT x.draw, least(x.class, y.class) || '|' || greatest(x.class, y.class) AS classes, avg(di) AS di, avg(ov) AS ov, count(*) AS n FROM rd JOIN pl x ON x.actor = a JOIN pl y ON y.actor = b AND y.draw = x.draw GROUP BY ALL),
s AS (SELECT classes, di AS d0, ov AS o0, n AS n0 FROM m WHERE draw = 0)
SELECT classes, any_value(n0) AS n, round(any_value(d0), 6) AS distinct_share, round(avg(di), 6) AS distinct_null, round((count(*) FILTER (abs(round(di, 9)) >= abs(round(d0, 9))) + 1) / (count(*) + 1.0), 6) AS distinct_p,
round(any_value(o0), 6) AS overlap, round(avg(ov), 6) AS overlap_null, round((count(*) FILTER (abs(round(ov, 9)) >= abs(round(o0, 9))) + 1) / (count(*) + 1.0), 6) AS overlap_p FROM s JOIN m USING (classes) WHERE draw > 0 GROUP BY classes""")
def j10b(spark, d):
    """Coverage (distinct share) and overlap of each pair of classes, less those of the 250 pairs alike in size, against 2,000 deals of the classes."""
    size = overlap(spark, d).select("a", "b", F.concat_ws("-", "a", "b").alias("pair"), F.struct(F.col("jaccard").alias("o"), (F.col("union") / (F.col("k_a") + F.col("k_b"))).alias("d")).alias("v"))
    rows = sized_pairs(spark, d).drop("jaccard").join(size, "pair")
    near = pairs.nearest_in_space(rows.select("pair", "lo", "hi", "v"), "pair", ["lo", "hi"], MATCHED, "v").filter(F.size("near") > 0)
    less = lambda c: F.col(f"v.{c}") - F.aggregate("near", F.lit(0.0), lambda s, x: s + x["value"][c]) / F.size("near")
    residuals = near.select("pair", less("d").alias("distinct_share"), less("o").alias("overlap")).join(size.select("pair", "a", "b"), "pair")
    out = resample.class_pair_permutations(store.cut(residuals, "residuals"), QUERIES["c20_fuzzy_class"](spark, d), ["distinct_share", "overlap"], DRAWS, seed=15)
    return out.select("classes", "n", *rounded("distinct_share"), F.round("distinct_share_null", 6).alias("distinct_null"), F.round("distinct_share_p", 6).alias("distinct_p"), *rounded("overlap", "overlap_null", "overlap_p"))


SPOTS = REGIONS + """, ax AS (SELECT topic, region, row_number() OVER (ORDER BY topic) - 1 AS k, count(*) OVER () AS n FROM reg), tx AS (SELECT topic, region, k, CASE WHEN n > 1 THEN k * 1.0 / (n - 1) ELSE 0 END AS x FROM ax)
"""


def placed(spark, d):
    """topic, region, topic_order, x: the order of the topics that the regions cut, from 0 to 1."""
    at = regions(spark, d)
    n = at.agg(F.count(F.lit(1)).alias("_n"))
    rows = at.withColumn("topic_order", F.row_number().over(Window.orderBy("topic")) - 1).crossJoin(n)
    return rows.select("topic", "region", "topic_order", F.when(F.col("_n") > 1, F.col("topic_order") / (F.col("_n") - 1)).otherwise(0.0).alias("x"))


@query("l01b_actor_summary", SPOTS + """, e AS (SELECT actor, topic, region, rca, x AS pos, active, rca / sum(rca) OVER (PARTITION BY actor) AS q FROM (SELECT actor, topic, rca, active FROM rca) JOIN tx USING (topic)),
g AS (SELECT actor, region, sum(rca) / sum(sum(rca)) OVER (PARTITION BY actor) AS share FROM e GROUP BY actor, region), h AS (SELECT actor, arg_min(region, (-round(share, 9), region)) AS region, round(max(share), 6) AS share FROM g GROUP BY actor)
SELECT e.actor, count(*) FILTER (active) AS k_active, any_value(h.region) AS dominant_region, any_value(h.share) AS dominant_region_share,
round(sum(rca * pos) / sum(rca), 6) AS centroid, round(coalesce(sum(rca) FILTER (e.region = 1), 0) / sum(rca), 6) AS region_1_share, round(coalesce(sum(rca) FILTER (e.region = 2), 0) / sum(rca), 6) AS region_2_share, round(coalesce(sum(rca) FILTER (e.region = 3), 0) / sum(rca), 6) AS region_3_share,
round(sum(rca), 6) AS support, round(CASE WHEN count(*) > 1 THEN -sum(q * ln(q)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM e JOIN h ON h.actor = e.actor GROUP BY e.actor""")
def l01b(spark, d):
    """For each actor its breadth, dominant region and share, centroid, shares of the three regions, summed index and its normalised entropy; of all activity, not only what is above 1."""
    spec = space.specialization(counts(spark, d)).join(placed(spark, d).withColumnRenamed("x", "at"), "topic")
    total = F.sum("rca").over(Window.partitionBy("actor"))
    rows = spec.withColumn("q", F.col("rca") / total)
    share = lambda k: F.sum(F.when(F.col("region") == k, F.col("rca")).otherwise(0.0)) / F.sum("rca")
    n = F.count(F.lit(1))
    out = rows.groupBy("actor").agg(
        F.count(F.when(F.col("active"), 1)).alias("k_active"), (F.sum(F.col("rca") * F.col("at")) / F.sum("rca")).alias("centroid"),
        *[share(k).alias(f"region_{k}_share") for k in (1, 2, 3)], F.sum("rca").alias("support"), F.when(n > 1, -F.sum(F.col("q") * F.log("q")) / F.log(n.cast("double"))).otherwise(0.0).alias("entropy"),
    )
    best = F.array_max(F.array(*[F.struct(F.round(f"region_{k}_share", 9).alias("s"), F.lit(-k).alias("k")) for k in (1, 2, 3)]))
    out = out.withColumns({"dominant_region": -best["k"], "dominant_region_share": best["s"]})
    return out.select("actor", "k_active", "dominant_region", *rounded("dominant_region_share", "centroid", "region_1_share", "region_2_share", "region_3_share", "support", "entropy"))


@query("l01c_region_summary", SPOTS + """, b AS (SELECT region, min(x) AS lo, max(x) AS hi, count(*) AS topics FROM tx GROUP BY region), s AS (SELECT region, sum(greatest(rca - 1, 0)) AS excess FROM rca JOIN reg USING (topic) GROUP BY region)
SELECT region, topics, round(coalesce((lo + lag(hi) OVER w) / 2, lo), 6) AS boundary_left, round(coalesce((hi + lead(lo) OVER w) / 2, hi), 6) AS boundary_right, round(excess, 6) AS excess FROM b JOIN s USING (region) WINDOW w AS (ORDER BY region)""")
def l01c(spark, d):
    """The boundaries of the regions, half way between their outer topics, with their topics and excess."""
    w = Window.orderBy("region")
    ends = placed(spark, d).groupBy("region").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("topics"))
    spec = space.excess(space.specialization(counts(spark, d)).join(regions(spark, d), "topic"), ["region"])
    left, right = F.coalesce((F.col("lo") + F.lag("hi").over(w)) / 2, F.col("lo")), F.coalesce((F.col("hi") + F.lead("lo").over(w)) / 2, F.col("hi"))
    return ends.withColumns({"boundary_left": left, "boundary_right": right}).join(spec, "region").select("region", "topics", *rounded("boundary_left", "boundary_right", "excess"))


@query("b06b_actor_documents", SQL + """, vo AS (SELECT topic, sum(x) AS volume FROM cube GROUP BY topic), th AS (SELECT p_name AS topic, min(p_type) AS theme FROM part GROUP BY 1), mx AS (SELECT actor, topic, rca, theme, volume FROM rca JOIN th USING (topic) JOIN vo USING (topic) WHERE rca > 0.5 AND volume % 5 > 0),
tt AS (SELECT actor, theme, sum(round(rca, 4)) AS s FROM mx GROUP BY ALL), dt AS (SELECT actor, arg_min(theme, (-round(s, 6), theme)) AS theme FROM tt GROUP BY actor)
SELECT actor AS id, count(*) AS support_size, round(avg(round(rca, 4)), 4) AS mean_rpa, round(max(rca), 4) AS max_rpa, any_value(dt.theme) AS dominant_theme, array_to_string(list(topic || ':' || printf('%.4f', rca) ORDER BY round(rca, 4) DESC, topic), ';') AS placements
FROM mx JOIN dt USING (actor) GROUP BY actor""")
def b06b(spark, d):
    """Each actor's document, read back from JSON: its placements on the saved layout (index above a half, strongest first), their mean and greatest, and the dominant theme."""
    doc = actor_documents(spark, d)
    path = store.shared_path(spark, "actors")
    store.write_json_text(doc.select("value"), path)
    schema = "id string, support_size long, mean_rpa double, max_rpa double, dominant_theme string, centroid struct<x: double, y: double>, topics array<struct<rpa: double, topic: string>>"
    back = spark.read.schema(schema).json(path).filter("centroid.x between 0 and 1 and centroid.y between 0 and 1")
    listed = F.array_join(F.transform("topics", lambda t: F.concat(t["topic"], F.lit(":"), F.format_string("%.4f", t["rpa"]))), ";")
    return back.select("id", "support_size", "mean_rpa", "max_rpa", "dominant_theme", listed.alias("placements"))


def actor_documents(spark, d, floor: float = 0.5):
    """value: one JSON document for each actor that has a topic above ``floor`` on the layout."""
    nodes = store.read_graph(spark, written_graph(spark, d))[0].filter("x is not null and y is not null")
    spots = nodes.select(F.lower(F.replace("id", F.lit("_"), F.lit(" "))).alias("_key"), F.col("x").alias("px"), F.col("y").alias("py"))
    themes = table(spark, d, "part").groupBy(F.col("p_name").alias("topic")).agg(F.min("p_type").alias("theme"))
    spec = space.specialization(counts(spark, d)).filter(F.col("rca") > floor).withColumn("_key", F.lower("topic"))
    rows = spec.join(spots, "_key").join(themes, "topic").select("actor", "topic", F.round("rca", 4).alias("rpa"), "theme", "px", "py")
    totals = rows.groupBy("actor", "theme").agg(F.round(F.sum("rpa"), 6).alias("s"))
    best = totals.groupBy("actor").agg(F.min_by("theme", F.struct(-F.col("s"), F.col("theme"))).alias("dominant_theme"))
    mean = lambda c: F.round(F.sum(F.col("rpa") * F.col(c)) / F.sum("rpa"), 3)
    each = rows.groupBy("actor").agg(
        F.count(F.lit(1)).alias("support_size"), F.round(F.avg("rpa"), 4).alias("mean_rpa"), F.max("rpa").alias("max_rpa"), F.struct(mean("px").alias("x"), mean("py").alias("y")).alias("centroid"),
        F.array_sort(F.collect_list(F.struct((-F.col("rpa")).alias("o"), "topic", "rpa", F.col("px").alias("x"), F.col("py").alias("y"), "theme"))).alias("_t"),
    )
    topics = F.transform("_t", lambda t: F.struct(t["topic"].alias("topic"), t["rpa"].alias("rpa"), t["x"].alias("x"), t["y"].alias("y"), t["theme"].alias("theme")))
    return each.join(best, "actor").select(F.to_json(F.struct(F.col("actor").alias("id"), "support_size", "mean_rpa", "max_rpa", "dominant_theme", "centroid", topics.alias("topics"))).alias("value"))
