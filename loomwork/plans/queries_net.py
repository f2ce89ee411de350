"""The giant component, diffusion against single topics, swap nulls by pair of regions, and attributes under 20,000 permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import models, network, pairs, resample, space
from loomwork.plans.facts import SQL, table
from loomwork.plans.queries_more import PAIR_SQL, pair_attributes
from loomwork.plans.queries_pairs import both_bases
from loomwork.plans.queries_space import REGIONS, counts, edges, rounded, shares
from loomwork.plans.registry import query

STRONG = 0.6


@query("d09_giant_component", SQL.replace("WITH lines", "WITH RECURSIVE lines", 1) + f""", strong AS (SELECT i, j, phi FROM phi WHERE phi >= {STRONG}), w AS (SELECT i, j FROM strong UNION SELECT j, i FROM strong),
reach AS (SELECT i AS a, i AS b FROM w UNION SELECT r.a, w.j FROM reach r JOIN w ON w.i = r.b), c AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
g AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), k AS (SELECT i, j, phi FROM strong JOIN c ON c.node = i JOIN g USING (component)),
d AS (SELECT i AS topic, phi FROM k UNION ALL SELECT j, phi FROM k), n AS (SELECT count(DISTINCT topic) AS n FROM d)
SELECT topic, count(*) AS degree, round(sum(phi), 6) AS strength, round(count(*) * 1.0 / (n - 1), 6) AS centrality FROM d, n GROUP BY topic, n""")
def d09(spark, d):
    """Degree and strength of the topics of the largest component of strong edges; the others are left out before anything is measured."""
    kept = network.giant_component(edges(spark, d).filter(F.col("phi") >= STRONG).select("i", "j", "phi"))
    ends = space.both_ways(kept, "phi").groupBy(F.col("i").alias("topic")).agg(F.count(F.lit(1)).alias("degree"), F.sum("phi").alias("strength"))
    n = ends.agg(F.count(F.lit(1)).alias("n"))
    return ends.crossJoin(n).select("topic", "degree", *rounded("strength"), F.round(F.col("degree") / (F.col("n") - 1), 6).alias("centrality"))


ROUNDS = 14
DIFFUSED = SQL + """, wy AS (SELECT i, j, phi FROM phi UNION ALL SELECT j, i, phi FROM phi), w AS (SELECT i, j, phi / sum(phi) OVER (PARTITION BY i) AS phi FROM wy), tp AS (SELECT DISTINCT topic FROM rca UNION SELECT i FROM w),
sh AS (SELECT actor, topic, rca / sum(rca) OVER (PARTITION BY actor) AS theta FROM rca),
st AS (SELECT 'actor' AS kind, actor AS name, topic, theta FROM sh WHERE theta > 0 UNION ALL SELECT 'topic', topic, topic, 1.0 FROM tp),
f0 AS (SELECT kind, name, topic, theta AS f FROM st),
""" + ",\n".join(
    f"f{k} AS (SELECT kind, name, topic, sum(f) AS f FROM (SELECT kind, name, topic, 0.85 * theta AS f FROM st UNION ALL SELECT kind, name, w.j, 0.15 * f * phi FROM f{k - 1} JOIN w ON w.i = topic) GROUP BY ALL)" for k in range(1, ROUNDS + 1)
) + f""", g AS (SELECT n.kind, n.name, tp.topic, coalesce(theta, 0) AS theta, coalesce(f, 0) AS f FROM (SELECT DISTINCT kind, name FROM st) n CROSS JOIN tp LEFT JOIN st ON st.kind = n.kind AND st.name = n.name AND st.topic = tp.topic
  LEFT JOIN f{ROUNDS} f ON f.kind = n.kind AND f.name = n.name AND f.topic = tp.topic),
pq AS (SELECT *, (theta + 1e-12) / sum(theta + 1e-12) OVER v AS p, (f + 1e-12) / sum(f + 1e-12) OVER v AS q FROM g WINDOW v AS (PARTITION BY kind, name)),
ls AS (SELECT kind, name, sum(p * ln(p / q)) AS kl, sqrt(greatest(0, (sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2)) AS js, -sum(p * ln(p)) AS e FROM pq GROUP BY ALL),
bs AS (SELECT s.name AS actor, sum(s.theta * -ln(t.f + 1e-12)) AS bk, sum(s.theta * l.js) AS bj FROM st s JOIN g t ON t.kind = 'topic' AND t.name = s.topic AND t.topic = s.topic JOIN ls l ON l.kind = 'topic' AND l.name = s.topic WHERE s.kind = 'actor' GROUP BY ALL),
fm AS (SELECT a.name AS actor, sum(a.f * phi * b.f) AS form FROM g a JOIN w ON w.i = a.topic JOIN g b ON b.kind = a.kind AND b.name = a.name AND b.topic = w.j WHERE a.kind = 'actor' GROUP BY ALL)
SELECT actor, round(kl, 6) AS kl, round(js, 6) AS js, round(kl / e, 6) AS kl_norm, round(bk, 6) AS baseline_kl, round(kl - bk, 6) AS kl_excess, round(bj, 6) AS baseline_js, round(js - bj, 6) AS js_excess, round(form, 6) AS form, round(e, 6) AS e
FROM ls JOIN bs ON actor = name JOIN fm USING (actor) WHERE kind = 'actor' AND e > 1e-8"""


@query("i51b_diffusion_excess", DIFFUSED)
def i51b(spark, d):
    """What each actor's interests lose by diffusion, and the excess over what its topics lose alone; weights normalised by row."""
    spec = space.specialization(counts(spark, d))
    total = spec.groupBy("actor").agg(F.sum("rca").alias("_t"))
    profile = spec.join(total, "actor").select("actor", "topic", (F.col("rca") / F.col("_t")).alias("theta"))
    out = network.diffused_interests(profile, edges(spark, d), tolerance=1e-10)
    return out.select("actor", *rounded("kl", "js", "kl_norm", "baseline_kl", "kl_excess", "baseline_js", "js_excess", "form", "e"))


@query("j14b_region_pair_swaps")
def j14b(spark, d):
    """Mean overlap by pair of dominant regions, block of ten years and basis, against 200 supports that keep both margins."""
    region = shares(spark, d).filter("dominant").select("actor", "region")
    sup = both_bases(spark, d).join(region, "actor")
    by = ("start", "end", "basis")
    drawn = models.swap_chains(sup, by, 200, seed=23, label="region").select(*by, "labels", "jaccard")
    names = region.select("actor", F.col("region").cast("string").alias("r"))
    both = pairs.pair_overlap(sup, by).join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
    seen = both.groupBy(*by, F.concat_ws("-", F.least("x", "y"), F.greatest("x", "y")).alias("labels")).agg(F.avg("jaccard").alias("jaccard"))
    return resample.null_summary(drawn, seen, "jaccard", (*by, "labels"))


SIX = ("mixed", "both", "one_of", "same_bloc", "either", "gated")


def six_attributes(spark, d):
    """The four attributes of a pair, whether either is a member, and either a gateway; chosen: whether they are dominant in the first and the last region."""
    k = F.col("n_nationkey")
    own = table(spark, d, "nation").select(F.col("n_name").alias("actor"), (k % 2 == 1).alias("member"), (k % 3 == 0).alias("gate"))
    x, y = (own.select([F.col(c).alias(f"{c}_{s}") for c in own.columns]) for s in "xy")
    rows = pair_attributes(spark, d).withColumn("_p", F.split("pair", "-"))
    rows = rows.join(x, F.col("_p")[0] == F.col("actor_x")).join(y, F.col("_p")[1] == F.col("actor_y"))
    region = shares(spark, d).filter("dominant").select("actor", "region")
    rows = rows.join(region.toDF("actor_x", "r"), "actor_x").join(region.toDF("actor_y", "s"), "actor_y")
    dominant = ((F.least("r", "s") == 1) & (F.greatest("r", "s") == 3)).cast("int")
    flag = lambda c: (F.col(f"{c}_x") | F.col(f"{c}_y")).cast("int")
    return rows.select("pair", *SIX[:4], flag("member").alias("either"), flag("gate").alias("gated"), dominant.alias("chosen"))


def _folded(count: int) -> str:
    gaps = " UNION ALL ".join(
        f"""SELECT '{a}' AS attribute, any_value(o) AS observed, avg(g) AS null_mean, (count(*) FILTER (abs(round(g, 9)) >= abs(round(o, 9))) + 1) / (count(*) + 1.0) AS p, count(*) AS draws
FROM (SELECT draw, avg("{a}") FILTER (chosen = 1) - avg("{a}") FILTER (chosen = 0) AS g FROM dl GROUP BY draw), (SELECT avg("{a}") FILTER (chosen = 1) - avg("{a}") FILTER (chosen = 0) AS o FROM sx)""" for a in SIX
    )
    return REGIONS + PAIR_SQL[len(SQL) :] + f""", sx AS (SELECT pt.*, CAST(least(ra.region, rb.region) = 1 AND greatest(ra.region, rb.region) = 3 AS INTEGER) AS chosen, CAST(x.member = 1 OR y.member = 1 AS INTEGER) AS either, CAST(x.gate = 1 OR y.gate = 1 AS INTEGER) AS gated
  FROM pt JOIN mb x ON x.actor = split_part(pair, '-', 1) JOIN mb y ON y.actor = split_part(pair, '-', 2) JOIN sh ra ON ra.actor = x.actor AND ra.dominant JOIN sh rb ON rb.actor = y.actor AND rb.dominant),
nb AS (SELECT chosen, row_number() OVER (ORDER BY pair) AS place FROM sx), dr AS (SELECT unnest(range(1, {count + 1})) AS draw),
dl AS (SELECT s.*, nb.chosen FROM (SELECT draw, sx.* EXCLUDE (chosen), row_number() OVER (PARTITION BY draw ORDER BY md5('9:' || draw || ':' || pair), pair) AS place FROM sx, dr) s JOIN nb USING (place))
SELECT attribute, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(p, 6) AS p, draws FROM ({gaps})"""


@query("j09b_attribute_permutation_20000", _folded(20000))
def j09b(spark, d):
    """Six attributes of the pairs between the first and the last region less those of the others, under 20,000 permutations."""
    out = resample.folded_permutations(six_attributes(spark, d), "pair", "chosen", SIX, 20000, seed=9, whole=True)
    return out.select("attribute", *rounded("observed", "null_mean", "p"), "draws")
