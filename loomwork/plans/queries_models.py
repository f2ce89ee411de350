"""Networks, orders, partitions, models and documents: queries that need numerical kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions import kernels
from loomwork.operators import cube, models, pairs, panel, space, stats
from loomwork.plans.facts import SQL, activity, table
from loomwork.plans.queries_pairs import distances, held, overlap
from loomwork.plans.queries_panel import adoption
from loomwork.plans.queries_panel import held as held_yearly
from loomwork.plans.queries_space import counts, edges, yearly
from loomwork.plans.registry import query


def space_matrix(spark, d):
    """The labels of all topics and the proximity matrix: as large as the topic universe."""
    labels = sorted(r[0] for r in yearly(spark, d).select("topic").distinct().collect())
    return labels, kernels.matrix(labels, [tuple(r) for r in edges(spark, d).select("i", "j", "phi").collect()])


@query("i37_scaffold")
def i37(spark, d):
    e = [tuple(r) for r in edges(spark, d).select("i", "j", "phi").orderBy("i", "j").collect()]
    tree = {(i, j) for i, j, _ in kernels.maximum_spanning_tree(e)}
    cut = np.quantile([w for *_, w in e], 0.95) if e else 0.0
    kept = [(i, j, float(w), (i, j) in tree) for i, j, w in e if (i, j) in tree or w >= cut]
    return spark.createDataFrame(kept, "i string, j string, phi double, in_tree boolean")


@query("i40_centralities")
def i40(spark, d):
    """Centralities of every year's network; each year is one task."""
    per_year = space.similarity(space.support(yearly(spark, d), ["year"]), ["year"]).select("year", "i", "j", "phi")

    def run(pdf):
        import pandas as pd

        labels = sorted({*pdf["i"], *pdf["j"]})
        w = kernels.matrix(labels, list(zip(pdf["i"], pdf["j"], pdf["phi"], strict=True)))
        return pd.DataFrame({"year": pdf["year"].iloc[0], "topic": labels, **kernels.centralities(w), "giant": kernels.components(w) == np.bincount(kernels.components(w)).argmax()})

    return per_year.groupBy("year").applyInPandas(run, "year int, topic string, betweenness double, closeness double, eigenvector double, clustering double, giant boolean")


def coordinates(spark, d):
    labels, w = space_matrix(spark, d)
    length = np.where(w > 0, -np.log(np.where(w > 0, w, 1)), np.inf)
    np.fill_diagonal(length, 0)
    for k in range(len(labels)):
        length = np.minimum(length, length[:, k : k + 1] + length[k : k + 1])
    most = length[np.isfinite(length)].max(initial=0)
    return labels, *kernels.classical_mds(np.where(np.isfinite(length), length, 1.05 * most), 3)


@query("i35_mds")
def i35(spark, d):
    labels, x, _ = coordinates(spark, d)
    return spark.createDataFrame([(t, *map(float, row)) for t, row in zip(labels, x, strict=True)], "topic string, x double, y double, z double")


@query("l10_eigen_mass")
def l10(spark, d):
    _, _, values = coordinates(spark, d)
    mass = np.maximum(values, 0)
    share = np.cumsum(mass) / mass.sum()
    return spark.createDataFrame([(k + 1, float(values[k]), float(share[k])) for k in range(min(5, len(values)))], "axis int, eigenvalue double, share double")


@query("i23_partition")
def i23(spark, d):
    """Three regions of the first axis; topics weigh their excess, smoothed along it."""
    labels, x, _ = coordinates(spark, d)
    excess = {r["topic"]: r["excess"] for r in space.excess(space.specialization(counts(spark, d)), ["topic"]).collect()}
    order = np.argsort(x[:, 0], kind="stable")
    weight = np.empty(len(labels))
    weight[order] = kernels.smooth(np.array([excess.get(labels[k], 0.0) for k in order]))
    _, cuts = kernels.centre_partition(x[:, 0], weight, 3)
    return spark.createDataFrame([(t, float(p), float(w), int(np.searchsorted(cuts, p, side="right")) + 1) for t, p, w in zip(labels, x[:, 0], weight, strict=True)], "topic string, position double, weight double, region int")


@query("i25_kmeans")
def i25(spark, d):
    """Inertia on the first axis, topics weighing the same, for 1 to 7 centres and the gains."""
    labels, x, _ = coordinates(spark, d)
    p = x[:, 0]
    out = []
    for k in range(1, 8):
        centres, _ = kernels.centre_partition(p, np.ones(len(p)), k)
        out.append((k, float(((p[:, None] - centres) ** 2).min(axis=1).sum())))
    w = Window.orderBy("k")
    return spark.createDataFrame(out, "k int, inertia double").withColumn("gain", F.lag("inertia").over(w) - F.col("inertia"))


@query("i43_communities")
def i43(spark, d):
    together = pairs.collaboration(activity(spark, d)).orderBy("a", "b").collect()
    labels = sorted({r[k] for r in together for k in "ab"})
    w = kernels.matrix(labels, [(r["a"], r["b"], float(r["documents"])) for r in together])
    norm = np.linalg.norm(w, axis=1)
    cosine = w @ w.T / np.maximum(norm[:, None] * norm, 1e-12)
    np.fill_diagonal(cosine, 0)
    return spark.createDataFrame([(a, int(c)) for a, c in zip(labels, kernels.communities(cosine), strict=True)], "actor string, community int")


@query("i48_fiedler_order")
def i48(spark, d):
    labels, w = space_matrix(spark, d)
    gaps = np.sqrt(((w[:, None] - w[None]) ** 2).sum(axis=2))
    return spark.createDataFrame([(labels[i], k) for k, i in enumerate(kernels.fiedler_order(gaps))], "topic string, place int")


@query("i49_ward_order")
def i49(spark, d):
    labels, w = space_matrix(spark, d)
    return spark.createDataFrame([(labels[i], k) for k, i in enumerate(kernels.ward_order(w)[0])], "topic string, place int")


@query("i51_diffusion")
def i51(spark, d):
    """Each actor's interests spread over the space, one actor at a time on the executors."""
    labels, w = space_matrix(spark, d)
    shared, names = spark.sparkContext.broadcast(w), labels

    def run(pdf):
        import pandas as pd

        x = pdf.set_index("topic")["x"].reindex(names).fillna(0.0).to_numpy(dtype=float)
        theta = x / x.sum()
        f = kernels.diffuse(shared.value, theta, 0.85, 100, 1e-6)
        kl, js = kernels.divergence(theta, f)
        return pd.DataFrame({"actor": [pdf["actor"].iloc[0]], "kl": [kl], "js": [js], "form": [float(theta @ shared.value @ theta)]})

    return counts(spark, d).groupBy("actor").applyInPandas(run, "actor string, kl double, js double, form double")


@query("j01_conditional_logit")
def j01(spark, d):
    rows = panel.with_choice(adoption(spark, d)).withColumn("distance", 1 - F.col("closeness"))
    return models.conditional_logit(rows, "group", "adopted", ["distance", "popularity"])


@query("j03_glm_cluster")
def j03(spark, d):
    rows = adoption(spark, d).withColumn("distance", 1 - F.col("closeness"))
    return models.logit(rows, "adopted", ["distance", "popularity"], cluster="actor")


@query("j05_ols_hc3")
def j05(spark, d):
    rows = overlap(spark, d).join(distances(spark, d), ["a", "b"]).withColumn("log_km", F.log(F.greatest("km", F.lit(1.0))))
    return models.ols(rows, "jaccard", ["log_km", "k_a", "k_b"])


@query("j11_swap_null")
def j11(spark, d):
    return models.swap_null_jaccard(held(spark, d), draws=400)


def both_panels(spark, d):
    adopt = adoption(spark, d).select("period", "actor", "topic", F.lit("adopt").alias("kind"), F.col("adopted").alias("outcome"), "closeness", "popularity")
    n = yearly(spark, d).agg(F.count_distinct("actor")).first()[0]
    keep = panel.persistence_panel(held_yearly(spark, d), edges(spark, d))
    pop = panel.popularity(held_yearly(spark, d), F.lit(n)).withColumnRenamed("period", "prev")
    kept = keep.join(pop, ["prev", "topic"], "left").select("period", "actor", "topic", F.lit("retain").alias("kind"), F.col("persisted").alias("outcome"), F.coalesce("closeness", F.lit(0.0)).alias("closeness"), "popularity")
    return adopt.unionByName(kept)


@query("l04_retain_adopt")
def l04(spark, d):
    retain, adopt = models.retain_adopt(both_panels(spark, d))
    return retain.withColumn("kind", F.lit("retain")).unionByName(adopt.withColumn("kind", F.lit("adopt")))


@query("l04b_simulated_breadth")
def l04b(spark, d):
    rows = both_panels(spark, d)
    retain, adopt = models.retain_adopt(rows)
    values = {k: [r["coefficient"] for r in m.collect()] for k, m in (("retain", retain), ("adopt", adopt))}
    return models.simulate(rows, values, 64).groupBy("period", "actor").agg(F.avg("breadth").alias("simulated"))


@query("g23_quadratic_fit", """WITH u AS (SELECT p_brand AS k, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y, x - avg(x) OVER (PARTITION BY p_brand) AS u FROM part),
s AS (SELECT k, avg(x) AS m, avg(y) AS a, avg(u * u) AS s2, sum(u * u * u) / sum(u * u) AS s3, sum(u * y) / sum(u * u) AS b FROM u GROUP BY k),
c AS (SELECT k, sum((u * u - s2 - s3 * u) * y) / sum(pow(u * u - s2 - s3 * u, 2)) AS c2 FROM u JOIN s USING (k) GROUP BY k)
SELECT k, round(a - c2 * s2 - (b - c2 * s3) * m + c2 * m * m, 4) AS c0, round(b - c2 * s3 - 2 * c2 * m, 4) AS c1, round(c2, 4) AS c2 FROM s JOIN c USING (k)""")
def g23(spark, d):
    """Price by size for each brand; the SQL takes what the line leaves of the square instead of the normal equations."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("k"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return stats.quadratic_fit(rows, "x", "y", ["k"]).select("k", *[F.round(c, 4).alias(c) for c in ("c0", "c1", "c2")])


@query("b04_graph_json", SQL + """, nr AS (SELECT i AS topic, j AS id, round(phi, 6) AS phi FROM phi UNION ALL SELECT j, i, round(phi, 6) FROM phi), l AS (SELECT topic, list({'phi': phi, 'id': id} ORDER BY phi DESC, id DESC) AS links FROM nr GROUP BY topic),
v AS (SELECT topic, CAST(sum(x) AS BIGINT) AS volume FROM cube GROUP BY topic)
SELECT topic, CAST(CASE WHEN links IS NULL THEN to_json({'id': topic, 'volume': volume}) ELSE to_json({'id': topic, 'volume': volume, 'links': links}) END AS VARCHAR) AS json FROM v LEFT JOIN l USING (topic)""")
def b04(spark, d):
    """One document for each topic: its weight and its neighbours, heaviest first."""
    volume = counts(spark, d).groupBy("topic").agg(F.sum("x").alias("volume"))
    near = space.both_ways(edges(spark, d), "phi").groupBy(F.col("i").alias("topic")).agg(F.sort_array(F.collect_list(F.struct(F.round("phi", 6).alias("phi"), F.col("j").alias("id"))), asc=False).alias("links"))
    return volume.join(near, "topic", "left").select("topic", F.to_json(F.struct(F.col("topic").alias("id"), "volume", "links")).alias("json"))


@query("b06_actor_json", SQL + """, r AS (SELECT actor, topic, c, rca, CAST(row_number() OVER (PARTITION BY actor ORDER BY round(rca, 9) DESC, topic) AS INTEGER) AS k FROM rca)
SELECT actor, CAST(to_json({'actor': actor, 'volume': max(c), 'top': list({'rank': k, 'topic': topic, 'rca': round(rca, 6)} ORDER BY k)}) AS VARCHAR) AS json FROM r WHERE k <= 8 GROUP BY actor""")
def b06(spark, d):
    """One document for each actor: its eight strongest topics and its share of all."""
    w = Window.partitionBy("actor")
    spec = space.specialization(counts(spark, d)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(F.round("rca", 9)), "topic")))
    top = spec.filter("_r <= 8").groupBy("actor").agg(F.sort_array(F.collect_list(F.struct(F.col("_r").alias("rank"), "topic", F.round("rca", 6).alias("rca")))).alias("top"), F.max("c").alias("volume"))
    return top.select("actor", F.to_json(F.struct("actor", "volume", "top")).alias("json"))
