"""Sources and sinks: what is written to the shared folder and read again, compared with what it was made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import space
from loomwork.plans.facts import SQL, activity, table
from loomwork.plans.queries_space import counts, edges, rounded, yearly
from loomwork.plans.registry import query
from loomwork.sources import store

YEARS = tuple(range(1994, 2003))


@query("a03_wide_years", f"""WITH v AS (SELECT n_name AS name, CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE year(o_orderdate) BETWEEN {YEARS[0]} AND {YEARS[-1]} AND (n_nationkey + year(o_orderdate)) % 3 > 0 GROUP BY ALL)
SELECT name, year, value FROM v""")
def a03(spark, d):
    """Mean order value by nation and year, through CSV files (one a region) with four lines before their header and empty cells."""
    path = store.shared_path(spark, "wide")
    wide_csv(spark, d).write.partitionBy("region").text(path)
    long = store.wide_years(spark, path, keys=("Country Name", "Country Code"))
    return long.select(F.col("Country Name").alias("name"), "year", "value")


def wide_csv(spark, d):
    """region, value: the text of one file each."""
    t = lambda n: table(spark, d, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("year", F.year("o_orderdate")).filter((F.col("n_nationkey") + F.col("year")) % 3 > 0)
    cells = rows.groupBy("n_regionkey", "n_nationkey", "n_name").pivot("year", list(YEARS)).agg(F.round(F.avg("o_totalprice"), 2))
    texts = [F.coalesce(F.col(str(y)).cast("decimal(18,2)").cast("string"), F.lit("")) for y in YEARS]
    line = F.concat_ws(",", F.concat(F.lit('"'), F.col("n_name"), F.lit('"')), F.format_string("N%02d", F.col("n_nationkey")), F.lit("\"value, mean\""), *texts)
    top = "Data Source,Orders\n\nLast Updated,never\n\n" + ",".join(["Country Name", "Country Code", "Indicator", *map(str, YEARS)])
    return cells.groupBy(F.col("n_regionkey").alias("region")).agg(F.concat_ws("\n", F.lit(top), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("value"))


@query("e11_latest_year", f"""WITH v AS (SELECT n_name AS name, CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE year(o_orderdate) BETWEEN {YEARS[0]} AND {YEARS[-1]} AND (n_nationkey + year(o_orderdate)) % 3 > 0 GROUP BY ALL)
SELECT name, max(year) AS year, arg_max(value, year) AS value FROM v GROUP BY name""")
def e11(spark, d):
    """The last year that has a value, of the same files."""
    path = store.shared_path(spark, "wide")
    wide_csv(spark, d).write.partitionBy("region").text(path)
    return store.latest_year(store.wide_years(spark, path), ["Country Name"]).select(F.col("Country Name").alias("name"), "year", "value")


def written_graph(spark, d):
    """The space as one document of nodes, with places on a circle of names, and links."""
    volume = counts(spark, d).groupBy("topic").agg(F.sum("x").cast("double").alias("volume"))
    at = F.pmod(F.crc32(F.col("topic").cast("binary")), F.lit(997)) / 997.0
    nodes = volume.select(F.upper(F.replace("topic", F.lit(" "), F.lit("_"))).alias("id"), "volume", F.when(F.col("volume") % 5 > 0, at).alias("x"), (at * at).alias("y"))
    links = edges(spark, d).select(F.col("i").alias("source"), F.col("j").alias("target"), F.round("phi", 6).alias("value"))
    path = store.shared_path(spark, "graph")
    store.write_json_text(store.graph_document(nodes, links), path)
    return path


@query("a06_graph_links", SQL + "SELECT i AS source, j AS target, round(phi, 6) AS value FROM phi")
def a06(spark, d):
    """The links of the space, through a graph document."""
    return store.read_graph(spark, written_graph(spark, d))[1].select("source", "target", "value")


@query("a06b_saved_layout", SQL + """, v AS (SELECT topic, sum(x) AS volume FROM cube GROUP BY topic), p AS (SELECT topic FROM v WHERE volume % 5 > 0)
SELECT count(*) AS placed, (SELECT count(*) FROM v) AS topics, 0.0 AS mean_x, 1.0 AS deviation_y FROM p""")
def a06b(spark, d):
    """How many topics the saved document places, by names in another spelling; the places are centred and scaled."""
    topics = yearly(spark, d).select("topic").distinct()
    places = store.saved_places(store.read_graph(spark, written_graph(spark, d))[0], topics, least_share=0.5)
    n = topics.agg(F.count(F.lit(1)).alias("topics"))
    if places is None:
        return n.select(F.lit(0).cast("long").alias("placed"), "topics", F.lit(0.0).alias("mean_x"), F.lit(1.0).alias("deviation_y"))
    return places.agg(F.count(F.lit(1)).alias("placed"), (F.round(F.avg("x"), 6) + 0.0).alias("mean_x"), F.round(F.stddev_pop("y"), 6).alias("deviation_y")).crossJoin(n).select("placed", "topics", "mean_x", "deviation_y")


@query("a07_first_usable", SQL + "SELECT actor, topic, round(rca, 6) AS rca FROM rca")
def a07(spark, d):
    """The specialization, from the first source that can be used: the ones before it are missing, empty, or lack the column."""
    at = {k: store.shared_path(spark, k) + ".parquet" for k in ("empty", "narrow", "good")}
    rows = space.specialization(counts(spark, d)).select("actor", "topic", *rounded("rca"))
    rows.limit(0).write.parquet(at["empty"])
    rows.select("actor").write.parquet(at["narrow"])
    rows.write.parquet(at["good"])
    return store.first_usable(spark, [store.shared_path(spark, "missing") + ".parquet", at["empty"], at["narrow"], at["good"]], ["actor", "topic", "rca"])


@query("b02_csv_and_metadata", SQL + """SELECT year, count(*) AS rows, CAST(sum(x) AS BIGINT) AS total, CAST((SELECT count(*) FROM ycube) AS BIGINT) AS stated FROM ycube GROUP BY year""")
def b02(spark, d):
    """The yearly cube through CSV, with the number of rows that its metadata states."""
    path = store.shared_path(spark, "cube") + ".csv"
    rows = activity(spark, d).groupBy("year", "actor", "topic").agg(F.count(F.lit(1)).alias("x"))
    store.write_csv(rows, path)
    stated = store.metadata(rows, {"kind": "cube"}).select(F.get_json_object("json", "$.rows").cast("long").alias("stated"))
    back = store.read_any(spark, path, "year int, actor string, topic string, x long")
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("x").alias("total")).crossJoin(stated)
