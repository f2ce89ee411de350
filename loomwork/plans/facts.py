"""The driver's tables read as bipartite activity: who (actor) works on what (topic), when (year)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Lines that one task joins and groups: tasks grow in number with the tables, not in memory.
TASK_LINES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """The distinct values of a column, null among them, with a number each; only a universe of names is ranked."""
    return df.select(name).distinct().withColumn(f"_{name}", F.row_number().over(Window.orderBy(name)))


def _told(spark: SparkSession, sf_dir: str, distinct: bool) -> DataFrame:
    """doc, year, quarter, actor, topic of each order line, or without the quarter each different one.

    Dimensions join on keys.  Parts and orders grow with the lines and are
    hashed part by part, so that no task sorts lines and none holds more than
    its share.  Rows lie by document, in tasks of about ``TASK_LINES``
    whatever the session's number of parts: each task sets aside memory before its
    first row.  Until they are told apart, lines carry the numbers of their names,
    which are joined last.
    """
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    actors, topics = _numbered(t("nation"), "n_name"), _numbered(t("part"), "p_name")
    nation = t("nation").join(actors.withColumnRenamed("n_name", "_n"), F.col("n_name").eqNullSafe(F.col("_n"))).select("n_nationkey", "_n_name")
    part = t("part").join(topics.withColumnRenamed("p_name", "_p"), F.col("p_name").eqNullSafe(F.col("_p"))).select("p_partkey", "_p_name")
    orders = t("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
    tasks = 1 + rows.count() // TASK_LINES
    coded = (
        rows
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_partkey", "_n_name")
        .join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "_n_name", "_p_name").repartition(tasks, "l_orderkey")
    )
    # a join of two bare exchanges would take the session's number of parts, however small
    orders = orders.drop("quarter").repartition(tasks, "o_orderkey").distinct() if distinct else orders
    coded = coded.distinct() if distinct else coded
    dated = coded.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = dated.join(actors, "_n_name").join(topics, "_p_name")
    return named.select(F.col("l_orderkey").alias("doc"), "year", *["quarter"] * (not distinct), F.col("n_name").alias("actor"), F.col("p_name").alias("topic"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: doc, year, quarter, actor, topic."""
    return _told(spark, sf_dir, False)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (doc, year, actor, topic)."""
    return _told(spark, sf_dir, True)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they come from an archive: year, actors joined by commas, topics joined by tabs.

    Some topics carry markers that cleaning has to undo.
    """
    text = lambda c, sep: F.array_join(F.sort_array(F.collect_set(c)), sep)
    rows = lines(spark, sf_dir).groupBy("doc", "year").agg(text("actor", ",").alias("actors"), text("topic", "\t").alias("topics"))
    marked = (
        F.when(F.pmod("doc", F.lit(7)) == 0, F.concat(F.lit("ALL\t"), F.col("topics")))
        .when(F.pmod("doc", F.lit(7)) == 1, F.concat(F.lit(" envirom x \t"), F.col("topics"), F.lit("\t other")))
        .when(F.pmod("doc", F.lit(7)) == 2, F.lit("ALL\tother"))
        .when(F.pmod("doc", F.lit(97)) == 3, F.lit("nan"))
        .otherwise(F.col("topics"))
    )
    return rows.withColumn("topics", marked)


#: The same in SQL, to put before a query.
SQL = """
WITH lines AS (
  SELECT l_orderkey AS doc, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, n_name AS actor, p_name AS topic
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
fact AS (SELECT DISTINCT doc, year, actor, topic FROM lines),
cube AS (SELECT actor, topic, count(*) AS x FROM fact GROUP BY ALL),
marg AS (
  SELECT actor, topic, x, CAST(sum(x) OVER (PARTITION BY actor) AS BIGINT) AS c, CAST(sum(x) OVER (PARTITION BY topic) AS BIGINT) AS p,
         CAST(sum(x) OVER () AS BIGINT) AS t FROM cube),
rca AS (SELECT *, (x * 1.0 / c) / (p * 1.0 / t) AS rca, CAST(x AS HUGEINT) * t > CAST(c AS HUGEINT) * p AS active FROM marg),
sup AS (SELECT actor, topic FROM rca WHERE active),
ubi AS (SELECT topic, count(*) AS u FROM sup GROUP BY topic),
co AS (SELECT a.topic AS i, b.topic AS j, count(*) AS n FROM sup a JOIN sup b ON a.actor = b.actor AND a.topic < b.topic GROUP BY ALL),
phi AS (SELECT i, j, n, ui.u AS ui, uj.u AS uj, n * 1.0 / greatest(ui.u, uj.u) AS phi FROM co JOIN ubi ui ON ui.topic = i JOIN ubi uj ON uj.topic = j),
years AS (SELECT DISTINCT year FROM fact),
ycube AS (SELECT year, actor, topic, count(*) AS x FROM fact GROUP BY ALL),
ymarg AS (
  SELECT *, CAST(sum(x) OVER (PARTITION BY year, actor) AS BIGINT) AS c, CAST(sum(x) OVER (PARTITION BY year, topic) AS BIGINT) AS p,
         CAST(sum(x) OVER (PARTITION BY year) AS BIGINT) AS t FROM ycube),
yrca AS (SELECT *, (x * 1.0 / c) / (p * 1.0 / t) AS rca, CAST(x AS HUGEINT) * t > CAST(c AS HUGEINT) * p AS active FROM ymarg),
ysup AS (SELECT year, actor, topic FROM yrca WHERE active)
"""
