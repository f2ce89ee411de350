"""Cleaning, cubes, periods and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import clean, cube
from loomwork.plans.facts import SQL, activity, cells, lines, table
from loomwork.plans.registry import query

CELLS = SQL + """, joined AS (
  SELECT doc, year, array_to_string(list_sort(list(DISTINCT actor)), ',') AS actors, array_to_string(list_sort(list(DISTINCT topic)), chr(9)) AS plain
  FROM lines GROUP BY ALL),
cells AS (
  SELECT doc, year, actors, CASE WHEN doc % 7 = 0 THEN 'ALL' || chr(9) || plain WHEN doc % 7 = 1 THEN ' envirom x ' || chr(9) || plain || chr(9) || ' other'
    WHEN doc % 7 = 2 THEN 'ALL' || chr(9) || 'other' WHEN doc % 97 = 3 THEN 'nan' ELSE plain END AS topics FROM joined),
tops AS (
  SELECT doc, year, actors, list_filter(list_transform(string_split(topics, chr(9)), lambda x: replace(trim(x), 'envirom', 'environ')),
    lambda x: upper(x) NOT IN ('', 'ALL', 'OTHER') AND lower(topics) <> 'nan') AS ts FROM cells)
"""


@query("e02_activity", SQL + "SELECT doc, year, actor, topic FROM fact")
def e02(spark, d):
    return activity(spark, d)


@query("e03_interaction_grid", SQL + """SELECT a.actor, t.topic, CAST(coalesce(x, 0) AS BIGINT) AS x
FROM (SELECT DISTINCT actor FROM fact) a CROSS JOIN (SELECT DISTINCT topic FROM fact) t LEFT JOIN cube ON cube.actor = a.actor AND cube.topic = t.topic""")
def e03(spark, d):
    return cube.complete_grid(cube.count_cube(activity(spark, d), ["actor", "topic"])).select("actor", "topic", "x")


@query("e04_universe", SQL + "SELECT 'actor' AS kind, actor AS label FROM fact GROUP BY ALL UNION ALL SELECT 'topic', topic FROM fact GROUP BY ALL")
def e04(spark, d):
    rows = activity(spark, d)
    kinds = [cube.distinct_values(rows, c).select(F.lit(c).alias("kind"), F.col(c).alias("label")) for c in ("actor", "topic")]
    return kinds[0].unionByName(kinds[1])


@query("c01_split_clean_explode", CELLS + """SELECT DISTINCT doc, year, trim(a) AS actor, t AS topic
FROM (SELECT doc, year, unnest(string_split(actors, ',')) AS a, ts FROM tops), unnest(ts) AS u(t)""")
def c01(spark, d):
    """The cells have one row for each document and year."""
    rows = cells(spark, d)
    return clean.explode_activity(rows, "doc", clean.split_cell(F.col("actors"), ","), clean.clean_topics(F.col("topics")), ["year"], once=True).select("doc", "year", "actor", "topic")


@query("c04_clean_cell", CELLS + "SELECT doc, nullif(array_to_string(ts, chr(9)), '') AS topics, CAST(len(ts) AS INTEGER) AS n FROM tops")
def c04(spark, d):
    topics = F.col("topics")
    return cells(spark, d).select("doc", clean.clean_cell(topics).alias("topics"), F.size(clean.clean_topics(topics)).alias("n"))


@query("e01_dedup_documents", CELLS + "SELECT doc, year, actors, topics FROM cells")
def e01(spark, d):
    rows = cells(spark, d)
    twice = rows.unionByName(rows.filter(F.pmod("doc", F.lit(3)) == 0))
    listed = twice.withColumn("parties", F.split("actors", ","))
    return clean.drop_duplicate_documents(listed, ["doc", "year", "parties", "no such column"]).select("doc", "year", "actors", "topics")


@query("e01b_attachments_kept", CELLS + "SELECT count(*) AS n FROM (SELECT doc FROM cells UNION ALL SELECT doc FROM cells WHERE doc % 3 = 0)")
def e01b(spark, d):
    rows = cells(spark, d).select("doc")
    twice = rows.unionByName(rows.filter(F.pmod("doc", F.lit(3)) == 0))
    return clean.drop_duplicate_documents(twice, ["doc"], enabled=False).agg(F.count(F.lit(1)).alias("n"))


@query("c07_recode_labels", SQL + """SELECT CASE actor WHEN 'FRANCE' THEN 'EUROPE' WHEN 'GERMANY' THEN 'EUROPE' WHEN 'NATION_1' THEN 'GROUP' WHEN 'NATION_2' THEN 'GROUP' ELSE actor END AS actor, topic, CAST(sum(x) AS BIGINT) AS x
FROM cube GROUP BY ALL""")
def c07(spark, d):
    names = {"FRANCE": "EUROPE", "GERMANY": "EUROPE", "NATION_1": "GROUP", "NATION_2": "GROUP"}
    rows = cube.count_cube(activity(spark, d), ["actor", "topic"]).withColumn("actor", clean.recode(F.col("actor"), names))
    return rows.groupBy("actor", "topic").agg(F.sum("x").alias("x"))


@query("c08_years_as_int", "SELECT o_orderkey AS doc, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderkey % 5 <> 0")
def c08(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.lit("n/a")).otherwise(F.year("o_orderdate").cast("string")).alias("year"))
    return clean.as_int(rows, "year")


@query("c09_names", """SELECT c_custkey AS id, trim(regexp_replace(lower(c_name), '[\\s_\\-]+', ' ', 'g')) AS node_key,
regexp_replace(regexp_replace(lower(c_name || ' (x) & Co'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
trim(regexp_replace(regexp_replace(replace(lower(c_name || ' (x) & Co''s'), '&', ' and '), '\\([^)]*\\)', ' ', 'g') , '[^a-z0-9]+', ' ', 'g')) AS quoted,
CASE WHEN length(replace(c_mktsegment, 'BUILDING', 'Bldg')) > 7 THEN rtrim(substring(replace(c_mktsegment, 'BUILDING', 'Bldg'), 1, 6)) || '…' ELSE replace(c_mktsegment, 'BUILDING', 'Bldg') END AS label
FROM customer""".replace(") , '[^a-z0-9]+'", "), '[^a-z0-9]+'").replace("replace(lower(c_name || ' (x) & Co''s'), '&', ' and ')", "replace(replace(lower(c_name || ' (x) & Co''s'), '&', ' and '), '''', '')"))
def c09(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), clean.node_key(n).alias("node_key"), clean.slug(F.concat(n, F.lit(" (x) & Co"))).alias("slug"),
        clean.plain_name(F.concat(n, F.lit(" (x) & Co's"))).alias("quoted"), clean.short_label(F.col("c_mktsegment"), {"BUILDING": "Bldg"}, 7).alias("label"),
    )


@query("h05_meeting_windows", SQL + """, steps AS (SELECT year, quarter, CAST(row_number() OVER (ORDER BY year, quarter) AS INTEGER) AS step FROM (SELECT DISTINCT year, quarter FROM lines)),
m AS (SELECT DISTINCT doc, step, actor, topic FROM lines JOIN steps USING (year, quarter))
SELECT CAST(e AS INTEGER) AS window_end, actor, topic, count(*) AS x FROM m, unnest(range(step, step + 4)) AS u(e)
WHERE e BETWEEN 4 AND (SELECT max(step) FROM steps) GROUP BY ALL""")
def h05(spark, d):
    rows = cube.ordinal_time(lines(spark, d), ["year", "quarter"]).select("doc", "step", "actor", "topic").distinct()
    last = rows.agg(F.max("step")).first()[0] or 0
    return cube.count_cube(cube.assign_rolling(rows, "step", 4, 4, last), ["window_end", "actor", "topic"])


@query("f10_block_periods", SQL + """SELECT CAST(s AS INTEGER) AS period_start, CAST(least(s + 2, (SELECT max(year) FROM fact)) AS INTEGER) AS period_end, actor, topic, count(*) AS x
FROM (SELECT *, year - (year - (SELECT min(year) + 1 FROM fact)) % 3 AS s FROM fact WHERE year > (SELECT min(year) FROM fact)) GROUP BY ALL""")
def f10(spark, d):
    rows = activity(spark, d)
    first, last = rows.agg(F.min("year"), F.max("year")).first()
    placed = cube.assign_blocks(rows, "year", 3, (first or 0) + 1, last or 0)
    return cube.count_cube(placed, ["period_start", "period_end", "actor", "topic"])


@query("f12_cumulative_cube", SQL + """, firsts AS (SELECT actor, topic, min(year) AS f FROM ycube GROUP BY ALL)
SELECT y.year, k.actor, k.topic, CAST(sum(coalesce(x, 0)) OVER (PARTITION BY k.actor, k.topic ORDER BY y.year) AS BIGINT) AS x
FROM firsts k JOIN years y ON y.year >= f LEFT JOIN ycube c ON c.year = y.year AND c.actor = k.actor AND c.topic = k.topic""")
def f12(spark, d):
    rows = activity(spark, d)
    years = rows.select("year").distinct()
    return cube.cumulative_cube(cube.count_cube(rows, ["year", "actor", "topic"]), "year", ["actor", "topic"], years).select("year", "actor", "topic", "x")


@query("e06_melt_lines", "SELECT l_orderkey AS doc, CAST(l_linenumber AS INTEGER) AS line, u.name, u.value FROM (SELECT l_orderkey, l_linenumber, unnest([{'name': 'l_quantity', 'value': l_quantity}, {'name': 'l_discount', 'value': l_discount}]) AS u FROM lineitem)")
def e06(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("line"), "l_quantity", "l_discount")
    return cube.melt(rows, ["doc", "line"], ["l_quantity", "l_discount"])


@query("e07_pivot_status", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def e07(spark, d):
    counts = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return cube.pivot(counts, ["year"], "o_orderstatus", ["F", "O", "P"], "n")


@query("e08_dummies", "SELECT c_custkey AS id, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS is_{s.lower()}" for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def e08(spark, d):
    kept = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")  # the first of the sorted labels is left out
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *[(F.col("c_mktsegment") == s).cast("int").alias(f"is_{s.lower()}") for s in kept])


@query("e10_last_value", "SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS value, max(o_orderkey) AS at FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1")
def e10(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), F.when(F.pmod("o_orderkey", F.lit(4)) != 0, F.col("o_totalprice")).alias("value"))
    return cube.keep_last(rows, ["id"], "at", "value")


@query("e12_top_or_other", SQL + """, top AS (SELECT topic FROM fact GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 10)
SELECT CASE WHEN topic IN (SELECT topic FROM top) THEN topic ELSE 'Other topics' END AS topic, count(*) AS n FROM fact GROUP BY 1""")
def e12(spark, d):
    return cube.top_or_other(activity(spark, d), "topic", 10).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("e13_recode_groups", SQL + """SELECT doc, array_to_string(list_sort(list(DISTINCT r_name)), ',') AS groups
FROM lines JOIN nation ON n_name = actor JOIN region ON r_regionkey = n_regionkey GROUP BY doc""")
def e13(spark, d):
    groups = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("actor"), F.col("r_name").alias("community"))
    docs = cells(spark, d)
    return clean.recode_to_groups(docs, clean.split_cell(F.col("actors"), ","), groups, "doc").select("doc", F.array_join("groups", ",").alias("groups"))


@query("i57_coverage", SQL + """SELECT year, count(DISTINCT doc) AS documents, count(DISTINCT actor) AS actors, count(DISTINCT topic) AS topics, count(*) AS n FROM fact GROUP BY year""")
def i57(spark, d):
    """A document is counted with the first of its facts, so that one reading makes the cube from which the rest is counted."""
    docs = lines(spark, d).groupBy("year", "doc").agg(F.collect_set(F.struct("actor", "topic")).alias("_facts"))
    facts = docs.select("year", F.posexplode("_facts").alias("_k", "_f")).groupBy("year", "_f.actor", "_f.topic")
    held = facts.agg(F.count(F.lit(1)).alias("x"), F.count(F.when(F.col("_k") == 0, 1)).alias("d"))
    return held.groupBy("year").agg(F.sum("d").alias("documents"), F.count_distinct("actor").alias("actors"), F.count_distinct("topic").alias("topics"), F.sum("x").alias("n"))
