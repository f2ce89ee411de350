"""The facts' tasks follow the lines, not the session's number of parts, and repeated or null names and dates count once."""

from pyspark.sql import functions as F

from loomwork.plans import facts

SF = "/root/testdata/sf0.001"
NAMES = ("lineitem", "orders", "part", "supplier", "nation")


def test_few_lines_are_few_tasks(spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert facts.activity(spark, SF).rdd.getNumPartitions() == 1 + facts.table(spark, SF, "lineitem").count() // facts.TASK_LINES
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


def test_repeated_dates_and_shared_or_null_names(spark, tmp_path):
    for n in NAMES:
        df = facts.table(spark, SF, n)
        if n == "orders":
            df = df.union(df)
        if n == "nation":  # two keys of one name
            df = df.withColumn("n_name", F.when(F.col("n_nationkey") < 2, F.lit("ONE")).otherwise(F.col("n_name")))
        if n == "part":
            df = df.withColumn("p_name", F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")))
        df.write.parquet(f"{tmp_path}/{n}.parquet")
    t = {n: spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in NAMES}
    joined = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    joined = joined.join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    want = joined.select("l_orderkey", F.year("o_orderdate"), "n_name", "p_name")
    assert facts.activity(spark, str(tmp_path)).exceptAll(want.distinct()).count() == 0
    assert want.distinct().exceptAll(facts.activity(spark, str(tmp_path))).count() == 0
    assert facts.lines(spark, str(tmp_path)).count() == want.count()
