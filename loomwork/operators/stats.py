"""Statistics by group, in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.sources.store import cut


def average_rank(x: str, by: Sequence[str] = ()) -> Column:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(w.partitionBy(*by, x)) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    ranked = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)})
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n"))


def gini(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Half the mean absolute difference over the mean of the nonzero values; null for fewer than two.

    The sorted closed form: sum((2 k - n - 1) x_k) / (n sum x).
    """
    rows = df.filter(F.col(value) != 0).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(value)))
    g = rows.groupBy(*by).agg(F.sum(F.col("_k") * F.col(value)).alias("_s"), F.sum(value).alias("_t"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, "n", F.when(F.col("n") > 1, (2 * F.col("_s") / F.col("_t") - F.col("n") - 1) / F.col("n")).alias("gini"))


def tukey(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Five numbers and the values beyond 1.5 interquartile ranges, sorted."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    reach = 1.5 * (F.col("q")[3] - F.col("q")[1])
    joined = df.join(q, list(by))
    out = F.when((F.col(value) < F.col("q")[1] - reach) | (F.col(value) > F.col("q")[3] + reach), F.col(value))
    return joined.groupBy(*by).agg(F.first("q").alias("q"), F.array_sort(F.collect_list(out)).alias("outliers")).select(*by, *[F.col("q")[k].alias(n) for k, n in enumerate(("least", "q25", "median", "q75", "most"))], "outliers")


def line_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope and intercept; without spread in x the slope is 0."""
    return df.groupBy(*by).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"), F.count(F.lit(1)).alias("n"))


def quadratic_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """c0 + c1 x + c2 x^2 by the normal equations of centred moments."""
    mean = Window.partitionBy(*by)
    rows = df.withColumn("_m", F.avg(x).over(mean)) if by else df.crossJoin(df.agg(F.avg(x).alias("_m")))
    u = F.col(x) - F.col("_m")
    s = rows.groupBy(*by).agg(
        F.first("_m").alias("m"), F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.pow(u, F.lit(k))).alias(f"s{k}") for k in (2, 3, 4)],
        F.sum(y).alias("t0"), F.sum(u * F.col(y)).alias("t1"), F.sum(u * u * F.col(y)).alias("t2"),
    )
    c = F.expr("(t2 - s2 * t0 / n - s3 * t1 / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2)")
    s = s.withColumn("c2", c).withColumn("_b", F.expr("(t1 - c2 * s3) / s2")).withColumn("_a", F.expr("(t0 - c2 * s2) / n"))
    return s.select(*by, F.expr("_a - _b * m + c2 * m * m").alias("c0"), F.expr("_b - 2 * c2 * m").alias("c1"), "c2")


def exact_percentiles(df: DataFrame, x: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, q: the percentiles of x at the given shares, linear between neighbours, for each group (without ``by``: one row); null without a value.

    Rows are sorted over all tasks and written with their place; the places
    wanted follow from how many rows of each group a task has, so that no group's
    values are held by one task.
    """
    by, known = list(by), df.filter(F.col(x).isNotNull())
    placed = known.select(*by, x).orderBy(*by, x).select(*by, x, F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at"))
    rows = cut(placed, "sorted")
    tasks = rows.groupBy(*by, "_task").agg(F.count(F.lit(1)).alias("_k"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*by)
    tasks = tasks.withColumns({"_n": F.sum("_k").over(whole), "_before": F.sum("_k").over(whole.orderBy("_task")) - F.col("_k")})
    share = F.posexplode(F.array(*[F.lit(float(p)) for p in at])).alias("_i", "_p")
    place = F.col("_p") * (F.col("_n") - 1)
    ends = tasks.select("*", share).withColumn("_place", place).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))))
    inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_k"))
    wanted = ends.filter(inside).select(*by, "_i", "_place", "_rank", (F.col("_first") + F.col("_rank") - F.col("_before")).alias("_at"))
    found = wanted.join(rows.select("_at", F.col(x).alias("_x")), "_at")
    weight = 1 - F.abs(F.col("_place") - F.col("_rank"))
    values = found.groupBy(*by, "_i").agg(F.sum(weight * F.col("_x")).alias("_v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"])
    return values.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 0, listed).alias("q"))


def z_score(df: DataFrame, value: str, by: Sequence[str] = (), sample: bool = False) -> DataFrame:
    """``z``: 0 where there is no spread."""
    sd = F.stddev_samp if sample else F.stddev_pop
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), sd(value).alias("_s"))
    joined = df.join(stats, list(by)) if by else df.crossJoin(stats)
    return joined.withColumn("z", F.when(F.coalesce(F.col("_s"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def min_max(df: DataFrame, value: str, degenerate: float = 0.5) -> DataFrame:
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(degenerate)).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.crossJoin(ends).withColumn("scaled", scaled).drop("_lo", "_hi")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def odds(beta: Column, se: Column) -> dict[str, Column]:
    """Odds ratio and 95 % interval of a logit coefficient."""
    return {"odds_ratio": F.exp(beta), "low": F.exp(beta - 1.96 * se), "high": F.exp(beta + 1.96 * se)}


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def is_finite(x: Column | str) -> Column:
    """Neither null, nan nor infinite."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
