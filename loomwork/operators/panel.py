"""Panels of adoption and persistence, spells, curves and survival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators.space import both_ways
from loomwork.operators.stats import exact_percentiles


def transitions(periods: DataFrame, period: str = "period", lag: int = 1) -> DataFrame:
    """prev, period for periods ``lag`` places apart; periods are few and ranked on their own."""
    w = Window.orderBy(period)
    return periods.select(period, F.lag(period, lag).over(w).alias("prev")).dropna()


def popularity(sup: DataFrame, entities: Column, period: str = "period", category: str = "topic") -> DataFrame:
    """Share of all entities that hold a category in a period."""
    return sup.groupBy(period, category).agg((F.count(F.lit(1)) / entities).alias("popularity"))


def adoption_panel(sup: DataFrame, edges: DataFrame, categories: DataFrame, entities: int, lag: int = 1, edges_by: str | None = None, weight: str = "phi") -> DataFrame:
    """One row for each category an entity does not hold in a period but could adopt by the next.

    ``sup``: period, actor, topic.  Entities without a portfolio in the earlier
    period are left out.  Columns: prev, period, actor, topic, adopted,
    closeness (greatest weight to the prior portfolio, 0 without a link),
    prev_diversity and popularity, both of the earlier period.
    ``edges_by``: the period column of edges that change with time (the
    earlier period's are used).
    """
    steps = transitions(sup.select("period").distinct(), lag=lag)
    prior = sup.withColumnRenamed("period", "prev").join(steps, "prev").select("prev", "period", "actor", "topic")
    held = prior.groupBy("prev", "period", "actor").agg(F.count(F.lit(1)).alias("prev_diversity"))
    risk = held.crossJoin(categories).join(prior, ["prev", "period", "actor", "topic"], "left_anti")
    near = both_ways(edges, weight, *([edges_by] if edges_by else []))
    near = near.select(*([F.col(edges_by).alias("prev")] if edges_by else []), F.col("i").alias("topic"), F.col("j").alias("_held"), weight)
    best = prior.withColumnRenamed("topic", "_held").join(near, [*(["prev"] if edges_by else []), "_held"]).groupBy("prev", "period", "actor", "topic").agg(F.max(weight).alias("closeness"))
    now = sup.withColumn("adopted", F.lit(1))
    pop = popularity(sup, F.lit(entities)).withColumnRenamed("period", "prev")
    out = risk.join(best, ["prev", "period", "actor", "topic"], "left").join(now, ["period", "actor", "topic"], "left").join(pop, ["prev", "topic"], "left")
    return out.select(
        "prev", "period", "actor", "topic", F.coalesce("adopted", F.lit(0)).alias("adopted"), F.coalesce("closeness", F.lit(0.0)).alias("closeness"),
        "prev_diversity", F.coalesce("popularity", F.lit(0.0)).alias("popularity"),
    )


def lookback_panel(sup: DataFrame, edges: DataFrame, categories: DataFrame, entities: int, lags: Sequence[int], weight: str = "phi") -> DataFrame:
    """The adoption panel for every lag at once, with the column ``lookback``: ``lag`` periods lie between prev and period.

    What an entity holds, its closeness and the popularity belong to the
    earlier period alone: they are made once and joined to the pairs of
    periods, so the facts are read once for all lags.
    """
    places = sup.select("period").distinct().withColumn("_n", F.row_number().over(Window.orderBy("period")))
    steps = places.select(F.col("period").alias("prev"), F.col("_n").alias("_m"), F.explode(F.array(*map(F.lit, lags))).alias("lookback"))
    steps = steps.join(places, F.col("_n") == F.col("_m") + F.col("lookback")).select("lookback", "prev", "period")
    prior = sup.withColumnRenamed("period", "prev")
    held = prior.groupBy("prev", "actor").agg(F.count(F.lit(1)).alias("prev_diversity"))
    near = both_ways(edges, weight).select(F.col("i").alias("topic"), F.col("j").alias("_held"), weight)
    best = prior.withColumnRenamed("topic", "_held").join(near, "_held").groupBy("prev", "actor", "topic").agg(F.max(weight).alias("closeness"))
    pop = popularity(sup, F.lit(entities)).withColumnRenamed("period", "prev")
    at = ["prev", "actor", "topic"]
    risk = held.crossJoin(categories).join(prior, at, "left_anti").join(best, at, "left").join(pop, ["prev", "topic"], "left")
    out = risk.join(steps, "prev").join(sup.withColumn("adopted", F.lit(1)), ["period", "actor", "topic"], "left")
    return out.select(
        "lookback", "prev", "period", "actor", "topic", F.coalesce("adopted", F.lit(0)).alias("adopted"), F.coalesce("closeness", F.lit(0.0)).alias("closeness"),
        "prev_diversity", F.coalesce("popularity", F.lit(0.0)).alias("popularity"),
    )


def persistence_panel(sup: DataFrame, edges: DataFrame, lag: int = 1, weight: str = "phi") -> DataFrame:
    """One row for each held category: whether it is held in the next period, and its closeness to the *other* held ones (null if there are none linked)."""
    steps = transitions(sup.select("period").distinct(), lag=lag)
    prior = sup.withColumnRenamed("period", "prev").join(steps, "prev").select("prev", "period", "actor", "topic")
    near = both_ways(edges, weight).select(F.col("i").alias("topic"), F.col("j").alias("_other"), weight)
    pairs = prior.join(prior.withColumnRenamed("topic", "_other"), ["prev", "period", "actor"]).filter("topic <> _other")
    best = pairs.join(near, ["topic", "_other"]).groupBy("prev", "period", "actor", "topic").agg(F.max(weight).alias("closeness"))
    size = prior.groupBy("prev", "period", "actor").agg(F.count(F.lit(1)).alias("prev_diversity"))
    now = sup.withColumn("persisted", F.lit(1))
    out = prior.join(best, ["prev", "period", "actor", "topic"], "left").join(now, ["period", "actor", "topic"], "left").join(size, ["prev", "period", "actor"])
    return out.select("prev", "period", "actor", "topic", F.coalesce("persisted", F.lit(0)).alias("persisted"), "closeness", "prev_diversity")


def with_choice(panel: DataFrame, keys: Sequence[str] = ("period", "actor"), outcome: str = "adopted") -> DataFrame:
    """The rows of choice sets with at least one success, with the set's name."""
    any_success = panel.groupBy(*keys).agg(F.max(outcome).alias("_any")).filter("_any = 1").drop("_any")
    return panel.join(any_success, list(keys), "left_semi").withColumn("group", F.concat_ws("::", "actor", F.col("period").cast("string")))


def equal_width_rate(df: DataFrame, x: str, outcome: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Rate of the outcome in ``bins`` right-closed bins of equal width over the range of all groups."""
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.coalesce(F.try_divide(F.col(x) - F.col("_lo"), width), F.lit(1)))))
    rows = df.filter(F.col(x).isNotNull()).crossJoin(ends).withColumn("bin", place.cast("int"))
    out = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("long")).alias("hits"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    return out.select(*by, "bin", "n", "hits", (F.col("_lo") + (F.col("bin") - 0.5) * step).alias("center"), (F.col("hits") / F.col("n")).alias("rate"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95 % interval of a rate, within [0, 1]."""
    p = hits / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    reach = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - reach), F.least(F.lit(1.0), centre + reach)


def quantile_edges(df: DataFrame, x: str, bins: int) -> DataFrame:
    """One row: the sorted distinct quantile edges of x."""
    return exact_percentiles(df, x, [k / bins for k in range(bins + 1)]).select(F.array_sort(F.array_distinct("q")).alias("edges"))


def quantile_bin(x: Column, edges: Column) -> Column:
    """The right-closed bin (from 1) of x; the least value falls into the first."""
    return F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < x))).cast("int")


def spells(activity: DataFrame, last: int, gap: int, keys: Sequence[str] = ("actor", "topic"), time: str = "step") -> DataFrame:
    """start, duration and event of every spell: from each entry, with up to ``gap`` idle steps tolerated in a row.

    ``activity`` has the active steps 0..last of the keys.  Every switch from
    idle to active starts a spell, inside another one too.  A spell ends with
    its first run of more than ``gap`` idle steps; the tolerated ones count, so
    the duration is last active + gap + 1 - start.  A spell whose walk reaches
    the end is censored and lasts to the end.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    rows = activity.select(*keys, time).distinct()
    rows = rows.withColumns({"_before": F.lag(time).over(w), "_next": F.lead(time).over(w)})
    # a step is the last of a spell if the next active one is too far away
    stop = F.when(F.coalesce(F.col("_next"), F.lit(last + 1)) - F.col(time) > gap + 1, F.col(time)).when(F.col("_next").isNull(), F.lit(last + 1))
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_stop", F.first(stop, ignorenulls=True).over(ahead))
    entry = F.col("_before").isNull() | (F.col("_before") < F.col(time) - 1)
    ended = (F.col("_stop") <= last) & (F.col("_stop") + gap + 1 <= last)
    length = F.when(ended, F.col("_stop") + gap + 1 - F.col(time)).otherwise(F.lit(last + 1) - F.col(time))
    return rows.filter(entry).select(*keys, F.col(time).alias("start"), length.cast("int").alias("duration"), ended.cast("int").alias("event"))


def every_step(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A survival curve with a row for each whole t from 0 to its last: those without an exit have no events and what survives before them."""
    by = list(by)
    last = curve.groupBy(*by).agg(F.max("t").alias("_last"))
    steps = last.select(*by, F.explode(F.sequence(F.lit(0), F.col("_last").cast("int"))).alias("t"))
    w = Window.partitionBy(*by).orderBy("t")
    joined = steps.join(curve, [*by, "t"], "left")
    after = F.first("at_risk", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.coalesce(F.last("survival", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return joined.select(*by, "t", after.alias("at_risk"), F.coalesce("events", F.lit(0).cast("long")).alias("events"), before.alias("survival"))


def kaplan_meier(spell: DataFrame, by: Sequence[str] = (), duration: str = "duration", event: str = "event") -> DataFrame:
    """t, at_risk, events and survival at every distinct duration."""
    at = spell.groupBy(*by, F.col(duration).alias("t")).agg(F.count(F.lit(1)).alias("leaving"), F.sum(F.col(event).cast("long")).alias("events"))
    w = Window.partitionBy(*by).orderBy("t")
    later = w.rowsBetween(0, Window.unboundedFollowing)
    at = at.withColumn("at_risk", F.sum("leaving").over(later))
    stays = F.col("at_risk") - F.col("events")
    gone = F.max((stays == 0).cast("int")).over(w)
    survival = F.when(gone == 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(stays > 0, F.log(stays / F.col("at_risk")))).over(w)))
    return at.select(*by, "t", "at_risk", "events", survival.alias("survival"))
