"""Count cubes, periods and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Names = Sequence[str]


def count_cube(df: DataFrame, keys: Names, value: str = "x") -> DataFrame:
    """Rows for each combination of the keys; distinct rows count once if ``df`` is distinct."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(value))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def complete_grid(cube: DataFrame, entity: str = "actor", category: str = "topic", value: str = "x", entities: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """The cube with a row of 0 for every absent pair of the two universes.

    The grid is as large as the result asks for; it is built from the distinct
    values after aggregation, never from the facts.
    """
    left = entities if entities is not None else distinct_values(cube, entity)
    right = categories if categories is not None else distinct_values(cube, category)
    return left.crossJoin(right).join(cube, [entity, category], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0).cast("long")))


def rolling_periods(first: int, last: int, width: int, skip_first: bool = False) -> list[tuple[int, int]]:
    """Closed windows (start, end) of ``width`` steps that end at every step; ``skip_first`` leaves the first full window out."""
    return [(e - width + 1, e) for e in range(first + width - (0 if skip_first else 1), last + 1)]


def block_periods(first: int, last: int, step: int) -> list[tuple[int, int]]:
    """Consecutive closed blocks; the last one is clipped."""
    return [(y, min(y + step - 1, last)) for y in range(first, last + 1, step)]


def assign_rolling(df: DataFrame, time: str, width: int, least_end: Column | int, greatest_end: Column | int, end: str = "window_end") -> DataFrame:
    """One row for each rolling window a row falls into.

    Times are spread over the windows that hold them, so no range join is
    needed and the later aggregation is keyed by window.
    """
    ends = F.explode(F.sequence(F.col(time), F.col(time) + F.lit(width - 1)))
    return df.withColumn(end, ends).filter((F.col(end) >= least_end) & (F.col(end) <= greatest_end))


def assign_blocks(df: DataFrame, time: str, step: int, start: int, last: int) -> DataFrame:
    """period_start and period_end of the block that holds a row's time; rows before ``start`` or after ``last`` go."""
    at = F.col(time) - F.pmod(F.col(time) - F.lit(start), F.lit(step))
    rows = df.filter(F.col(time).between(start, last)).withColumn("period_start", at.cast("int"))
    return rows.withColumn("period_end", F.least(F.col("period_start") + F.lit(step - 1), F.lit(last)).cast("int"))


def ordinal_time(df: DataFrame, columns: Names, name: str = "step") -> DataFrame:
    """``df`` with the rank of its (columns) among the distinct ones: an ordinal time axis.

    Only the distinct values are ranked, so the facts are joined, not sorted.
    """
    steps = df.select(*columns).distinct().withColumn(name, F.row_number().over(Window.orderBy(*columns)))
    return df.join(steps, list(columns))


def cumulative_cube(cube: DataFrame, time: str, keys: Names, times: DataFrame, value: str = "x") -> DataFrame:
    """For each time the sum of all values up to it, for keys seen by then."""
    seen = cube.groupBy(*keys).agg(F.min(time).alias("_first"))
    dense = seen.join(times.select(F.col(time)), F.col(time) >= F.col("_first")).drop("_first").join(cube, [time, *keys], "left")
    upto = Window.partitionBy(*keys).orderBy(time)
    return dense.withColumn(value, F.sum(F.coalesce(value, F.lit(0))).over(upto))


def melt(df: DataFrame, ids: Names, values: Names, name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot(df: DataFrame, ids: Names, column: str, values: Names, value: str, fill=0) -> DataFrame:
    """One column for each of the given values; absent cells get ``fill``."""
    return df.groupBy(*ids).pivot(column, list(values)).agg(F.first(value)).fillna(fill, list(values))


def keep_last(df: DataFrame, keys: Names, order: str, value: str) -> DataFrame:
    """For each key the value of the greatest order that has one."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def top_or_other(df: DataFrame, column: str, n: int, other: str = "Other topics") -> DataFrame:
    """Relabels all but the n most frequent values; ties by label."""
    top = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(n).select(F.col(column).alias("_kept"))
    return df.join(top, F.col(column) == F.col("_kept"), "left").withColumn(column, F.coalesce("_kept", F.lit(other))).drop("_kept")
