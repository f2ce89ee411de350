"""Files and tables: scans, sinks, and tables that cut a plan short."""

from __future__ import annotations

import csv
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read back, for plans that are used again and again."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A parquet, csv (with header) or json table by its ending."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    if kind == "json":
        return reader.json(path, multiLine=True)
    return reader.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_usable(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """The first of the candidates that can be opened, has the columns and holds a row.

    A file that is missing, broken, empty or lacks a column is passed over; if
    none is left, the error names what was wrong with each.
    """
    wrong = []
    for path in paths:
        if not _exists(spark, path):
            wrong.append(f"{path}: missing")
            continue
        try:
            found = read_any(spark, path)
            lacking = [c for c in columns if c not in found.columns]
            if not lacking and found.limit(1).count():
                return found
            wrong.append(f"{path}: " + (f"no column {', '.join(lacking)}" if lacking else "no rows"))
        except (PySparkException, Py4JJavaError) as error:
            wrong.append(f"{path}: {str(error).splitlines()[0][:200]}")
    raise FileNotFoundError("; ".join(wrong) or "no candidates")


def built_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], columns: Sequence[str] = ()) -> DataFrame:
    """The parquet table at ``path``; built first if it is missing or lacks one of the columns."""
    if _exists(spark, path):
        found = spark.read.parquet(path)
        if set(columns) <= set(found.columns):
            return found
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def tagged(path: str, tag: str | None) -> str:
    """stem_tag.ext"""
    stem, ext = os.path.splitext(path)
    return f"{stem}_{tag}{ext}" if tag else path


def preferred_path(folder: str, stem: str, time_unit: str, window: int, ext: str = ".parquet") -> list[str]:
    """Candidate files from the most to the least specific."""
    return [f"{folder}/{tagged(stem + ext, t)}" for t in (f"{time_unit}_{window}", f"{window}", None)]


def csv_after(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """A CSV whose files have ``skip`` lines of something else before their header; all columns are strings.

    Lines are known by their file, their block in it and their place in the
    block, and only the first ``skip`` + 1 of each file are ranked.  Files may
    have different headers; columns that one lacks are null there.  Blank lines
    go; a quoted cell does not span lines.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    rows = cut(read, "lines")
    top = Window.partitionBy("_file").orderBy("_block", "_place")
    first = rows.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= skip + 1)
    headers = first.filter(F.col("_r") == skip + 1).select("_file", F.col("value").alias("_header"))
    body = rows.join(first.select("_file", "_place"), ["_file", "_place"], "left_anti").filter(F.trim("value") != "").join(headers, "_file")
    parts = []
    for (line,) in headers.select("_header").distinct().orderBy("_header").collect():  # one for each kind of file
        names = [c.strip() or f"_{k}" for k, c in enumerate(next(csv.reader([line.lstrip("\ufeff")])))]
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
        parts.append(body.filter(F.col("_header") == line).select(F.from_csv("value", schema).alias("_row")).select("_row.*"))
    if not parts:
        return spark.createDataFrame([], "value string").select()
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def wide_years(spark: SparkSession, path: str, skip: int = 4, keys: Sequence[str] = ("Country Name", "Country Code")) -> DataFrame:
    """A CSV with ``skip`` lines before its header and a column for each year, as (keys, year, value); cells that are no number go."""
    df = csv_after(spark, path, skip)
    years = [c for c in df.columns if re.fullmatch(r"\d{4}", c)]
    if not years:
        raise ValueError(f"no year columns in {path}")
    quoted = lambda names: [F.col(f"`{c}`") for c in names]
    long = df.select(*quoted([*keys, *years])).unpivot(quoted(keys), quoted(years), "year", "value")
    return long.select(*quoted(keys), F.col("year").cast("int").alias("year"), F.col("value").try_cast("double").alias("value")).dropna(subset=["value"])


def latest_year(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, year, value: the last year of each key that has a value."""
    return long.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.max("year").alias("year"), F.max_by("value", "year").alias("value"))


GRAPH = "nodes array<struct<id: string, volume: double, theme: string, x: double, y: double>>, links array<struct<source: string, target: string, value: double>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, volume, theme, x, y) and links (source, target, value) of graph or layout documents; entries without a name or an end go.

    A document that is no JSON, or whose lists are none, has neither.
    """
    df = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes = df.select(F.inline("nodes")).filter(F.col("id").isNotNull())
    links = df.select(F.inline("links")).filter(F.col("source").isNotNull() & F.col("target").isNotNull())
    return nodes, links


def graph_document(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One JSON row of ``nodes`` (any columns of a graph's) and ``links``, each sorted by name; both are universes of topics."""
    listed = lambda df, *order: df.agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order]))).alias("a"))
    both = listed(nodes, "id").select(F.col("a").alias("nodes")).crossJoin(listed(links, "source", "target").select(F.col("a").alias("links")))
    return both.select(F.to_json(F.struct("nodes", "links")).alias("value"))


def saved_places(nodes: DataFrame, wanted: DataFrame, least_share: float = 0.7, least: int = 3) -> DataFrame | None:
    """topic, x, y of the wanted topics that a saved layout places, centred and scaled to deviation 1; None if it places too few.

    Names match without regard to case, underscores and spaces; of nodes that
    come to the same name the first by id counts.
    """
    key = lambda c: F.lower(F.trim(F.regexp_replace(F.replace(F.col(c), F.lit("_"), F.lit(" ")), r"\s+", " ")))
    placed = nodes.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(key("id").alias("_key")).agg(F.min_by(F.struct("x", "y"), "id").alias("p"))
    found = cut(wanted.select("topic", key("topic").alias("_key")).join(placed, "_key").select("topic", "p.x", "p.y"), "places")
    have, want = found.count(), wanted.count()
    if have < least or have < least_share * want:
        return None
    scale = lambda c: (F.col(c) - F.col(f"m{c}")) / F.when(F.col(f"s{c}") < 1e-9, 1.0).otherwise(F.col(f"s{c}"))
    ends = found.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return found.crossJoin(ends).select("topic", scale("x").alias("x"), scale("y").alias("y"))


def matrix_cells(spark: SparkSession, path: str, expected: Sequence[int]) -> DataFrame:
    """A CSV matrix with an index column as (row, col, value) over the expected labels; missing cells are 0."""
    df = spark.read.csv(path, header=True)
    labels = df.columns[1:]
    # a label such as 1.0 is no column name to refer to: columns go by number
    places = [f"c{k}" for k in range(len(labels))]
    long = df.toDF("row", *places).unpivot("row", places, "place", "value")
    names = spark.createDataFrame(list(zip(places, labels, strict=True)), "place string, col string")
    number = lambda c: F.col(c).try_cast("double").cast("int")
    long = long.join(names, "place").select(number("row").alias("row"), number("col").alias("col"), F.col("value").try_cast("double").alias("value"))
    want = spark.createDataFrame([(r, c) for r in expected for c in expected], "row int, col int")
    return want.join(long, ["row", "col"], "left").fillna(0.0, ["value"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def metadata(df: DataFrame, facts: dict[str, object]) -> DataFrame:
    """One JSON row: the given facts, the columns and the number of rows of ``df``."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.to_json(F.struct("rows", F.array(*[F.lit(c) for c in df.columns]).alias("columns"), *[F.lit(v).alias(k) for k, v in facts.items()])).alias("json"))


def write_json_text(df: DataFrame, path: str) -> None:
    """A one-column DataFrame of JSON strings as text files."""
    df.write.mode("overwrite").text(path)
