"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of a batch that Spark sends to a Python worker; one row at least.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine) a local one is made
    and set for the session's context.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found:
        master = conf.get("spark.master", "")
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what this worker has freed to the system; workers stay for later tasks, and with them all that they ever took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` over batches of about BATCH_BYTES, after which the worker gives its memory back.

    A bound on batches that the session has already stays.
    """
    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(bound, None) is None:
        conf.set(bound, str(BATCH_BYTES))

    def freeing(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(freeing, schema)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that a text operator reads, under fixed names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def unlike(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def same_text(id_col: str, text_col: str, key: str = "_doc_id", text_hash: str = "_text_hash") -> Column:
    """Joins rows to keys: equal or both null ids, and equal hashes of the text.

    Ids may repeat or be null, so that a row's text belongs to its name.
    """
    return F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(f"`{key}`")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(f"`{text_hash}`"))


def vocabulary_path(name: str) -> str:
    """A public tokenizer file; LOOMWORK_TOKENIZERS names another folder."""
    folder = os.environ.get("LOOMWORK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def finite_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<double>) of the rows whose vector is there, not empty and holds neither null, nan nor infinity.

    Vectors must be of one length to be compared: those of the most frequent
    length stay (of equally frequent ones, the longest).
    """
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & whole)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["d"] if lengths else 0))
