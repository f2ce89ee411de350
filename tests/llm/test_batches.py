"""Python steps get batches of a bounded number of bytes, not of rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomwork.llm import _shared, decontaminate

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(_shared, "BATCH_BYTES", 10_000)
    had = spark.conf.get(BOUND, None)
    spark.conf.unset(BOUND)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    try:
        rows = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 1_000).alias("text"))
        got = _shared.map_batches(rows, sizes, "n long, size long").collect()
        assert len(got) >= 10 and sum(r["n"] for r in got) == 200 and max(r["size"] for r in got) < 20_000
        items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
        docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.lit("so one two three four five six seven eight nine ten eleven twelve thirteen")).otherwise(F.repeat(F.lit("other words "), 200)).alias("text"))
        assert [r["doc_id"] for r in decontaminate.overlaps(docs, items).collect()] == [7]
    finally:
        spark.conf.unset(BOUND)
        if had is not None:
            spark.conf.set(BOUND, had)
