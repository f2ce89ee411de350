"""The cube over a stream equals the cube over the same rows at rest, but for rows later than its watermark."""

import datetime as dt
from collections import Counter

from loomwork.streaming.cube import windowed_cube


def test_stream_counts_as_the_table_and_drops_only_late_rows(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    parts = [
        [(day(1, 3), "a"), (day(1, 9), "a"), (day(2, 1), "b"), (None, "a"), (day(2, 2), None)],
        [(day(1, 23), "a"), (day(8, 5), "a")],
        [(day(1, 1), "a"), (day(8, 6), "b"), (day(7, 1), "a")],
        [(day(20, 0), "z")],
        [(day(20, 1), "z")],
    ]
    source, out = tmp_path / "in", tmp_path / "out"
    stream = None
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(str(source))
        cube = windowed_cube(spark.readStream.schema("ts timestamp, kind string").parquet(str(source)), "ts", ["kind"])
        stream = cube.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(out))
        assert stream.awaitTermination(120), n
    found = {(r["window_start"].day, r["kind"]): r["x"] for r in spark.read.parquet(str(out)).collect()}
    late = (day(1, 1), "a")
    want = Counter((t.day, k) for rows in parts for t, k in rows if t is not None and (t, k) != late and t.day < 18)
    assert found == dict(want)
