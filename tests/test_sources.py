import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nestlake.operators.hist import Axis
from nestlake.sources import framing
from nestlake.streaming.histograms import fill_windows


@pytest.mark.parametrize("setting", [0, 101, 207, 404, 505])
def test_blocks_come_back(setting):
    for raw in (b"", b"a", b"abc" * 10_000, random.Random(1).randbytes(5000), b"x" * (framing.MOST + 10)):
        stored = framing.compress(raw, setting)
        assert framing.decompress(stored, len(raw)) == raw and len(stored) <= len(raw)


def test_damaged_blocks_are_found():
    stored = bytearray(framing.compress(b"abc" * 1000, 404))
    stored[-1] ^= 1
    with pytest.raises(ValueError):
        framing.decompress(bytes(stored), 3000)
    with pytest.raises(ValueError):
        framing.compress(b"abc", 909)


def test_packed_times():
    t = dt.datetime(2024, 2, 29, 23, 59, 58)
    assert framing.unpack_time(framing.pack_time(t)) == t


def test_streamed_histogram(spark, tmp_path):
    df = spark.range(100).select((F.lit(1_700_000_000) + F.col("id")).cast("timestamp").alias("ts"), (F.col("id") % 10).cast("double").alias("x"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = fill_windows(stream, "ts", [Axis("x", 5, 0, 10)], "1 hour", "1 minute").writeStream.format("memory").queryName("h").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert {r["ix"]: r["n"] for r in spark.sql("select ix, sum(entries) n from h group by ix").collect()} == {i: 20 for i in range(1, 6)}
