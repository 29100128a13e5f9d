"""Means of whole kinds that are exact halves round up in whatever order their records are added."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import rollup as R
from gaugeflow.streaming import frames, jobs

RECORDS = "host_name string, app_name string, group_id int, path string, ts double, kind string, value double, value_string string, active boolean"
#: Mean 8.5; added in these orders as binary numbers it comes out as 8.5 or just below.
VALUES = [v for pair in ((0.86, 16.14), (4.93, 12.07), (2.29, 14.71)) for v in pair] * 6


def shuffled(seed):
    values = list(VALUES)
    random.Random(seed).shuffle(values)
    return values


def rows(seeds):
    """A frame of 60 s for each seed, in each of which the values stand in another order, and one record of the next frame."""
    out = []
    for seed in seeds:
        host, values = f"h{seed}", shuffled(seed)
        out += [(host, "a", 0, "/v", i / 2, "int64", v, None, True) for i, v in enumerate(values)]
        out.append((host, "a", 0, "/v", 300.0, "int64", 0.0, None, True))
    return out


def test_the_values_need_it():
    below = 0
    for seed in range(40):
        total = 0.0
        for v in shuffled(seed):
            total += v
        below += total / len(VALUES) < 8.5
    assert 0 < below < 40


def test_batch(spark):
    out = R.rollup(spark.createDataFrame(rows(range(40)), RECORDS).coalesce(1), 60).where("ts = 0")
    assert {r.value for r in out.collect()} == {9.0} and out.count() == 40


def test_stream_by_watermark(spark, tmp_path):
    df = spark.createDataFrame(rows(range(40)), RECORDS).coalesce(1).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = jobs.to_parquet(jobs.stream_rollup(s, 60), str(tmp_path / "out")).where("ts = 0")
    assert {r.value for r in out.collect()} == {9.0} and out.count() == 40


@pytest.mark.parametrize("timeout", [None, 50.0])
def test_stream_by_group(spark, tmp_path, timeout):
    """Sums are kept from one micro-batch to the next."""
    every = rows(range(40))
    for k in range(6):
        spark.createDataFrame([r for r in every if r[4] // 3 == k or k == 5 and r[4] > 18], RECORDS).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    s = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in*"))
    out = jobs.to_parquet(frames.stream_group_rollup(s, 60, timeout), str(tmp_path / "out")).where("ts = 0")
    assert {r.value for r in out.collect()} == {9.0} and out.count() == 40
