"""Segmented scans give the rows of the plain rules, and a hot endpoint spreads over slices."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import series as S
from gaugeflow.operators import slices as C

OBS = "host_name string, app_name string, batch_seq long, path string, group_id int, ts double, value double, active boolean"


@pytest.fixture(scope="module")
def obs(spark):
    """One endpoint has most of the rows: four metrics in two groups, absent at times, late at times, with nulls."""
    rng, rows = random.Random(11), []
    for host, n in (("hot", 900), ("a", 40), ("b", 15), ("c", 1)):
        for b in range(n):
            for path, group in (("/x", 0), ("/y", 0), ("/z", 1), ("/rare", 1)):
                if rng.random() < (0.01 if path == "/rare" else 0.7):
                    late = 300.0 if rng.random() < 0.1 else 0.0
                    rows.append((host, "app", b, path, group, 10.0 * b - late + group, rng.choice([1.0, 1.0, 2.0, None]), rng.random() < 0.8))
    return spark.createDataFrame(rows, OBS).cache()


def same(a, b):
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    assert sorted(map(repr, a.select(*cols).collect())) == sorted(map(repr, b.select(*cols).collect()))


@pytest.mark.parametrize("parts", [2, 7, 64])
def test_sliced_rules_are_the_plain_ones(obs, parts):
    by_batch, by_ts = C.find_slices(obs, "batch_seq", parts, 30), C.find_slices(obs, "ts", parts, 30)
    assert by_batch.cuts is not None
    kept = S.drop_late(obs).cache()
    same(C.drop_late(obs, by_batch), kept)
    same(C.drop_late(obs, by_batch, keep_first=False), S.drop_late(obs, keep_first=False))
    same(C.mark_inactive(obs, by_batch), S.mark_inactive(obs))
    unique = obs.withColumn("ts", F.col("batch_seq") * 10.0)
    changes = S.compress_changes(unique).drop("batch_seq").cache()
    same(C.compress_changes(unique, by_ts).drop("batch_seq"), changes)
    times = unique.select("host_name", "app_name", "group_id", "ts").distinct()
    same(C.densify(changes, times, by_ts), S.densify(changes, times))


def test_without_hot_endpoints_there_is_one_slice(obs):
    s = C.find_slices(obs, "ts", 4, 10_000_000)
    assert s.cuts is None
    unique = obs.withColumn("ts", F.col("batch_seq") * 10.0)
    same(C.compress_changes(unique, s), S.compress_changes(unique))
    times = unique.select("host_name", "app_name", "group_id", "ts").distinct()
    changes = S.compress_changes(unique).drop("batch_seq")
    same(C.densify(changes, times, s), S.densify(changes, times))
    empty = obs.limit(0)
    assert C.drop_late(empty, C.find_slices(empty, "batch_seq")).count() == C.mark_inactive(empty, s).count() == 0


def test_a_hot_endpoint_spreads_evenly(spark):
    rows = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('h', id % 500) END AS host_name", "'a' AS app_name", "'/x' AS path", "0 AS group_id", "id * id / 1000D AS ts", "cast(id % 4 AS double) AS value", "true AS active")
    s = C.find_slices(rows, "ts", 64, 100)
    sizes = [r["count"] for r in s.of(rows).where("host_name = 'hot'").groupBy(C.SLICE).count().collect()]
    assert len(sizes) == 64 and sum(sizes) == 20_000 and max(sizes) < 2 * min(sizes)
    plan = C.compress_changes(rows, s)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(host_name" in plan and all(C.SLICE in line for line in plan.splitlines() if "Window [lag(struct" in line)
