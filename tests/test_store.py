"""The dated store against the whole history, over loads in and out of order."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from gaugeflow.model import OBSERVATIONS
from gaugeflow.operators import series as S
from gaugeflow.sources import store

DAY = 86400
CHANGES = "host_name string, app_name string, path string, group_id int, ts double, value double, active boolean"


def changes(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows, used = [], set()
    for _ in range(n):
        host, path, ts = f"h{rng.randrange(5)}", f"/p{rng.randrange(3)}", round(rng.uniform(0, 12 * DAY), 1)
        if (host, path, ts) not in used:
            used.add((host, path, ts))
            rows.append((host, "a", path, 0, ts, rng.random(), rng.random() < 0.8))
    rows += [("quiet", "a", "/p0", 0, 5.0, 1.0, True), ("h0", "a", "/edge", 0, 3.0 * DAY, 1.0, True), ("h0", "a", "/edge", 0, 4.0 * DAY, 2.0, True)]
    return spark.createDataFrame(rows, CHANGES)


def rows_of(df):
    return sorted(map(repr, df.select("host_name", "path", "ts", "value", "active").collect()))


RANGES = [(0, DAY), (2.5 * DAY, 4 * DAY), (3 * DAY, 3 * DAY + 1), (7 * DAY + 5, 11 * DAY), (11.9 * DAY, 30 * DAY), (-5.0, 2.0), (5 * DAY, 5 * DAY)]


@pytest.mark.parametrize("every", [1, 3])
def test_history_from_the_store(spark, tmp_path, every):
    ch = changes(spark).cache()
    s = store.ChangeStore(spark, str(tmp_path), every=every)
    # In order, then late rows of the first days together with new ones, then late ones alone; one load is repeated.
    old, late = F.col("ts") < 6 * DAY, F.col("host_name").isin("h1", "h2")
    s.load(ch.where(old & ~late), "1")
    s.load(ch.where(~old & (F.col("ts") < 9 * DAY) | old & (F.col("host_name") == "h1")), "2")
    s.load(ch.where(~old & (F.col("ts") < 9 * DAY) | old & (F.col("host_name") == "h1")), "2")
    s.load(ch.where(old & (F.col("host_name") == "h2")), "3")
    s.load(ch.where(F.col("ts") >= 9 * DAY), "4")
    s.load(ch.limit(0), "5")
    for start, end in RANGES:
        assert rows_of(s.history(start, end)) == rows_of(S.history(ch, start, end)), (start, end)
    assert rows_of(s.at(6.5 * DAY)) == rows_of(S.history(ch, 6.5 * DAY, 6.5 * DAY + 1e-4))
    own = F.col("host_name") == "h3"
    assert rows_of(s.history(2 * DAY, 9 * DAY, own)) == rows_of(S.history(ch.where(own), 2 * DAY, 9 * DAY))


def test_a_range_needs_its_days_and_one_snapshot(spark, tmp_path):
    ch = changes(spark, 2).cache()
    s = store.ChangeStore(spark, str(tmp_path))
    s.load(ch, "all")
    expected = rows_of(S.history(ch, 8.2 * DAY, 9.5 * DAY))
    plan = s.history(8.2 * DAY, 9.5 * DAY)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("PartitionFilters: [isnotnull(date") == 3 and "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in plan
    for folder in ("changes", "snapshots"):  # without all other days it still gives the same
        for d in (tmp_path / folder).glob("date=*"):
            if d.name[5:] not in ("1970-01-09", "1970-01-10"):
                shutil.rmtree(d)
    assert rows_of(s.history(8.2 * DAY, 9.5 * DAY)) == expected


def test_snapshots_do_not_grow_with_loads(spark, tmp_path):
    ch = changes(spark, 3).cache()
    s = store.ChangeStore(spark, str(tmp_path))
    for k in range(12):
        s.load(ch.where((F.col("ts") >= k * DAY) & (F.col("ts") < (k + 1) * DAY)), f"day{k}")
    n = spark.read.parquet(f"{tmp_path}/snapshots").groupBy("date").count().collect()
    assert len(n) == 12 and max(r["count"] for r in n) <= ch.select("host_name", "path").distinct().count()
    assert rows_of(s.history(10 * DAY, 11 * DAY)) == rows_of(S.history(ch, 10 * DAY, 11 * DAY))


def test_changes_without_a_timestamp_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="without a timestamp"):
        store.ChangeStore(spark, str(tmp_path)).load(changes(spark).withColumn("ts", F.when(F.col("ts") > 100, F.col("ts"))), "1")


def test_observations_by_date(spark, tmp_path):
    rows = spark.range(200).selectExpr("'h' AS host_name", "'a' AS app_name", "id AS batch_seq", "'/x' AS path", "CASE WHEN id % 3 > 0 THEN id * 7000D END AS ts", "CASE WHEN id < 190 THEN id * 7000D + 1 END AS batch_ts")
    rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in OBSERVATIONS.fields])
    store.write_observations(rows.where("batch_seq < 100"), str(tmp_path), "a")
    store.write_observations(rows.where("batch_seq >= 100"), str(tmp_path), "b")
    store.write_observations(rows.where("batch_seq >= 100"), str(tmp_path), "b")
    got = store.read_observations(spark, str(tmp_path), 3 * DAY, 5 * DAY)
    assert got.columns == OBSERVATIONS.names
    at = F.coalesce("ts", "batch_ts")
    assert sorted(r.batch_seq for r in got.collect()) == sorted(r.batch_seq for r in rows.where((at >= 3 * DAY) & (at < 5 * DAY)).collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert store.read_observations(spark, str(tmp_path), 0, 100 * DAY).count() == rows.where(at.isNotNull()).count()
