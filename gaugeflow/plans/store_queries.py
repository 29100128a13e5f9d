"""Queries: the dated store, loaded in several loads, some of them late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.model import OBSERVATIONS, K
from gaugeflow.operators import series as S
from gaugeflow.plans.adapters import EV, LV, START, events, levels
from gaugeflow.plans.registry import ORACLES, query
from gaugeflow.plans.series_queries import _COMPRESSED
from gaugeflow.sources.names import NameIndex
from gaugeflow.sources.shared import scratch
from gaugeflow.sources.store import ChangeStore, read_observations, write_observations

_DAY = 86400


def _store(spark: SparkSession, sf_dir: str) -> ChangeStore:
    """All level changes in three loads: twelve days, the rest with what a seventh of the hosts had of those days, and the last days."""
    path = scratch(spark, "levels")
    S.compress_changes(levels(spark, sf_dir)).drop("batch_seq").write.parquet(path)
    changes = spark.read.parquet(path)
    store = ChangeStore(spark, scratch(spark, "store"), every=2)
    old, slow = F.col("ts") < START + 12 * _DAY, F.col("host_name").endswith("7")
    new = F.col("ts") >= START + 22 * _DAY
    store.load(changes.where(old & ~slow), "first")
    store.load(changes.where(old & slow | ~old & ~new), "second")
    store.load(changes.where(new), "third")
    return store


@query(ORACLES["history"])
def history_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).history(START + 10 * _DAY, START + 20 * _DAY).select(*K, "ts", "value", "active")


@query(f"WITH {EV}, {LV}, {_COMPRESSED} SELECT host_name, app_name, max(ts) AS ts, max_by(value, ts) AS value, max_by(active, ts) AS active FROM ch WHERE ts <= {START + 25.5 * _DAY} AND host_name LIKE '%1' GROUP BY ALL")
def state_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each level of some hosts was at one time."""
    return _store(spark, sf_dir).at(START + 25.5 * _DAY, F.col("host_name").endswith("1")).select(*K, "ts", "value", "active")


@query(f"WITH {EV} SELECT host_name, app_name, batch_seq, ts, value AS value_double FROM ev WHERE ts >= {START + 7.5 * _DAY} AND ts < {START + 9 * _DAY}")
def observations_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of an observations table laid out by date, written in two loads."""
    e = events(spark, sf_dir)
    cells = {"path": F.lit("/events/value"), "kind": F.lit("float64"), "group_id": F.lit(0), "ts": F.when(F.col("k") % 2 == 0, F.col("ts")), "batch_ts": F.col("ts"), "value_double": F.col("value")}
    obs = e.select(*[cells.get(f.name, F.col(f.name) if f.name in e.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in OBSERVATIONS.fields])
    path = scratch(spark, "observations")
    write_observations(obs.where("batch_seq % 2 = 0"), path, "even")
    write_observations(obs.where("batch_seq % 2 = 1"), path, "odd")
    return read_observations(spark, path, START + 7.5 * _DAY, START + 9 * _DAY).select(*K, "batch_seq", F.coalesce("ts", "batch_ts").alias("ts"), "value_double")


_NAMES = "nm AS (SELECT DISTINCT 'host/' || host_name || '/' || app_name AS name FROM ev)"


def _index(spark: SparkSession, sf_dir: str) -> NameIndex:
    """Names of hosts' applications, in three batches that repeat names, of which the first two are put together."""
    e = events(spark, sf_dir).select(F.lit("metrics").alias("type"), F.concat(F.lit("host/"), "host_name", F.lit("/"), "app_name").alias("name"), "k")
    index = NameIndex(spark, scratch(spark, "names"))
    index.add(e.where("k % 3 = 0"), "0")
    index.add(e.where("k % 3 <= 1"), "1")
    index.compact()
    index.add(e, "2")
    return index


@query(f"WITH {EV}, {_NAMES} SELECT 'metrics' AS type, name FROM nm")
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).names()


@query(f"WITH {EV}, {_NAMES} SELECT name FROM nm WHERE starts_with(name, 'host/host1') ORDER BY name LIMIT 25")
def suggest_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).suggest("metrics", "host/host1")
