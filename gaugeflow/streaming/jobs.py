"""Structured Streaming forms of ingest, roll-up and export.

The batch operators are exact. The roll-ups here wait for a global watermark; those of `frames` close a frame by its own group's next one,
as the rules say. Late values are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.scalars import is_numeric, mean_of
from gaugeflow.model import INTEGER_KINDS, KINDS, K
from gaugeflow.operators.health import INSTANCE, fs_used, health_percents, used_percent, variable
from gaugeflow.operators.series import MARKER_GAP
from gaugeflow.streaming.frames import ROCKSDB
from gaugeflow.streaming.ingest import Ingest
from gaugeflow.streaming.parts import dealt

CHANGES = "host_name string, app_name string, path string, group_id int, ts double, value double, active boolean"


def read_files(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of one table in a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def refused(batch: list[dict]) -> bool:
    """Whether a poll breaks the rules: paths out of component order or twice, a kind that there is not, two timestamps in one group."""
    order = [row["path"].lstrip("/").split("/") for row in batch]
    if any(a >= b for a, b in zip(order, order[1:])) or any(row.get("kind") is not None and row["kind"] not in KINDS for row in batch):
        return True
    own: dict[int, float] = {}
    return any(row["ts"] is not None and own.setdefault(row["group_id"], row["ts"]) != row["ts"] for row in batch)


def ingest_batch(state: dict, batch: list[dict]) -> list[dict]:
    """One poll of an endpoint: the changes and markers that it adds; a refused one adds nothing. state: last timestamps of groups, and for each metric its group, value, timestamp and whether it is active."""
    if refused(batch):
        return []
    groups, metrics, out = state["groups"], state["metrics"], []
    own = {}
    for row in batch:
        if row["ts"] is not None:
            own[row["group_id"]] = max(row["ts"], own.get(row["group_id"], row["ts"]))
    times = {row["group_id"]: own.get(row["group_id"], row["batch_ts"]) for row in batch}
    fresh = {g for g, ts in times.items() if str(g) not in groups or ts > groups[str(g)]}
    seen = set()
    for row in batch:
        name, g = f"{row['group_id']} {row['path']}", row["group_id"]
        seen.add(name)
        old = metrics.get(name)
        if g not in fresh and old is not None:
            continue  # late
        if old is None or not old["active"] or old["value"] != row["value"]:
            out.append({"path": row["path"], "group_id": g, "ts": times[g], "value": row["value"], "active": True})
        metrics[name] = {"path": row["path"], "group": g, "value": row["value"], "ts": times[g], "active": True}
    for name, m in metrics.items():
        if m["active"] and name not in seen and (m["group"] not in times or m["group"] in fresh):
            m["active"] = False
            out.append({"path": m["path"], "group_id": m["group"], "ts": times.get(m["group"], m["ts"] + MARKER_GAP), "value": 0.0, "active": False})
    groups.update({str(g): times[g] for g in fresh})
    return out


def stream_ingest(obs: DataFrame, keep: float | None = None) -> DataFrame:
    """Change records of a stream of polls (endpoint, batch_seq, path, group_id, ts, batch_ts, value, and, where they have them, kind and seq, the place in the poll).

    Validation, default timestamps, late drop, change compression and inactive markers, as `ingest_batch` says for one poll, on typed state: an entry for each metric and group of an
    endpoint, of which those that change are written with their chunk (`parts`). keep: seconds of its group's time after which an inactive metric is forgotten; a value of it then is a new metric's. A task holds a
    micro-batch's polls of one part of the endpoints: bound these by files per trigger.
    """
    return dealt(obs, K).groupBy("part").transformWithStateInPandas(Ingest(keep), CHANGES, "Append", "None")


def _frame(period: int) -> Column:
    return F.window("event_time", f"{period} seconds", f"{period} seconds", f"{period / 2} seconds")


def _centre(period: int) -> Column:
    return F.unix_micros("w.start") / 1e6 + period / 2


def stream_rollup(records: DataFrame, span: int, delay: str = "0 seconds", keys: tuple[str, ...] = (*K, "path")) -> DataFrame:
    """(keys, ts, kind, value, value_string) of frames centred on multiples of the span, each emitted once the watermark has passed it, as in the batch roll-up.

    Numbers average, whole kinds round half up, whatever the order in which records come; other kinds take the first value. The kind is that of the frame's first record; inactive records
    do not count. records: event_time, kind, value (double), value_string, active.
    """
    own = records.where("active").withColumn("numeric", is_numeric("kind")).withWatermark("event_time", delay)
    first = F.min_by(F.struct("kind", "value", "value_string"), "event_time")
    out = own.groupBy(*keys, "numeric", _frame(span).alias("w")).agg(first.alias("f"), mean_of("value", "kind").alias("mean"))
    mean = F.when(F.col("f.kind").isin(*INTEGER_KINDS), F.floor(F.col("mean") + 0.5).cast("double")).otherwise(F.col("mean"))
    return out.select(*keys, _centre(span).alias("ts"), "f.kind", F.when(F.col("numeric"), mean).otherwise(F.col("f.value")).alias("value"), F.when(~F.col("numeric"), F.col("f.value_string")).alias("value_string"))


def stream_health_rollup(stats: DataFrame, period: int, delay: str = "0 seconds") -> DataFrame:
    """(account, instance, region, ts, and count, min, max and sum of cpu, memory_free, memory_size and memory_percent) for each closed period; stats: as in the batch form, with event_time."""
    rows = health_percents(stats).withWatermark("event_time", delay)
    out = rows.groupBy(*INSTANCE, _frame(period).alias("w")).agg(*variable(F.col("cpu_percent"), "cpu"), *variable(F.col("memory_free"), "memory_free"), *variable(F.col("memory_total"), "memory_size"), *variable(F.col("memory_percent"), "memory_percent"))
    return out.select(*INSTANCE, _centre(period).cast("long").alias("ts"), *[c for c in out.columns if c not in (*INSTANCE, "w")])


def stream_fs_rollup(stats: DataFrame, period: int, delay: str = "0 seconds") -> DataFrame:
    """The same of size, free, used and used_percent for each mount in `fss`; mounts whose size is never known are left out."""
    rows = stats.withWatermark("event_time", delay).select(*INSTANCE, "event_time", F.explode("fss").alias("f")).select(*INSTANCE, "event_time", "f.*")
    size, free = F.col("size"), F.col("free")
    out = rows.groupBy(*INSTANCE, "mount_point", _frame(period).alias("w")).agg(*variable(size, "size"), *variable(free, "free"), *variable(fs_used(size, free), "used"), *variable(used_percent(free, size), "used_percent"))
    return out.where("size_count > 0").select(*INSTANCE, _centre(period).cast("long").alias("ts"), *[c for c in out.columns if c not in (*INSTANCE, "w")])


def stream_export(stream: DataFrame, name: str, root: str, writer: Callable[[DataFrame, int], None], hooks: tuple[Callable[[DataFrame, int], None], ...] = ()):
    """Starts a named export over what is there now: its checkpoint under `root` moves on only after the writer and hooks have succeeded, and a failed batch is tried again under the same epoch."""

    def run(batch: DataFrame, epoch: int) -> None:
        writer(batch, epoch)
        for hook in hooks:
            hook(batch, epoch)

    return stream.writeStream.queryName(name).option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).foreachBatch(run).start()


def to_parquet(stream: DataFrame, root: str) -> DataFrame:
    """Runs a stream over what is there now into a Parquet sink (exactly once) and reads it."""
    start_stateful(stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True), stream.sparkSession).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def start_stateful(writer, spark: SparkSession):
    """Starts a query with the state store that typed state needs; a query takes the setting over when it starts, and the session's own is put back."""
    key, provider = ROCKSDB
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
