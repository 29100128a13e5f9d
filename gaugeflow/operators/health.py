"""Machine health: instant statistics, percents and periodic roll-ups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.scalars import frame_id
from gaugeflow.model import K

#: Points of an instance and of a filesystem in one call, and the budget of a call (fixed values).
INSTANCE_POINTS, FS_POINTS, MOST_POINTS = 12, 9, 1000
_FS = "^/sys/fs(/.*)?/METRICS/"


def mount_point(path: Column | str = "path") -> Column:
    """The mount of a filesystem path: what stands between /sys/fs and the first METRICS; else null."""
    p = F.split(F.col(path) if isinstance(path, str) else path, "/")
    at = F.array_position(p, "METRICS").cast("int")
    inside = F.array_join(F.slice(p, 4, F.greatest(at - 4, F.lit(0))), "/")
    return F.when((F.element_at(p, 2) == "sys") & (F.try_element_at(p, F.lit(3)) == "fs") & (at > 3), F.concat(F.lit("/"), inside))


def file_systems(obs: DataFrame) -> DataFrame:
    """(endpoint, mount_point), distinct."""
    return obs.where(F.col("path").startswith("/sys/fs/")).select(*K, mount_point().alias("mount_point")).where("mount_point is not null").distinct()


def instance_stats(obs: DataFrame) -> DataFrame:
    """(endpoint, batch_seq, user_time_fraction, memory_free, memory_total) and fss, an array of (mount_point, size, free); a value of the wrong kind is missing."""
    batch = [*K, "batch_seq"]
    wanted = obs.where(F.col("path").isin("/sys/sched/cpu/user-time-fraction", "/sys/memory/available", "/sys/memory/total") | F.col("path").rlike(_FS))

    def pick(path: str, kind: str, column: str) -> Column:
        return F.max(F.when((F.col("path") == path) & (F.col("kind") == kind), F.col(column)))

    leaf = F.when(F.col("path").endswith("/size"), "size").when(F.col("path").endswith("/free"), "free")
    number = F.when(F.col("kind") == "uint64", F.col("value_long"))
    cells = wanted.select(*batch, "ts", "path", "kind", "value_double", "value_long", mount_point().alias("mount_point"), leaf.alias("leaf"), number.alias("number"))
    # One shuffle by the batch serves both aggregations: by mount, then of the mounts.
    mounts = cells.repartition(*batch).groupBy(*batch, "mount_point").agg(
        F.max("ts").alias("ts"),
        pick("/sys/sched/cpu/user-time-fraction", "float64", "value_double").alias("user_time_fraction"),
        pick("/sys/memory/available", "uint64", "value_long").alias("memory_free"),
        pick("/sys/memory/total", "uint64", "value_long").alias("memory_total"),
        F.max(F.when(F.col("leaf") == "size", F.col("number"))).alias("size"),
        F.max(F.when(F.col("leaf") == "free", F.col("number"))).alias("free"),
    )
    names = ("ts", "user_time_fraction", "memory_free", "memory_total")
    out = mounts.groupBy(*batch).agg(*[F.max(c).alias(c) for c in names], F.array_sort(F.collect_list(F.when(F.col("mount_point").isNotNull(), F.struct("mount_point", "size", "free")))).alias("fss"))
    return out.withColumn("fss", F.when(F.size("fss") > 0, F.col("fss")))


def cpu_percent(fraction: Column | str) -> Column:
    f = F.col(fraction) if isinstance(fraction, str) else fraction
    return F.when(f.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), f * 100)))


def used_percent(free: Column, total: Column) -> Column:
    """Share in use; null if the total is 0 or either is unknown, 0 if more is free than there is."""
    return F.when((total > 0) & free.isNotNull(), F.greatest(F.lit(0.0), (total - free) * 100.0 / total))


def health_percents(stats: DataFrame) -> DataFrame:
    """Adds cpu_percent and memory_percent."""
    return stats.withColumn("cpu_percent", cpu_percent("user_time_fraction")).withColumn("memory_percent", used_percent(F.col("memory_free"), F.col("memory_total")))


def fs_used(size: Column, free: Column) -> Column:
    return F.when(free >= size, F.lit(0)).otherwise(size - free)


def combine_fs(stats: DataFrame) -> DataFrame:
    """fss becomes one filesystem "/" with the sums over the mounts whose size and free are both known; none if there is no such mount."""
    known = F.filter("fss", lambda f: f["size"].isNotNull() & f["free"].isNotNull())
    total = lambda name: F.aggregate(known, F.lit(0).cast("long"), lambda a, f: a + f[name])
    one = F.array(F.struct(F.lit("/").alias("mount_point"), total("size").alias("size"), total("free").alias("free")))
    return stats.withColumn("fss", F.when(F.size(known) > 0, one).otherwise(F.slice(one, 1, 0)))


def memory_only(stats: DataFrame, flag: Column) -> DataFrame:
    """Without cpu and filesystems where the flag holds."""
    return stats.withColumn("user_time_fraction", F.when(~flag, F.col("user_time_fraction"))).withColumn("fss", F.when(~flag, F.col("fss")))


def variable(value: Column, name: str) -> list[Column]:
    return [F.count(value).alias(f"{name}_count"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"), F.sum(value).alias(f"{name}_sum")]


def integer_average(name: str) -> Column:
    """The truncated mean of an integer variable, null if it is empty."""
    return F.when(F.col(f"{name}_count") > 0, F.expr(f"{name}_sum div {name}_count"))


INSTANCE = ["account", "instance", "region"]


def health_rollup(stats: DataFrame, period: float) -> DataFrame:
    """count, min, max and sum of each variable for each instance and period; ts rounds half up to the period."""
    rows = health_percents(stats).withColumn("ts", frame_id("ts", period).cast("long"))
    return rows.groupBy(*INSTANCE, "ts").agg(*variable(F.col("cpu_percent"), "cpu"), *variable(F.col("memory_free"), "memory_free"), *variable(F.col("memory_total"), "memory_size"), *variable(F.col("memory_percent"), "memory_percent"))


def fs_rollup(stats: DataFrame, period: float) -> DataFrame:
    """The same for each mount; mounts whose size is never known (free space alone says nothing) are left out."""
    rows = stats.withColumn("ts", frame_id("ts", period).cast("long")).select(*INSTANCE, "ts", F.explode("fss").alias("f")).select(*INSTANCE, "ts", "f.*")
    used = fs_used(F.col("size"), F.col("free"))
    out = rows.groupBy(*INSTANCE, "ts", "mount_point").agg(*variable(F.col("size"), "size"), *variable(F.col("free"), "free"), *variable(used, "used"), *variable(used_percent(F.col("free"), F.col("size")), "used_percent"))
    return out.where("size_count > 0")


def retain(snapshots: DataFrame, span: float, keys: list[str]) -> DataFrame:
    """Snapshots no older than the key's newest less the span (seconds)."""
    return snapshots.withColumn("_last", F.max("ts").over(Window.partitionBy(*keys))).where(F.col("ts") >= F.col("_last") - span).drop("_last")


def packed(pdf: pd.DataFrame, keys: list[str], most: int = MOST_POINTS, used: int = 0, batch: int = 0) -> pd.DataFrame:
    """The calls of one key's snapshots, or of those of one slice: the call that is open before them has the number `batch` and `used` points."""
    with_instance, without = (most - INSTANCE_POINTS) // FS_POINTS, most // FS_POINTS
    pdf, rows = pdf.sort_values(["ts", "n_fs"], kind="stable"), []
    for i, n in enumerate(pdf["n_fs"].tolist()):
        points = INSTANCE_POINTS + FS_POINTS * n
        if points > most:
            batch += used > 0
            cuts = [0, *range(with_instance, n, without), n]
            rows += [(i, a, b - a, a == 0, batch + k) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
            batch, used = batch + len(cuts) - 1, 0
            continue
        if used + points > most:
            batch, used = batch + 1, 0
        used += points
        rows.append((i, 0, n, True, batch))
    out = pd.DataFrame(rows, columns=["at", "fs_from", "fs_count", "with_instance", "batch"])
    return pd.concat([pdf[[*keys, "ts"]].iloc[out["at"]].reset_index(drop=True), out.drop(columns="at")], axis=1)


def pack_batches(snapshots: DataFrame, keys: list[str], most: int = MOST_POINTS) -> DataFrame:
    """(keys, ts, fs_from, fs_count, with_instance, batch): snapshots in time order, each of INSTANCE_POINTS + FS_POINTS * n_fs points, put greedily into calls of at most `most` points.

    A snapshot over the budget alone first closes the open call; it is split so that the first call holds the instance, and further ones only filesystems.
    snapshots: keys, ts, n_fs. A sequential rule, so one key is one group: apply retain() first, which leaves 48 hours' worth.
    """
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return packed(pdf, keys, most)

    rows = snapshots.select(*keys, F.col("ts").cast("double").alias("ts"), F.col("n_fs").cast("long").alias("n_fs"))
    kept = T.StructType(rows.drop("n_fs").schema.fields).add("fs_from", "long").add("fs_count", "long").add("with_instance", "boolean").add("batch", "long")
    return rows.groupBy(*keys).applyInPandas(pack, kept)
