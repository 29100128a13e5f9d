"""Application discovery and package inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.scalars import json_text
from gaugeflow.model import INTEGER_KINDS, K


def discover_apps(obs: DataFrame, has_metrics: str) -> DataFrame:
    """(host_name, batch_seq, name, port, use_tls) of /health-checks/<name> entries whose flag `has_metrics` (its name) is true and that give a whole port number; TLS is off by default."""
    p = F.split("path", "/")
    own = obs.where(F.col("path").startswith("/health-checks/")).withColumn("name", F.element_at(p, 3)).withColumn("leaf", F.array_join(F.slice(p, 4, 99), "/"))

    def pick(leaf: str, good: Column, column: str) -> Column:
        return F.max(F.when((F.col("leaf") == leaf) & good, F.col(column)))

    whole, flag = F.col("kind").isin(*INTEGER_KINDS), F.col("kind") == "bool"
    out = own.groupBy("host_name", "batch_seq", "name").agg(
        pick(has_metrics, flag, "value_bool").alias("has"), pick("port-number", whole, "value_long").alias("port"), pick("use-tls", flag, "value_bool").alias("tls")
    )
    return out.where("has and port is not null").select("host_name", "batch_seq", "name", "port", F.coalesce("tls", F.lit(False)).alias("use_tls"))


def package_inventory(obs: DataFrame, instance_id: str | None = None) -> DataFrame:
    """(endpoint, batch_seq, instance_id, mgmt, ts, packages array<struct<name,version,size>>) from /sys/packages/<mgmt>/<name>/<size|version>.

    The first management type only; a size must be uint64 and a version a string, else the field is empty. ts is that of the first row. The
    instance id is given or that of /sys/cloud/aws/instance-id; batches without one are left out.
    """
    batch = [*K, "batch_seq"]
    p = F.split(F.expr("substring(path, 15)"), "/")
    rows = obs.where(F.col("path").startswith("/sys/packages/")).withColumn("_p", p).where(F.size("_p") == 3)
    rows = rows.select(*batch, "ts", "kind", "value_long", "value_string", F.get("_p", 0).alias("mgmt"), F.get("_p", 1).alias("name"), F.get("_p", 2).alias("leaf"), "path")
    rows = rows.withColumn("_first", F.min("mgmt").over(Window.partitionBy(*batch))).where("mgmt = _first")
    one = rows.groupBy(*batch, "mgmt", "name").agg(
        F.max(F.when((F.col("leaf") == "version") & (F.col("kind") == "string"), F.col("value_string"))).alias("version"),
        F.max(F.when((F.col("leaf") == "size") & (F.col("kind") == "uint64"), F.col("value_long"))).alias("size"),
        F.min_by("ts", "path").alias("ts"),
    )
    out = one.groupBy(*batch, "mgmt").agg(F.min_by("ts", "name").alias("ts"), F.array_sort(F.collect_list(F.struct("name", F.coalesce("version", F.lit("")).alias("version"), F.coalesce("size", F.lit(0)).alias("size")))).alias("packages"))
    if instance_id is not None:
        return out.withColumn("instance_id", F.lit(instance_id))
    ids = obs.where((F.col("path") == "/sys/cloud/aws/instance-id") & (F.col("kind") == "string")).groupBy(*batch).agg(F.max("value_string").alias("instance_id"))
    return out.join(ids, batch)


def changed_inventories(inventories: DataFrame) -> DataFrame:
    """Inventories (instance_id, ts, packages) that differ from the instance's previous one."""
    before = F.lag("packages").over(Window.partitionBy("instance_id").orderBy("ts"))
    return inventories.withColumn("_before", before).where(~F.col("packages").eqNullSafe(F.col("_before"))).drop("_before")


def newest_pending(inventories: DataFrame) -> DataFrame:
    """One inventory of each instance, the newest: what a queue that keeps one entry for each key hands out."""
    return inventories.groupBy("instance_id").agg(F.max_by("packages", "ts").alias("packages"), F.max("ts").alias("ts"))


def inventory_to_json(inventories: DataFrame) -> DataFrame:
    """(instance_id, body): {"pkgMgmtType":…,"installed":{name with _ for .:{version,size}}}."""
    entry = lambda p: F.struct(F.replace(p["name"], F.lit("."), F.lit("_")).alias("key"), F.struct(p["version"].alias("version"), p["size"].alias("size")).alias("value"))
    body = F.to_json(F.struct(F.col("mgmt").alias("pkgMgmtType"), F.map_from_entries(F.transform("packages", entry)).alias("installed")))
    return inventories.select("instance_id", body.alias("body"))


def bulk_json(bodies: DataFrame, by: list[str]) -> DataFrame:
    """(by, body): one object of instance id to inventory for each group of calls."""
    pairs = F.array_sort(F.collect_list(F.struct("instance_id", "body")))
    entry = lambda p: F.concat(json_text(p["instance_id"]), F.lit(":"), p["body"])
    return bodies.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(F.transform(pairs, entry), ","), F.lit("}")).alias("body"))
