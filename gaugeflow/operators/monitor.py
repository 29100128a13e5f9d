"""Monitoring of the pipeline itself: names, counts, histograms and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.scalars import is_numeric, tsdb_escape
from gaugeflow.model import K
from gaugeflow.sources.shared import scratch


def distinct_names(obs: DataFrame) -> DataFrame:
    """(type, name): escaped numeric metric paths (metrics), and hosts and ip addresses (tagv)."""
    metrics = obs.where(is_numeric("kind")).select("path").distinct().select(F.lit("metrics").alias("type"), tsdb_escape("path").alias("name"))
    hosts = obs.select(F.col("host_name").alias("name")).distinct()
    if "ip_address" in obs.columns:
        hosts = hosts.unionByName(obs.select(F.col("ip_address").alias("name")).where("name <> ''").distinct()).distinct()
    return metrics.unionByName(hosts.select(F.lit("tagv").alias("type"), tsdb_escape("name").alias("name")))


def suggest(names: DataFrame, prefix: str, most: int = 25) -> DataFrame:
    """The first `most` (0 or less: all) distinct names that start with the prefix, sorted."""
    out = names.where(F.col("name").startswith(prefix)).select("name").distinct().orderBy("name")
    return out.limit(most) if most > 0 else out


def earliest(series: DataFrame, path: str) -> DataFrame:
    """One row: the largest earliest valid time of the path's series, 0 if there is none; series: path, earliest."""
    return series.where(F.col("path") == path).agg(F.coalesce(F.max("earliest"), F.lit(0.0)).alias("earliest"))


def writer_counts(log: DataFrame) -> DataFrame:
    """(writer, total, written, skipped, not_written, success_ratio); log: writer, to_write, written, skipped, ok."""
    out = log.groupBy("writer").agg(F.sum("to_write").alias("total"), F.sum("written").alias("written"), F.sum("skipped").alias("skipped"), F.count_if("ok").alias("_ok"), F.count(F.lit(1)).alias("_n"))
    return out.select("writer", "total", "written", "skipped", F.greatest(F.lit(0), F.col("total") - F.col("skipped") - F.col("written")).alias("not_written"), F.coalesce(F.try_divide("_ok", "_n"), F.lit(0.0)).alias("success_ratio"))


def writer_metrics(log: DataFrame) -> DataFrame:
    """(writer, attempts, successes, failures, values_written, last_error, last_error_ts, last_success_ts, total_seconds); log: writer, ts, error (null: success), written, seconds."""
    bad = F.col("error").isNotNull()
    return log.groupBy("writer").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(~bad).alias("successes"),
        F.count_if(bad).alias("failures"),
        F.coalesce(F.sum(F.when(~bad, F.col("written"))), F.lit(0)).alias("values_written"),
        F.max_by("error", F.when(bad, F.col("ts"))).alias("last_error"),
        F.max(F.when(bad, F.col("ts"))).alias("last_error_ts"),
        F.max(F.when(~bad, F.col("ts"))).alias("last_success_ts"),
        F.sum("seconds").alias("total_seconds"),
    )


def histogram(df: DataFrame, column: str, limits: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, bucket, n): values counted by how many of the ascending upper limits they reach."""
    bucket = F.size(F.filter(F.array(*[F.lit(float(x)) for x in limits]), lambda x: x <= F.col(column)))
    return df.where(F.col(column).isNotNull()).groupBy(*(by or []), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def dist_rollover(samples: DataFrame) -> DataFrame:
    """Adds roll_over_count to samples (endpoint, path, ts, dist): 1 at first, one more whenever the bucket limits change or the generation falls."""
    w = Window.partitionBy(*K, "path").orderBy("ts")
    before = F.lag("dist").over(w)
    turn = before.isNull() | ~before["upper_limits"].eqNullSafe(F.col("dist")["upper_limits"]) | (F.col("dist")["generation"] < before["generation"])
    return samples.withColumn("_turn", turn.cast("int")).withColumn("roll_over_count", F.sum("_turn").over(w)).drop("_turn")


def limit_records(records: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """At most n records (0 or less: all) of each consumer key, in order."""
    if n <= 0:
        return records
    w = Window.partitionBy(*keys).orderBy(*order)
    return records.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def lease_filter(records: DataFrame, leases: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """(records inside the owner's leases [start, end), one row with the number of records outside that a later lease follows).

    A time is inside if the largest end of the leases that start by then is after it. Distinct times and starts are dealt by ranges,
    each range takes over the largest end of those before it; the ranges are written to the shared folder. Leases
    without a start or an end are left out.
    """
    own = leases.where(F.col("owner") == owner).select(F.col("start").cast("double").alias("t"), F.col("end").cast("double").alias("end")).dropna()
    last = own.agg(F.max("t")).first()[0]
    times = records.select(F.col("ts").cast("double").alias("t"), F.lit(None).cast("double").alias("end")).dropna(subset=["t"]).distinct()
    # One row for each time, so that a common one weighs no more than others in its range.
    points = own.unionByName(times).groupBy("t").agg(F.max("end").alias("end"))
    path = scratch(records.sparkSession, "leases")
    points.repartitionByRange("t").withColumn("part", F.spark_partition_id()).write.parquet(path)
    points = records.sparkSession.read.schema("t double, end double, part int").parquet(path)
    # One row a range: small, whatever the number of leases.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = points.groupBy("part").agg(F.max("end").alias("top")).select("part", F.max("top").over(before).alias("earlier"))
    so_far = F.max("end").over(Window.partitionBy("part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    inside = points.select("part", "t", so_far.alias("reach")).join(parts, "part").where(F.greatest("reach", "earlier") > F.col("t")).select(F.col("t").alias("_t"))
    timed = records.withColumn("_t", F.col("ts").cast("double"))
    skipped = timed.where(F.col("_t") < F.lit(last).cast("double")).join(inside, "_t", "left_anti").agg(F.count(F.lit(1)).alias("skipped"))
    return timed.join(inside, "_t", "left_semi").drop("_t"), skipped
