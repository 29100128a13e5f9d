"""Machines, applications and their activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.model import K

#: The agent that reports a host's health is always active.
HEALTH_AGENT = "health agent"


def with_tags(observations: DataFrame, endpoints: DataFrame, columns: tuple[str, ...] = ("region", "ip_address")) -> DataFrame:
    """Observations with columns of their endpoint; unknown endpoints get nulls. Spark broadcasts the table below its size threshold."""
    return observations.join(endpoints.select(*K, *columns), K, "left")


def diff_machines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(host_name, active, status): the machine table after a snapshot; old: host_name, active; new: host_name. status: added, returned, kept, removed or gone."""
    o, n = old.select("host_name", F.col("active").alias("_was")), new.select("host_name").distinct().withColumn("_now", F.lit(True))
    out = o.join(n, "host_name", "full_outer")
    status = F.when(F.col("_was").isNull(), "added").when(F.col("_now").isNull(), F.when(F.col("_was"), "removed").otherwise("gone")).otherwise(F.when(F.col("_was"), "kept").otherwise("returned"))
    return out.select("host_name", F.col("_now").isNotNull().alias("active"), status.alias("status"))


def host_reports(reports: DataFrame) -> DataFrame:
    """(host_name, seq_no, apps): the newest application list of each host, with a running number; lists of an older or equal number are ignored.

    reports: host_name, batch_seq (a number given by the source), apps array<struct<app_name,port,is_tls>>, in the order of arrival `arrival`.
    """
    best = F.max("batch_seq").over(Window.partitionBy("host_name").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    used = reports.withColumn("_best", best).where("_best is null or batch_seq > _best")
    return used.groupBy("host_name").agg(F.count(F.lit(1)).alias("seq_no"), F.max_by("apps", "batch_seq").alias("apps"))


def add_application(latest: DataFrame, extra: DataFrame) -> DataFrame:
    """host_reports with extra applications (host_name, app_name, port, is_tls) whose port is not listed yet; the number stays, 1 for a new host."""
    listed = latest.select("host_name", F.explode_outer("apps.port").alias("port"))
    new = extra.join(listed, ["host_name", "port"], "left_anti").groupBy("host_name").agg(F.array_sort(F.collect_list(F.struct("app_name", "port", "is_tls"))).alias("_more"))
    out = latest.join(new, "host_name", "full_outer")
    none = F.slice("_more", 1, 0)
    apps = F.concat(F.coalesce("apps", none), F.coalesce("_more", F.slice("apps", 1, 0)))
    return out.select("host_name", F.coalesce("seq_no", F.lit(1)).alias("seq_no"), apps.alias("apps"))


def app_activity(reports: DataFrame, listed: DataFrame, n: int = 3) -> DataFrame:
    """(host_name, seq_no, app_name, active): an application is inactive once it is missing from n reports in a row, and active again when listed.

    reports: host_name, seq_no (one row for each counted report); listed: host_name, seq_no, app_name. An application exists from its first report on.
    """
    numbered = reports.select("host_name", "seq_no").distinct().withColumn("_i", F.row_number().over(Window.partitionBy("host_name").orderBy("seq_no")))
    apps = listed.join(numbered, ["host_name", "seq_no"]).groupBy("host_name", "app_name").agg(F.min("_i").alias("_from"))
    every = apps.join(numbered, "host_name").where("_i >= _from")
    seen = every.join(listed.select("host_name", "seq_no", "app_name").distinct().withColumn("_here", F.lit(True)), ["host_name", "seq_no", "app_name"], "left")
    last = F.max(F.when(F.col("_here"), F.col("_i"))).over(Window.partitionBy("host_name", "app_name").orderBy("_i"))
    active = (F.col("_i") - last < max(n, 1)) | (F.col("app_name") == HEALTH_AGENT)
    return seen.withColumn("_active", active).select("host_name", "seq_no", "app_name", F.col("_active").alias("active"))


def endpoint_activity(machines: DataFrame, apps: DataFrame) -> DataFrame:
    """(endpoint, active): active if and only if machine and application are."""
    return apps.join(machines.select("host_name", F.col("active").alias("_host")), "host_name", "left").select(*K, (F.coalesce("_host", F.lit(False)) & F.col("active")).alias("active"))


def endpoint_summary(endpoints: DataFrame) -> DataFrame:
    """One row: total, active, failed (active and down) and up (active and not down); endpoints: host_active, app_active, down."""
    active = F.col("host_active") & F.col("app_active")
    return endpoints.agg(F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"), F.count_if(active & F.col("down")).alias("failed"), F.count_if(active & ~F.col("down")).alias("up"))


def changed_metric_stats(polls: DataFrame) -> DataFrame:
    """(endpoint, initial, average): changed metrics of the first poll, and the mean of later ones (0 if none); polls: endpoint, batch_seq, changed."""
    first = F.min("batch_seq").over(Window.partitionBy(*K))
    rows = polls.withColumn("_first", F.col("batch_seq") == first)
    return rows.groupBy(*K).agg(F.max(F.when(F.col("_first"), F.col("changed"))).alias("initial"), F.coalesce(F.avg(F.when(~F.col("_first"), F.col("changed"))), F.lit(0.0)).alias("average"))


#: State that ends each duration of a sweep (fixed values).
POLL_STATES = {"connecting": "wait_connect", "waiting_to_poll": "connect", "polling": "wait_poll", "synced": "poll"}


def poll_durations(states: DataFrame) -> DataFrame:
    """(endpoint, sweep, wait_connect, connect, wait_poll, poll, total): time since the previous state of the sweep; the total once it is synced. states: endpoint, sweep, state, ts."""
    w = Window.partitionBy(*K, "sweep").orderBy("ts")
    rows = states.withColumn("_d", F.col("ts") - F.lag("ts").over(w))
    out = rows.groupBy(*K, "sweep").agg(*[F.max(F.when(F.col("state") == s, F.col("_d"))).alias(name) for s, name in POLL_STATES.items()])
    total = F.col("wait_connect") + F.col("connect") + F.col("wait_poll") + F.col("poll")
    return out.withColumn("total", F.when(F.col("poll").isNotNull(), total))


def current_errors(results: DataFrame) -> DataFrame:
    """(endpoint, ts, error): the last error of each endpoint unless a later success cleared it, by host; results: endpoint, ts, error (null: success)."""
    last = results.groupBy(*K).agg(F.max("ts").alias("ts"), F.max_by("error", "ts").alias("error"))
    return last.where("error is not null").orderBy(*K)


def aws_policy(machines: DataFrame, test_mode: bool, default_seconds: float, tag: str = "HealthTest", period_tag: str = "AlarmPeriod") -> DataFrame:
    """Adds health_export, memory_only and alarm_period (seconds) from the machine's tag map.

    Health export is on if the test mode is that of the machine (it has the test tag or not), and nothing is exported else. Without the period tag the
    alarm period is the default, for memory only; a tag that is no duration or under a minute gives the default as well.
    """
    tags = F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>"))
    same = F.map_contains_key(tags, tag) == F.lit(test_mode)
    text = F.try_element_at(tags, F.lit(period_tag))
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)(?:h|m|s)"), F.lit(0))
    unit = lambda p: F.when(F.endswith(p, F.lit("h")), 3600.0).when(F.endswith(p, F.lit("m")), 60.0).otherwise(1.0)
    seconds = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.regexp_extract(p, "[0-9.]+", 0).cast("double") * unit(p))
    good = text.rlike(r"^(\d+(\.\d+)?[hms])+$") & (seconds >= 60)
    period = F.when(~same, 0.0).when(good, seconds).otherwise(F.lit(float(default_seconds)))
    return machines.select("*", same.alias("health_export"), (same & ~F.map_contains_key(tags, period_tag)).alias("memory_only"), period.alias("alarm_period"))


def hosts_matching(df: DataFrame, pattern: str, column: str | Column = "host_name") -> DataFrame:
    """Rows whose host matches the regular expression anywhere."""
    return df.where((F.col(column) if isinstance(column, str) else column).rlike(pattern))
