"""The driver's tables as observations, and the same adapters as SQL for the oracles."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.params import Buckets

START, DAYS, STEP = 1704067200, 29, 21600
END = START + DAYS * 86400
RANGE = Buckets(START, END, STEP)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(df: DataFrame, column: str = "ts") -> Column:
    """Epoch seconds of a timestamp column, with or without a time zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})") / 1e6
    return F.unix_micros(column) / 1e6


def events(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """host_name, app_name, batch_seq, ts, value, k, user_id; a range (whole seconds) is tested on the stored column, so that it reaches the Parquet scan."""
    e = table(spark, sf_dir, "events")
    if start is not None:
        kind = dict(e.dtypes)["ts"]
        at = lambda t: F.lit(datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") + ("" if kind == "timestamp_ntz" else "Z")).cast(kind)
        e = e.where((F.col("ts") >= at(start)) & (F.col("ts") < at(end)))
    return e.select(
        F.concat(F.lit("host"), "user_id").alias("host_name"),
        F.col("event_type").alias("app_name"),
        F.col("event_id").alias("batch_seq"),
        seconds(e).alias("ts"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "user_id",
    )


def points(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(endpoint, path, ts, value): /events/value, and /events/k where k is no multiple of 7. A branch for each path: a filter on the path leaves one of them."""
    e = events(spark, sf_dir, start, end)
    keys = ["host_name", "app_name", "batch_seq", "ts"]
    values = e.select(*keys, F.lit("/events/value").alias("path"), "value").where("value is not null")
    return values.unionByName(e.where("k % 7 <> 0").select(*keys, F.lit("/events/k").alias("path"), F.col("k").cast("double").alias("value")))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(endpoint, region, ip_address, user_id) of the endpoints that have events."""
    e = events(spark, sf_dir).select("host_name", "app_name", "user_id").distinct()
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("region"))
    ip = F.concat(F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.col("user_id") % 256)
    return e.join(places, e.user_id % 25 == F.col("n_nationkey")).select("host_name", "app_name", "region", ip.alias("ip_address"), "user_id")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records (endpoint, path, group_id, ts, value, active) of /events/level = floor(value / 25), inactive where k is a multiple of 7."""
    return events(spark, sf_dir).select(
        "host_name", "app_name", F.lit("/events/level").alias("path"), F.lit(0).alias("group_id"), "batch_seq", "ts", F.when(F.col("k") % 7 != 0, F.floor(F.col("value") / 25).cast("double")).otherwise(0.0).alias("value"), (F.col("k") % 7 != 0).alias("active")
    )


#: Common table expressions of the oracles.
EV = """ev AS (SELECT 'host' || user_id AS host_name, event_type AS app_name, event_id AS batch_seq, epoch_us(ts) / 1e6 AS ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id FROM events)"""
PTS = EV + """, pts AS (SELECT host_name, app_name, batch_seq, ts, '/events/value' AS path, value FROM ev UNION ALL SELECT host_name, app_name, batch_seq, ts, '/events/k', k::DOUBLE FROM ev WHERE k % 7 <> 0)"""
EP = """ep AS (SELECT DISTINCT host_name, app_name, r_name AS region, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip_address, user_id FROM ev JOIN nation ON user_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LV = """lv AS (SELECT host_name, app_name, '/events/level' AS path, 0 AS group_id, batch_seq, ts, CASE WHEN k % 7 <> 0 THEN floor(value / 25) ELSE 0 END AS value, k % 7 <> 0 AS active FROM ev)"""
#: Series points in their bucket, and the buckets of a series (avg).
BK = f"""bk AS (SELECT *, (CAST(floor(ts) AS BIGINT) - ({RANGE.first})) // {RANGE.width} AS idx FROM pts WHERE path = '/events/value' AND ts >= {RANGE.clamp} AND ts >= {START} AND ts < {END}),
ds AS (SELECT host_name, app_name, idx, avg(value) AS value FROM bk WHERE idx >= 0 AND idx < {RANGE.size} GROUP BY ALL)"""
LABEL = f"({RANGE.first + RANGE.width // 2} + idx * {RANGE.width})"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison: sums differ in their last digits by the order of addition. The small addend keeps exact halves off the rounding's edge."""
    return df.withColumns({c: F.round(F.col(c) + (1e-9 if digits < 9 else 0), digits) for c in columns})
