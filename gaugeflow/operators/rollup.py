"""Roll-ups for export and the positions of named readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.scalars import frame_id, is_numeric, mean_of
from gaugeflow.model import INTEGER_KINDS, K


def chop_incomplete(records: DataFrame, span: float, most_frames: int | None = None) -> DataFrame:
    """Without the newest frame of each timestamp group, and of the others the first `most_frames`."""
    out = records.withColumn("frame", frame_id("ts", span))
    out = out.withColumn("_last", F.max("frame").over(Window.partitionBy(*K, "group_id"))).where("frame < _last")
    if most_frames is not None:
        w = Window.partitionBy(*K, "group_id").orderBy("frame")
        out = out.withColumn("_rank", F.dense_rank().over(w)).where(F.col("_rank") <= most_frames).drop("_rank")
    return out.drop("_last")


def rollup(records: DataFrame, span: float, keys: Sequence[str] = ("path",), most_frames: int | None = None) -> DataFrame:
    """(endpoint, keys, ts, kind, value, value_string) for each complete frame of dense records.

    Numbers average, whole kinds round half up; other kinds, bool too, take the first value. The kind is that of the frame's first record; inactive
    records do not count. records: value (double) and value_string.
    """
    cut = chop_incomplete(records, span, most_frames).where("active").withColumn("numeric", is_numeric("kind"))
    first = F.min_by(F.struct("kind", "value", "value_string"), "ts")
    out = cut.groupBy(*K, *keys, "numeric", "frame").agg(first.alias("f"), mean_of("value", "kind").alias("mean"))
    mean = F.when(F.col("f.kind").isin(*INTEGER_KINDS), F.floor(F.col("mean") + 0.5).cast("double")).otherwise(F.col("mean"))
    return out.select(*K, *keys, F.col("frame").alias("ts"), "f.kind", F.when(F.col("numeric"), mean).otherwise(F.col("f.value")).alias("value"), F.when(~F.col("numeric"), F.col("f.value_string")).alias("value_string"))


def unread(records: DataFrame, progress: DataFrame, reader: str) -> DataFrame:
    """Records that a named reader has not been handed yet; progress: reader, host_name, app_name, group_id, position."""
    own = progress.where(F.col("reader") == reader).select(*K, "group_id", "position")
    return records.join(own, [*K, "group_id"], "left").where("position is null or ts > position").drop("position")


def reader_progress(group_ts: DataFrame, progress: DataFrame, reader: str) -> DataFrame:
    """(endpoint, seconds_left, percent, skipped): the largest lag of a group, the mean share of its span that is caught up, and whether a position lies before all that is kept."""
    own = progress.where(F.col("reader") == reader).select(*K, "group_id", "position")
    g = group_ts.join(own, [*K, "group_id"], "left").groupBy(*K, "group_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.max("position").alias("position"), F.min(F.when(F.col("position").isNull() | (F.col("ts") > F.col("position")), F.col("ts"))).alias("pending"))
    left = F.col("hi") - F.coalesce(F.least("position", "hi"), F.col("lo"))
    percent = F.coalesce(F.try_divide((F.coalesce("pending", "hi") - F.col("lo")) * 100, F.col("hi") - F.col("lo")), F.lit(100.0))
    return g.groupBy(*K).agg(F.max(left).alias("seconds_left"), F.avg(percent).alias("percent"), F.bool_or(F.coalesce(F.col("position") < F.col("lo"), F.lit(False))).alias("skipped"))


def commit(progress: DataFrame, reader: str, written: DataFrame) -> DataFrame:
    """The progress table after a successful write of `written`: each group's position is the newest timestamp handed out."""
    new = written.groupBy(*K, "group_id").agg(F.max("ts").alias("position")).select(F.lit(reader).alias("reader"), *K, "group_id", "position")
    return progress.unionByName(new).groupBy("reader", *K, "group_id").agg(F.max("position").alias("position"))


def start_at_beginning(progress: DataFrame, reader: str) -> DataFrame:
    """The progress table without the reader's positions."""
    return progress.where(F.col("reader") != reader)


def copy_position(progress: DataFrame, source: str, target: str) -> DataFrame:
    """The progress table with the target reader where the source stands."""
    return start_at_beginning(progress, target).unionByName(progress.where(F.col("reader") == source).withColumn("reader", F.lit(target)))
