"""Change-compressed series: ingest rules, as-of densifying, latest and historical values.

Rows of records: endpoint (host_name, app_name), path, group_id, ts, value columns, active. All windows
partition by a key that starts with the endpoint, so that one exchange on it serves the ingest steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.scalars import under_path
from gaugeflow.model import K, NUMERIC_KINDS

SERIES = [*K, "path", "group_id"]
#: An inactive marker of an absent group stands this many seconds after the last value.
MARKER_GAP = 0.001


def default_group_ts(obs: DataFrame) -> DataFrame:
    """ts of every value of a group: the group's own timestamp in that batch, else the collector's (batch_ts)."""
    own = F.max("ts").over(Window.partitionBy(*K, "batch_seq", "group_id"))
    return obs.withColumn("ts", F.coalesce(own, F.col("batch_ts")))


def drop_late(obs: DataFrame, keep_first: bool = True) -> DataFrame:
    """Leaves out a batch's group values unless its timestamp exceeds all earlier ones of the group; a metric's very first value may stay."""
    before = Window.partitionBy(*K, "group_id").orderBy("batch_seq").rangeBetween(Window.unboundedPreceding, -1)
    out = obs.withColumn("_max", F.max("ts").over(before))
    keep = F.col("_max").isNull() | (F.col("ts") > F.col("_max"))
    if keep_first:
        out = out.withColumn("_first", F.min("batch_seq").over(Window.partitionBy(*SERIES)))
        keep |= F.col("batch_seq") == F.col("_first")
    return out.where(keep).drop("_max", "_first")


def mark_inactive(obs: DataFrame) -> DataFrame:
    """Markers (series, ts): a metric missing from the endpoint's next batch is inactive from the group's new timestamp, or, if its whole group is absent, MARKER_GAP after its last value. One marker for each outage."""
    batches = obs.select(*K, "batch_seq").distinct().withColumn("next_batch", F.lead("batch_seq").over(Window.partitionBy(*K).orderBy("batch_seq")))
    groups = obs.groupBy(*K, F.col("batch_seq").alias("next_batch"), "group_id").agg(F.max("ts").alias("next_ts"))
    own = obs.withColumn("own_next", F.lead("batch_seq").over(Window.partitionBy(*SERIES).orderBy("batch_seq")))
    gone = own.join(batches, [*K, "batch_seq"]).where("next_batch is not null and (own_next is null or own_next > next_batch)")
    return gone.join(groups, [*K, "next_batch", "group_id"], "left").select(*SERIES, F.coalesce("next_ts", F.col("ts") + MARKER_GAP).alias("ts"))


def inactivate_endpoints(records: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Markers (series, ts) for all series of endpoints that went inactive: MARKER_GAP after each group's last timestamp, whatever the time of the change."""
    last = records.join(endpoints.select(*K), K, "left_semi").withColumn("_last", F.max("ts").over(Window.partitionBy(*K, "group_id")))
    newest = last.groupBy(*SERIES).agg(F.max_by("active", "ts").alias("active"), F.max("_last").alias("_last")).where("active")
    return newest.select(*SERIES, (F.col("_last") + MARKER_GAP).alias("ts"))


def compress_changes(records: DataFrame, values: Sequence[str] = ("value",), keys: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """Keeps a row only if its values or its active flag differ from the series' previous row (lists and structs compare by content)."""
    w = Window.partitionBy(*keys).orderBy("ts")
    cols = [*values, *(["active"] if "active" in records.columns else [])]
    changed = F.row_number().over(w) == 1
    for c in cols:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return records.withColumn("_changed", changed).where("_changed").drop("_changed")


def densify(changes: DataFrame, group_ts: DataFrame, values: Sequence[str] = ("value",)) -> DataFrame:
    """(series, ts, values, active) at every timestamp of the metric's group: the last change at or before it; nothing before the first. Inactive markers count as timestamps of their series."""
    series = changes.groupBy(*SERIES).agg(F.min("ts").alias("_first"))
    times = series.join(group_ts.select(*K, "group_id", "ts"), [*K, "group_id"]).where("ts >= _first").select(*SERIES, "ts", F.lit(None).cast("boolean").alias("_change"))
    marks = changes.where("not active").select(*SERIES, "ts", F.lit(None).cast("boolean").alias("_change"))
    times = times.unionByName(marks).distinct()
    state = F.struct(*values, "active")
    both = times.select("*", F.lit(None).cast(changes.select(state.alias("s")).schema["s"].dataType).alias("_s")).unionByName(changes.select(*SERIES, "ts", F.lit(True).alias("_change"), state.alias("_s")))
    w = Window.partitionBy(*SERIES).orderBy("ts", F.col("_change").desc_nulls_last())
    dense = both.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_change is null")
    return dense.select(*SERIES, "ts", "_s.*")


def history(changes: DataFrame, start: float, end: float, keys: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """Changes inside (start, end) and the last one at or before the start.

    The range is a plain filter; the earlier history is an aggregate of one row a series, which tasks combine before the shuffle.
    """
    before = changes.where((F.col("ts") <= start) & (F.col("ts") < end))
    last = before.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), "ts").alias("_last")).select("_last.*")
    return changes.where((F.col("ts") > start) & (F.col("ts") < end)).unionByName(last)


def latest(records: DataFrame, keys: Sequence[str | Column] = (*K, "path"), values: Sequence[str] = ("value",)) -> DataFrame:
    """(keys, ts, values) of the newest record of each key, if it is active. An aggregate, so that each task sends one row for each key."""
    best = F.max_by(F.struct("ts", "active", *values), F.struct("ts", "active"))
    return records.groupBy(*keys).agg(best.alias("_b")).select("*", "_b.*").drop("_b").where("active").drop("active")


def merge_grouped(records: DataFrame, keys: Sequence[str] = (*K, "path")) -> DataFrame:
    """The series of one grouping key as one: of rows with one timestamp, an active one is taken."""
    w = Window.partitionBy(*keys, "ts").orderBy(F.col("active").desc(), "group_id")
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def numeric_series(changes: DataFrame, group_ts: DataFrame, path: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """(endpoint, path, ts, value) of all numeric kinds of a path: dense, merged, active rows only."""
    own = changes.where((F.col("path") == path) & F.col("kind").isin(*NUMERIC_KINDS))
    dense = merge_grouped(densify(own, group_ts)).where("active").select(*K, "path", "ts", F.col("value").cast("double").alias("value"))
    if start is not None:
        dense = dense.where(F.col("ts") >= start)
    return dense if end is None else dense.where(F.col("ts") < end)


def select_paths(records: DataFrame, path: str, singleton: bool = False, keys: Sequence[str] = tuple(K)) -> DataFrame:
    """Rows of exactly the path; for endpoints without any, and unless `singleton`, all below it."""
    if singleton:
        return records.where(F.col("path") == path)
    own = records.where(under_path("path", path))
    exact = F.max((F.col("path") == path).cast("int")).over(Window.partitionBy(*keys))
    return own.withColumn("_exact", exact).where((F.col("_exact") == 0) | (F.col("path") == path)).drop("_exact")


def verify_batches(obs: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Violations (endpoint, batch_seq, violation, path): unsorted or duplicate paths, unsupported kinds, more than one timestamp in a group. obs has `seq`, the place in the batch."""
    batch = [*K, "batch_seq"]
    key = F.split(F.regexp_replace("path", "^/", ""), "/")
    w = Window.partitionBy(*batch).orderBy("seq")
    marked = obs.withColumn("_key", key).withColumn("_before", F.lag(key).over(w))
    unsorted = marked.where("_key < _before").select(*batch, F.lit("unsorted").alias("violation"), "path")
    duplicate = obs.groupBy(*batch, "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*batch, F.lit("duplicate").alias("violation"), "path")
    kind = obs.where(~F.col("kind").isin(*kinds) | F.col("kind").isNull()).select(*batch, F.lit("kind").alias("violation"), "path")
    times = obs.where("ts is not null").groupBy(*batch, "group_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.min("path").alias("path")).where("lo < hi").select(*batch, F.lit("timestamps").alias("violation"), "path")
    return unsorted.unionByName(duplicate).unionByName(kind).unionByName(times)
