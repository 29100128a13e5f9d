"""The ordered rules of ingest over slices of hot endpoints: segmented scans instead of one window task for each series.

The windows of `operators.series` hold one series, or one endpoint's group, in one task. Where an endpoint has a large share of
all rows, `find_slices` cuts it along time (or the batch number) into slices of about equal numbers of rows. Every rule then runs in three steps:
each slice is summarised (its last value, its largest timestamp, its first batch), a window over the few summaries of a key carries these
to the next slices, and each slice is finished alone with what it was carried. Rows and results are those of the plain rules.

Keys (endpoint, path, group_id) are not null here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.model import K
from gaugeflow.operators.series import MARKER_GAP, SERIES

#: An endpoint with more than one PARTS-th of all rows is cut into so many slices, unless it has few rows anyway.
PARTS, FEW_ROWS = 128, 100_000
SLICE = "_slice"


@dataclass(frozen=True)
class Slices:
    """Where hot endpoints are cut along the column `order`; cuts: at most PARTS endpoints, each with at most PARTS - 1 bounds."""

    order: str
    cuts: DataFrame | None
    keys: Sequence[str] = tuple(K)

    def of(self, rows: DataFrame) -> DataFrame:
        """The rows with their slice's number; 0 for endpoints that are not cut."""
        if self.cuts is None:
            return rows.withColumn(SLICE, F.lit(0))
        # At most PARTS rows, so that a broadcast is bounded.
        return rows.join(F.broadcast(self.cuts), list(self.keys), "left").withColumn(SLICE, _slice(F.col(self.order))).drop("_bounds")

    def each(self, series: DataFrame, first: str) -> DataFrame:
        """Series with each slice of their endpoint from that of the value `first` on."""
        if self.cuts is None:
            return series.withColumn(SLICE, F.lit(0))
        last = F.coalesce(F.size("_bounds"), F.lit(0))
        own = series.join(F.broadcast(self.cuts), list(self.keys), "left")
        return own.withColumn(SLICE, F.explode(F.sequence(_slice(F.col(first)), F.when(F.col("_bounds").isNull(), 0).otherwise(last)))).drop("_bounds")


def _slice(value: Column) -> Column:
    return F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda b: b < value)))


def find_slices(rows: DataFrame, order: str = "ts", parts: int = PARTS, few: int = FEW_ROWS, keys: Sequence[str] = tuple(K)) -> Slices:
    """The cuts of endpoints (or other keys) with more than 1 / parts of the rows, of which there are fewer than `parts`: from counts, and quantiles of those endpoints alone.

    One pass over the keys, and one over the hot rows; all rules of an ingest can share them. The quantiles are approximate, which shapes
    the slices only.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    hot = counts.where((F.col("n") > total / parts) & (F.col("n") > few)).select(*keys).collect()  # fewer than `parts`
    if not hot:
        return Slices(order, None, keys)
    spark = rows.sparkSession
    own = F.broadcast(spark.createDataFrame(hot, rows.select(*keys).schema))
    shares = [k / parts for k in range(1, parts)]
    bounds = rows.join(own, list(keys), "left_semi").groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col(order).cast("double"), shares))).alias("_bounds"))
    return Slices(order, spark.createDataFrame(bounds.collect(), bounds.schema), keys)


def compress_changes(records: DataFrame, slices: Slices, values: Sequence[str] = ("value",), keys: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """series.compress_changes by slices along ts: a slice's first row is compared with the last one of the slice before."""
    part, rows = [*keys, SLICE], slices.of(records)
    cols = [*values, *(["active"] if "active" in records.columns else [])]
    state = F.struct(*cols)
    ends = rows.groupBy(*part).agg(F.max_by(state, "ts").alias("_end"))
    ends = ends.select(*part, F.lag("_end").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_carried"))
    before = F.coalesce(F.lag(state).over(Window.partitionBy(*part).orderBy("ts")), F.col("_carried"))
    out = rows.join(ends, part).withColumn("_before", before)
    changed = F.col("_before").isNull()
    for c in cols:
        changed = changed | ~F.col(c).eqNullSafe(F.col("_before")[c])
    return out.where(changed).select(*records.columns)


def drop_late(obs: DataFrame, slices: Slices, keep_first: bool = True) -> DataFrame:
    """series.drop_late by slices along batch_seq: each slice knows the largest timestamp of those before it."""
    group, rows = [*K, "group_id"], slices.of(obs)
    part = [*group, SLICE]
    before = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*part).agg(F.max("ts").alias("_top")).select(*part, F.max("_top").over(before).alias("_carried"))
    own = F.max("ts").over(Window.partitionBy(*part).orderBy("batch_seq").rangeBetween(Window.unboundedPreceding, -1))
    out = rows.join(tops, part).withColumn("_max", F.greatest(own, F.col("_carried")))
    keep = F.col("_max").isNull() | (F.col("ts") > F.col("_max"))
    if keep_first:
        first = obs.groupBy(*SERIES).agg(F.min("batch_seq").alias("batch_seq")).withColumn("_first", F.lit(True))
        out = out.join(first, [*SERIES, "batch_seq"], "left")
        keep |= F.col("_first").isNotNull()
    return out.where(keep).select(*obs.columns)


def _next_batch(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows with the key's next batch: the next one in the slice, or else the first of its next slice that has one."""
    part = [*keys, SLICE]
    heads = rows.groupBy(*part).agg(F.min("batch_seq").alias("_head"))
    heads = heads.select(*part, F.lead("_head").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_carried"))
    own = F.lead("batch_seq").over(Window.partitionBy(*part).orderBy("batch_seq"))
    return rows.join(heads, part).withColumn(name, F.coalesce(own, F.col("_carried"))).drop("_carried")


def mark_inactive(obs: DataFrame, slices: Slices) -> DataFrame:
    """series.mark_inactive by slices along batch_seq: the next batch of an endpoint or of a series may be the first of a later slice."""
    rows = slices.of(obs)
    batches = _next_batch(rows.select(*K, SLICE, "batch_seq").distinct(), K, "next_batch").drop(SLICE)
    groups = obs.groupBy(*K, F.col("batch_seq").alias("next_batch"), "group_id").agg(F.max("ts").alias("next_ts"))
    own = _next_batch(rows, SERIES, "own_next")
    gone = own.join(batches, [*K, "batch_seq"]).where("next_batch is not null and (own_next is null or own_next > next_batch)")
    return gone.join(groups, [*K, "next_batch", "group_id"], "left").select(*SERIES, F.coalesce("next_ts", F.col("ts") + MARKER_GAP).alias("ts"))


def densify(changes: DataFrame, group_ts: DataFrame, slices: Slices, values: Sequence[str] = ("value",)) -> DataFrame:
    """series.densify by slices along ts: each slice of a series starts from the state at the end of those before it."""
    part, state = [*SERIES, SLICE], F.struct(*values, "active")
    rows = slices.of(changes.select(*SERIES, "ts", *values, "active"))
    series = slices.each(changes.groupBy(*SERIES).agg(F.min("ts").alias("_first")), "_first")
    times = series.join(slices.of(group_ts.select(*K, "group_id", "ts")), [*K, "group_id", SLICE]).where("ts >= _first")
    empty = F.lit(None).cast("boolean").alias("_change")
    times = times.select(*part, "ts", empty).unionByName(rows.where("not active").select(*part, "ts", empty)).distinct()
    both = times.withColumn("_s", F.lit(None).cast(rows.select(state.alias("s")).schema["s"].dataType)).unionByName(rows.select(*part, "ts", F.lit(True).alias("_change"), state.alias("_s")))
    ends = rows.groupBy(*part).agg(F.max_by(state, "ts").alias("_end"))
    before = Window.partitionBy(*SERIES).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = series.join(ends, part, "left").select(*part, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    w = Window.partitionBy(*part).orderBy("ts", F.col("_change").desc_nulls_last())
    dense = both.join(carried, part).withColumn("_s", F.coalesce(F.last("_s", ignorenulls=True).over(w), F.col("_carried"))).where("_change is null")
    return dense.select(*SERIES, "ts", "_s.*")
