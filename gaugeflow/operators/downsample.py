"""Downsampling, fill policies, aggregation across series, and rates.

Series points are long rows (series keys, ts double, value double). Every step works on at most
1000 buckets for each series or group: the first aggregation shrinks the data, and map-side partial
aggregation shrinks what is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.params import Buckets
from gaugeflow.operators.mergeable import MergeableStates

#: Aggregators by name: column function or mergeable states, value of no input or None, default fill.
AGGREGATORS: dict[str, tuple[Callable[[Column], Column] | MergeableStates, float | None, str]] = {
    "avg": (F.avg, None, "none"),
    "count": (F.count, 0.0, "zero"),
    "max": (F.max, None, "none"),
    "min": (F.min, None, "none"),
    "sum": (F.sum, None, "none"),
}


def register_aggregator(name: str, function: Callable[[Column], Column], empty: float | None = None, default_fill: str = "none") -> None:
    """Adds an aggregator; `function` takes the value column and returns an aggregate (a grouped pandas UDF will do)."""
    AGGREGATORS[name] = (function, empty, default_fill)


def register_mergeable(name: str, states: MergeableStates, empty: float | None = None, default_fill: str = "none") -> None:
    """Adds an aggregator of a user's own code over partial states: each task sends one state for each group, and these are merged after the shuffle."""
    AGGREGATORS[name] = (states, empty, default_fill)


def aggregator(name: str) -> Callable[[Column], Column] | MergeableStates:
    if name not in AGGREGATORS:
        raise ValueError(f"no such aggregator: {name}; there are {', '.join(sorted(AGGREGATORS))}")
    return AGGREGATORS[name][0]


def combine(rows: DataFrame, keys: list[str], agg: str) -> DataFrame:
    """(keys, value): the aggregate of each group's values; nulls do not count."""
    function = aggregator(agg)
    if isinstance(function, MergeableStates):
        return function.aggregate(rows, keys)
    return rows.groupBy(*keys).agg(function(F.col("value")).cast("double").alias("value"))


def fill_policy(policy: str, agg: str) -> str:
    """A policy of "none" leaves it to the aggregator: interpolation, if that has no other default."""
    return AGGREGATORS[agg][2] if policy == "none" else policy


def downsample(points: DataFrame, keys: list[str], b: Buckets, agg: str = "avg") -> DataFrame:
    """(keys, idx, value): one row for each series and bucket with points."""
    cut = points.where((F.col("ts") >= b.clamp) & F.col("value").isNotNull()).withColumn("idx", b.index("ts"))
    cut = cut.where((F.col("idx") >= 0) & (F.col("idx") < b.size))
    return combine(cut, [*keys, "idx"], agg)


def grid(series: DataFrame, keys: list[str], b: Buckets) -> DataFrame:
    """Every bucket of every series."""
    if b.size == 0:
        return series.select(*keys, F.lit(0).cast("long").alias("idx")).limit(0)
    return series.select(*keys).distinct().withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b.size - 1).cast("long"))))


def interpolate(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Fills the buckets between two known ones of a series on the straight line; nothing before the first or after the last."""
    w = Window.partitionBy(*keys).orderBy("idx")
    gap = buckets.withColumn("_next", F.lead("idx").over(w)).withColumn("_to", F.lead("value").over(w))
    stop = F.coalesce(F.col("_next") - 1, F.col("idx"))
    out = gap.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), stop - F.col("idx"))))
    width = F.col("_next") - F.col("idx")
    value = F.when(F.col("_k") == 0, F.col("value")).otherwise((F.col("value") * (width - F.col("_k")) + F.col("_to") * F.col("_k")) / width)
    return out.select(*keys, (F.col("idx") + F.col("_k")).alias("idx"), value.alias("value"))


def fill(buckets: DataFrame, keys: list[str], b: Buckets, policy: str, agg: str = "avg", series: DataFrame | None = None) -> DataFrame:
    """Fills gaps: zero gives 0 in every bucket, also of series without points; nan and null leave gaps; none is the aggregator's own default, which interpolates if it has no other.

    After an aggregator with a value of no input (as a count has) no bucket is a gap: it has that value.
    """
    empty, policy = AGGREGATORS[agg][1], fill_policy(policy, agg)
    if policy == "zero" or empty is not None:
        every = grid(series if series is not None else buckets, keys, b)
        return every.join(buckets, [*keys, "idx"], "left").select(*keys, "idx", F.coalesce("value", F.lit(0.0 if empty is None else float(empty))).alias("value"))
    if policy in ("nan", "null"):
        return buckets
    return interpolate(buckets, keys)


def aggregate_series(filled: DataFrame, by: list[str], b: Buckets, agg: str = "avg", series: DataFrame | None = None) -> DataFrame:
    """(by, idx, value): all series of a group put together in each bucket. A count is 0 in the empty buckets of every group of `series`."""
    out = combine(filled, [*by, "idx"], agg)
    if AGGREGATORS[agg][1] is not None and series is not None:
        empty = AGGREGATORS[agg][1]
        out = grid(series, by, b).join(out, [*by, "idx"], "left").select(*by, "idx", F.coalesce("value", F.lit(empty)).alias("value"))
    return out


def aggregate_zero_filled(buckets: DataFrame, keys: list[str], by: list[str], b: Buckets, agg: str, series: DataFrame) -> DataFrame:
    """aggregate_series over zero-filled series without making their zeros: a group's missing series count as zeros arithmetically."""
    if agg not in ("avg", "count", "max", "min", "sum"):
        return aggregate_series(fill(buckets, keys, b, "zero", series=series), by, b, agg)
    # Without tags to group by, no series at all would still be one group.
    n = series.select(*keys).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    part = buckets.groupBy(*by, "idx").agg(F.count("value").alias("_m"), F.sum("value").alias("_sum"), F.max("value").alias("_max"), F.min("value").alias("_min"))
    every = grid(n, [*by, "_n"], b).join(part, [*by, "idx"], "left")
    total, missing = F.coalesce("_sum", F.lit(0.0)), F.coalesce("_m", F.lit(0)) < F.col("_n")
    value = {
        "avg": total / F.col("_n"),
        "sum": total,
        "count": F.col("_n").cast("double"),
        "max": F.when(missing, F.greatest(F.coalesce("_max", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("_max")),
        "min": F.when(missing, F.least(F.coalesce("_min", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("_min")),
    }[agg]
    return every.select(*by, "idx", value.alias("value"))


def rate(buckets: DataFrame, by: list[str], b: Buckets, counter: bool = False, counter_max: float = 0.0, reset: float = 0.0) -> DataFrame:
    """Change per second to the next bucket, gaps interpolated. A counter that falls has rolled over at its maximum; still negative or beyond the reset value: 0."""
    w = Window.partitionBy(*by).orderBy("idx")
    steps = buckets.withColumn("_n", F.lead("idx").over(w) - F.col("idx")).withColumn("_delta", (F.lead("value").over(w) - F.col("value")) / F.col("_n")).where("_n is not null")
    steps = steps.withColumn("idx", F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("_n") - 1)))
    r = F.col("_delta") / b.width
    if counter:
        r = F.when(F.col("_delta") < 0, (F.col("_delta") + counter_max) / b.width).otherwise(r)
        r = F.when(r < 0, 0.0).otherwise(r)
        if reset > 0:
            r = F.when(r > reset, 0.0).otherwise(r)
    return steps.select(*by, "idx", r.alias("value"))


def early_truncate(points: DataFrame, by: list[str], earliest: DataFrame) -> DataFrame:
    """Drops points (by, ts) before the largest `earliest` of the group's series; a group without one stays whole."""
    cut = earliest.groupBy(*by).agg(F.max("earliest").alias("_earliest")) if by else None
    if cut is None:
        w = earliest.agg(F.max("earliest").alias("_earliest")).first()[0]  # one number
        return points if w is None else points.where(F.col("ts") >= w)
    return points.join(cut, by, "left").where(F.col("_earliest").isNull() | (F.col("ts") >= F.col("_earliest"))).drop("_earliest")
