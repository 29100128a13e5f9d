"""Algebra of result sets: rows (name, tags map<string,string>, ts, value)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tags_key(tags: Column | str = "tags") -> Column:
    """A string of the sorted tags: maps cannot be join, sort or window keys."""
    entries = F.array_sort(F.map_entries(F.col(tags) if isinstance(tags, str) else tags))
    return F.coalesce(F.to_json(entries), F.lit("[]"))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_tags", tags_key())


def _union(dfs: tuple[DataFrame, ...]) -> DataFrame:
    columns = [set(d.columns) for d in dfs]
    if any(c != columns[0] for c in columns):
        raise ValueError("result sets with differing columns")
    return reduce(DataFrame.unionByName, [d.withColumn("_src", F.lit(i)) for i, d in enumerate(dfs)])


def merge_series(*dfs: DataFrame) -> DataFrame:
    """All rows; of rows with equal name, tags and time, that of the last listed set."""
    both = _keyed(_union(dfs))
    w = Window.partitionBy("name", "_tags", "ts").orderBy(F.desc("_src"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*dfs[0].columns)


def sum_series(*dfs: DataFrame) -> DataFrame:
    """Point-wise sums: a lone point passes, a point with a null among its partners is null. One shuffle, no outer join."""
    both = _keyed(_union(dfs))
    total = F.when(F.count("value") == F.count(F.lit(1)), F.sum("value"))
    return both.groupBy("name", "_tags", "ts").agg(F.any_value("tags").alias("tags"), total.alias("value")).select("name", "tags", "ts", "value")


def divide_series(lhs: DataFrame | Sequence[DataFrame], rhs: DataFrame) -> DataFrame:
    """Point-wise lhs / rhs of matching points; null if either is null or the divisor is 0. Of a series that several sets of lhs have, the last listed one counts."""
    left = _keyed(lhs) if isinstance(lhs, DataFrame) else _last_series(lhs)
    right = _keyed(rhs).select("name", "_tags", "ts", F.col("value").alias("_r"))
    return left.join(right, ["name", "_tags", "ts"]).select("name", "tags", "ts", F.try_divide("value", "_r").alias("value"))


def _last_series(dfs: Sequence[DataFrame]) -> DataFrame:
    """The rows of each series from the last set that has it."""
    both = _keyed(_union(tuple(dfs)))
    last = both.groupBy("name", "_tags").agg(F.max("_src").alias("_src"))
    return both.join(last, ["name", "_tags", "_src"], "left_semi").drop("_src")


def merge_means(sums: list[DataFrame], counts: list[DataFrame]) -> DataFrame:
    """Means over shards: the sum of the shards' sums over the sum of their counts."""
    return divide_series(sum_series(*sums), sum_series(*counts))


def merge_preferred(original: DataFrame, preferred: DataFrame) -> DataFrame:
    """Each series of the original up to the preferred one's first point that is neither null nor 0, and the preferred one from there on.

    A preferred series without such a point leaves the original as it is; series on one side only pass whole. Sets without name, tags, ts and value give the original.
    """
    if not {"name", "tags", "ts", "value"} <= set(preferred.columns) & set(original.columns):
        return original
    o, p = _keyed(original), _keyed(preferred)
    key = ["name", "_tags"]
    cuts = p.groupBy(*key).agg(F.min(F.when(F.col("value") != 0, F.col("ts"))).alias("_cut"))
    head = o.join(cuts, key, "left").where("_cut is null or ts < _cut")
    known = o.select(*key).distinct().withColumn("_both", F.lit(True))
    tail = p.join(cuts, key).join(known, key, "left").where("_both is null or ts >= _cut")
    columns = ["name", "tags", "ts", "value"]
    return head.select(*columns).unionByName(tail.select(*columns))


def order_series(df: DataFrame) -> DataFrame:
    """By name, then sorted tag keys and values, then time."""
    return df.orderBy("name", F.array_sort(F.map_entries("tags")), "ts")
