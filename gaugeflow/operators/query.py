"""Metric queries: filters, the full query, and the shapes of its results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.params import Buckets
from gaugeflow.functions.scalars import json_number, literal_or, tsdb_escape
from gaugeflow.model import K
from gaugeflow.operators import downsample as D

TAGS = {"host": "host_name", "app": "app_name", "region": "region", "ip": "ip_address"}


class UnknownMetric(LookupError):
    """No endpoint has a numeric series of that path (which differs from an empty result)."""


@dataclass(frozen=True)
class Query:
    """One metric query. inner and fill are of the downsampling, outer of the aggregation across series; filters are "a|b" lists."""

    path: str
    start: float
    end: float
    step: float
    outer: str = "avg"
    inner: str = "avg"
    fill: str = "none"
    by: tuple[str, ...] = ()
    filters: dict[str, str] = field(default_factory=dict)
    rate: bool = False
    counter: bool = False
    counter_max: float = 0.0
    reset: float = 0.0


#: (across series, in series) of the aggregate names of the other query language.
INFLUX_AGGREGATES = {"mean": ("avg", "avg"), "sum": ("sum", "sum"), "count": ("sum", "count"), "ecount": ("count", "avg"), "esum": ("sum", "avg"), "min": ("min", "min"), "max": ("max", "max")}


def filter_endpoints(df: DataFrame, **filters: str | Column) -> DataFrame:
    """Rows that pass all filters; host, app, region and ip take "a|b" lists or a predicate column."""
    for tag, spec in filters.items():
        df = df.where(literal_or(TAGS[tag], spec) if isinstance(spec, str) else spec)
    return df


def time_range(df: DataFrame, start: float, end: float, column: str = "ts") -> DataFrame:
    """start <= ts < end."""
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def query_parts(points: DataFrame, endpoints: DataFrame, q: Query, series: DataFrame | None = None) -> DataFrame:
    """Rows (host_name, app_name, region, ip_address, ts, value) of a query; tags that it does not group by are "".

    points: host_name, app_name, path, ts, value (numeric, active, dense); endpoints: the tags of each endpoint. series: the
    endpoints (host_name, app_name) that have the metric at all, which zero fill and counts need. Without it they are taken from the
    points, so that these must reach beyond the range then.
    """
    own = filter_endpoints(endpoints.select(*TAGS.values()), **q.filters)
    b = Buckets(q.start, q.end, q.step)
    # The endpoint table is small next to the points; Spark broadcasts it below its size threshold.
    found = points.where(F.col("path") == q.path).select(*K, "ts", "value").join(own, K)
    by = [TAGS[t] for t in q.by]
    keys = list(TAGS.values())
    series = own.join(series.select(*K).distinct(), K, "left_semi") if series is not None else found.select(*keys).distinct()
    buckets = D.downsample(time_range(found, q.start, q.end), keys, b, q.inner)
    empty = D.AGGREGATORS[q.inner][1]
    if empty == 0 or empty is None and D.fill_policy(q.fill, q.inner) == "zero":
        out = D.aggregate_zero_filled(buckets, keys, by, b, q.outer, series)
    else:
        filled = D.fill(buckets, keys, b, q.fill, q.inner, series)
        out = D.aggregate_series(filled, by, b, q.outer, series)
    if q.rate:
        out = D.rate(out, by, b, q.counter, q.counter_max, q.reset)
    out = out.withColumn("ts", b.label("idx"))
    if not q.rate:
        out = out.where(F.col("ts") >= b.clamp)
    return out.select(*[F.col(c) if c in by else F.lit("").alias(c) for c in TAGS.values()], "ts", "value")


def tsdb_query(points: DataFrame, endpoints: DataFrame, q: Query, earliest: DataFrame | None = None, series: DataFrame | None = None) -> DataFrame:
    """The full query; raises UnknownMetric if no filtered endpoint has the path. earliest: (tags, earliest) of series, for early truncation.

    With `series` (see query_parts) that is looked up there, and the points are read once; else in a job of its own over the points.
    """
    own = filter_endpoints(endpoints.select(*TAGS.values()), **q.filters)
    having = series if series is not None else points.where(F.col("path") == q.path)
    if having.select(*K).join(own, K, "left_semi").isEmpty():
        raise UnknownMetric(q.path)
    out = query_parts(points, endpoints, q, series)
    return D.early_truncate(out, [TAGS[t] for t in q.by], earliest) if earliest is not None else out


def run_queries(points: DataFrame, endpoints: DataFrame, queries: list[Query]) -> DataFrame:
    """Rows of all queries with their number (query_id); an unknown metric gives no rows."""
    parts = [query_parts(points, endpoints, q).select(F.lit(i).alias("query_id"), "*") for i, q in enumerate(queries)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def influx_query(path: str, start: float, end: float, step: float, agg: str, **more) -> Query:
    """A query by the other language's aggregate name; its time buckets are the same, gaps stay."""
    outer, inner = INFLUX_AGGREGATES[agg]
    return Query(path, start, end, step, outer=outer, inner=inner, fill="nan", **more)


def to_grid(points: DataFrame, keys: list[str], start: float, end: float, step: int) -> DataFrame:
    """Every step from floor(start) to ceil(end), value or null, for each series."""
    low, high = int(start // step * step), int(-(-end // step) * step) - step
    if high < low:
        return points.select(*keys, "ts", "value").limit(0)
    every = points.select(*keys).distinct().withColumn("ts", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"), F.lit(step).cast("long"))))
    return every.join(points.select(*keys, "ts", "value"), [*keys, "ts"], "left")


def series_to_json(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, series): {"second":value,...} ascending; seconds are truncated. Points that are null, NaN or infinite are left out."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("ts").cast("long").alias("s"), F.col("value").alias("v"))))
    entry = F.transform(pairs, lambda p: F.concat(F.lit('"'), p["s"].cast("string"), F.lit('":'), json_number(p["v"])))
    return points.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(entry, ","), F.lit("}")).alias("series"))


def tsdb_response(result: DataFrame, path: str, by: tuple[str, ...]) -> DataFrame:
    """(metric, tags, aggregate_tags, dps): the escaped metric, tags for grouped HostName and appname, the other one of those two as aggregate tags."""
    known = {"host": "HostName", "app": "appname"}
    tags = [x for t in known if t in by for x in (F.lit(known[t]), tsdb_escape(TAGS[t]))]
    rest = [known[t] for t in known if t not in by]
    keys = [TAGS[t] for t in TAGS]
    out = series_to_json(result, keys).withColumnRenamed("series", "dps")
    return out.select(
        tsdb_escape(F.lit(path)).alias("metric"), (F.to_json(F.create_map(*tags)) if tags else F.lit("{}")).alias("tags"), F.lit(",".join(rest)).alias("aggregate_tags"), "dps"
    )


def influx_response(result: DataFrame, path: str, by: tuple[str, ...], start: float, end: float, step: int, unit: str = "s") -> DataFrame:
    """(name, tags, values): tags of the grouped ones only, a null-padded grid of [time, value] in the epoch unit."""
    from gaugeflow.functions.scalars import to_epoch

    names = {"host": "host", "app": "appname", "region": "region", "ip": "ipaddress"}
    tags = [x for t in TAGS if t in by for x in (F.lit(names[t]), F.col(TAGS[t]))]
    keys = list(TAGS.values())
    padded = to_grid(result, keys, start, end, step)
    pairs = F.array_sort(F.collect_list(F.struct(to_epoch("ts", unit).cast("long").alias("t"), F.col("value").alias("v"))))
    entry = F.transform(pairs, lambda p: F.concat(F.lit("["), p["t"].cast("string"), F.lit(","), F.coalesce(json_number(p["v"]), F.lit("null")), F.lit("]")))
    out = padded.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(entry, ","), F.lit("]")).alias("values"))
    return out.select(F.lit(path).alias("name"), (F.to_json(F.create_map(*tags)) if tags else F.lit("{}")).alias("tags"), "values")
