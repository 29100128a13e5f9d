"""Many metric queries in one scan of the points.

Queries are rows. What they downsample (path, range, step, aggregator) is a *plan*, of which like queries share one; which endpoints they
take (filters) is a *choice*, shared likewise. A point meets the plans of its path whose range holds it, a first aggregation leaves
one row for each plan, series and bucket, and only these meet the queries. What follows is the same for all queries, with their parameters
as columns: fill, aggregation across series by each query's own tags, rates.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.functions.params import Buckets
from gaugeflow.functions.scalars import unescape
from gaugeflow.model import K
from gaugeflow.operators import downsample as D
from gaugeflow.operators.mergeable import MergeableStates
from gaugeflow.operators.query import TAGS, Query

_TAGS = list(TAGS.values())
_GROUP = ["query_id", *_TAGS]
#: Queries above this number are joined without the hint to broadcast them.
MOST_BROADCAST = 20_000


def _numbered(items: Iterable) -> dict:
    """Distinct items and their numbers, in the order met."""
    return {x: i for i, x in enumerate(dict.fromkeys(items))}


def _choice(q: Query) -> tuple:
    return tuple(sorted(q.filters.items()))


def _plan(q: Query) -> tuple:
    return (q.path, float(q.start), float(q.end), float(q.step), q.inner)


def _has_zeros(q: Query) -> bool:
    return D.AGGREGATORS[q.inner][1] == 0 or D.fill_policy(q.fill, q.inner) == "zero"


class Request:
    """The tables of a list of queries: plans, choices with their filters, and the queries with the numbers of both."""

    def __init__(self, spark: SparkSession, queries: list[Query]):
        for name in {x for q in queries for x in (q.inner, q.outer)}:
            if isinstance(D.aggregator(name), MergeableStates) or D.AGGREGATORS[name][1] not in (None, 0):
                raise ValueError(f"{name} has states or an empty value of its own: ask for it by tsdb_query")
        self.queries, self.hint = queries, (F.broadcast if len(queries) <= MOST_BROADCAST else lambda df: df)
        plans, choices = _numbered(map(_plan, queries)), _numbered(map(_choice, queries))
        rows = []
        for p, i in plans.items():
            b = Buckets(*p[1:4])
            rows.append((i, p[0], p[1], p[2], float(b.clamp), b.first, b.width, b.size, p[4]))
        self.plans = spark.createDataFrame(rows, "plan int, path string, start double, end double, clamp double, first long, width long, size long, inner string")
        self.inner = sorted({q.inner for q in queries})
        self.outer = sorted({q.outer for q in queries})
        zero = [_has_zeros(q) for q in queries]
        rows = [
            (i, plans[_plan(q)], choices[_choice(q)], q.outer, z, not z and D.fill_policy(q.fill, q.inner) not in ("nan", "null"), [TAGS[t] for t in q.by], q.rate, q.counter, float(q.counter_max), float(q.reset))
            for i, (q, z) in enumerate(zip(queries, zero))
        ]
        wanted = spark.createDataFrame(rows, "query_id int, plan int, choice int, outer string, zero boolean, between boolean, by array<string>, rate boolean, counter boolean, counter_max double, reset double")
        self.table = wanted.join(self.plans.drop("start", "end"), "plan")
        self.has_zero, self.has_between, self.has_rate = any(zero), any(r[5] for r in rows), any(q.rate for q in queries)
        self.needs_series = self.has_zero or any(D.AGGREGATORS[q.outer][1] is not None for q in queries)
        self.filters = spark.createDataFrame([(i, TAGS[t], unescape(v), len(c)) for c, i in choices.items() for t, spec in c for v in set(spec.split("|"))], "choice int, tag string, value string, n int")
        self.free = [i for c, i in choices.items() if not c]

    def chosen(self, endpoints: DataFrame) -> DataFrame:
        """(choice, tags) of the endpoints that pass all filters of a choice: an equi-join of tag values, not of all pairs."""
        own = endpoints.select(*_TAGS)
        cells = own.select("*", F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("value")) for t in _TAGS])).alias("c")).select(*_TAGS, "c.*")
        passed = cells.join(self.hint(self.filters), ["tag", "value"]).groupBy("choice", *_TAGS).agg(F.count_distinct("tag").alias("m"), F.max("n").alias("n")).where("m = n").select("choice", *_TAGS)
        return passed.unionByName(own.select(F.explode(F.array(*map(F.lit, self.free))).alias("choice"), *_TAGS)) if self.free else passed


def _picked(names: list[str], column: str, value: str) -> Column:
    """The aggregate of `value` by the aggregator whose name is in `column`."""
    out = F.lit(None).cast("double")
    for name in names:
        own = D.aggregator(name)(F.when(F.col(column) == name, F.col(value))).cast("double")
        out = F.when(F.first(column) == name, own).otherwise(out)
    return out


def _buckets(request: Request, points: DataFrame) -> DataFrame:
    """(plan, endpoint, idx, value): the one scan of the points."""
    paths = sorted({q.path for q in request.queries})
    own = points.where(F.col("path").isin(paths) & (F.col("ts") >= min(q.start for q in request.queries)) & (F.col("ts") < max(q.end for q in request.queries)) & F.col("value").isNotNull())
    met = own.select(*K, "path", "ts", "value").join(request.hint(request.plans), "path").where("ts >= start and ts < end and ts >= clamp")
    met = met.withColumn("idx", F.expr("(cast(ts as bigint) - first) div width")).where("idx >= 0 and idx < size")
    return met.groupBy("plan", *K, "idx").agg(_picked(request.inner, "inner", "value").alias("value"))


def _tagged(df: DataFrame) -> DataFrame:
    """Tags that the query does not group by become ""."""
    return df.select(*[F.when(F.array_contains("by", t), F.col(t)).otherwise(F.lit("")).alias(t) if t in _TAGS else F.col(t) for t in df.columns])


def _grid(groups: DataFrame) -> DataFrame:
    return groups.where("size > 0").withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))


def _zeros(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, tags, idx, value) of queries with zeros: a group's missing series are added arithmetically."""
    part = found.where("zero").groupBy(*_GROUP, "idx").agg(F.count("value").alias("m"), F.sum("value").alias("total"), F.max("value").alias("top"), F.min("value").alias("low"))
    every = _grid(groups.where("zero")).join(part, [*_GROUP, "idx"], "left")
    total, missing = F.coalesce("total", F.lit(0.0)), F.coalesce("m", F.lit(0)) < F.col("n")
    value = {
        "avg": total / F.col("n"),
        "sum": total,
        "count": F.col("n").cast("double"),
        "max": F.when(missing, F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("top")),
        "min": F.when(missing, F.least(F.coalesce("low", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("low")),
    }
    out = F.lit(None).cast("double")
    for name, v in value.items():
        out = F.when(F.col("outer") == name, v).otherwise(out)
    return every.select(*_GROUP, "idx", out.alias("value"))


def _interpolated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """downsample.interpolate for the rows whose query fills between known buckets; others stay as they are."""
    w = Window.partitionBy(*keys).orderBy("idx")
    gap = rows.withColumn("_n", F.when(F.col("between"), F.lead("idx").over(w) - F.col("idx"))).withColumn("_to", F.lead("value").over(w))
    out = gap.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_n") - 1, F.lit(0)))))
    value = F.when(F.col("_k") == 0, F.col("value")).otherwise((F.col("value") * (F.col("_n") - F.col("_k")) + F.col("_to") * F.col("_k")) / F.col("_n"))
    return out.select(*keys, (F.col("idx") + F.col("_k")).alias("idx"), value.alias("value"))


def _rates(rows: DataFrame) -> DataFrame:
    """Change per second to the next bucket where the query asks for it, by its own counter rules; other rows stay as they are."""
    w = Window.partitionBy(*_GROUP).orderBy("idx")
    steps = rows.withColumn("_n", F.when(F.col("rate"), F.lead("idx").over(w) - F.col("idx")).otherwise(1)).withColumn("_delta", F.when(F.col("rate"), (F.lead("value").over(w) - F.col("value")) / F.col("_n")))
    steps = steps.where("_n is not null").withColumn("idx", F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("_n") - 1)))
    raw = F.col("_delta") / F.col("width")
    turned = F.when(F.col("_delta") < 0, (F.col("_delta") + F.col("counter_max")) / F.col("width")).otherwise(raw)
    turned = F.when((turned < 0) | (F.col("reset") > 0) & (turned > F.col("reset")), 0.0).otherwise(turned)
    return steps.withColumn("value", F.when(~F.col("rate"), F.col("value")).when(F.col("counter"), turned).otherwise(raw))


def run_queries(points: DataFrame, endpoints: DataFrame, queries: list[Query], series: DataFrame | None = None) -> DataFrame:
    """(query_id, tags, ts, value) of all queries, as query.run_queries gives them, from one scan of the points; an unknown metric gives no rows.

    series: the (endpoint, path) that exist. It is needed for zero fill and counts alone; without it they are taken from the points in a scan of their
    own, which must reach beyond the range then. Zero fill knows the five named aggregators across series.
    """
    request = Request(points.sparkSession, queries)
    odd = {q.outer for q in queries if _has_zeros(q) and q.outer not in ("avg", "count", "max", "min", "sum")}
    if odd:
        raise ValueError(f"zero fill across series by {', '.join(sorted(odd))}")
    own = request.hint(request.table)
    chosen = request.chosen(endpoints)
    # The queries of a bucket, and of these the ones that choose its endpoint.
    buckets = _buckets(request, points).join(own.select("plan", "query_id", "choice", "outer", "zero", "between", "by"), "plan")
    found = buckets.join(chosen, [*K, "choice"]).select("query_id", *_TAGS, "idx", "value", "outer", "zero", "between", "by")
    groups = None
    if request.needs_series:
        if series is None:
            series = points.where(F.col("path").isin(sorted({q.path for q in queries}))).select(*K, "path").distinct()
        having = series.select(*K, "path").distinct().join(own.select("path", "query_id", "choice", "outer", "zero", "by", "size"), "path").join(chosen, [*K, "choice"])
        groups = _tagged(having.select("query_id", *_TAGS, "outer", "zero", "by", "size")).groupBy(*_GROUP, "outer", "zero", "size").agg(F.count(F.lit(1)).alias("n"))
    plain = found.where("not zero")
    if request.has_between:
        plain = _interpolated(plain, ["query_id", *_TAGS, "outer", "by"])
    parts = [_tagged(plain.select("query_id", *_TAGS, "outer", "by", "idx", "value")).groupBy(*_GROUP, "idx").agg(_picked(request.outer, "outer", "value").alias("value"))]
    empty = {name: D.AGGREGATORS[name][1] for name in request.outer if D.AGGREGATORS[name][1] is not None}
    if empty and groups is not None:
        # Buckets of a known group without any point have the aggregator's value of no input.
        default = F.lit(None).cast("double")
        for name, v in empty.items():
            default = F.when(F.col("outer") == name, F.lit(float(v))).otherwise(default)
        every = _grid(groups.where(~F.col("zero") & F.col("outer").isin(*empty))).withColumn("_empty", default).select(*_GROUP, "idx", "_empty")
        parts = [parts[0].join(every, [*_GROUP, "idx"], "full_outer").select(*_GROUP, "idx", F.coalesce("value", "_empty").alias("value"))]
    if request.has_zero:
        parts.append(_zeros(_tagged(found), groups))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.join(own.select("query_id", "first", "width", "clamp", "rate", "counter", "counter_max", "reset"), "query_id")
    if request.has_rate:
        out = _rates(out)
    out = out.withColumn("ts", F.expr("first + width div 2 + idx * width"))
    return out.where(F.col("rate") | (F.col("ts") >= F.col("clamp"))).select(*_GROUP, "ts", "value")


def slots(endpoints: DataFrame, queries: list[Query], series: DataFrame) -> DataFrame:
    """(query_id, known): whether an endpoint that the query chooses has its metric; the slot of one that is not known stays empty."""
    request = Request(series.sparkSession, queries)
    own = request.hint(request.table)
    having = series.select(*K, "path").distinct().join(own.select("path", "query_id", "choice"), "path").join(request.chosen(endpoints), [*K, "choice"])
    return own.select("query_id").join(having.select("query_id").distinct().withColumn("known", F.lit(True)), "query_id", "left").select("query_id", F.coalesce("known", F.lit(False)).alias("known"))
