"""Queries: downsampling, fill, aggregation across series, rates and response shapes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.params import Buckets
from gaugeflow.model import K
from gaugeflow.operators import downsample as D
from gaugeflow.operators import multiquery as M
from gaugeflow.operators import query as Q
from gaugeflow.operators.mergeable import MergeableStates, sums
from gaugeflow.plans.adapters import BK, DAYS, END, EP, LABEL, PTS, RANGE, START, STEP, endpoints, points, rounded
from gaugeflow.plans.registry import query

_P = "/events/value"
_N = RANGE.size


def _value_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.time_range(points(spark, sf_dir, START, END).where(F.col("path") == _P), START, END)


def _register_downsample(agg: str) -> None:
    sql = f"WITH {PTS}, {BK} SELECT host_name, app_name, idx, round({agg}(value)::DOUBLE + 1e-9, 6) AS value FROM bk WHERE idx >= 0 AND idx < {_N} GROUP BY ALL"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(D.downsample(_value_points(spark, sf_dir), K, RANGE, agg), "value")

    run.__name__ = f"downsample_{agg}"
    query(sql)(run)


for _agg in ("avg", "count", "max", "min", "sum"):
    _register_downsample(_agg)


@query(f"WITH {PTS}, {BK}, g AS (SELECT * FROM (SELECT DISTINCT host_name, app_name FROM pts WHERE path = '{_P}'), (SELECT unnest(range({_N})) AS idx)) SELECT g.host_name, g.app_name, g.idx, round(coalesce(value, 0) + 1e-9, 6) AS value FROM g LEFT JOIN ds USING (host_name, app_name, idx)")
def fill_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).where(F.col("path") == _P)
    buckets = D.downsample(Q.time_range(p, START, END), K, RANGE)
    return rounded(D.fill(buckets, K, RANGE, "zero", series=p.select(*K).distinct()), "value")


_INTERPOLATED = "nx AS (SELECT *, lead(idx) OVER w AS n, lead(value) OVER w AS v FROM ds WINDOW w AS (PARTITION BY host_name, app_name ORDER BY idx)), ip AS (SELECT host_name, app_name, idx + j AS idx, CASE WHEN j = 0 THEN value ELSE (value * (n - idx - j) + v * j) / (n - idx) END AS value FROM nx, LATERAL (SELECT unnest(range(coalesce(n - idx, 1))) AS j))"


@query(f"WITH {PTS}, {BK}, {_INTERPOLATED} SELECT host_name, app_name, idx, round(value + 1e-9, 6) AS value FROM ip")
def fill_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.fill(D.downsample(_value_points(spark, sf_dir), K, RANGE), K, RANGE, "none"), "value")


@query(f"WITH {PTS}, {BK} SELECT host_name, app_name, idx, round(value + 1e-9, 6) AS value FROM ds")
def fill_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.fill(D.downsample(_value_points(spark, sf_dir), K, RANGE), K, RANGE, "nan"), "value")


def _run(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return rounded(_query(spark, sf_dir, Q.Query(_P, START, END, STEP, **more)), "value")


def _query(spark: SparkSession, sf_dir: str, q: Q.Query, earliest: DataFrame | None = None) -> DataFrame:
    """The points are read within the range alone; every endpoint has the metric, so that the endpoint table is the list of its series."""
    ep = endpoints(spark, sf_dir)
    return Q.tsdb_query(points(spark, sf_dir, START, END), ep, q, earliest, series=ep.select(*K))


_NO_TAGS = "'' AS host_name, '' AS app_name, '' AS region, '' AS ip_address"


@query(f"WITH {PTS}, {BK} SELECT {_NO_TAGS}, {LABEL} AS ts, round(avg(value) + 1e-9, 6) AS value FROM ds WHERE {LABEL} >= {RANGE.clamp} GROUP BY idx")
def tsdb_query_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: the mean over the fleet of each endpoint's mean in six-hour buckets."""
    return _run(spark, sf_dir, fill="nan")


@query(f"WITH {PTS}, {BK} SELECT host_name, '' AS app_name, '' AS region, '' AS ip_address, {LABEL} AS ts, round(sum(value) + 1e-9, 6) AS value FROM ds WHERE {LABEL} >= {RANGE.clamp} GROUP BY host_name, idx")
def tsdb_query_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, fill="nan", outer="sum", by=("host",))


@query(f"WITH {PTS}, {EP}, {BK}, n AS (SELECT region, count(*) AS n FROM ep GROUP BY region), s AS (SELECT region, idx, sum(value) AS s FROM ds JOIN ep USING (host_name, app_name) GROUP BY ALL) SELECT '' AS host_name, '' AS app_name, region, '' AS ip_address, {LABEL} AS ts, round(coalesce(s, 0) / n + 1e-9, 6) AS value FROM (SELECT * FROM n, (SELECT unnest(range({_N})) AS idx)) LEFT JOIN s USING (region, idx) WHERE {LABEL} >= {RANGE.clamp}")
def tsdb_query_zero_fill_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, fill="zero", by=("region",))


@query(f"WITH {PTS}, {EP}, {BK}, n AS (SELECT region, count(*) AS n FROM ep GROUP BY region), s AS (SELECT region, idx, max(value) AS s, count(*) AS m FROM ds JOIN ep USING (host_name, app_name) GROUP BY ALL) SELECT '' AS host_name, '' AS app_name, region, '' AS ip_address, {LABEL} AS ts, round(CASE WHEN coalesce(m, 0) < n THEN greatest(coalesce(s, 0), 0) ELSE s END + 1e-9, 6) AS value FROM (SELECT * FROM n, (SELECT unnest(range({_N})) AS idx)) LEFT JOIN s USING (region, idx) WHERE {LABEL} >= {RANGE.clamp}")
def tsdb_query_zero_fill_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, fill="zero", outer="max", by=("region",))


@query(f"WITH {PTS}, {BK} SELECT '' AS host_name, app_name, '' AS region, '' AS ip_address, {LABEL} AS ts, coalesce(n, 0)::DOUBLE AS value FROM (SELECT * FROM (SELECT DISTINCT app_name FROM pts WHERE path = '{_P}'), (SELECT unnest(range({_N})) AS idx)) LEFT JOIN (SELECT app_name, idx, count(*) AS n FROM ds GROUP BY ALL) USING (app_name, idx) WHERE {LABEL} >= {RANGE.clamp}")
def tsdb_query_count_by_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, fill="nan", outer="count", by=("app",))


@query(f"WITH {PTS}, {BK}, {_INTERPOLATED} SELECT '' AS host_name, app_name, '' AS region, '' AS ip_address, {LABEL} AS ts, round(avg(value) + 1e-9, 6) AS value FROM ip WHERE {LABEL} >= {RANGE.clamp} GROUP BY app_name, idx")
def tsdb_query_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, by=("app",))


@query(f"WITH {PTS}, {EP}, {BK} SELECT host_name, '' AS app_name, '' AS region, ip_address, {LABEL} AS ts, round(max(value) + 1e-9, 6) AS value FROM ds JOIN ep USING (host_name, app_name) WHERE app_name IN ('click', 'view') AND region IN ('ASIA', 'EUROPE') AND {LABEL} >= {RANGE.clamp} GROUP BY host_name, ip_address, idx")
def tsdb_query_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, fill="nan", outer="max", by=("host", "ip"), filters={"app": "click|view", "region": "ASIA|EUROPE"})


@query(f"""WITH {PTS}, {BK}, a AS (SELECT app_name, idx, sum(value) AS value FROM ds GROUP BY ALL),
nx AS (SELECT *, lead(idx) OVER w - idx AS n, lead(value) OVER w AS v FROM a WINDOW w AS (PARTITION BY app_name ORDER BY idx)),
st AS (SELECT app_name, idx + j AS idx, (v - value) / n AS d FROM nx, LATERAL (SELECT unnest(range(n)) AS j) WHERE n IS NOT NULL),
r AS (SELECT *, CASE WHEN d < 0 THEN (d + 500) / {RANGE.width} ELSE d / {RANGE.width} END AS r FROM st)
SELECT '' AS host_name, app_name, '' AS region, '' AS ip_address, {LABEL} AS ts, round(CASE WHEN r < 0 OR r > 0.02 THEN 0 ELSE r END, 9) AS value FROM r""")
def tsdb_rate_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Q.Query(_P, START, END, STEP, outer="sum", fill="nan", by=("app",), rate=True, counter=True, counter_max=500.0, reset=0.02)
    return rounded(_query(spark, sf_dir, q), "value", digits=9)


def _register_influx(agg: str, outer: str, inner: str) -> None:
    value = "count(*)" if inner == "count" else f"{inner}(value)"
    if inner == "count":
        sql = f"WITH {PTS}, {BK}, c AS (SELECT app_name, idx, count(*) AS n FROM bk WHERE idx >= 0 AND idx < {_N} GROUP BY ALL) SELECT '' AS host_name, app_name, '' AS region, '' AS ip_address, {LABEL} AS ts, coalesce(n, 0)::DOUBLE AS value FROM (SELECT * FROM (SELECT DISTINCT app_name FROM pts WHERE path = '{_P}'), (SELECT unnest(range({_N})) AS idx)) LEFT JOIN c USING (app_name, idx) WHERE {LABEL} >= {RANGE.clamp}"
    elif outer == "count":
        sql = f"WITH {PTS}, {BK}, c AS (SELECT app_name, idx, count(*) AS n FROM ds GROUP BY ALL) SELECT '' AS host_name, app_name, '' AS region, '' AS ip_address, {LABEL} AS ts, coalesce(n, 0)::DOUBLE AS value FROM (SELECT * FROM (SELECT DISTINCT app_name FROM pts WHERE path = '{_P}'), (SELECT unnest(range({_N})) AS idx)) LEFT JOIN c USING (app_name, idx) WHERE {LABEL} >= {RANGE.clamp}"
    else:
        sql = f"WITH {PTS}, {BK}, d AS (SELECT host_name, app_name, idx, {value} AS value FROM bk WHERE idx >= 0 AND idx < {_N} GROUP BY ALL) SELECT '' AS host_name, app_name, '' AS region, '' AS ip_address, {LABEL} AS ts, round({outer}(value) + 1e-9, 6) AS value FROM d WHERE {LABEL} >= {RANGE.clamp} GROUP BY app_name, idx"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(_query(spark, sf_dir, Q.influx_query(_P, START, END, STEP, agg, by=("app",))), "value")

    run.__name__ = f"influx_query_{agg}"
    query(sql)(run)


for _name, (_outer, _inner) in Q.INFLUX_AGGREGATES.items():
    _register_influx(_name, _outer, _inner)


@query(f"WITH {PTS}, {BK} SELECT 0 AS query_id, {_NO_TAGS}, {LABEL} AS ts, round(avg(value) + 1e-9, 6) AS value FROM ds WHERE {LABEL} >= {RANGE.clamp} GROUP BY idx UNION ALL SELECT 2, '', app_name, '', '', {LABEL}, round(max(value) + 1e-9, 6) FROM ds WHERE {LABEL} >= {RANGE.clamp} GROUP BY app_name, idx")
def run_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = [Q.Query(_P, START, END, STEP, fill="nan"), Q.Query("/not/there", START, END, STEP, fill="nan"), Q.Query(_P, START, END, STEP, outer="max", fill="nan", by=("app",))]
    return rounded(Q.run_queries(points(spark, sf_dir, START, END), endpoints(spark, sf_dir), qs), "value")


def _day_sql() -> str:
    """One query a day and host group: the mean by application in two-hour buckets, and every third one the rate of the sum over all."""
    parts = []
    for i, q in enumerate(_day_queries()):
        b = Buckets(q.start, q.end, q.step)
        host = "host_name LIKE 'host1%'" if q.filters else "true"
        label = f"({b.first + b.width // 2} + idx * {b.width})"
        app = "app_name" if q.by else "''"
        rows = f"SELECT host_name, app_name, (CAST(floor(ts) AS BIGINT) - ({b.first})) // {b.width} AS idx, avg(value) AS value FROM pts WHERE path = '{q.path}' AND {host} AND ts >= {b.clamp} AND ts >= {q.start} AND ts < {q.end} GROUP BY ALL"
        group = f"SELECT {app} AS app_name, idx, {q.outer}(value) AS value FROM ({rows}) WHERE idx >= 0 AND idx < {b.size} GROUP BY ALL"
        if q.rate:
            step = f"SELECT *, lead(idx) OVER w - idx AS n, lead(value) OVER w AS v FROM ({group}) WINDOW w AS (PARTITION BY app_name ORDER BY idx)"
            parts.append(f"SELECT {i} AS query_id, '' AS host_name, app_name, '' AS region, '' AS ip_address, {label} AS ts, round(value, 9) AS value FROM (SELECT app_name, idx + j AS idx, (v - value) / n / {b.width} AS value FROM ({step}), LATERAL (SELECT unnest(range(n)) AS j) WHERE n IS NOT NULL)")
        else:
            parts.append(f"SELECT {i} AS query_id, '' AS host_name, app_name, '' AS region, '' AS ip_address, {label} AS ts, round(value, 9) AS value FROM ({group}) WHERE {label} >= {b.clamp}")
    return f"WITH {PTS} " + " UNION ALL ".join(parts)


def _day_queries() -> list[Q.Query]:
    hosts = "|".join(f"host{k}" for k in [1, *range(10, 20), *range(100, 200), *range(1000, 2000), *range(10_000, 20_000)])
    out = []
    for day in range(DAYS):
        more = {"rate": True, "outer": "sum"} if day % 3 == 0 else {"by": ("app",)}
        out.append(Q.Query("/events/k" if day % 4 == 0 else _P, START + day * 86400, START + (day + 1) * 86400, 7200, fill="nan", filters={"host": hosts} if day % 2 else {}, **more))
    return [*out, Q.Query("/not/there", START, END, STEP, fill="zero")]


@query(_day_sql())
def run_queries_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each day, with ranges, filters and aggregations of their own, in one scan of the points; the last one's metric is unknown."""
    out = M.run_queries(points(spark, sf_dir, START, END), endpoints(spark, sf_dir), _day_queries(), points(spark, sf_dir).select(*K, "path").distinct())
    return out.withColumn("value", F.round("value", 9))


@query(f"WITH {PTS}, r AS (SELECT DISTINCT path, starts_with(host_name, 'host1') AS own FROM pts), q AS (SELECT unnest(range({DAYS})) AS d) SELECT d AS query_id, coalesce(bool_or(d % 2 = 0 OR own), false) AS known FROM q LEFT JOIN r ON path = CASE WHEN d % 4 = 0 THEN '/events/k' ELSE '{_P}' END GROUP BY d UNION ALL SELECT {DAYS}, false")
def query_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the queries have a metric that is known."""
    return M.slots(endpoints(spark, sf_dir), _day_queries(), points(spark, sf_dir).select(*K, "path"))


@query(f"WITH {PTS}, {EP}, {BK}, e AS (SELECT region, max({START} + (user_id % 10) * 86400) AS earliest FROM ep GROUP BY region), a AS (SELECT region, {LABEL} AS ts, avg(value) AS value FROM ds JOIN ep USING (host_name, app_name) WHERE {LABEL} >= {RANGE.clamp} GROUP BY region, idx) SELECT '' AS host_name, '' AS app_name, region, '' AS ip_address, ts, round(value + 1e-9, 6) AS value FROM a JOIN e USING (region) WHERE ts >= earliest")
def early_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ep = endpoints(spark, sf_dir)
    earliest = ep.select("region", (F.lit(START) + (F.col("user_id") % 10) * 86400).cast("double").alias("earliest"))
    return rounded(_query(spark, sf_dir, Q.Query(_P, START, END, STEP, fill="nan", by=("region",)), earliest), "value")


_BY_APP = f"a AS (SELECT app_name, {LABEL} AS ts, round(max(value) + 1e-9, 6) AS value FROM ds WHERE {LABEL} >= {RANGE.clamp} GROUP BY app_name, idx)"
_NUMBER = "CASE WHEN value = floor(value) THEN CAST(floor(value) AS BIGINT)::VARCHAR ELSE value::VARCHAR END"


def _by_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, fill="nan", outer="max", by=("app",))


@query(f"WITH {PTS}, {BK}, {_BY_APP}, g AS (SELECT * FROM (SELECT DISTINCT app_name FROM a), (SELECT unnest(range({START // STEP * STEP}, {END}, {STEP})) AS ts)) SELECT g.app_name, g.ts, value FROM g LEFT JOIN a ON a.app_name = g.app_name AND a.ts = g.ts")
def to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.to_grid(_by_app(spark, sf_dir), ["app_name"], START, END, STEP)


@query(f"WITH {PTS}, {BK}, {_BY_APP} SELECT app_name, '{{' || string_agg('\"' || ts || '\":' || {_NUMBER}, ',' ORDER BY ts) || '}}' AS series FROM a GROUP BY app_name")
def series_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.series_to_json(_by_app(spark, sf_dir), ["app_name"])


@query(f"WITH {PTS}, {BK}, {_BY_APP} SELECT '/events/value' AS metric, '{{\"appname\":\"' || app_name || '\"}}' AS tags, 'HostName' AS aggregate_tags, '{{' || string_agg('\"' || ts || '\":' || {_NUMBER}, ',' ORDER BY ts) || '}}' AS dps FROM a GROUP BY app_name")
def tsdb_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.tsdb_response(_by_app(spark, sf_dir), _P, ("app",))


@query(f"WITH {PTS}, {BK}, {_BY_APP}, g AS (SELECT * FROM (SELECT DISTINCT app_name FROM a), (SELECT unnest(range({START // STEP * STEP}, {END}, {STEP})) AS ts)) SELECT '/events/value' AS name, '{{\"appname\":\"' || g.app_name || '\"}}' AS tags, '[' || string_agg('[' || (g.ts * 1000) || ',' || coalesce({_NUMBER}, 'null') || ']', ',' ORDER BY g.ts) || ']' AS values FROM g LEFT JOIN a ON a.app_name = g.app_name AND a.ts = g.ts GROUP BY g.app_name")
def influx_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.influx_response(_by_app(spark, sf_dir), _P, ("app",), START, END, STEP, "ms")


@query(f"WITH {PTS}, {BK} , d AS (SELECT host_name, app_name, idx, max(value) - min(value) AS value FROM bk WHERE idx >= 0 AND idx < {_N} GROUP BY ALL) SELECT '' AS host_name, app_name, '' AS region, '' AS ip_address, {LABEL} AS ts, round(avg(value) + 1e-9, 6) AS value FROM d WHERE {LABEL} >= {RANGE.clamp} GROUP BY app_name, idx")
def registered_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query by an aggregator of one's own: the spread of a bucket's values."""
    D.register_aggregator("spread", lambda c: F.max(c) - F.min(c))
    return _run(spark, sf_dir, fill="nan", inner="spread", by=("app",))


def _moments(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return sums(group, np.stack([np.ones(len(values)), values, values**2], axis=1), n)


def _variance(states: np.ndarray) -> np.ndarray:
    n, s, q = states.T
    return np.maximum(q / n - (s / n) ** 2, 0.0)


@query(f"WITH {PTS}, {BK}, d AS (SELECT app_name, idx, var_pop(value) AS value FROM ds GROUP BY ALL) SELECT '' AS host_name, app_name, '' AS region, '' AS ip_address, {LABEL} AS ts, round(value + 1e-9, 6) AS value FROM d WHERE {LABEL} >= {RANGE.clamp}")
def mergeable_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query by code of one's own over partial states: the variance across an application's series."""
    D.register_mergeable("variance", MergeableStates(3, _moments, sums, _variance))
    ep = endpoints(spark, sf_dir)
    q = Q.Query(_P, START, END, STEP, outer="variance", fill="nan", by=("app",))
    return rounded(Q.tsdb_query(points(spark, sf_dir, START, END), ep, q, series=ep.select(*K)), "value")


@query(f"WITH {PTS}, {BK}, n AS (SELECT DISTINCT host_name, app_name FROM pts WHERE path = '{_P}'), g AS (SELECT * FROM n, (SELECT unnest(range({_N})) AS idx)), d AS (SELECT host_name, app_name, idx, sum(value) AS value FROM bk WHERE idx >= 0 AND idx < {_N} GROUP BY ALL), f AS (SELECT app_name, idx, coalesce(value, -1) AS value FROM g LEFT JOIN d USING (host_name, app_name, idx)) SELECT '' AS host_name, app_name, '' AS region, '' AS ip_address, {LABEL} AS ts, round(max(value) + 1e-9, 6) AS value FROM f WHERE {LABEL} >= {RANGE.clamp} GROUP BY app_name, idx")
def aggregator_default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregator whose value of no input is -1: buckets without points have it."""
    D.register_aggregator("sum_or_minus", F.sum, empty=-1.0, default_fill="zero")
    ep = endpoints(spark, sf_dir)
    q = Q.Query(_P, START, END, STEP, inner="sum_or_minus", outer="max", by=("app",))
    return rounded(Q.tsdb_query(points(spark, sf_dir, START, END), ep, q, series=ep.select(*K)), "value")


@query(f"WITH {PTS}, {BK} SELECT app_name, {LABEL} AS ts, round(avg(value) + 1e-9, 6) AS value FROM ds WHERE app_name LIKE '%i%' AND {LABEL} >= {RANGE.clamp} GROUP BY app_name, idx")
def filter_callables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints picked by a predicate column instead of a list."""
    ep = Q.filter_endpoints(endpoints(spark, sf_dir), app=F.col("app_name").contains("i"))
    q = Q.Query(_P, START, END, STEP, fill="nan", by=("app",))
    return rounded(Q.query_parts(points(spark, sf_dir, START, END), ep, q).select("app_name", "ts", "value"), "value")
