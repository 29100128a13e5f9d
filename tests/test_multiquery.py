"""Many queries in one scan give the rows of each query on its own."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import downsample as D
from gaugeflow.operators import multiquery as M
from gaugeflow.operators import query as Q

PATHS = ("/a", "/b", "/c.d")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, rows = random.Random(5), []
    ends = [(f"h{h}", a, ("ASIA", "EUROPE", "x y")[h % 3], f"10.0.0.{h}") for h in range(6) for a in ("p", "q")]
    for h, a, *_ in ends:
        for path in PATHS:
            if rng.random() < 0.8:
                rows += [(h, a, path, round(rng.uniform(0, 4000), 2), round(rng.uniform(-5, 20), 2)) for _ in range(rng.randrange(1, 25))]
    path = str(tmp_path_factory.mktemp("points"))
    spark.createDataFrame(rows, "host_name string, app_name string, path string, ts double, value double").write.parquet(path, mode="overwrite")
    return spark.read.parquet(path), spark.createDataFrame(ends, "host_name string, app_name string, region string, ip_address string").cache()


def some_queries(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        start = rng.choice([0, 100, 900.5, 1500])
        filters = rng.choice([{}, {"host": "h1|h2|h5"}, {"region": "ASIA|x_20y"}, {"app": "p", "region": "EUROPE"}, {"ip": "none"}])
        rate = rng.random() < 0.3
        out.append(Q.Query(
            rng.choice([*PATHS, "/unknown"]), start, start + rng.choice([600, 1500, 2500]), rng.choice([60, 100, 250]), outer=rng.choice(list(D.AGGREGATORS)[:5]), inner=rng.choice(list(D.AGGREGATORS)[:5]),
            fill=rng.choice(["none", "nan", "null", "zero"]), by=rng.choice([(), ("host",), ("app", "region"), ("ip",), ("host", "app")]), filters=filters, rate=rate, counter=rate and rng.random() < 0.5, counter_max=15.0, reset=rng.choice([0.0, 0.05]),
        ))
    return out


def shown(df):
    return sorted((r.query_id, r.host_name, r.app_name, r.region, r.ip_address, r.ts, round(r.value, 6) + 0.0) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_of_each_query(tables, seed):
    points, ends = tables
    queries = some_queries(14, seed)
    assert shown(M.run_queries(points, ends, queries)) == shown(Q.run_queries(points, ends, queries))


def test_series_that_are_given_need_no_scan_beyond_the_range(tables):
    points, ends = tables
    series = points.select("host_name", "app_name", "path").distinct()
    queries = [Q.Query("/a", 900, 1900, 100, fill="zero", by=("app",)), Q.Query("/a", 900, 1900, 100, outer="count", fill="nan", by=("host",)), Q.Query("/unknown", 900, 1900, 100, fill="zero")]
    inside = points.where("ts >= 900 and ts < 1900")
    assert shown(M.run_queries(inside, ends, queries, series)) == shown(Q.run_queries(points, ends, queries))
    assert {r.query_id: r.known for r in M.slots(ends, queries, series).collect()} == {0: True, 1: True, 2: False}


def test_a_thousand_queries_are_one_scan(tables):
    points, ends = tables
    queries = [q for q in some_queries(1200, 3) if q.fill != "zero" and "count" not in (q.inner, q.outer)]
    out = M.run_queries(points, ends, queries)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(queries) > 500 and plan.count("FileScan parquet") == 1
    assert out.select("query_id").distinct().count() > 100


def test_registered_aggregators_and_errors(tables):
    points, ends = tables
    D.register_aggregator("spread_m", lambda c: F.max(c) - F.min(c))
    queries = [Q.Query("/a", 0, 4000, 500, inner="spread_m", fill="nan", by=("app",)), Q.Query("/b", 0, 4000, 500, outer="spread_m", fill="nan")]
    assert shown(M.run_queries(points, ends, queries)) == shown(Q.run_queries(points, ends, queries))
    with pytest.raises(ValueError, match="no such aggregator"):
        M.run_queries(points, ends, [Q.Query("/a", 0, 1, 1, outer="odd")])
    with pytest.raises(ValueError, match="zero fill"):
        M.run_queries(points, ends, [Q.Query("/a", 0, 1000, 100, outer="spread_m", fill="zero")])
