"""Buckets, fill policies, aggregation across series and rates against hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions.params import Buckets
from gaugeflow.operators import downsample as D
from gaugeflow.operators import query as Q

#: (ts, value) of three series; the fourth has no points.
A = [(900, 31), (930, 31.5), (1099.999, 31.25), (1301, 20), (1499, 30), (1736, 75)]
B = [(1100, 40), (1500, 46)]


def series(spark, **rows):
    data = [(name, float(t), float(v)) for name, pts in rows.items() for t, v in pts]
    return spark.createDataFrame(data, "s string, ts double, value double")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def run(spark, buckets_of, outer="avg", inner="avg", policy="none", all_series=("a",), rate=None, **rows):
    b, p = buckets_of, series(spark, **rows)
    buckets = D.downsample(Q.time_range(p, b.start, b.end), ["s"], b, inner)
    known = names(spark, *all_series)
    if policy == "zero":
        out = D.aggregate_zero_filled(buckets, ["s"], [], b, outer, known)
        slow = D.aggregate_series(D.fill(buckets, ["s"], b, "zero", inner, known), [], b, outer)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, slow.collect()))
    else:
        out = D.aggregate_series(D.fill(buckets, ["s"], b, policy, inner, known), [], b, outer, known.select(F.lit(1).alias("g")).distinct() if outer == "count" else None)
    if rate is not None:
        out = D.rate(out, [], b, **rate)
    out = out.withColumn("label", b.label("idx"))
    if rate is None:
        out = out.where(F.col("label") >= b.clamp)
    return {r.label: round(r.value, 6) for r in out.collect()}


def test_interpolation(spark):
    assert run(spark, Buckets(900, 1900, 200), a=A) == {1000: 31.25, 1200: 28.125, 1400: 25, 1600: 50, 1800: 75}


def test_two_series(spark):
    assert run(spark, Buckets(900, 1900, 200), a=A, b=B) == {1000: 31.25, 1200: 34.0625, 1400: 34, 1600: 48, 1800: 75}


def test_zero_fill_counts_series_without_points(spark):
    out = run(spark, Buckets(900, 1900, 200), policy="zero", all_series=("a", "b", "c", "d"), a=[(1000, 48.5)], b=[(1400, 3075)], c=[(1600, 99), (1800, 298)])
    assert out == {1000: 12.125, 1200: 0, 1400: 768.75, 1600: 24.75, 1800: 74.5}


@pytest.mark.parametrize(("policy", "expected"), [("none", {200: 5, 400: 7.5, 600: 10, 800: 3.75}), ("nan", {200: 5, 600: 10, 800: 3.75}), ("null", {200: 5, 600: 10, 800: 3.75}), ("zero", {0: 0, 200: 5, 400: 0, 600: 10, 800: 3.75})])
def test_fill_policies_of_a_sum(spark, policy, expected):
    rows = [(200, 5), (600, 1), (601, 2), (602, 3), (603, 4), (800, -1.25), (801, 1.5), (802, 3.5)]
    assert run(spark, Buckets(-100, 900, 200), inner="sum", policy=policy, a=rows) == expected


def test_partial_buckets_at_both_ends(spark):
    assert run(spark, Buckets(957, 1838, 200), a=A) == {1400: 25}


def test_negative_start(spark):
    b = Buckets(-34028, 24028, 10000)
    assert run(spark, b, policy="nan", a=[(-10000, -5), (0, 5)]) == {-10000: -5, 0: 5}


RATE = [(1000, 10000), (1200, 49000), (1400, 3000), (1600, 53000), (1800, 52000)]


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({"counter": True, "counter_max": 65500, "reset": 200}, [195, 97.5, 0, 0]),
        ({"counter": True, "counter_max": 65500}, [195, 97.5, 250, 322.5]),
        ({"counter": True}, [195, 0, 250, 0]),
        ({}, [195, -230, 250, -5]),
    ],
)
def test_rates(spark, options, expected):
    assert list(dict(sorted(run(spark, Buckets(900, 1900, 200), rate=options, a=RATE).items())).values()) == expected


def test_rate_over_gaps(spark):
    out = run(spark, Buckets(900, 1900, 200), policy="nan", rate={}, a=[(900, 10000), (1500, 49000), (1700, 52000)])
    assert out == {1000: 65, 1200: 65, 1400: 65, 1600: 15}


@pytest.fixture(scope="module")
def fleet(spark):
    """/foo on three hosts and two applications; values start at 30, 40, ... and rise by one."""
    rows = [(f"host{h}", f"app{a}", "/foo", float(490 + 10 * i), 30.0 + 10 * (2 * (h - 1) + a - 1) + i) for h in (1, 2, 3) for a in (1, 2) for i in range(5)]
    ep = [(f"host{h}", f"app{a}", "east" if h < 3 else "west", f"10.0.0.{h}") for h in (1, 2, 3) for a in (1, 2)]
    return spark.createDataFrame(rows, "host_name string, app_name string, path string, ts double, value double"), spark.createDataFrame(ep, "host_name string, app_name string, region string, ip_address string")


def test_query_without_grouping(fleet):
    out = Q.tsdb_query(*fleet, Q.Query("/foo", 490, 590, 20, fill="nan"))
    assert {(r.ts, r.value) for r in out.collect()} == {(500, 55.5), (520, 57.5), (540, 59.0)}


def test_query_by_host(fleet):
    out = Q.tsdb_query(*fleet, Q.Query("/foo", 390, 690, 20, fill="nan", by=("host",)))
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.ts):
        got.setdefault(r.host_name, []).append(r.value)
    assert got == {"host1": [35.5, 37.5, 39], "host2": [55.5, 57.5, 59], "host3": [75.5, 77.5, 79]}


def test_unknown_metric_is_not_an_empty_result(fleet):
    with pytest.raises(Q.UnknownMetric):
        Q.tsdb_query(*fleet, Q.Query("/not there", 490, 590, 20))
    assert Q.tsdb_query(*fleet, Q.Query("/foo", 491, 529, 20, fill="nan")).count() == 0


def test_registered_aggregator(fleet):
    D.register_aggregator("range", lambda c: F.max(c) - F.min(c))
    out = Q.tsdb_query(*fleet, Q.Query("/foo", 490, 590, 20, outer="range", fill="nan"))
    assert {r.value for r in out.collect()} == {50.0}
    with pytest.raises(ValueError, match="no such aggregator"):
        D.aggregator("median of means")


def test_null_padded_grid(spark):
    p = spark.createDataFrame([("x", 3000, 3.0), ("x", 3500, 3.5), ("x", 4000, 4.0)], "name string, ts long, value double")
    out = Q.to_grid(p, ["name"], 2499, 5000, 500)
    assert sorted((r.ts, r.value) for r in out.collect()) == [(2000, None), (2500, None), (3000, 3.0), (3500, 3.5), (4000, 4.0), (4500, None)]
