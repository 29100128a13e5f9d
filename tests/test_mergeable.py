"""Aggregators of user code over partial states, with their fills and empty values."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions.params import Buckets
from gaugeflow.operators import downsample as D
from gaugeflow.operators import multiquery as M
from gaugeflow.operators import query as Q
from gaugeflow.operators.mergeable import MergeableStates, sums


def made():
    """Functions of this module, pickled by value: workers do not import tests."""

    def moments(group, values, n):
        return sums(group, np.stack([np.ones(len(values)), values, values**2], axis=1), n)

    def variance(states):
        n, s, q = states.T
        return q / n - (s / n) ** 2

    return MergeableStates(3, moments, sums, variance)


VARIANCE = made()


@pytest.fixture
def points(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(2000)), rng.choice([1.0, 2.0, 8.0, None, float("nan")])) for _ in range(3000)]
    return spark.createDataFrame(rows, "s string, ts double, value double").repartition(5)


def brute(points, b):
    groups = defaultdict(list)
    for s, ts, v in points.collect():
        idx = (int(ts) - b.first) // b.width
        if v is not None and v == v and ts >= b.clamp and 0 <= idx < b.size:
            groups[s, idx].append(v)
    return {k: round(float(np.var(v)), 9) for k, v in groups.items()}


@pytest.mark.parametrize("held", [3, 200_000])
def test_states_are_merged(points, held, monkeypatch):
    b = Buckets(0, 2000, 100)
    cut = points.where(F.col("ts") >= b.clamp).withColumn("idx", b.index("ts")).where((F.col("idx") >= 0) & (F.col("idx") < b.size))
    got = VARIANCE.aggregate(cut, ["s", "idx"], held)
    assert got.columns == ["s", "idx", "value"]
    assert {(r.s, r.idx): round(r.value, 9) for r in got.collect()} == brute(points, b)
    assert VARIANCE.aggregate(cut.limit(0), ["s", "idx"]).count() == 0


def test_one_state_a_group_and_task_is_shuffled(points):
    partial = points.select("s", "value").where("value is not null").mapInPandas(VARIANCE._partial(["s"], 1000), "s string, _state array<double>")
    assert partial.count() == 3 * points.rdd.getNumPartitions()


def test_registered_states_in_queries(spark, points):
    D.register_mergeable("var", VARIANCE)
    D.register_mergeable("var_zero", VARIANCE, default_fill="zero")
    D.register_mergeable("energy", MergeableStates(1, lambda g, v, n: np.bincount(g, v * v, n)[:, None], sums, lambda s: s[:, 0]), empty=5.0)
    rows = [("h", "x", "/p", float(t), float(v)) for t, v in ((100, 1), (110, 3), (510, 7), (520, 7))]
    p = spark.createDataFrame(rows, "host_name string, app_name string, path string, ts double, value double")
    ends = spark.createDataFrame([("h", "x", "r", "1")], "host_name string, app_name string, region string, ip_address string")

    def run(inner, fill, outer="avg"):
        out = Q.tsdb_query(p, ends, Q.Query("/p", 0, 800, 200, inner=inner, outer=outer, fill=fill))
        return {r.ts: r.value for r in out.collect()}

    # Buckets are centred on 0, 200, 400, ...; the range leaves 0 out.
    assert run("var", "nan") == {200: 1.0, 600: 0.0}
    assert run("var", "none") == {200: 1.0, 400: 0.5, 600: 0.0}
    assert run("var_zero", "none") == run("var", "zero") == {200: 1.0, 400: 0.0, 600: 0.0}
    assert run("energy", "nan") == run("energy", "none") == {200: 10.0, 400: 5.0, 600: 98.0}
    assert run("sum", "nan", "var") == {200: 0.0, 600: 0.0}
    with pytest.raises(ValueError, match="tsdb_query"):
        M.run_queries(p, ends, [Q.Query("/p", 0, 800, 200, inner="energy")])
