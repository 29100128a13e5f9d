"""Payloads, documents and plans against literal cases."""

import json
import time

import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gaugeflow.functions import params as P
from gaugeflow.functions import scalars as C
from gaugeflow.operators import export as X
from gaugeflow.operators import health as H
from gaugeflow.operators import merge as M
from gaugeflow.operators import query as Q
from gaugeflow.operators import series as S
from gaugeflow.plans import adapters, metric_queries
from gaugeflow.sources import readers
from gaugeflow.streaming.jobs import ingest_batch

STATS = "account string, instance string, region string, ts double, user_time_fraction double, memory_free long, memory_total long, fss array<struct<mount_point: string, size: long, free: long>>"


def hours(spark):
    """Samples at 13:31, 14:00 and 14:29, which all belong to the hour of 14:00."""
    at = 1_480_428_000  # 2016-11-29 14:00 UTC
    rows = [
        ("", "i-1", "r", at - 29 * 60.0, 0.25, 3000, 4000, [("/", 7000, 4000), ("/free", None, 3)]),
        ("", "i-1", "r", float(at), 0.375, 3500, 6200, [("/", 7600, 3900), ('/odd"name', 10, None)]),
        ("", "i-1", "r", at + 29 * 60.0, None, None, None, []),
    ]
    return at, spark.createDataFrame(rows, STATS)


def test_dashboard_payload(spark):
    at, stats = hours(spark)
    rollup, fs = H.health_rollup(stats, 3600), H.fs_rollup(stats, 3600)
    assert sorted(r.mount_point for r in fs.collect()) == ["/", '/odd"name']  # free space alone says nothing
    row = X.to_dashboard_payload(rollup, "dc", "main", fs).first()
    instance, mounts = json.loads(row.payload)["metrics"]["datasets"]
    assert instance["metadata"] == {
        "assetType": "aws:ec2:instance",
        "granularity": "hour",
        "keys": ["assetId", "timestamp", "cpu:used:percent.avg", "cpu:used:percent.max", "cpu:used:percent.min", "memory:free:bytes.avg", "memory:free:bytes.max", "memory:free:bytes.min", "memory:size:bytes.avg", "memory:size:bytes.max", "memory:size:bytes.min", "memory:used:percent.avg", "memory:used:percent.max", "memory:used:percent.min"],
    }
    [values] = instance["values"]
    assert values[:11] == ["dc:main:i-1", "2016-11-29T14:00:00+00:00", 31.25, 37.5, 25, 3250, 3500, 3000, 5100, 6200, 4000]
    assert values[11:] == pytest.approx([(25 + 2700 / 62) / 2, 2700 / 62, 25])
    assert mounts["metadata"]["assetType"] == "aws:ec2:instance:fs"
    assert mounts["metadata"]["keys"] == ["assetId", "timestamp", "fs:size:bytes.avg", "fs:size:bytes.max", "fs:size:bytes.min", "fs:used:bytes.avg", "fs:used:bytes.max", "fs:used:bytes.min", "fs:used:percent.avg", "fs:used:percent.max", "fs:used:percent.min"]
    root, odd = mounts["values"]
    assert root[:8] == ["dc:main:i-1:/", "2016-11-29T14:00:00+00:00", 7300, 7600, 7000, 3350, 3700, 3000]
    assert odd == ['dc:main:i-1:/odd"name', "2016-11-29T14:00:00+00:00", 10, 10, 10, None, None, None, None, None, None]


def test_dashboard_payload_read_back(spark):
    """The parser gives the long form of what the payload was made of."""
    at, stats = hours(spark)
    stats = stats.withColumn("account", F.lit("acct"))
    rollup, fs = H.health_rollup(stats, 3600), H.fs_rollup(stats, 3600)
    payload = X.to_dashboard_payload(rollup, "r", "main", fs).withColumn("payload_id", F.lit(1))
    got = {tuple(r) for r in readers.parse_dashboard_payload(payload).select("region", "account", "instance", "ts", "metric", F.round("value", 6)).collect()}
    long = X.snapshot_to_long(rollup, fs).where("value is not null")
    assert got == {tuple(r) for r in long.select("region", "account", "instance", "ts", "metric", F.round("value", 6)).collect()}
    assert ("r", "acct", "i-1", at, "CpuUsedPercentAvg", 31.25) in got and ("r", "acct", "i-1", at, "FsUsedBytesMax", 3700.0) in got and len(got) == 21


def test_each_dataset_gives_its_first_root(spark):
    keys = '"keys":["assetId","timestamp","fs:size:bytes.avg"]'
    rows = lambda *v: ",".join(f'["r:a:i:{m}","2016-11-29T14:00:00+00:00",{x}]' for m, x in v)
    sets = [f'{{"metadata":{{"assetType":"aws:ec2:instance:fs",{keys}}},"values":[{rows(("/boot", 1), ("/", 2), ("/", 3))}]}}', f'{{"metadata":{{"assetType":"aws:ec2:instance:fs",{keys}}},"values":[{rows(("/", 4))}]}}', f'{{"metadata":{{"assetType":"other",{keys}}},"values":[{rows(("/", 5))}]}}']
    df = spark.createDataFrame([(1, f'{{"metrics":{{"datasets":[{",".join(sets)}]}}}}')], "payload_id int, payload string")
    assert sorted(r.value for r in readers.parse_dashboard_payload(df).collect()) == [2.0, 4.0]


EXPORT = "host string, path string, tags map<string,string>, ts double, kind string, unit string, value_double double, value_long long, value_bool boolean, value_string string"


def test_tsdb_put_of_all_kinds(spark):
    odd = 'a "quoted" \\ string'
    rows = [
        ("h", '/p"q', {"appname": 'x"y'}, 99.9, "bool", "", None, None, True, None),
        ("h", "/p", {"appname": "x"}, 100.0, "uint64", "", None, 1 << 53, None, None),
        ("h", "/p", {"appname": "x"}, 100.0, "float64", "", -79.236, None, None, None),
        ("h", "/p", {"appname": "x"}, 100.0, "time", "", 1450370423.5, None, None, None),
        ("h", "/p", {"appname": "x"}, 100.0, "duration", "ms", -60.12, None, None, None),
        ("h", "/p", {"appname": "x"}, 100.0, "string", "", None, None, None, odd),
    ]
    rec = spark.createDataFrame(rows, EXPORT)
    assert X.filter_supported(rec, X.TSDB_KINDS).count() == len(rows)
    got = [json.loads(r.payload) for r in X.to_tsdb_put(rec).collect()]
    assert [g["value"] for g in got] == [1, 1 << 53, -79.236, 1450370423.5, -60120.0, odd]
    assert got[0] == {"metric": '/p"q', "timestamp": 99, "value": 1, "tags": {"HostName": "h", "appname": 'x"y'}}


def test_milliseconds_are_cut_off(spark):
    rec = spark.createDataFrame([("h", "/p", {}, 1450370423.123999, "int64", "", None, 1, None, None)], EXPORT)
    assert json.loads(X.to_json_payload(rec, "t", "k").first().payload)["@timestamp"] == "2015-12-17T16:40:23.123Z"
    batch = spark.createDataFrame([("b", "/x", 0, 5.0019), ("b", "/x", 1, 5.0011), ("b", "/y", 2, 5.0019)], "batch string, path string, seq int, ts double")
    assert [r.ms for r in X.shift_duplicates(batch).orderBy("seq").collect()] == [5001, 5002, 5001]


def test_shifts_take_time_in_proportion():
    n = 200_000
    began = time.perf_counter()
    out = X._shift(pd.DataFrame({"ms": [7] * n + [3]}))["ms"].tolist()
    assert out == [*range(7, 7 + n), 3] and time.perf_counter() - began < 5


def test_documents_of_metrics(spark):
    rec = spark.createDataFrame(
        [
            ("h", "a", "/foo.bar", "int64", "s", "", "", 1.5, 2.0, True, None, False),
            ("h", "a", "/foo/bar", "dist", "s", "of it", "", 1450370423.25, 7.0, True, [1.0, 2.5], True),
            ("h", "a", "/foo/bar", "dist", "s", "of it", "", 1450370424.0, 0.0, False, [1.0, 2.5], True),
            ("h", "a", "/list", "list", "", "", "string", 3.0, 1.0, True, None, None),
        ],
        "host_name string, app_name string, path string, kind string, unit string, description string, sub_type string, ts double, value double, active boolean, upper_limits array<double>, is_not_cumulative boolean",
    )
    docs = [json.loads(r.document) for r in X.endpoint_metrics(rec).collect()]
    assert [d["path"] for d in docs] == ["/foo/bar", "/foo.bar", "/list"]
    assert docs[0] == {"path": "/foo/bar", "description": "of it", "unit": "s", "kind": "dist", "values": [{"timestamp": "1450370424.000000000", "value": 0.0, "active": False}, {"timestamp": "1450370423.250000000", "value": 7.0, "active": True}], "upperLimits": [1.0, 2.5], "isNotCumulative": True}
    assert docs[1]["bits"] == 64 and "upperLimits" not in docs[1] and docs[2]["subType"] == "string"


def test_distributions_of_dumps(spark, tmp_path):
    value = {"sum": 12.5, "count": 6, "generation": 3, "isNotCumulative": True, "ranges": [{"lower": 0, "upper": 10, "count": 1}, {"lower": 10, "upper": 20, "count": 2}, {"lower": 20, "count": 3}]}
    (tmp_path / "d.json").write_text(json.dumps([{"path": "/d", "kind": "dist", "value": value}, {"path": "/e", "kind": "dist", "value": "no distribution"}]))
    got = {r.path: r.value_dist for r in readers.read_metrics_json(spark, str(tmp_path / "d.json")).collect()}
    assert got["/d"].asDict() == {"upper_limits": [10.0, 20.0], "counts": [1, 2, 3], "sum": 12.5, "generation": 3, "is_not_cumulative": True}
    assert got["/e"] is None


def test_last_left_series_is_divided(spark):
    schema = "name string, tags map<string,string>, ts long, value double"
    a = spark.createDataFrame([("m", {"h": "1"}, 10, 4.0), ("m", {"h": "1"}, 20, 8.0), ("m", {"h": "2"}, 10, 6.0)], schema)
    b = spark.createDataFrame([("m", {"h": "1"}, 10, 100.0)], schema)
    right = spark.createDataFrame([("m", {"h": "1"}, 10, 2.0), ("m", {"h": "1"}, 20, 2.0), ("m", {"h": "2"}, 10, 2.0)], schema)
    rows = sorted((r.tags["h"], r.ts, r.value) for r in M.divide_series([a, b], right).collect())
    assert rows == [("1", 10, 50.0), ("2", 10, 3.0)]


def test_history_keeps_one_earlier_change(spark):
    rows = [("h", "a", p, 0, float(t), float(t)) for p, times in (("/x", (1, 5, 9, 12, 20)), ("/y", (3,)), ("/z", (30,))) for t in times]
    changes = spark.createDataFrame(rows, "host_name string, app_name string, path string, group_id int, ts double, value double")
    assert sorted((r.path, r.ts) for r in S.history(changes, 9, 20).collect()) == [("/x", 9), ("/x", 12), ("/y", 3)]
    assert sorted((r.path, r.ts) for r in S.history(changes, 8, 20).collect()) == [("/x", 5), ("/x", 9), ("/x", 12), ("/y", 3)]


def test_refused_polls_change_nothing():
    row = lambda path, ts=None, kind="int64", group=0: {"path": path, "group_id": group, "ts": ts, "batch_ts": 1.0, "value": 1.0, "kind": kind}
    for bad in ([row("/b"), row("/a")], [row("/a"), row("/a")], [row("/a", kind="complex")], [row("/a", 1.0), row("/b", 2.0)]):
        state = {"groups": {}, "metrics": {}}
        assert ingest_batch(state, bad) == [] and state == {"groups": {}, "metrics": {}}
    state = {"groups": {}, "metrics": {}}
    good = [row("/foo/bar", 1.0), row("/foo.bar"), row("/z", 2.0, group=1)]
    assert [c["path"] for c in ingest_batch(state, good)] == ["/foo/bar", "/foo.bar", "/z"]


def test_table_of_downsamples(spark):
    specs = ["15m-avg-zero", "", "1h30m-sum-odd", "90s-count-null", "250ms-max"]
    got = [(r.seconds, r.aggregator, r.fill) for r in P.parse_downsamples(spark.createDataFrame([(x,) for x in specs], "spec string")).collect()]
    assert got == [P.parse_downsample(x) or (None, None, None) for x in specs]
    for bad in ("15m", "15x-avg", "-avg"):
        with pytest.raises(Exception, match="no downsample"):
            P.parse_downsamples(spark.createDataFrame([(bad,)], "spec string")).collect()


def test_epochs_and_frames(spark):
    df = spark.createDataFrame([(-3601.0, 7), (7199.9, 149)], "ts double, whole int")
    got = [tuple(r) for r in df.select(C.to_epoch("ts", "h"), C.to_epoch("ts", "m"), C.frame_id("whole", 300)).collect()]
    assert got == [(-1, -60, 0.0), (1, 119, 0.0)]
    assert df.select(C.to_epoch("ts", "h").alias("h"), C.frame_id("whole", 300).alias("f")).dtypes == [("h", "bigint"), ("f", "double")]


def test_ranges_and_columns_reach_the_scan(spark):
    plan = metric_queries._query(spark, DATA, metric_queries.Q.Query("/events/value", adapters.START, adapters.END, adapters.STEP, fill="nan"))._jdf.queryExecution().executedPlan().toString()
    ranges = [line for line in plan.split("\n") if "GreaterThanOrEqual(ts," in line and "LessThan(ts," in line]
    assert ranges and all("props" not in line.split("ReadSchema")[1] for line in ranges)


def test_large_unsigned_values_survive(spark, tmp_path):
    big, over = 2**64 - 1, 2**64
    (tmp_path / "m.json").write_text(json.dumps([{"path": p, "kind": "uint64", "value": v, "timestamp": 1.0} for p, v in (("/a", big), ("/b", 2**63), ("/c", 5), ("/d", over), ("/e", -1))]))
    got = readers.read_metrics_json(spark, str(tmp_path / "m.json"))
    values = {r.path: (r.value_long, None if r.value_unsigned is None else int(r.value_unsigned)) for r in got.collect()}
    assert values == {"/a": (None, big), "/b": (None, 2**63), "/c": (5, None), "/d": (None, None), "/e": (-1, None)}
    rec = got.where("path in ('/a', '/c')").selectExpr("'h' AS host", "path", "map('appname', 'a') AS tags", "ts", "kind", "unit", "value_double", "value_long", "value_bool", "value_string", "value_unsigned")
    put = sorted((json.loads(r.payload) for r in X.to_tsdb_put(rec).collect()), key=lambda p: p["metric"])
    assert [p["value"] for p in put] == [big, 5]
    assert sorted(json.loads(r.payload)["value"] for r in X.to_json_payload(rec, "t", "k").collect()) == [5.0, float(big)]


def test_values_that_json_does_not_have(spark):
    rows = [("/a", float("nan")), ("/b", float("inf")), ("/c", float("-inf")), ("/d", 1.5), ("/e", 1e300)]
    rec = spark.createDataFrame([("h", p, {"appname": "a"}, 1.0, "float64", "", v, None, None, None) for p, v in rows], "host string, path string, tags map<string,string>, ts double, kind string, unit string, value_double double, value_long long, value_bool boolean, value_string string")
    strict = lambda text: json.loads(text, parse_constant=lambda c: pytest.fail(c))
    assert {p["name"]: p["value"] for p in (strict(r.payload) for r in X.to_json_payload(rec, "t", "k").collect())} == {"/a": None, "/b": None, "/c": None, "/d": 1.5, "/e": 1e300}
    assert sorted(strict(r.payload)["value"] for r in X.to_tsdb_put(rec).collect()) == [1.5, 1e300]
    points = spark.createDataFrame([("s", float(i), v) for i, (_, v) in enumerate(rows)], "s string, ts double, value double")
    assert strict(Q.series_to_json(points, ["s"]).first().series) == {"3": 1.5, "4": 1e300}
