"""Series, merges, roll-ups, health, inventories, activity and payloads against hand-computed cases."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import params as P
from gaugeflow.functions import scalars as C
from gaugeflow.model import K
from gaugeflow.operators import endpoints as E
from gaugeflow.operators import export as X
from gaugeflow.operators import health as H
from gaugeflow.operators import inventory as I
from gaugeflow.operators import merge as M
from gaugeflow.operators import monitor as O
from gaugeflow.operators import rollup as R
from gaugeflow.operators import series as S
from gaugeflow.sources import readers
from gaugeflow.streaming.jobs import ingest_batch

OBS = "host_name string, app_name string, batch_seq long, path string, group_id int, ts double, value double"


def obs(spark, rows):
    return spark.createDataFrame([("h", "a", b, p, g, float(t), float(v)) for b, p, g, t, v in rows], OBS)


def test_latest_of_an_unchanged_value(spark):
    o = obs(spark, [(i, "/x", 0, 100 * i, 357) for i in (1, 2, 3)]).withColumn("active", F.lit(True))
    changes = S.compress_changes(o)
    assert changes.count() == 1
    dense = S.densify(changes, o)
    assert [(r.ts, r.value) for r in S.latest(dense).collect()] == [(300, 357)]


def test_inactive_marker_and_history(spark):
    rows = [(0, 1000, 3), (1, 1010, 13), (2, 1020, 23), (4, 1040, 43)]
    o = obs(spark, [(b, "/foo/bar", 0, t, v) for b, t, v in rows] + [(b, "/foo/baz", 0, 1000 + 10 * b, 1) for b in range(5)])
    marks = S.mark_inactive(o).withColumns({"value": F.lit(0.0), "active": F.lit(False)})
    both = o.withColumn("active", F.lit(True)).drop("batch_seq").unionByName(marks)
    bar = S.history(S.compress_changes(both), 1020, 1041).where("path = '/foo/bar'").orderBy(F.desc("ts"))
    assert [(r.ts, r.value, r.active) for r in bar.collect()] == [(1040, 43, True), (1030, 0, False), (1020, 23, True)]


def test_markers_when_a_whole_group_is_absent(spark):
    o = obs(spark, [(i, "/x", 5 if i in (0, 1, 4, 5) else 7, 1000 + 10 * i, 10 * i) for i in range(6)])
    assert sorted(round(r.ts, 3) for r in S.mark_inactive(o).collect()) == [1010.001, 1030.001]


def test_inactivated_endpoint(spark):
    o = obs(spark, [(0, "/bar", 0, 1900, 1), (1, "/bar", 0, 1910, 11), (2, "/bar", 0, 1920, 11)]).withColumn("active", F.lit(True)).drop("batch_seq")
    mark = S.inactivate_endpoints(o, spark.createDataFrame([("h", "a")], "host_name string, app_name string")).withColumns({"value": F.lit(0.0), "active": F.lit(False)})
    changes = S.compress_changes(o.unionByName(mark))
    dense = S.densify(changes, o).orderBy("ts").collect()
    assert [(round(r.ts, 3), r.value, r.active) for r in dense] == [(1900, 1, True), (1910, 11, True), (1920, 11, True), (1920.001, 0, False)]


def test_merge_prefers_the_active_record(spark):
    rec = spark.createDataFrame([("h", "a", "/p", 1, 222.0, 1.0, False), ("h", "a", "/p", 2, 222.0, 2.0, True)], "host_name string, app_name string, path string, group_id int, ts double, value double, active boolean")
    assert [(r.value, r.active) for r in S.merge_grouped(rec).collect()] == [(2.0, True)]


def test_default_group_timestamp(spark):
    rows = [("h", "a", 1, "/x", 0, 1200.0, 1300.0), ("h", "a", 1, "/y", 0, None, 1300.0), ("h", "a", 1, "/z", 1, None, 1300.0)]
    o = spark.createDataFrame(rows, "host_name string, app_name string, batch_seq long, path string, group_id int, ts double, batch_ts double")
    assert {r.path: r.ts for r in S.default_group_ts(o).collect()} == {"/x": 1200, "/y": 1200, "/z": 1300}


def test_streaming_ingest_of_one_endpoint():
    state = {"groups": {}, "metrics": {}}
    row = lambda path, group, ts, value: {"path": path, "group_id": group, "ts": ts, "batch_ts": 1.0, "value": value}
    assert [c["value"] for c in ingest_batch(state, [row("/x", 0, 10.0, 1.0), row("/y", 0, None, 5.0)])] == [1.0, 5.0]
    assert ingest_batch(state, [row("/x", 0, 9.0, 7.0), row("/y", 0, None, 8.0)]) == []  # late
    out = ingest_batch(state, [row("/x", 0, 20.0, 1.0)])
    assert out == [{"path": "/y", "group_id": 0, "ts": 20.0, "value": 0.0, "active": False}]
    out = ingest_batch(state, [row("/z", 1, 30.0, 2.0)])
    assert [(c["path"], c["ts"], c["active"]) for c in out] == [("/z", 30.0, True), ("/x", 20.001, False)]
    assert [(c["value"], c["active"]) for c in ingest_batch(state, [row("/x", 0, 40.0, 1.0), row("/z", 1, 40.0, 2.0)])] == [(1.0, True)]


def points(spark, rows):
    return spark.createDataFrame([("m", {"host": "h"}, t, v) for t, v in rows], "name string, tags map<string,string>, ts long, value double")


def rows_of(df):
    return sorted((r.ts, r.value) for r in df.collect())


def test_divide(spark):
    l, r = points(spark, [(13000, 92.6), (13100, 38.4), (13200, 46.5), (13300, 66.0)]), points(spark, [(13100, 0.0), (13200, 3.0), (13300, 4.0), (13400, 5.3)])
    assert rows_of(M.divide_series(l, r)) == [(13100, None), (13200, 15.5), (13300, 16.5)]


def test_sum_and_merge(spark):
    a, b = points(spark, [(1, 1.0), (2, None), (3, 3.0)]), points(spark, [(2, 2.0), (3, 4.0), (4, 5.0)])
    assert rows_of(M.sum_series(a, b)) == [(1, 1.0), (2, None), (3, 7.0), (4, 5.0)]
    assert rows_of(M.merge_series(a, b)) == [(1, 1.0), (2, 2.0), (3, 4.0), (4, 5.0)]
    assert rows_of(M.merge_series(M.merge_series(a, b), b)) == rows_of(M.merge_series(a, b))
    with pytest.raises(ValueError, match="differing columns"):
        M.merge_series(a, b.drop("value"))


def test_merge_preferred(spark):
    a = points(spark, [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)])
    assert rows_of(M.merge_preferred(a, points(spark, [(1, 0.0), (2, None), (3, 9.0), (4, 0.0), (5, None)]))) == [(1, 1.0), (2, 2.0), (3, 9.0), (4, 0.0), (5, None)]
    assert rows_of(M.merge_preferred(a, points(spark, [(1, 0.0), (2, None)]))) == rows_of(a)


def test_rollup(spark):
    rows = [("h", "a", "/i", 0, float(t), "int64", float(v), None, True) for t, v in ((0, 1), (10, 2), (20, 2), (60, 5), (120, 9), (240, 1))]
    rows += [("h", "a", "/s", 0, float(t), "string", None, v, True) for t, v in ((0, "hello"), (10, "bee"), (60, "long"), (120, "x"), (240, "y"))]
    rec = spark.createDataFrame(rows, "host_name string, app_name string, path string, group_id int, ts double, kind string, value double, value_string string, active boolean")
    out = {(r.path, r.ts): r.value if r.path == "/i" else r.value_string for r in R.rollup(rec, 120).collect()}
    assert out == {("/i", 0): 2, ("/i", 120): 7, ("/s", 0): "hello", ("/s", 120): "long"}


def test_reader_positions(spark):
    progress = spark.createDataFrame([("a", "h", "a", 0, 5.0)], "reader string, host_name string, app_name string, group_id int, position double")
    rec = obs(spark, [(i, "/x", 0, i, i) for i in range(10)])
    assert R.unread(rec, progress, "a").count() == 4
    assert R.unread(rec, R.copy_position(progress, "a", "b"), "b").count() == 4
    assert R.unread(rec, R.start_at_beginning(progress, "a"), "a").count() == 10
    assert [r.position for r in R.commit(progress, "a", rec).collect()] == [9.0]


def test_health(spark):
    rows = [("/sys/memory/available", "uint64", None, 3210000), ("/sys/memory/total", "uint64", None, 4000000), ("/sys/sched/cpu/user-time-fraction", "float64", 0.0625, None)]
    rows += [("/sys/fs/METRICS/size", "uint64", None, 10), ("/sys/fs/METRICS/free", "uint64", None, 8), ("/sys/fs/boot/METRICS/free", "uint64", None, 3), ("/sys/fs/mnt/METRICS/size", "uint64", None, 6), ("/sys/fs/mnt/METRICS/free", "uint64", None, 5)]
    o = spark.createDataFrame([("h", "a", 1, 0.0, *r) for r in rows], "host_name string, app_name string, batch_seq long, ts double, path string, kind string, value_double double, value_long long")
    s = H.instance_stats(o)
    p = H.health_percents(s).first()
    assert (p.cpu_percent, round(p.memory_percent, 6)) == (6.25, 19.75)
    assert [tuple(f) for f in H.combine_fs(s).first().fss] == [("/", 16, 13)]
    assert sorted(r.mount_point for r in H.file_systems(o).collect()) == ["/", "/boot", "/mnt"]


def test_pack_batches_splits_a_large_snapshot(spark):
    snaps = spark.createDataFrame([("h", 1.0, 50), ("h", 2.0, 50), ("h", 3.0, 1000), ("h", 4.0, 1)], "host string, ts double, n_fs int")
    out = sorted(H.pack_batches(snaps, ["host"]).collect(), key=lambda r: (r.batch, r.ts, r.fs_from))
    points_ = {}
    for r in out:
        points_[r.batch] = points_.get(r.batch, 0) + 9 * r.fs_count + 12 * r.with_instance
    assert max(points_.values()) <= 1000
    big = [r for r in out if r.ts == 3.0]
    assert [(r.fs_from, r.fs_count) for r in big][:2] == [(0, 109), (109, 111)]
    assert sum(r.fs_count for r in big) == 1000
    assert [r.with_instance for r in big] == [True] + [False] * (len(big) - 1)
    assert out[0].batch == 0 and out[1].batch == 0 and big[0].batch == 1


def test_packages(spark):
    rows = [("/sys/cloud/aws/instance-id", "string", None, "i-1"), ("/sys/packages/debs/apt/size", "uint64", 5, None), ("/sys/packages/debs/apt/version", "string", None, "1.2"), ("/sys/packages/debs/b.c/other", "string", None, "x"), ("/sys/packages/debs/bad/size", "int64", 7, None), ("/sys/packages/rpms/z/size", "uint64", 1, None), ("/sys/packages/debs/apt/size/more", "uint64", 9, None)]
    o = spark.createDataFrame([("h", "a", 1, float(i), *r) for i, r in enumerate(rows)], "host_name string, app_name string, batch_seq long, ts double, path string, kind string, value_long long, value_string string")
    inv = I.package_inventory(o)
    got = inv.first()
    assert (got.instance_id, got.mgmt, got.ts) == ("i-1", "debs", 1.0)
    assert [tuple(p) for p in got.packages] == [("apt", "1.2", 5), ("b.c", "", 0), ("bad", "", 0)]
    body = json.loads(I.inventory_to_json(inv).first().body)
    assert body["pkgMgmtType"] == "debs" and body["installed"]["b_c"] == {"version": "", "size": 0}
    assert I.package_inventory(o, "given").first().instance_id == "given"


def test_application_activity(spark):
    reports = spark.createDataFrame([("h", i) for i in range(1, 7)], "host_name string, seq_no long")
    listed = spark.createDataFrame([("h", i, "a") for i in range(1, 7)] + [("h", 1, "dominator"), ("h", 6, "dominator"), ("h", 1, "health agent")], "host_name string, seq_no long, app_name string")
    out = E.app_activity(reports, listed, 3)
    assert [r.active for r in out.where("app_name = 'dominator'").orderBy("seq_no").collect()] == [True, True, True, False, False, True]
    assert all(r.active for r in out.where("app_name = 'health agent'").collect())


def test_added_application(spark):
    apps = "array<struct<app_name:string,port:int,is_tls:boolean>>"
    latest = spark.createDataFrame([("h", 4, [("x", 1, False)])], f"host_name string, seq_no long, apps {apps}")
    extra = spark.createDataFrame([("h", "y", 1, False), ("h", "z", 2, True), ("new", "z", 2, True)], "host_name string, app_name string, port int, is_tls boolean")
    out = {r.host_name: (r.seq_no, [a.app_name for a in r.apps]) for r in E.add_application(latest, extra).collect()}
    assert out == {"h": (4, ["x", "z"]), "new": (1, ["z"])}


def test_leases(spark):
    rec = obs(spark, [(i, "/x", 0, 200 + 10 * i, 1) for i in range(30)])
    leases = spark.createDataFrame([("me", 300.0, 350.0), ("me", 440.0, 1000.0), ("you", 0.0, 1000.0)], "owner string, start double, end double")
    inside, skipped = O.lease_filter(rec, leases, "me")
    assert inside.count() == 5 + 6
    assert skipped.first().skipped == 10 + 9


def test_many_leases(spark):
    """150,000 leases of one owner, of which one is long and one is empty, over several ranges of times."""
    rec = spark.range(-5, 2000).selectExpr("cast(id * 77 + 0.5 AS double) AS ts", "id").unionByName(spark.createDataFrame([(None, -9), (77.5, -8)], "ts double, id long"))
    leases = spark.range(150_000).selectExpr("'me' AS owner", "cast(id AS double) AS start", "id + CASE WHEN id = 1000 THEN 5000 WHEN id % 3 = 0 THEN 1 ELSE 0 END AS end")
    leases = leases.unionByName(spark.createDataFrame([("me", 200_000.0, 1.0), ("me", None, 9.0), ("me", 1.0, None), ("you", 0.0, 1e9)], "owner string, start double, end double"))
    spans = [x for x in [*range(-5, 2000), -8] for t in [77 * (1 if x == -8 else x)] if 1000 <= t < 6000 or 0 <= t < 150_000 and t % 3 == 0]
    inside, skipped = O.lease_filter(rec, leases, "me")
    assert inside.columns == rec.columns
    assert sorted(r.id for r in inside.collect()) == sorted(spans)
    assert skipped.first().skipped == 2006 - len(spans)
    nothing, none = O.lease_filter(rec, leases, "nobody")
    assert nothing.count() == 0 and none.first().skipped == 0


def test_escapes(spark):
    df = spark.createDataFrame([("mo town",), ("_a_b_c_",)], "x string")
    assert [r[0] for r in df.select(C.tsdb_escape("x")).collect()] == ["mo_20town", "_5Fa_5Fb_5Fc_5F"]
    df = spark.createDataFrame([("x_2by",), ("_9",), ("_zz_41",)], "x string")
    assert [r[0] for r in df.select(C.tsdb_unescape("x")).collect()] == ["x+y", "_9", "_zzA"]
    assert C.unescape("x_2by") == "x+y"


def test_json_payload(spark):
    rows = [("bool", "", None, None, True, None), ("uint64", "", None, 13579, None, None), ("float64", "", -79.236, None, None, None), ("time", "", 1450370423.0, None, None, None), ("duration", "s", -60.12, None, None, None), ("duration", "ms", -60.12, None, None, None), ("string", "", None, None, None, "x" * 150)]
    rec = spark.createDataFrame([("h", "/p/q", {"appname": "a"}, 1450370423.5, *r) for r in rows], "host string, path string, tags map<string,string>, ts double, kind string, unit string, value_double double, value_long long, value_bool boolean, value_string string")
    got = [json.loads(r.payload) for r in X.to_json_payload(rec, "t", "k", slashes_to_underscores=True).collect()]
    assert [g["value"] for g in got] == [1.0, 13579.0, -79.236, 1450370423.0, -60.12, -60120.0, 0.0]
    assert got[6]["stringValue"] == "x" * 100 and "stringValue" not in got[0]
    assert got[0]["@timestamp"] == "2015-12-17T16:40:23.500Z" and got[0]["name"] == "_p_q" and got[0]["appname"] == "a"


def test_shifted_duplicates(spark):
    rec = spark.createDataFrame([("b", "/x", i, 0.001 * t) for i, t in enumerate((5, 5, 6, 5, 9))], "batch string, path string, seq int, ts double")
    assert [r.ms for r in X.shift_duplicates(rec).orderBy("seq").collect()] == [5, 6, 7, 8, 9]


def test_batch_validation(spark):
    cols = "host_name string, app_name string, batch_seq long, seq int, path string, kind string, group_id int, ts double"
    batch = lambda *rows: spark.createDataFrame([("h", "a", 1, i, *r) for i, r in enumerate(rows)], cols)
    good = batch(("/netstat/foo", "int64", 0, 1.0), ("/netstat.0/foo", "int64", 0, 1.0))
    assert S.verify_batches(good, ["int64"]).count() == 0
    bad = batch(("/b", "int64", 0, 1.0), ("/a", "int64", 0, 2.0), ("/c", "complex", 1, 1.0), ("/c", "int64", 1, 1.0))
    assert sorted(r.violation for r in S.verify_batches(bad, ["int64"]).collect()) == ["duplicate", "kind", "timestamps", "unsorted"]


def test_parameters():
    assert P.parse_downsample("15m-avg-zero") == (900.0, "avg", "zero")
    assert P.parse_downsample("") is None
    assert P.parse_downsample("1h-sum-odd")[2] == "none"
    with pytest.raises(ValueError):
        P.parse_downsample("15m")
    assert P.guard_range(0, 100_000, 10, 20) == (80_000, 100_000, 20)
    with pytest.raises(ValueError):
        P.guard_range(0, 100_000, 10, 20, move_start=False)


def test_rollover_of_distributions(spark):
    dist = "struct<upper_limits:array<double>,counts:array<bigint>,sum:double,generation:bigint,is_not_cumulative:boolean>"
    rows = [([1.0], 1), ([1.0], 2), ([2.0], 2), ([2.0], 3), ([2.0], 1), ([2.0], 1)]
    df = spark.createDataFrame([("h", "a", "/d", float(i), (u, [1, 2], 0.0, g, False)) for i, (u, g) in enumerate(rows)], f"host_name string, app_name string, path string, ts double, dist {dist}")
    assert [r.roll_over_count for r in O.dist_rollover(df).orderBy("ts").collect()] == [1, 1, 2, 2, 3, 3]


def test_read_metrics_json(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"path": "/a", "kind": "int64", "value": 5, "timestamp": 1.5, "groupId": 2}, {"path": "/b", "kind": "list", "subType": "string", "value": ["x", "y"]}, {"path": "/c", "kind": "bool", "value": True}]))
    got = {r.path: r for r in readers.read_metrics_json(spark, str(tmp_path / "m.json")).collect()}
    assert (got["/a"].value_long, got["/a"].ts, got["/a"].group_id) == (5, 1.5, 2)
    assert got["/b"].value_list == ["x", "y"] and got["/c"].value_bool is True


def test_empty_tables(spark):
    o = obs(spark, []).withColumn("active", F.lit(True))
    assert S.compress_changes(o).count() == S.mark_inactive(o).count() == S.latest(o).count() == 0
    assert R.rollup(o.withColumns({"kind": F.lit("int64"), "value_string": F.lit("")}), 60).count() == 0
    assert K == ["host_name", "app_name"]
