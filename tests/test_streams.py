"""Streams in several micro-batches: frames closed by their own group, periods of machines, ingest on typed state."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import rollup as R
from gaugeflow.streaming import frames, ingest, jobs

RECORDS = "host_name string, app_name string, group_id int, path string, ts double, kind string, value double, value_string string, active boolean"


def stream_of(spark, tmp_path, schema, batches):
    """A stream with one micro-batch for each list of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i:02d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in*"))


def records(seed):
    """A fast group, which runs to 3,000 s, and a slow one, which reaches 400 s in the same micro-batches."""
    rng, batches = random.Random(seed), []
    for k in range(3):
        rows = []
        for host, speed in (("fast", 1000.0), ("slow", 130.0), ("other", 500.0)):
            for _ in range(12):
                ts = round(speed * (k + rng.random()), 2)
                for path, kind in (("/i", "int64"), ("/f", "float64"), ("/s", "string")):
                    if rng.random() < 0.8:
                        rows.append((host, "a", 0, path, ts, kind, None if kind == "string" else round(rng.uniform(0, 9), 2), f"v{ts}" if kind == "string" else None, rng.random() < 0.9))
        batches.append(rows)
    return batches


def shown(df):
    return sorted((r.host_name, r.path, r.ts, r.kind, None if r.value is None else round(r.value, 6), r.value_string) for r in df.collect())


def test_groups_close_their_own_frames(spark, tmp_path):
    batches = records(1)
    s = stream_of(spark, tmp_path, RECORDS, batches)
    out = jobs.to_parquet(frames.stream_group_rollup(s, 60), str(tmp_path / "out"))
    every = spark.createDataFrame([r for b in batches for r in b], RECORDS)
    assert shown(out) == shown(R.rollup(every, 60))
    assert {r.host_name for r in out.collect()} == {"fast", "slow", "other"}


def test_silent_groups_time_out(spark, tmp_path):
    batches = records(2)
    late = [("slow", "a", 0, "/i", 380.0, "int64", 7.0, None, True)]
    s = stream_of(spark, tmp_path, RECORDS, [*batches, [("fast", "a", 0, "/i", 9000.0, "int64", 1.0, None, True)], late])
    got = shown(jobs.to_parquet(frames.stream_group_rollup(s, 60, timeout=3500.0), str(tmp_path / "out")))
    # The fast group's newest frame but one is closed by its row at 9,000, the others' newest by the timeout; after that the slow one's row is late.
    every = spark.createDataFrame([r for b in batches for r in b], RECORDS)
    ends = every.select("host_name", "app_name", "group_id", "path", F.lit(1e6).alias("ts"), "kind", "value", "value_string", F.lit(False).alias("active"))
    assert got == shown(R.rollup(every.unionByName(ends), 60))


STATS = "account string, instance string, region string, ts double, period int, user_time_fraction double, memory_free long, memory_total long, fss array<struct<mount_point:string,size:long,free:long>>"


def test_machines_have_their_own_periods(spark, tmp_path):
    rng, batches = random.Random(3), []
    for k in range(3):
        rows = []
        for machine, period in (("hourly", 3600), ("five", 300), ("changing", 3600 if k < 1 else 300)):
            for i in range(20):
                ts = 4000.0 * k + 200.0 * i + rng.random()
                free = rng.choice([None, rng.randrange(1000)])
                rows.append(("a", machine, "r", ts, period, rng.random(), free, 1000, [("/", 100, rng.randrange(100)), ("/boot", None, 5)]))
        batches.append(rows)
    s = stream_of(spark, tmp_path, STATS, batches)
    out = jobs.to_parquet(frames.stream_machine_rollup(s), str(tmp_path / "out")).toPandas()
    mounts = jobs.to_parquet(frames.stream_machine_fs_rollup(stream_of(spark, tmp_path / "again", STATS, batches)), str(tmp_path / "out2")).toPandas()
    flat = pd.DataFrame([r[:8] for b in batches for r in b], columns=["account", "instance", "region", "ts", "period", "cpu", "free", "total"])
    flat["frame"] = np.floor(flat.ts / flat.period + 0.5) * flat.period
    flat["open"] = list(zip(flat.frame, flat.period))
    last = flat.loc[flat.groupby("instance").ts.idxmax()].set_index("instance")["open"]
    flat = flat[flat["open"] != flat["instance"].map(last)]
    expected = flat.groupby(["instance", "period", "frame"]).agg(n=("free", "count"), lo=("free", "min"), total=("free", "sum"), cpu=("cpu", "sum")).reset_index()
    got = sorted((r.instance, r.ts, r.memory_free_count, None if pd.isna(r.memory_free_min) else r.memory_free_min, 0 if pd.isna(r.memory_free_sum) else r.memory_free_sum, round(r.cpu_sum, 4)) for r in out.itertuples())
    assert got == sorted((r.instance, int(r.frame), r.n, None if pd.isna(r.lo) else r.lo, r.total, round(100 * r.cpu, 4)) for r in expected.itertuples())
    assert set(mounts["mount_point"]) == {"/"} and len(mounts) == len(expected) and (mounts["size_max"] == 100).all()


def polls(seed, n=60):
    """Two groups, late polls, refused polls, missing and null values, a metric that comes late for the first time."""
    rng, rows = random.Random(seed), []
    for b in range(n):
        t, own = 10.0 * b - (45.0 if rng.random() < 0.15 else 0.0), {}
        names = [p for p in ("/a", "/b", "/b.c", "/b/c", "/z/1") if rng.random() < 0.75]
        names.sort(key=lambda p: p.lstrip("/").split("/"))
        if rng.random() < 0.1:
            names = names[::-1]
        for i, p in enumerate(names):
            g = 1 if p.startswith("/z") else 0
            own.setdefault(g, None if rng.random() < 0.3 else t)
            ts = own[g] if rng.random() > 0.03 else t + 1
            rows.append({"batch_seq": b, "seq": i, "path": p, "group_id": g, "ts": ts, "batch_ts": t + 0.5, "kind": "odd" if rng.random() < 0.02 else "float64", "value": rng.choice([1.0, 1.0, 2.0, None])})
    return rows


def plain(rows):
    state, out = {"groups": {}, "metrics": {}}, []
    for b in sorted({r["batch_seq"] for r in rows}):
        out += jobs.ingest_batch(state, [r for r in rows if r["batch_seq"] == b])
    return sorted(repr((r["path"], r["group_id"], round(r["ts"], 6), r["value"], r["active"])) for r in out)


def as_frame(rows):
    return pd.DataFrame(rows).astype({"ts": float, "value": float})


def listed(out):
    return [repr((r.path, r.group_id, round(r.ts, 6), None if pd.isna(r.value) else r.value, r.active)) for r in out.itertuples()]


@pytest.mark.parametrize("seed", range(12))
def test_polls_as_arrays_are_the_plain_rule(seed):
    """In micro-batches of any size, with the state carried over; only what changes is written."""
    rows, metrics, groups, found = polls(seed), {}, {}, []
    rng, at = random.Random(seed), 0
    while at < 60:
        size = rng.choice([1, 1, 3, 20])
        state = ingest.EndpointState(metrics, groups)
        part = [r for r in rows if at <= r["batch_seq"] < at + size]
        if part:
            found += listed(state.polls(as_frame(part)))
        number = lambda x: None if np.isnan(x) else float(x)
        for i in np.flatnonzero(state.dirty):
            metrics[state.keys[i]] = (number(state.value[i]), bool(state.active[i]), number(state.late[i]))
        assert all(metrics[k][:2] == (number(state.value[i]), bool(state.active[i])) for i, k in enumerate(state.keys) if state.known[i])
        groups.update({g: state.groups[g] for g in state.moved})
        at += size
    assert sorted(found) == plain(rows)


def test_unchanged_metrics_are_not_written():
    rows = [{"batch_seq": b, "seq": i, "path": f"/m{i:02d}", "group_id": 0, "ts": float(b), "batch_ts": 0.0, "value": 1.0} for b in range(3) for i in range(50)]
    first = ingest.EndpointState({}, {})
    first.polls(as_frame(rows[:100]))
    held = {k: (float(first.value[i]), bool(first.active[i]), None) for i, k in enumerate(first.keys)}
    second = ingest.EndpointState(held, first.groups)
    changed = [*rows[100:149], {**rows[149], "value": 2.0}]
    assert len(second.polls(as_frame(changed))) == second.dirty.sum() == 1


def test_streamed_ingest_over_micro_batches(spark, tmp_path):
    schema = "host_name string, app_name string, batch_seq long, seq int, path string, group_id int, ts double, batch_ts double, kind string, value double"
    hosts = {f"h{i}": polls(100 + i, 30) for i in range(3)}
    batches = [[(h, "a", *[r[c] for c in ("batch_seq", "seq", "path", "group_id", "ts", "batch_ts", "kind", "value")]) for h, rows in hosts.items() for r in rows if r["batch_seq"] // 10 == k] for k in range(3)]
    out = jobs.to_parquet(jobs.stream_ingest(stream_of(spark, tmp_path, schema, batches)), str(tmp_path / "out")).toPandas()
    for h, rows in hosts.items():
        assert sorted(listed(out[out.host_name == h])) == plain(rows)


def test_inactive_metrics_can_be_forgotten(spark, tmp_path):
    schema = "host_name string, app_name string, batch_seq long, path string, group_id int, ts double, batch_ts double, value double"
    row = lambda b, path, ts: ("h", "a", b, path, 0, ts, 0.0, 1.0)
    batches = [[row(0, "/x", 1.0), row(0, "/y", 1.0)], [row(1, "/x", 100.0)], [row(2, "/x", 300.0)], [row(3, "/x", 310.0)], [row(4, "/x", 250.0), row(4, "/y", 250.0)]]
    out = jobs.to_parquet(jobs.stream_ingest(stream_of(spark, tmp_path, schema, batches), keep=150.0), str(tmp_path / "out"))
    # /y is new again, so that its value may be late.
    assert sorted((r.path, r.ts, r.active) for r in out.collect()) == [("/x", 1.0, True), ("/y", 1.0, True), ("/y", 100.0, False), ("/y", 250.0, True)]
