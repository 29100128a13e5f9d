"""State of many keys at a time: few calls whatever the number of keys, and the results of one key at a time."""

import random

import pandas as pd

from test_streams import listed, plain, polls

from gaugeflow.streaming import frames, ingest, parts


class Handle:
    """State in dicts, which counts what is asked of it."""

    def __init__(self):
        self.calls, self.tables, self.timers = 0, {}, set()

    def getMapState(self, name, key, value):
        return MapState(self, self.tables.setdefault(name, {}))

    def getValueState(self, name, schema):
        return ValueState(self, self.tables.setdefault(name, {}))

    def registerTimer(self, at):
        self.timers.add(at)


class MapState:
    def __init__(self, handle, table):
        self.handle, self.table = handle, table

    def exists(self):
        return bool(self.table)

    def getValue(self, key):
        self.handle.calls += 1
        return self.table.get(key)

    def updateValue(self, key, value):
        self.handle.calls += 1
        self.table[key] = value

    def iterator(self):
        return iter(list(self.table.items()))


class ValueState(MapState):
    def get(self):
        return self.table[0]

    def update(self, value):
        self.table[0] = value

    def clear(self):
        self.table.clear()


def records(n_keys, seed, lo, hi):
    rng, rows = random.Random(seed), []
    for k in range(n_keys):
        for _ in range(rng.randrange(1, 5)):
            ts = round(rng.uniform(lo, hi), 2)
            rows.append((f"h{k}", "a", 0, "/v", ts, "float64", float(rng.randrange(9)), None, rng.random() < 0.9, True, float((ts + 5) // 10 * 10), 10.0, k % parts.CHUNKS))
    return pd.DataFrame(rows, columns=["host_name", "app_name", "group_id", "path", "ts", "kind", "value", "value_string", "active", "numeric", "frame", "period", "chunk"])


def run(batches, split, timeout=None):
    """The frames that a processor gives, with the rows of a micro-batch handed over together or key by key; and its handle."""
    handle, processor, out = Handle(), frames.RollupFrames(timeout), []
    processor.init(handle)
    for b in batches:
        for _, rows in b.groupby("host_name") if split else [(0, b)]:
            out += processor.handleInputRows((0,), iter([rows]), None)
    return sorted((r.host_name, r.ts, r.value) for x in out for r in x.itertuples()), handle


def test_many_keys_at_a_time():
    batches = [records(3000, seed, 20.0 * seed, 20.0 * seed + 35) for seed in range(3)]
    together, handle = run(batches, False)
    assert len(together) > 5000
    assert handle.calls <= 3 * 4 * parts.CHUNKS  # two tables are read and written
    small = [b[b["host_name"].isin([f"h{k}" for k in range(60)])] for b in batches]
    one_by_one, _ = run(small, True)
    keys = {f"h{k}" for k in range(60)}
    assert one_by_one == [r for r in together if r[0] in keys]


def test_only_touched_chunks_are_read_and_written():
    whole = records(3000, 0, 0, 35)
    _, handle = run([whole, whole[whole["host_name"] == "h7"].assign(ts=99.0, frame=100.0)], False)
    assert handle.calls == 4 * parts.CHUNKS + 4


def test_due_frames_close_at_once():
    class At:
        def __init__(self, t):
            self.t = t

        def getExpiryTimeInMs(self):
            return self.t

        def getCurrentWatermarkInMs(self):
            return 1_000_000

    handle, processor = Handle(), frames.RollupFrames(5.0)
    processor.init(handle)
    rows = records(500, 1, 0, 35)
    closed = list(processor.handleInputRows((0,), iter([rows]), None))
    left = [x for t in sorted(handle.timers) for x in processor.handleExpiredTimer((0,), At(t), At(t))]
    assert len(left) == 1 and len(handle.timers) <= 5
    active = rows[rows["active"]]
    assert sum(map(len, closed + left)) == len(active.drop_duplicates(["host_name", "frame"]))
    late = rows.iloc[:1].assign(ts=rows["ts"].max() - 40)
    assert not list(processor.handleInputRows((0,), iter([late]), None))


def test_a_key_with_nothing_but_inactive_records():
    """It has a frame, of which nothing comes."""
    rows = records(1, 3, 0, 5).iloc[:1].assign(active=False)
    out, _ = run([rows, rows.assign(ts=12.0, frame=10.0, active=True), rows.assign(ts=42.0, frame=40.0)], False)
    assert [r[1] for r in out] == [10.0]


def test_endpoints_polled_together_are_the_plain_rule():
    """Endpoints with different numbers of polls, in micro-batches, on state with few calls."""
    hosts = {f"h{i}": polls(500 + i, 2 + i % 23) for i in range(120)}
    every = pd.DataFrame([{"host_name": h, "app_name": "a", "chunk": int(h[1:]) % parts.CHUNKS, **r} for h, rows in hosts.items() for r in rows])
    handle, processor, found = Handle(), ingest.Ingest(None), []
    processor.init(handle)
    for lo in (0, 5, 12):
        batch = every[(every["batch_seq"] >= lo) & (every["batch_seq"] < {0: 5, 5: 12, 12: 99}[lo])].astype({"ts": float, "value": float})
        found += processor.handleInputRows((0,), iter([batch.sample(frac=1, random_state=lo)]), None)
    out = pd.concat(found)
    for h, rows in hosts.items():
        assert sorted(listed(out[out["host_name"] == h])) == plain(rows)
    assert handle.calls <= 3 * 4 * parts.CHUNKS
