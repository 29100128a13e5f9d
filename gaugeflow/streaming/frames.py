"""Streamed roll-ups whose frames are closed by each key's own later data, not by a watermark over all keys.

A key (an endpoint's timestamp group, a machine) has one open frame. Its partial results are keyed state with a schema: a row for
each metric or mount. Keys are worked on many at a time (`parts`). Data of another frame of the key closes it: it is emitted and its state cleared. So a
slow key is not cut off by a fast one, and a fast key does not wait. With a timeout, a key that falls silent closes its frame by
an event-time timer, once some key's frame ends that much later; data of that frame or an earlier one is late then.

Data of closed frames is left out. Rows of a key in one micro-batch are put in order of time first, so that a micro-batch can span
many frames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gaugeflow.functions.scalars import FRACTIONS, is_numeric
from gaugeflow.model import INTEGER_KINDS, K
from gaugeflow.operators.health import INSTANCE, fs_used, health_percents, used_percent
from gaugeflow.streaming.parts import Chunks, dealt

#: Stateful operators with several state variables need this store.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Frames(StatefulProcessor):
    """The open frames of a part's keys. Subclasses say what a row's partial results are (`partial`, with the rows' index), how those of one run and sub-key are put together (`merged`) and what a closed frame gives (`closed`, a row for each part)."""

    #: Columns of the key with their types, and the schema of one partial result.
    key_schema: str
    schema: str

    def __init__(self, timeout: float | None):
        self.timeout = timeout

    def init(self, handle) -> None:
        self.handle = handle
        self.keys = [c.split()[0] for c in self.key_schema.split(", ")]
        self.names = [c.split()[0] for c in self.schema.split(", ")]
        self.open = Chunks(handle, "open", f"{self.key_schema}, frame double, period double, last double, closed boolean")
        # owner: the place of the key among those of its chunk.
        self.parts = Chunks(handle, "parts", f"owner bigint, {self.schema}")
        self.earliest = handle.getValueState("earliest", "due bigint")

    def partial(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def merged(self, parts: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def closed(self, parts: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def _emit(self, keys: pd.DataFrame, frame: np.ndarray, parts: pd.DataFrame) -> pd.DataFrame:
        """Closed frames: keys and frame of each row of parts."""
        return self.closed(parts.reset_index(drop=True)).assign(**{c: keys[c].to_numpy() for c in self.keys}, ts=frame)

    @staticmethod
    def _owners(keys: pd.DataFrame, parts: pd.DataFrame) -> np.ndarray:
        """The row of keys that each part belongs to; both as read, in the order of chunks."""
        return np.searchsorted(keys["chunk"].to_numpy(), parts["chunk"].to_numpy(), "left") + parts["owner"].to_numpy(np.int64)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        chunks = np.unique(rows["chunk"])
        held, kept = self.open.read(chunks), self.parts.read(chunks)
        # Keys by number: those held first, in their order.
        named = [*self.keys, "chunk"]
        every = pd.concat([held[named], rows[named]], ignore_index=True) if len(held) else rows[named]
        number = every.groupby(self.keys, sort=False, dropna=False).ngroup().to_numpy()
        keys = every.iloc[np.unique(number, return_index=True)[1]].reset_index(drop=True)
        own, n = number[len(held) :], len(keys)
        frame, period, last, closed = (np.concatenate([held[c].to_numpy(kind), np.full(n - len(held), fill, kind)]) for c, fill, kind in (("frame", np.nan, float), ("period", np.nan, float), ("last", -np.inf, float), ("closed", False, bool)))
        of, ts = rows["frame"].to_numpy(float), rows["ts"].to_numpy(float)
        to = rows["period"].to_numpy(float)
        inside = (of == frame[own]) & (to == period[own])
        good = np.where(closed[own], (ts > last[own]) & ~inside, inside | (ts >= last[own]) | np.isnan(frame[own]))
        at = np.flatnonzero(good)
        if not len(at):
            return
        # What belongs to a key's open frame comes first, the rest in the order of time.
        at = at[np.lexsort((ts[at], ~inside[at], own[at]))]
        rows, own, of, to, ts = rows.iloc[at].reset_index(drop=True), own[at], of[at], to[at], ts[at]
        # Runs of one key and frame; what is held is the key's first run's or a run before it.
        turn = np.append(True, (own[1:] != own[:-1]) | (of[1:] != of[:-1]) | (to[1:] != to[:-1]))
        run, run_key, run_frame, run_period = np.cumsum(turn) - 1, own[turn], of[turn], to[turn]
        begins, newest = np.append(True, run_key[1:] != run_key[:-1]), np.append(run_key[1:] != run_key[:-1], True)
        first = np.full(n, -1)
        first[run_key[begins]] = np.flatnonzero(begins)
        counted = self.partial(rows)
        parts = [counted.assign(_run=run[counted.index.to_numpy(int)])]
        owner = self._owners(held, kept)
        met = first[owner] >= 0
        before = owner[met]
        joins = (run_frame[first[before]] == frame[before]) & (run_period[first[before]] == period[before])
        parts.insert(0, kept.loc[met, self.names].assign(_run=np.where(joins, first[before], len(run_key) + before)))
        run_key, run_frame, newest = np.append(run_key, np.arange(n)), np.append(run_frame, frame), np.append(newest, np.zeros(n, bool))
        parts = self.merged(pd.concat([x for x in parts if len(x)] or parts[1:], ignore_index=True))
        place = parts["_run"].to_numpy(int)
        stay = newest[place]
        moved = run_key[newest]
        frame[moved], period[moved], closed[moved] = run_frame[newest], run_period[newest[: len(run_period)]], False
        np.maximum.at(last, own, ts)
        chunk = keys["chunk"].to_numpy()
        by = np.argsort(chunk, kind="stable")
        spot = np.empty(n, np.int64)
        spot[by] = np.arange(n) - np.searchsorted(chunk[by], chunk[by], "left")
        touched = np.unique(chunk[moved])
        self.open.write(keys.assign(frame=frame, period=period, last=last, closed=closed).iloc[by], touched)
        still = [kept.loc[~met, self.names].assign(_key=owner[~met]), parts.loc[stay, self.names].assign(_key=run_key[place[stay]])]
        still = pd.concat([x for x in still if len(x)] or still[1:], ignore_index=True)
        still = still.assign(owner=spot[still["_key"].to_numpy(int)], chunk=chunk[still["_key"].to_numpy(int)])
        self.parts.write(still.sort_values("chunk", kind="stable"), touched)
        if self.timeout is not None:
            due = np.unique(self._due(frame[moved], period[moved]))
            for t in due.tolist():
                self.handle.registerTimer(t)
            known = self.earliest.get() if self.earliest.exists() else None
            self.earliest.update((int(due[0]) if known is None else min(int(due[0]), known[0]),))
        if not stay.all():
            place = place[~stay]
            yield self._emit(keys.iloc[run_key[place]], run_frame[place], parts[~stay])

    @staticmethod
    def _due(frame: np.ndarray, period: np.ndarray) -> np.ndarray:
        return ((frame + period / 2) * 1000).astype(np.int64)  # the watermark is behind by the timeout

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes all frames of the part that are due: the other timers up to now find nothing left to do."""
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        known = self.earliest.get() if self.earliest.exists() else None
        if known is None or known[0] > now:
            return  # the frames that the timer was for have been closed by later data
        held, kept = self.open.read_all(), self.parts.read_all()
        due, is_open = self._due(held["frame"].to_numpy(float), held["period"].to_numpy(float)), ~held["closed"].to_numpy(bool)
        ends = is_open & (due <= now)
        left = due[is_open & ~ends]
        if len(left):
            self.earliest.update((int(left.min()),))
        else:
            self.earliest.clear()
        if not ends.any():
            return
        owner = self._owners(held, kept)
        out = ends[owner]
        touched = np.unique(held["chunk"].to_numpy()[ends])
        self.open.write(held.assign(closed=held["closed"].to_numpy(bool) | ends), touched)
        self.parts.write(kept[~out], touched)
        parts = self.merged(kept.loc[out, self.names].assign(_run=owner[out]))
        if len(parts):
            place = parts["_run"].to_numpy(int)
            yield self._emit(held.iloc[place], held["frame"].to_numpy(float)[place], parts)

    def close(self) -> None:
        pass


class RollupFrames(Frames):
    """Records of an endpoint's timestamp group: numbers average, other kinds keep the first value."""

    key_schema = "host_name string, app_name string, group_id int"
    schema = "path string, numeric boolean, first_ts double, kind string, value double, value_string string, total double, rest double, n bigint"

    def partial(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["active"]]
        value = rows["value"].astype(float)
        part = value.where(~rows["kind"].isin(INTEGER_KINDS), np.rint(value))  # the sums of `scalars.addends`
        return pd.DataFrame({
            "path": rows["path"], "numeric": rows["numeric"], "first_ts": rows["ts"], "kind": rows["kind"], "value": rows["value"], "value_string": rows["value_string"],
            "total": part.fillna(0.0), "rest": np.rint((value - part) * FRACTIONS).fillna(0.0), "n": value.notna().astype("int64"),
        })

    def merged(self, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("first_ts", kind="stable")
        by = ["_run", "path", "numeric"]
        sums = parts.groupby(by, sort=False, dropna=False)[["total", "rest", "n"]].sum()
        # Both are in the order in which the groups are met first.
        return parts.drop_duplicates(by).assign(**{c: sums[c].to_numpy() for c in sums})[["_run", *self.names]]

    def closed(self, parts: pd.DataFrame) -> pd.DataFrame:
        numeric, n = parts["numeric"].to_numpy(bool), parts["n"].to_numpy(float)
        mean = (parts["total"].to_numpy(float) + parts["rest"].to_numpy(float) / FRACTIONS) / np.where(n > 0, n, np.nan)
        mean = np.where(np.isin(parts["kind"].to_numpy(str), INTEGER_KINDS), np.floor(mean + 0.5), mean)
        value = np.where(numeric, mean, parts["value"].to_numpy(float))
        return pd.DataFrame({"path": parts["path"], "kind": parts["kind"], "value": value, "value_string": np.where(numeric, None, parts["value_string"].to_numpy(object))})


class VariableFrames(Frames):
    """Variables of a machine, or of its mounts (`sub`): count, min, max and sum of each."""

    key_schema = ", ".join(f"{c} string" for c in INSTANCE)

    def __init__(self, timeout: float | None, names: Sequence[str], sub: str | None):
        super().__init__(timeout)
        self.variables, self.sub = list(names), sub
        self.schema = ", ".join(["sub string", *[f"{v}_{f} {kind}" for v in names for f, kind in (("count", "bigint"), ("min", "double"), ("max", "double"), ("sum", "double"))]])

    def partial(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"sub": rows[self.sub] if self.sub else pd.Series("", rows.index)}
        for v in self.variables:
            x = rows[v].astype(float)
            out |= {f"{v}_count": x.notna().astype("int64"), f"{v}_min": x, f"{v}_max": x, f"{v}_sum": x}
        return pd.DataFrame(out)

    def merged(self, parts: pd.DataFrame) -> pd.DataFrame:
        groups = parts.groupby(["_run", "sub"], sort=False)
        out = {}
        for v in self.variables:
            out |= {f"{v}_count": groups[f"{v}_count"].sum(), f"{v}_min": groups[f"{v}_min"].min(), f"{v}_max": groups[f"{v}_max"].max(), f"{v}_sum": groups[f"{v}_sum"].sum(min_count=1)}
        return pd.DataFrame(out).reset_index()

    def closed(self, parts: pd.DataFrame) -> pd.DataFrame:
        return parts.drop(columns="_run").rename(columns={"sub": self.sub or "_sub"}).drop(columns=[] if self.sub else ["_sub"])


def _run(rows: DataFrame, keys: Sequence[str], processor: Frames, schema: str, timeout: float | None) -> DataFrame:
    rows = dealt(rows, keys)
    if timeout is not None:
        # By the ends of frames: a row is late for Spark only if its frame is.
        end = F.timestamp_micros(F.round((F.col("frame") + F.col("period") / 2) * 1e6).cast("long"))
        rows = rows.withColumn("event_time", end).withWatermark("event_time", f"{int(timeout * 1000)} milliseconds")
    return rows.groupBy("part").transformWithStateInPandas(processor, schema, "Append", "EventTime" if timeout is not None else "None")


def _framed(rows: DataFrame, period) -> DataFrame:
    rows = rows.withColumn("period", period.cast("double"))
    return rows.withColumn("frame", F.floor(F.col("ts") / F.col("period") + 0.5) * F.col("period"))


def stream_group_rollup(records: DataFrame, span: float, timeout: float | None = None) -> DataFrame:
    """(endpoint, group_id, path, ts, kind, value, value_string) of the frames of each timestamp group, each when the group's next frame begins.

    records: endpoint, group_id, path, ts (seconds), kind, value, value_string, active; inactive records move a group on but do not count. timeout: seconds by
    which another group's frame must end later for a silent group's frame to be closed too. Of a stream that ends, each group's newest frame stays open.
    """
    rows = _framed(records, F.lit(float(span))).withColumn("numeric", is_numeric("kind")).select(*K, "group_id", "path", "ts", "kind", "value", "value_string", "active", "numeric", "frame", "period")
    schema = "host_name string, app_name string, group_id int, path string, ts double, kind string, value double, value_string string"
    return _run(rows, [*K, "group_id"], RollupFrames(timeout), schema, timeout)


def _variables(names: Sequence[str], whole: Sequence[str]) -> str:
    kinds = {v: "bigint" if v in whole else "double" for v in names}
    return ", ".join(f"{v}_count bigint, {v}_min {k}, {v}_max {k}, {v}_sum {k}" for v, k in kinds.items())


def _whole(df: DataFrame, schema: str, names: Sequence[str]) -> DataFrame:
    """Sums and bounds of whole variables as whole numbers: below 2^53 they are exact."""
    return df.select(*[F.col(c.split()[0]).cast("bigint") if c.split()[0].rsplit("_", 1)[0] in names else F.col(c.split()[0]) for c in schema.split(", ")])


def stream_machine_rollup(stats: DataFrame, timeout: float | None = None) -> DataFrame:
    """(account, instance, region, ts, and count, min, max and sum of cpu, memory_free, memory_size, memory_percent) of each machine's own periods.

    stats: as in the batch form, with ts and `period`, the machine's seconds at that time. A period is emitted, and its state cleared, when a sample of another period
    of the machine arrives; a machine whose period changes starts a new one.
    """
    rows = health_percents(_framed(stats, F.col("period")))
    names = {"cpu": "cpu_percent", "memory_free": "memory_free", "memory_size": "memory_total", "memory_percent": "memory_percent"}
    rows = rows.select(*INSTANCE, "ts", "frame", "period", *[F.col(c).cast("double").alias(v) for v, c in names.items()])
    plain = "account string, instance string, region string, ts double, " + _variables(list(names), ())
    return _whole(_run(rows, INSTANCE, VariableFrames(timeout, list(names), None), plain, timeout), plain, ("memory_free", "memory_size")).withColumn("ts", F.col("ts").cast("long"))


def stream_machine_fs_rollup(stats: DataFrame, timeout: float | None = None) -> DataFrame:
    """The same of size, free, used and used_percent for each mount in `fss`; mounts whose size is never known in a period are left out."""
    size, free = F.col("f.size"), F.col("f.free")
    rows = _framed(stats, F.col("period")).select(*INSTANCE, "ts", "frame", "period", F.explode_outer("fss").alias("f"))
    names = ["size", "free", "used", "used_percent"]
    values = dict(zip(names, (size, free, fs_used(size, free), used_percent(free, size))))
    rows = rows.select(*INSTANCE, "ts", "frame", "period", F.col("f.mount_point").alias("mount_point"), *[v.cast("double").alias(c) for c, v in values.items()])
    plain = "account string, instance string, region string, ts double, mount_point string, " + _variables(names, ())
    out = _whole(_run(rows, INSTANCE, VariableFrames(timeout, names, "mount_point"), plain, timeout), plain, names[:3])
    return out.where("size_count > 0").withColumn("ts", F.col("ts").cast("long"))
