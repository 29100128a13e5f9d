"""Streaming ingest on typed keyed state: a row for each metric and each timestamp group of an endpoint.

Endpoints are worked on many at a time (`parts`). Of a part's endpoints, the first polls of a micro-batch are compared with the state as arrays, then
the second ones, and so on: there are as many rounds as the endpoint with the most polls has. Only chunks of endpoints in which the value, the
activity or the time of a late first value of a metric or a group's time changed are written back. A metric's last timestamp is that of its group unless its
newest value came late, and is kept only then.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from gaugeflow.model import KINDS, K
from gaugeflow.operators.series import MARKER_GAP
from gaugeflow.streaming.parts import Chunks

COLUMNS = ["path", "group_id", "ts", "value", "active"]


def refused_rows(rows: pd.DataFrame, poll: np.ndarray) -> np.ndarray:
    """Flags of rows whose poll breaks the rules: paths out of component order or twice, a kind that there is not, two timestamps in one group. rows: in the order of poll and place."""
    code, paths = pd.factorize(rows["path"])
    parts = [p.lstrip("/").split("/") for p in paths]
    order = sorted(range(len(parts)), key=lambda i: parts[i])
    rank, place = np.zeros(len(parts), np.int64), 0
    for k, i in enumerate(order):  # paths of like components share a rank
        place += k > 0 and parts[i] != parts[order[k - 1]]
        rank[i] = place
    own = rank[code]
    bad = np.append(False, (own[1:] <= own[:-1]) & (poll[1:] == poll[:-1]))
    if "kind" in rows.columns:
        bad |= (rows["kind"].notna() & ~rows["kind"].isin(KINDS)).to_numpy()
    times = rows["ts"].astype(float).groupby([poll, rows["group_id"].to_numpy()])
    bad |= (times.transform("max") > times.transform("min")).to_numpy()
    return np.isin(poll, poll[bad])


def numbered(held: pd.DataFrame, rows: pd.DataFrame, by: Sequence[str]) -> tuple[np.ndarray, pd.DataFrame]:
    """(the place of each row's key, the keys that are not held): held keys are distinct and have the first places."""
    every = pd.concat([held[by], rows[by]], ignore_index=True) if len(held) else rows[by].reset_index(drop=True)
    number = every.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    return number[len(held) :], every.iloc[np.unique(number, return_index=True)[1][len(held) :]]


class State:
    """Metrics and groups of endpoints, which have numbers. metrics: end, group_id, path, value, active, late (the time of a late value, else NaN); groups: end, group_id, ts."""

    def __init__(self, metrics: pd.DataFrame, groups: pd.DataFrame):
        self.metrics, self.groups = metrics[["end", "group_id", "path"]], groups[["end", "group_id"]]
        self.value, self.late = metrics["value"].to_numpy(float), metrics["late"].to_numpy(float)
        self.active, self.known = metrics["active"].to_numpy(bool), np.ones(len(metrics), bool)
        self.last, self.met = groups["ts"].to_numpy(float), np.ones(len(groups), bool)
        self.dirty, self.moved = np.zeros(len(metrics), bool), np.zeros(len(groups), bool)

    def _places(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' metrics and groups; new ones are added, not known yet."""
        at, new = numbered(self.metrics, rows, ["end", "group_id", "path"])
        self.metrics = pd.concat([self.metrics, new], ignore_index=True) if len(self.metrics) else new.reset_index(drop=True)
        of, more = numbered(self.groups, self.metrics, ["end", "group_id"])
        self.groups = pd.concat([self.groups, more], ignore_index=True) if len(self.groups) else more.reset_index(drop=True)
        longer = lambda x, n, fill: np.append(x, np.full(n, fill, x.dtype))
        self.value, self.late = longer(self.value, len(new), np.nan), longer(self.late, len(new), np.nan)
        self.active, self.known, self.dirty = (longer(x, len(new), False) for x in (self.active, self.known, self.dirty))
        self.last, self.met, self.moved = longer(self.last, len(more), np.nan), longer(self.met, len(more), False), longer(self.moved, len(more), False)
        return at, of

    def polls(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The changes and markers (end and COLUMNS) of polls; refused ones add nothing. rows: in the order of end, batch_seq and place."""
        end, seq = rows["end"].to_numpy(), rows["batch_seq"].to_numpy()
        poll = np.cumsum(np.append(True, (end[1:] != end[:-1]) | (seq[1:] != seq[:-1])))
        good = ~refused_rows(rows, poll)
        rows, poll = rows[good].reset_index(drop=True), poll[good]
        if not len(rows):
            return pd.DataFrame(columns=["end", *COLUMNS])
        at, of = self._places(rows)
        value = rows["value"].astype(float).to_numpy()
        ts = rows["ts"].astype(float).groupby([poll, rows["group_id"].to_numpy()]).transform("max").fillna(rows["batch_ts"].astype(float)).to_numpy()
        # The number of each poll among its endpoint's.
        end = rows["end"].to_numpy()
        count = np.cumsum(np.append(True, poll[1:] != poll[:-1]))
        start = np.append(True, end[1:] != end[:-1])
        turn = count - np.repeat(count[start], np.diff(np.append(np.flatnonzero(start), len(end))))
        order = np.argsort(turn, kind="stable")
        at, value, ts, end = at[order], value[order], ts[order], end[order]
        cuts = np.searchsorted(turn[order], np.arange(int(turn.max()) + 2))
        # Metrics by endpoint.
        owner = self.metrics["end"].to_numpy(np.int64)
        self._by, self._of = np.argsort(owner, kind="stable"), of
        self._bounds = np.searchsorted(owner[self._by], np.arange(int(owner.max()) + 2))
        self._seen = np.zeros(len(owner), bool)
        self._time, self._here, self._fresh = np.zeros(len(self.last)), np.zeros(len(self.last), bool), np.zeros(len(self.last), bool)
        out = [self._round(at[a:b], value[a:b], ts[a:b], np.unique(end[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        place, ts, values, active = (np.concatenate(x) for x in zip(*out))
        found = self.metrics.iloc[place]
        return pd.DataFrame({"end": found["end"].to_numpy(), "path": found["path"].to_numpy(), "group_id": found["group_id"].to_numpy(), "ts": ts, "value": values, "active": active})

    def _round(self, at: np.ndarray, value: np.ndarray, ts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """One poll of each of some endpoints."""
        own = self._of[at]
        self._time[own] = ts
        groups = np.unique(own)
        fresh = groups[~self.met[groups] | (self._time[groups] > self.last[groups])]
        self._here[groups], self._fresh[fresh], self._seen[at] = True, True, True
        is_fresh = self._fresh[own]
        taken = is_fresh | ~self.known[at]  # a metric's very first value may be late
        old = self.value[at]
        same = self.known[at] & self.active[at] & ((old == value) | np.isnan(old) & np.isnan(value))
        changed = taken & ~same
        late = np.where(is_fresh, np.nan, ts)
        self.dirty[at[taken & (~same | ~((late == self.late[at]) | np.isnan(late) & np.isnan(self.late[at])))]] = True
        here = at[taken]
        self.value[here], self.late[here], self.active[here], self.known[here] = value[taken], late[taken], True, True
        # All metrics of these endpoints.
        first, size = self._bounds[ends], self._bounds[ends + 1] - self._bounds[ends]
        stop = np.cumsum(size)
        every = self._by[np.repeat(first - (stop - size), size) + np.arange(int(stop[-1]))]
        of = self._of[every]
        gone = every[self.known[every] & self.active[every] & ~self._seen[every] & (~self._here[of] | self._fresh[of])]
        of = self._of[gone]
        last = np.where(np.isnan(self.late[gone]), self.last[of], self.late[gone]) + MARKER_GAP
        mark = np.where(self._here[of], self._time[of], last)
        self.active[gone], self.dirty[gone] = False, True
        self.last[fresh], self.met[fresh], self.moved[fresh] = self._time[fresh], True, True
        self._here[groups], self._fresh[fresh], self._seen[at] = False, False, False
        n = int(changed.sum())
        return np.append(at[changed], gone), np.append(ts[changed], mark), np.append(value[changed], np.zeros(len(gone))), np.append(np.ones(n, bool), np.zeros(len(gone), bool))


class EndpointState:
    """The state of one endpoint. metrics: (group, path) -> (value, active, ts of a late value or None); groups: last timestamps."""

    def __init__(self, metrics: dict[tuple[int, str], tuple], groups: dict[int, float]):
        held = [(0, g, path, np.nan if v is None else v, active, np.nan if late is None else late) for (g, path), (v, active, late) in metrics.items()]
        self.state = State(pd.DataFrame(held, columns=["end", "group_id", "path", "value", "active", "late"]), pd.DataFrame([(0, g, ts) for g, ts in groups.items()], columns=["end", "group_id", "ts"]))

    def polls(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The changes and markers of polls in the order of batch_seq; refused polls add nothing."""
        return self.state.polls(rows.assign(end=0))[COLUMNS]

    def __getattr__(self, name: str):
        return getattr(self.state, name)  # value, active, late, known and dirty, by the place of `keys`

    @property
    def keys(self) -> list[tuple[int, str]]:
        return [(int(g), path) for g, path in zip(self.state.metrics["group_id"], self.state.metrics["path"])]

    @property
    def groups(self) -> dict[int, float]:
        return {int(g): float(ts) for g, ts in zip(self.state.groups["group_id"], self.state.last)}

    @property
    def moved(self) -> set[int]:
        return set(map(int, self.state.groups["group_id"][self.state.moved]))


class Ingest(StatefulProcessor):
    """keep: seconds of its group's time after which an inactive metric is forgotten; None keeps all."""

    def __init__(self, keep: float | None):
        self.keep = keep

    def init(self, handle) -> None:
        names = ", ".join(f"{c} string" for c in K)
        self.metrics = Chunks(handle, "metrics", f"{names}, group_id int, path string, value double, active boolean, late double, since double")
        self.groups = Chunks(handle, "groups", f"{names}, group_id int, ts double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        chunks = np.unique(rows["chunk"])
        held, groups = self.metrics.read(chunks), self.groups.read(chunks)
        named = [*K, "chunk"]
        every = pd.concat([x[named] for x in (groups, held, rows) if len(x)], ignore_index=True)
        number = every.groupby(K, sort=False, dropna=False).ngroup().to_numpy()
        ends = every.iloc[np.unique(number, return_index=True)[1]].reset_index(drop=True)
        groups, held, rows = groups.assign(end=number[: len(groups)]), held.assign(end=number[len(groups) : len(number) - len(rows)]), rows.assign(end=number[len(number) - len(rows) :])
        rows = rows.sort_values(["end", "batch_seq", *(["seq"] if "seq" in rows.columns else [])], kind="stable", ignore_index=True)
        forgotten = np.zeros(0, int)
        if self.keep is not None and len(held):
            of, _ = numbered(groups, held, ["end", "group_id"])
            last = np.append(groups["ts"].to_numpy(float), np.full(len(held), np.nan))[of]
            old = ~held["active"].to_numpy(bool) & (last > held["since"].to_numpy(float) + self.keep)
            forgotten, held = np.unique(held["chunk"].to_numpy(int)[old]), held[~old].reset_index(drop=True)
        state = State(held, groups)
        out = state.polls(rows)
        chunk = ends["chunk"].to_numpy(int)
        touched = np.unique(np.concatenate([forgotten, chunk[state.metrics["end"].to_numpy(int)[state.dirty]], chunk[state.groups["end"].to_numpy(int)[state.moved]]]).astype(int))
        if len(touched):
            self._keep(state, held, ends, touched)
        if len(out):
            own = ends.iloc[out["end"].to_numpy(int)]
            yield out.assign(**{c: own[c].to_numpy() for c in K})[[*K, *COLUMNS]]

    def _keep(self, state: State, held: pd.DataFrame, ends: pd.DataFrame, touched: np.ndarray) -> None:
        def placed(table: pd.DataFrame, more: dict) -> pd.DataFrame:
            own = ends.iloc[table["end"].to_numpy(int)]
            return table.assign(**{c: own[c].to_numpy() for c in (*K, "chunk")}, **more).sort_values("chunk", kind="stable")

        of, _ = numbered(state.groups, state.metrics, ["end", "group_id"])
        since = np.append(held["since"].to_numpy(float), np.zeros(len(state.value) - len(held)))
        since = np.where(state.dirty, np.where(np.isnan(state.last[of]), 0.0, state.last[of]), since)
        self.metrics.write(placed(state.metrics, {"value": state.value, "active": state.active, "late": state.late, "since": since}), touched)
        self.groups.write(placed(state.groups, {"ts": state.last}), touched)

    def close(self) -> None:
        pass
