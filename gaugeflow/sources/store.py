"""Observations and change records by date, with carry-forward snapshots.

A store of changes is two folders of Parquet files:

* ``changes/date=D/load=L``: the change records of one (UTC) day that one load brought, clustered by series and time, so that the files'
  statistics tell endpoints and paths apart;
* ``snapshots/date=D/load=L``: for each series the last change before day D, as far as load L knows it.

What was so at a time is then the newest snapshot up to that day and the changes since: a range with its predecessor reads the days of
the range, one snapshot and at most the days between snapshots, however long the history is. A snapshot may hold several
rows of a series; the newest counts. So a load that brings values of past days only adds its own rows to the snapshots after them.
A load that failed is simply run again under its name: it overwrites what it has written.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.model import OBSERVATIONS, K
from gaugeflow.operators.series import SERIES

_EPOCH = date(1970, 1, 1)


def day_of(ts: float) -> date:
    return _EPOCH + timedelta(days=math.floor(ts / 86400))


def date_column(ts: Column) -> Column:
    """The UTC day of epoch seconds, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(ts / 86400).cast("int"))


def _write(df: DataFrame, path: str, load: str, order: Sequence[str]) -> None:
    """Rows by `date`, clustered in the given order; what a load has written of a date before is replaced. A large day goes to several files."""
    by = ["date", "load"]
    ordered = df.withColumn("load", F.lit(_PREFIX + load)).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


#: Keeps a load's name in its folder's from being taken for a number.
_PREFIX = "load-"


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """The folders below a path that begin so, without that beginning; from the listing alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))


def write_observations(obs: DataFrame, path: str, load: str) -> None:
    """Lays observations out by the date of their own or else their collector's timestamp (those without either: no date), clustered by endpoint and path."""
    _write(obs.withColumn("date", date_column(F.coalesce("ts", "batch_ts"))), path, load, [*K, "path", "batch_seq"])


def read_observations(spark: SparkSession, path: str, start: float, end: float) -> DataFrame:
    """Observations with start <= timestamp < end: only the partitions of those days are read."""
    schema = T.StructType([*OBSERVATIONS.fields, T.StructField("date", T.DateType()), T.StructField("load", T.StringType())])
    ts = F.coalesce("ts", "batch_ts")
    return spark.read.schema(schema).parquet(path).where(_days(start, end) & (ts >= start) & (ts < end)).select(*OBSERVATIONS.names)


def _days(start: float, end: float) -> Column:
    return (F.col("date") >= F.lit(day_of(start))) & (F.col("date") <= F.lit(day_of(end)))


class ChangeStore:
    """Change records of series under one folder. keys: what makes a series; every: days from one snapshot to the next."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = tuple(SERIES), every: int = 1):
        self.spark, self.keys, self.every = spark, list(keys), every
        self.changes, self.snapshots = f"{root.rstrip('/')}/changes", f"{root.rstrip('/')}/snapshots"

    def _dates(self, path: str, but: str | None = None) -> list[date]:
        """The dates that a folder has rows of, from another load than `but`."""
        found = _children(self.spark, path, "date=")
        if but is not None:
            found = [d for d in found if set(_children(self.spark, f"{path}/date={d}", "load=")) - {_PREFIX + but}]
        return [date.fromisoformat(d) for d in found]

    def _newest(self, rows: DataFrame, *more: str) -> DataFrame:
        """The newest change of each series (and of each value of `more`): an aggregate that tasks combine before the shuffle."""
        names = [c for c in rows.columns if c not in (*self.keys, *more)]
        return rows.groupBy(*self.keys, *more).agg(F.max_by(F.struct(*names), "ts").alias("_c")).select(*self.keys, *more, "_c.*").select(*rows.columns)

    def load(self, changes: DataFrame, name: str) -> None:
        """Adds change records (keys, ts, further columns; a series' timestamps are distinct) under the load's name, and the snapshots that are due after them.

        Of what is stored only the newest snapshot and the changes since are read. The changes are read three times: give them as a table. Rows without a
        timestamp are refused.
        """
        rows = changes.withColumn("date", date_column(F.col("ts")))
        first, last, odd = rows.agg(F.min("date"), F.max("date"), F.count_if(F.col("ts").isNull())).first()
        if odd:
            raise ValueError(f"{odd} changes without a timestamp")
        if first is None:
            return
        known = self._dates(self.snapshots, but=name)
        stored = [d for d in self._dates(self.changes, but=name) if not known or d >= known[-1]]
        order = [*self.keys, "ts"]
        _write(rows, self.changes, name, order)
        parts = []
        late = [d for d in known if d > first]
        if late:  # values of past days belong to all snapshots after them
            dates = F.array(*[F.lit(d) for d in late])
            spread = rows.withColumn("date", F.explode(F.filter(dates, lambda d: d > F.col("date"))))
            parts.append(self._newest(spread, "date"))
        last = max([last, *stored])
        due = (known[-1] if known else first) + timedelta(days=self.every)
        fresh = [due + timedelta(days=k) for k in range(0, (last - due).days + 2, self.every)]
        if fresh:
            parts.append(self._due(rows, name, known[-1] if known else None, stored, fresh))
        if parts:
            _write(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), self.snapshots, name, order)

    def _due(self, rows: DataFrame, name: str, base: date | None, stored: list[date], fresh: list[date]) -> DataFrame:
        """The snapshots of the dates `fresh`: each series' newest change before them, from the snapshot of `base`, the changes since and a load's rows."""
        if stored:
            since = self.spark.read.parquet(self.changes).where((F.col("date") >= F.lit(stored[0])) & (F.col("load") != _PREFIX + name))
            rows = rows.unionByName(since.select(*rows.columns))
        if base is not None:  # all that was before counts as of the day before
            before = self.spark.read.parquet(self.snapshots).where((F.col("date") == F.lit(base)) & (F.col("load") != _PREFIX + name))
            rows = rows.unionByName(before.select(*rows.columns))
            rows = rows.withColumn("date", F.greatest(date_column(F.col("ts")), F.lit(base - timedelta(days=1))))
        days = self._newest(rows, "date")
        # A day's change holds until the series' next day with one.
        days = days.withColumn("_until", F.lead("date").over(Window.partitionBy(*self.keys).orderBy("date")))
        dates = F.array(*[F.lit(d) for d in fresh])
        own = F.filter(dates, lambda d: (d > F.col("date")) & (F.col("_until").isNull() | (d <= F.col("_until"))))
        return days.withColumn("date", F.explode(own)).drop("_until")

    def history(self, start: float, end: float, where: Column | None = None) -> DataFrame:
        """The changes inside (start, end) and each series' last one at or before the start; `where` (on keys, say) reaches the scans."""
        first = day_of(min(start, end))
        base = max((d for d in self._dates(self.snapshots) if d <= first), default=None)
        changes = self.spark.read.parquet(self.changes)
        columns = [c for c in changes.columns if c not in ("date", "load")]
        since = F.lit(True) if base is None else F.col("date") >= F.lit(base)
        before = changes.where(since & (F.col("date") <= F.lit(first)) & (F.col("ts") <= start) & (F.col("ts") < end))
        if base is not None:
            before = before.unionByName(self.spark.read.parquet(self.snapshots).where(F.col("date") == F.lit(base)))
        inside = changes.where(_days(start, end) & (F.col("ts") > start) & (F.col("ts") < end))
        if where is not None:
            before, inside = before.where(where), inside.where(where)
        return inside.select(*columns).unionByName(self._newest(before.select(*columns)))

    def at(self, ts: float, where: Column | None = None) -> DataFrame:
        """Each series' last change at or before a time."""
        return self.history(ts, math.nextafter(ts, math.inf), where)
