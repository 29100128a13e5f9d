"""Parameters of queries: bucket layout, downsample specifications and time ranges."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BUCKETS = 1000
_SECONDS = {"ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0}


def _div(a: int, b: int) -> int:
    """Integer division that truncates toward zero."""
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


@dataclass(frozen=True)
class Buckets:
    """Centred buckets of a range [start, end): a bucket is labelled by its middle, and a partial one at either end is dropped."""

    start: float
    end: float
    step: float

    @property
    def width(self) -> int:
        return max(1, int(self.step))

    @property
    def first(self) -> int:
        """The left edge of bucket 0."""
        half = self.width // 2
        p = _div(int(self.start) + half, self.width) * self.width - half
        return p - self.width if p > self.start else p

    @property
    def size(self) -> int:
        return max(0, _div(int(self.end) - self.first, self.width))

    @property
    def clamp(self) -> float:
        """Points before it belong to a partial first bucket."""
        q = self.start / self.step + 0.5
        return (q - 0.5) * self.step if q == math.floor(q) else (math.floor(q) + 0.5) * self.step

    def index(self, ts):
        """Bucket number of a time column (integer division toward zero)."""
        return F.expr(f"(cast({ts} as bigint) - ({self.first})) div {self.width}")

    def label(self, index):
        return F.lit(self.first + self.width // 2) + F.col(index) * self.width


def duration(text: str) -> float:
    """Seconds of "90s", "15m", "2h30m", ..."""
    if not re.fullmatch(r"(\d+(?:\.\d+)?(ms|[smhdw]))+", text):
        raise ValueError(f"no duration: {text}")
    return sum(float(n) * _SECONDS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ms|[smhdw])", text))


def parse_downsample(spec: str) -> tuple[float, str, str] | None:
    """(step, aggregator, fill) of "15m-avg[-zero]"; None for an empty one."""
    if not spec:
        return None
    parts = spec.split("-")
    if len(parts) < 2:
        raise ValueError(f"a downsample needs a duration and an aggregator: {spec}")
    return duration(parts[0]), parts[1], parts[2] if len(parts) > 2 and parts[2] in ("nan", "null", "zero") else "none"


def parse_downsamples(specs: DataFrame, column: str = "spec") -> DataFrame:
    """parse_downsample over a table: adds seconds, aggregator and fill (nulls for an empty specification); one that is none is an error."""
    parts = F.split(column, "-")
    pieces = F.regexp_extract_all(parts[0], F.lit(r"\d+(?:\.\d+)?(?:ms|[smhdw])"), F.lit(0))
    unit = F.create_map(*[F.lit(x) for kv in _SECONDS.items() for x in kv])
    seconds = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + F.regexp_extract(p, r"^[\d.]+", 0).cast("double") * unit[F.regexp_extract(p, "[a-z]+$", 0)])
    good = (F.size(parts) >= 2) & parts[0].rlike(r"^(\d+(\.\d+)?(ms|[smhdw]))+$")
    empty = F.col(column) == ""
    third = F.get(parts, F.lit(2))
    checked = F.when(empty, F.lit(None).cast("double")).when(good, seconds).otherwise(F.raise_error(F.concat(F.lit("no downsample: "), F.col(column))))
    return specs.select("*", checked.alias("seconds"), F.when(~empty, F.get(parts, F.lit(1))).alias("aggregator"), F.when(~empty, F.when(third.isin("nan", "null", "zero"), third).otherwise("none")).alias("fill"))


def guard_range(start: float, end: float, step: float, least_step: float, most: int = MOST_BUCKETS, move_start: bool = True) -> tuple[float, float, float]:
    """(start, end, step) with at least the least step and at most `most` buckets: the start is moved, or else it is an error."""
    step = max(step, least_step)
    if (end - start) / step > most:
        if not move_start:
            raise ValueError(f"more than {most} buckets")
        start = end - step * most
    return start, end, step


def guard_ranges(queries: DataFrame, least_step: float, most: int = MOST_BUCKETS) -> DataFrame:
    """guard_range over a table of queries (start, end, step)."""
    step = F.greatest("step", F.lit(float(least_step)))
    return queries.withColumn("step", step).withColumn("start", F.greatest(F.col("start"), F.col("end") - F.col("step") * most))


def clip_range(queries: DataFrame, low: float, high: float) -> DataFrame:
    """The ranges (start, end) of a table of queries cut to [low, high); those outside are dropped."""
    out = queries.withColumn("start", F.greatest("start", F.lit(float(low)))).withColumn("end", F.least("end", F.lit(float(high))))
    return out.where("start < end")


def union_range(queries: DataFrame) -> DataFrame:
    """One row: the least start and the largest end."""
    return queries.agg(F.min("start").alias("start"), F.max("end").alias("end"))
