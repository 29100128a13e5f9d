"""Queries: streams over the event files, run to their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.model import K
from gaugeflow.plans.adapters import EV, rounded, seconds
from gaugeflow.plans.registry import query
from gaugeflow.sources.shared import scratch
from gaugeflow.streaming import frames, jobs
from gaugeflow.streaming.exports import NamedExports

_SPAN, _DELAY = 172800, 3600


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = jobs.read_files(spark, sf_dir, "events")
    ts = seconds(e)
    return e.select(F.concat(F.lit("host"), "user_id").alias("host_name"), F.col("event_type").alias("app_name"), F.col("event_id").alias("batch_seq"), ts.alias("ts"), F.timestamp_micros(F.round(ts * 1e6).cast("long")).alias("event_time"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


# A frame is emitted once the newest event less the delay has passed its end.
_CLOSED = f"fr AS (SELECT *, floor(ts / {_SPAN} + 0.5) * {_SPAN} AS frame FROM ev), mx AS (SELECT floor(max(ts) * 1000) / 1000 - {_DELAY} AS wm FROM ev)"


_KIND = "CASE WHEN app_name IN ('click', 'error') THEN 'int64' WHEN app_name = 'view' THEN 'bool' WHEN app_name = 'signup' THEN 'string' ELSE 'float64' END"


@query(f"""WITH {EV}, {_CLOSED} SELECT host_name, app_name, frame::DOUBLE AS ts, min_by({_KIND}, ts) AS kind,
round(CASE WHEN app_name = 'signup' THEN NULL WHEN app_name = 'view' THEN min_by(value, ts) WHEN app_name IN ('click', 'error') THEN floor(avg(value) + 0.5) ELSE avg(value) END + 1e-9, 6) AS value, CASE WHEN app_name = 'signup' THEN min_by('s' || k, ts) END AS value_string
FROM fr, mx WHERE frame + {_SPAN // 2} <= wm AND k % 7 <> 0 GROUP BY host_name, app_name, frame""")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, whole numbers, booleans and text, of which the last two take a frame's first value."""
    app = F.col("app_name")
    kind = F.when(app.isin("click", "error"), "int64").when(app == "view", "bool").when(app == "signup", "string").otherwise("float64")
    s = _stream(spark, sf_dir).withColumns({"kind": kind, "value_string": F.when(app == "signup", F.concat(F.lit("s"), "k")), "value": F.when(app != "signup", F.col("value")), "active": F.col("k") % 7 != 0})
    return rounded(jobs.to_parquet(jobs.stream_rollup(s, _SPAN, f"{_DELAY} seconds", tuple(K)), scratch(spark, "rollup")), "value")


def _stats_stream(spark: SparkSession, sf_dir: str, more: dict[str, Column] | None = None) -> DataFrame:
    k = F.col("k")
    boot = F.when(k % 3 == 0, F.struct(F.lit("/boot").alias("mount_point"), ((k + 2) * 10).alias("size"), F.when(k % 5 != 0, (k + 1) * 5).alias("free")))
    root = F.struct(F.lit("/").alias("mount_point"), ((k + 1) * 1000).alias("size"), (k * 700).alias("free"))
    return _stream(spark, sf_dir).select(
        F.lit("a").alias("account"), F.col("host_name").alias("instance"), F.lit("r").alias("region"), "event_time",
        (F.col("value") / 300).alias("user_time_fraction"), F.when(k % 10 != 0, k * 10_000).alias("memory_free"), F.lit(1_000_000).cast("long").alias("memory_total"), F.array_compact(F.array(root, boot)).alias("fss"), *[c.alias(name) for name, c in (more or {}).items()],
    )


def _vars(x: str, name: str, whole: bool) -> str:
    r = (lambda e: f"({e})::BIGINT") if whole else (lambda e: f"round({e} + 1e-9, 4)")
    return f"count({x}) AS {name}_count, {r(f'min({x})')} AS {name}_min, {r(f'max({x})')} AS {name}_max, {r(f'sum({x})')} AS {name}_sum"


# Frames closed by a later frame of their own group, or by another group's that ends half a day later.
_OWN = f"fr AS (SELECT *, floor(ts / {_SPAN} + 0.5) * {_SPAN} AS frame FROM ev), ow AS (SELECT *, max(frame) OVER (PARTITION BY host_name, app_name) AS newest FROM fr)"
_FRAME_VALUES = f"""SELECT host_name, app_name, frame::DOUBLE AS ts, min_by({_KIND}, ts) AS kind,
round(CASE WHEN app_name = 'signup' THEN NULL WHEN app_name = 'view' THEN min_by(value, ts) WHEN app_name IN ('click', 'error') THEN floor(avg(value) + 0.5) ELSE avg(value) END + 1e-9, 6) AS value, CASE WHEN app_name = 'signup' THEN min_by('s' || k, ts) END AS value_string"""


def _group_rollup(spark: SparkSession, sf_dir: str, timeout: float | None) -> DataFrame:
    app = F.col("app_name")
    kind = F.when(app.isin("click", "error"), "int64").when(app == "view", "bool").when(app == "signup", "string").otherwise("float64")
    s = _stream(spark, sf_dir).withColumns({"group_id": F.lit(0), "path": F.lit("/v"), "kind": kind, "value_string": F.when(app == "signup", F.concat(F.lit("s"), "k")), "value": F.when(app != "signup", F.col("value")), "active": F.col("k") % 7 != 0})
    out = jobs.to_parquet(frames.stream_group_rollup(s, _SPAN, timeout), scratch(spark, "frames"))
    return rounded(out.select(*K, "ts", "kind", "value", "value_string"), "value")


@query(f"WITH {EV}, {_OWN} {_FRAME_VALUES} FROM ow WHERE frame < newest AND k % 7 <> 0 GROUP BY host_name, app_name, frame")
def stream_group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's frames as soon as its next one begins, however far other groups are: only its newest stays open."""
    return _group_rollup(spark, sf_dir, None)


@query(f"WITH {EV}, {_OWN} {_FRAME_VALUES} FROM ow, (SELECT max(frame) AS last FROM fr) WHERE (frame < newest OR frame + 43200 < last) AND k % 7 <> 0 GROUP BY host_name, app_name, frame")
def stream_group_rollup_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with half a day's patience for groups that have fallen silent."""
    return _group_rollup(spark, sf_dir, 43200.0)


_CHANGE = 1704067200 + 15 * 86400
#: Machines report by six hours or by two days; a fifth of them changes from one to the other.
_PERIODS = f"pe AS (SELECT *, CASE WHEN user_id % 5 = 0 AND ts >= {_CHANGE} OR user_id % 5 <> 0 AND user_id % 2 = 0 THEN 21600 ELSE {_SPAN} END AS period FROM ev), pf AS (SELECT *, floor(ts / period + 0.5) * period AS frame FROM pe), pn AS (SELECT *, max_by(frame, ts) OVER w AS last_frame, max_by(period, ts) OVER w AS last_period FROM pf WINDOW w AS (PARTITION BY host_name)), pc AS (SELECT * FROM pn WHERE frame <> last_frame OR period <> last_period)"


def _machine_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.regexp_extract("host_name", "[0-9]+", 0).cast("int")
    period = F.when((user % 5 == 0) & (F.col("ts") >= _CHANGE) | (user % 5 != 0) & (user % 2 == 0), 21600).otherwise(_SPAN)
    return _stats_stream(spark, sf_dir, {"ts": F.col("ts"), "period": period})


@query(f"""WITH {EV}, {_CLOSED}, s AS (SELECT host_name, frame, least(100, value / 3) AS cpu, CASE WHEN k % 10 <> 0 THEN k * 10000 END AS free, 1000000::BIGINT AS total FROM fr, mx WHERE frame + {_SPAN // 2} <= wm),
p AS (SELECT *, CASE WHEN free IS NOT NULL THEN greatest(0, (total - free) * 100.0::DOUBLE / total) END AS mem FROM s)
SELECT host_name AS instance, CAST(frame AS BIGINT) AS ts, {_vars('cpu', 'cpu', False)}, {_vars('free', 'memory_free', True)}, {_vars('total', 'memory_size', True)}, {_vars('mem', 'memory_percent', False)} FROM p GROUP BY host_name, frame""")
def stream_health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.to_parquet(jobs.stream_health_rollup(_stats_stream(spark, sf_dir), _SPAN, f"{_DELAY} seconds"), scratch(spark, "health")).drop("account", "region")
    return rounded(out, *[c for c in out.columns if c.startswith(("cpu_m", "cpu_s", "memory_percent_m", "memory_percent_s"))], digits=4)


@query(f"""WITH {EV}, {_CLOSED}, f AS (SELECT host_name, frame, '/' AS m, (k + 1) * 1000 AS s, k * 700 AS f FROM fr, mx WHERE frame + {_SPAN // 2} <= wm UNION ALL SELECT host_name, frame, '/boot', (k + 2) * 10, CASE WHEN k % 5 <> 0 THEN (k + 1) * 5 END FROM fr, mx WHERE frame + {_SPAN // 2} <= wm AND k % 3 = 0),
p AS (SELECT *, CASE WHEN f IS NOT NULL THEN greatest(s - f, 0) END AS u, CASE WHEN f IS NOT NULL THEN greatest(0, (s - f) * 100.0::DOUBLE / s) END AS up FROM f)
SELECT host_name AS instance, CAST(frame AS BIGINT) AS ts, m AS mount_point, {_vars('s', 'size', True)}, {_vars('f', 'free', True)}, {_vars('u', 'used', True)}, {_vars('up', 'used_percent', False)} FROM p GROUP BY host_name, frame, m""")
def stream_fs_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.to_parquet(jobs.stream_fs_rollup(_stats_stream(spark, sf_dir), _SPAN, f"{_DELAY} seconds"), scratch(spark, "mounts")).drop("account", "region")
    return rounded(out, "used_percent_min", "used_percent_max", "used_percent_sum", digits=4)


@query(f"""WITH {EV}, {_PERIODS}, s AS (SELECT host_name, period, frame, least(100, value / 3) AS cpu, CASE WHEN k % 10 <> 0 THEN k * 10000 END AS free, 1000000::BIGINT AS total FROM pc),
p AS (SELECT *, CASE WHEN free IS NOT NULL THEN greatest(0, (total - free) * 100.0::DOUBLE / total) END AS mem FROM s)
SELECT host_name AS instance, CAST(frame AS BIGINT) AS ts, {_vars('cpu', 'cpu', False)}, {_vars('free', 'memory_free', True)}, {_vars('total', 'memory_size', True)}, {_vars('mem', 'memory_percent', False)} FROM p GROUP BY host_name, period, frame""")
def stream_machine_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines with periods of their own in one stream, some of which change theirs."""
    out = jobs.to_parquet(frames.stream_machine_rollup(_machine_stream(spark, sf_dir)), scratch(spark, "machines")).drop("account", "region")
    return rounded(out, *[c for c in out.columns if c.startswith(("cpu_m", "cpu_s", "memory_percent_m", "memory_percent_s"))], digits=4)


@query(f"""WITH {EV}, {_PERIODS}, f AS (SELECT host_name, period, frame, '/' AS m, (k + 1) * 1000 AS s, k * 700 AS f FROM pc UNION ALL SELECT host_name, period, frame, '/boot', (k + 2) * 10, CASE WHEN k % 5 <> 0 THEN (k + 1) * 5 END FROM pc WHERE k % 3 = 0),
p AS (SELECT *, CASE WHEN f IS NOT NULL THEN greatest(s - f, 0) END AS u, CASE WHEN f IS NOT NULL THEN greatest(0, (s - f) * 100.0::DOUBLE / s) END AS up FROM f)
SELECT host_name AS instance, CAST(frame AS BIGINT) AS ts, m AS mount_point, {_vars('s', 'size', True)}, {_vars('f', 'free', True)}, {_vars('u', 'used', True)}, {_vars('up', 'used_percent', False)} FROM p GROUP BY host_name, period, frame, m""")
def stream_machine_fs_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.to_parquet(frames.stream_machine_fs_rollup(_machine_stream(spark, sf_dir)), scratch(spark, "machine_mounts")).drop("account", "region")
    return rounded(out, "used_percent_min", "used_percent_max", "used_percent_sum", digits=4)


# Every seventh poll is refused for a kind that there is not, every eleventh comes late; the second metric is missing where k is a multiple of 5.
@query(f"""WITH {EV}, b AS (SELECT host_name, app_name, batch_seq, floor(ts) - CASE WHEN batch_seq % 11 = 0 THEN 4000000 ELSE 0 END AS ts, floor(value / 25) AS level, k FROM ev WHERE batch_seq % 7 <> 0),
g AS (SELECT *, max(ts) OVER (PARTITION BY host_name, app_name ORDER BY batch_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, min(CASE WHEN k % 5 <> 0 THEN batch_seq END) OVER (PARTITION BY host_name, app_name) AS fk FROM b),
l AS (SELECT host_name, app_name, batch_seq, '/level' AS path, ts, level AS value, true AS active FROM g WHERE m IS NULL OR ts > m
 UNION ALL SELECT host_name, app_name, batch_seq, '/k', ts, CASE WHEN k % 5 <> 0 THEN k ELSE 0 END, k % 5 <> 0 FROM g WHERE (m IS NULL OR ts > m OR batch_seq = fk) AND batch_seq >= fk),
w AS (SELECT *, lag(value) OVER o AS pv, lag(active) OVER o AS pa FROM l WINDOW o AS (PARTITION BY host_name, app_name, path ORDER BY batch_seq))
SELECT host_name, app_name, path, ts::DOUBLE AS ts, value::DOUBLE AS value, active FROM w WHERE pa IS NULL OR active <> pa OR value <> pv""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics of each poll: changes, markers of the one that is missing, late and refused polls."""
    s, k = _stream(spark, sf_dir), F.col("k")
    ts = (F.floor("ts") - F.when(F.col("batch_seq") % 11 == 0, 4_000_000).otherwise(0)).cast("double")
    cell = lambda seq, path, value: F.struct(F.lit(seq).alias("seq"), F.lit(path).alias("path"), value.cast("double").alias("value"))
    cells = F.array_compact(F.array(F.when(k % 5 != 0, cell(0, "/k", k)), cell(1, "/level", F.floor(F.col("value") / 25))))
    kind = F.when(F.col("batch_seq") % 7 == 0, "complex").otherwise("float64")
    obs = s.select(*K, "batch_seq", ts.alias("ts"), ts.alias("batch_ts"), kind.alias("kind"), F.explode(cells).alias("c")).select(*K, "batch_seq", "ts", "batch_ts", "kind", F.lit(0).alias("group_id"), "c.*")
    return jobs.to_parquet(jobs.stream_ingest(obs), scratch(spark, "ingest")).drop("group_id")


@query(f"WITH {EV} SELECT host_name, app_name, batch_seq, ts FROM ev")
def stream_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named export run twice over the same files: the second run finds its position and writes nothing again."""
    root = scratch(spark, "export")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    for _ in range(2):
        jobs.stream_export(_stream(spark, sf_dir).select(*K, "batch_seq", "ts"), "points", root, write).awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*K, "batch_seq", "ts")


@query(f"WITH {EV} SELECT app_name, count(*) AS n, max(batch_seq) AS newest FROM ev GROUP BY app_name")
def stream_export_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a hook of a named export notes down of each successful write: rows and newest sequence number by application."""
    root = scratch(spark, "hooks")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    def note(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("app_name").agg(F.count(F.lit(1)).alias("n"), F.max("batch_seq").alias("newest")).write.mode("overwrite").parquet(f"{root}/notes/epoch={epoch}")

    jobs.stream_export(_stream(spark, sf_dir).select(*K, "batch_seq", "ts"), "hooked", root, write, (note,)).awaitTermination()
    notes = spark.read.parquet(f"{root}/notes")
    return notes.groupBy("app_name").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))


_HALF = 1704067200 + 15 * 86400


@query(f"""WITH {EV}, p AS (SELECT host_name, app_name, max(ts) AS position FROM ev WHERE ts < {_HALF} GROUP BY ALL)
SELECT 'copied' AS reader, host_name, app_name, batch_seq, ts FROM ev LEFT JOIN p USING (host_name, app_name) WHERE position IS NULL OR ts > position UNION ALL SELECT 'reset', host_name, app_name, batch_seq, ts FROM ev WHERE app_name = 'error'""")
def stream_reader_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that has been handed the first half of the events; one that starts where it stands, over all events; and one that is run, set back and run again."""
    root = scratch(spark, "readers")
    named = NamedExports(spark, f"{root}/state")
    rows = _stream(spark, sf_dir).select(*K, F.lit(0).alias("group_id"), "batch_seq", "ts")

    def write(name: str):
        return lambda batch, number: batch.select(F.lit(name).alias("reader"), *K, "batch_seq", "ts").write.mode("overwrite").parquet(f"{root}/out/{name}/number={number}")

    named.export(rows.where(F.col("ts") < _HALF), "first", write("first")).awaitTermination()
    named.copy_position("first", "copied")
    named.export(rows, "copied", write("copied")).awaitTermination()
    errors = rows.where("app_name = 'error'")
    named.export(errors, "reset", write("reset")).awaitTermination()
    named.start_at_beginning("reset")
    named.export(errors, "reset", write("reset")).awaitTermination()
    out = spark.read.parquet(f"{root}/out/copied").unionByName(spark.read.parquet(f"{root}/out/reset"))
    # Both runs of the set-back reader wrote all its rows: those of its second generation are given.
    return out.where("reader = 'copied' or number >= 4294967296").select("reader", *K, "batch_seq", "ts")
