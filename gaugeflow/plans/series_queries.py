"""Queries: ingest rules, change-compressed series, result-set algebra, roll-ups and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.model import K
from gaugeflow.operators import merge as M
from gaugeflow.operators import rollup as R
from gaugeflow.operators import series as S
from gaugeflow.plans.adapters import END, EV, LV, PTS, START, events, levels, points, rounded
from gaugeflow.plans.registry import query

_CH = "host_name, app_name, path, group_id"
_COMPRESSED = "cw AS (SELECT *, lag(value) OVER w AS pv, lag(active) OVER w AS pa, row_number() OVER w AS rn FROM lv WINDOW w AS (PARTITION BY host_name, app_name ORDER BY ts)), ch AS (SELECT * FROM cw WHERE rn = 1 OR value IS DISTINCT FROM pv OR active IS DISTINCT FROM pa)"


@query(f"WITH {EV}, {LV}, {_COMPRESSED} SELECT host_name, app_name, path, batch_seq, ts, value, active FROM ch")
def compress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compress_changes(levels(spark, sf_dir)).drop("group_id")


@query(f"WITH {EV}, {LV} SELECT {_CH}, ts, value, active FROM lv")
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed and made dense again: every level at every timestamp of its endpoint."""
    lv = levels(spark, sf_dir)
    return S.densify(S.compress_changes(lv).drop("batch_seq"), lv.select(*K, "group_id", "ts"))


@query(f"WITH {EV}, {LV}, {_COMPRESSED}, h AS (SELECT *, lead(ts) OVER (PARTITION BY host_name, app_name ORDER BY ts) AS n FROM ch WHERE ts < {START + 20 * 86400}) SELECT host_name, app_name, ts, value, active FROM h WHERE ts > {START + 10 * 86400} OR n IS NULL OR n > {START + 10 * 86400}")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.history(S.compress_changes(levels(spark, sf_dir)), START + 10 * 86400, START + 20 * 86400).select(*K, "ts", "value", "active")


@query(f"WITH {EV}, {LV}, l AS (SELECT *, row_number() OVER (PARTITION BY host_name, app_name ORDER BY ts DESC) AS n FROM lv) SELECT host_name, app_name, path, ts, value FROM l WHERE n = 1 AND active")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(levels(spark, sf_dir))


@query(f"WITH {PTS}, l AS (SELECT *, row_number() OVER (PARTITION BY host_name, path ORDER BY ts DESC) AS n FROM pts WHERE path = '/events' OR starts_with(path, '/events/')) SELECT host_name, path, ts, value FROM l WHERE n = 1 ORDER BY host_name, path")
def latest_under_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value of each metric below a path, in the order of host and path components."""
    from gaugeflow.functions.scalars import path_sort_key

    own = S.select_paths(points(spark, sf_dir), "/events").withColumn("active", F.lit(True))
    return S.latest(own, ("host_name", "path")).orderBy("host_name", path_sort_key("path"))


@query(f"WITH {EV}, r AS (SELECT *, floor(ts / 3600) * 3600 AS hour FROM ev), n AS (SELECT *, row_number() OVER (PARTITION BY host_name, hour ORDER BY (k % 7 <> 0) DESC, app_name, batch_seq) AS n FROM r) SELECT host_name, hour AS ts, k, k % 7 <> 0 AS active FROM n WHERE n = 1")
def merge_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applications of a host as one series by the hour, active rows preferred."""
    e = events(spark, sf_dir).select("host_name", F.struct("app_name", "batch_seq").alias("group_id"), (F.floor(F.col("ts") / 3600) * 3600).cast("double").alias("ts"), "k", (F.col("k") % 7 != 0).alias("active"))
    return S.merge_grouped(e, ("host_name",)).drop("group_id")


#: Every seventh batch carries an old timestamp, and metrics of a host fall into two groups by application.
_OBS = "ob AS (SELECT host_name, 'all' AS app_name, batch_seq, '/' || app_name AS path, CASE WHEN app_name IN ('click', 'view') THEN 0 ELSE 1 END AS group_id, CASE WHEN batch_seq % 7 = 0 THEN floor(ts) - 400000 ELSE floor(ts) END AS ts, value FROM ev)"


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        "host_name",
        F.lit("all").alias("app_name"),
        "batch_seq",
        F.concat(F.lit("/"), "app_name").alias("path"),
        F.when(F.col("app_name").isin("click", "view"), 0).otherwise(1).alias("group_id"),
        (F.floor("ts") - F.when(F.col("batch_seq") % 7 == 0, 400000).otherwise(0)).cast("double").alias("ts"),
        "value",
    )


@query(f"WITH {EV}, {_OBS}, w AS (SELECT *, max(ts) OVER (PARTITION BY host_name, group_id ORDER BY batch_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, min(batch_seq) OVER (PARTITION BY host_name, path) AS f FROM ob) SELECT host_name, batch_seq, path, ts, value FROM w WHERE m IS NULL OR ts > m OR batch_seq = f")
def drop_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drop_late(_obs(spark, sf_dir)).select("host_name", "batch_seq", "path", "ts", "value")


@query(f"""WITH {EV}, {_OBS}, b AS (SELECT host_name, batch_seq, group_id, path, ts, lead(batch_seq) OVER (PARTITION BY host_name ORDER BY batch_seq) AS nb, lead(batch_seq) OVER (PARTITION BY host_name, path ORDER BY batch_seq) AS ob FROM ob)
SELECT b.host_name, b.path, round(coalesce(n.ts, b.ts + 0.001), 3) AS ts FROM b LEFT JOIN ob n ON n.host_name = b.host_name AND n.batch_seq = b.nb AND n.group_id = b.group_id WHERE nb IS NOT NULL AND (b.ob IS NULL OR b.ob > nb)""")
def mark_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mark_inactive(_obs(spark, sf_dir)).select("host_name", "path", F.round("ts", 3).alias("ts"))


@query(f"WITH {EV}, {LV}, g AS (SELECT *, max(ts) OVER (PARTITION BY host_name, app_name) + 0.001 AS m, row_number() OVER (PARTITION BY host_name, app_name ORDER BY ts DESC) AS n FROM lv WHERE app_name IN ('click', 'error')) SELECT host_name, app_name, round(m, 3) AS ts FROM g WHERE n = 1 AND active")
def inactivate_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = levels(spark, sf_dir)
    return S.inactivate_endpoints(lv, lv.where("app_name in ('click', 'error')").select(*K).distinct()).select(*K, F.round("ts", 3).alias("ts"))


@query(f"WITH {EV}, b AS (SELECT host_name, batch_seq // 50 AS batch, app_name, batch_seq, CASE WHEN k % 2 = 0 THEN ts END AS own, (batch_seq // 50)::DOUBLE AS bt FROM ev) SELECT host_name, batch_seq, coalesce(max(own) OVER (PARTITION BY host_name, batch, app_name), bt) AS ts FROM b")
def default_group_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    obs = e.select("host_name", F.lit("").alias("app_name"), F.col("batch_seq").alias("row"), F.expr("batch_seq div 50").alias("batch_seq"), F.col("app_name").alias("group_id"), F.when(F.col("k") % 2 == 0, F.col("ts")).alias("ts"), F.expr("cast(batch_seq div 50 as double)").alias("batch_ts"))
    return S.default_group_ts(obs).select("host_name", F.col("row").alias("batch_seq"), "ts")


@query(f"WITH {EV}, {LV} SELECT host_name, app_name, ts, value FROM lv WHERE active AND ts >= {START + 5 * 86400} AND ts < {END - 5 * 86400}")
def numeric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = levels(spark, sf_dir).withColumn("kind", F.lit("float64"))
    changes = S.compress_changes(lv, ("value", "kind")).drop("batch_seq")
    # kind is constant here, so it need not be carried through the densifying.
    return S.numeric_series(changes, lv.select(*K, "group_id", "ts"), "/events/level", START + 5 * 86400, END - 5 * 86400).select(*K, "ts", "value")


@query(f"""WITH {EV}, b AS (SELECT host_name, batch_seq // 100 AS batch, batch_seq AS seq, app_name AS path, k, ts FROM ev), w AS (SELECT *, lag(path) OVER (PARTITION BY host_name, batch ORDER BY seq) AS p FROM b)
SELECT host_name, batch AS batch_seq, 'unsorted' AS violation, path FROM w WHERE path < p UNION ALL SELECT host_name, batch, 'duplicate', path FROM b GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT host_name, batch, 'kind', path FROM b WHERE k % 11 = 0
UNION ALL SELECT host_name, batch, 'timestamps', min(path) FROM b GROUP BY host_name, batch HAVING min(ts) < max(ts)""")
def verify_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    obs = e.select("host_name", F.lit("").alias("app_name"), F.expr("batch_seq div 100").alias("batch_seq"), F.col("batch_seq").alias("seq"), F.col("app_name").alias("path"), F.when(F.col("k") % 11 == 0, "complex").otherwise("float64").alias("kind"), F.lit(0).alias("group_id"), "ts")
    return S.verify_batches(obs, ["float64"]).select("host_name", "batch_seq", "violation", "path")


#: Three result sets by the hour: the values of clicks, views and errors, null where k is a multiple of 5.
def _sql_set(name: str) -> str:
    return f"SELECT host_name, (CAST(floor(ts) AS BIGINT) // 86400) * 86400 AS ts, CASE WHEN max(k) % 5 <> 0 THEN max(value) END AS value FROM ev WHERE app_name = '{name}' GROUP BY ALL"


def _result_set(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("app_name") == name).withColumn("ts", F.floor(F.floor("ts") / 86400) * 86400)
    out = e.groupBy("host_name", "ts").agg(F.when(F.max("k") % 5 != 0, F.max("value")).alias("value"))
    return out.select(F.lit("m").alias("name"), F.create_map(F.lit("host"), F.col("host_name")).alias("tags"), "ts", "value")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("name", F.col("tags")["host"].alias("host"), F.col("ts").cast("long").alias("ts"), F.round(F.col("value") + 1e-9, 6).alias("value"))


_SETS = f"{EV}, c AS ({_sql_set('click')}), v AS ({_sql_set('view')}), e AS ({_sql_set('error')})"


@query(f"WITH {_SETS}, u AS (SELECT 0 AS s, * FROM c UNION ALL SELECT 1, * FROM v UNION ALL SELECT 2, * FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY host_name, ts ORDER BY s DESC) AS n FROM u) SELECT 'm' AS name, host_name AS host, ts, value FROM r WHERE n = 1")
def merge_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(M.merge_series(*(_result_set(spark, sf_dir, n) for n in ("click", "view", "error"))))


@query(f"WITH {_SETS}, u AS (SELECT * FROM c UNION ALL SELECT * FROM v UNION ALL SELECT * FROM e) SELECT 'm' AS name, host_name AS host, ts, round(CASE WHEN count(value) = count(*) THEN sum(value) END + 1e-9, 6) AS value FROM u GROUP BY host_name, ts")
def sum_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(M.sum_series(*(_result_set(spark, sf_dir, n) for n in ("click", "view", "error"))))


@query(f"WITH {_SETS} SELECT 'm' AS name, host_name AS host, ts, round(CASE WHEN v.value <> 0 THEN c.value / v.value END + 1e-9, 6) AS value FROM c JOIN v USING (host_name, ts)")
def divide_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(M.divide_series(_result_set(spark, sf_dir, "click"), _result_set(spark, sf_dir, "view")))


@query(f"WITH {EV}, d AS (SELECT host_name, (CAST(floor(ts) AS BIGINT) // 86400) * 86400 AS ts, round(avg(value) + 1e-9, 6) AS value FROM ev GROUP BY ALL) SELECT 'm' AS name, host_name AS host, ts, value FROM d")
def merge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of a host from one shard for each application."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.floor("ts") / 86400) * 86400)
    sums, counts = [], []
    for app in ("click", "error", "purchase", "signup", "view"):
        own = e.where(F.col("app_name") == app).groupBy("host_name", "day").agg(F.sum("value").alias("s"), F.count("value").cast("double").alias("n"))
        shape = lambda c: own.select(F.lit("m").alias("name"), F.create_map(F.lit("host"), F.col("host_name")).alias("tags"), F.col("day").alias("ts"), F.col(c).alias("value"))  # noqa: B023, E731
        sums.append(shape("s"))
        counts.append(shape("n"))
    return _flat(M.merge_means(sums, counts))


@query(f"""WITH {_SETS}, cut AS (SELECT host_name, min(ts) FILTER (value <> 0) AS cut FROM v GROUP BY host_name)
SELECT 'm' AS name, c.host_name AS host, ts, round(value + 1e-9, 6) AS value FROM c LEFT JOIN cut USING (host_name) WHERE cut IS NULL OR ts < cut
UNION ALL SELECT 'm', v.host_name, ts, round(value + 1e-9, 6) FROM v JOIN cut USING (host_name) WHERE ts >= cut OR v.host_name NOT IN (SELECT host_name FROM c)""")
def merge_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(M.merge_preferred(_result_set(spark, sf_dir, "click"), _result_set(spark, sf_dir, "view")))


@query(f"WITH {EV}, d AS (SELECT DISTINCT app_name, host_name FROM ev), r AS (SELECT 'm' || app_name AS name, host_name AS host, row_number() OVER (ORDER BY 'm' || app_name, host_name) AS place FROM d) SELECT * FROM r")
def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each series in the order of names and tags; a report over the few distinct series."""
    from pyspark.sql import Window

    e = events(spark, sf_dir).select(F.concat(F.lit("m"), "app_name").alias("name"), "host_name").distinct()
    ordered = M.order_series(e.select("name", F.create_map(F.lit("host"), F.col("host_name")).alias("tags"), F.lit(0).alias("ts")))
    return ordered.select("name", F.col("tags")["host"].alias("host"), F.row_number().over(Window.orderBy("name", F.array_sort(F.map_entries("tags")))).alias("place"))


_SPAN = 172800
_FR = f"fr AS (SELECT *, floor(ts / {_SPAN} + 0.5) * {_SPAN} AS frame FROM lv), cut AS (SELECT * FROM (SELECT *, max(frame) OVER (PARTITION BY host_name, app_name) AS last FROM fr) WHERE frame < last)"


@query(f"""WITH {EV}, lv AS (SELECT host_name, app_name, ts, CASE WHEN app_name IN ('click', 'error') THEN 'int64' WHEN app_name = 'view' THEN 'bool' ELSE 'float64' END AS kind, value, k % 7 <> 0 AS active FROM ev), {_FR}
SELECT host_name, app_name, frame AS ts, min_by(kind, ts) AS kind, round(CASE WHEN app_name = 'view' THEN min_by(value, ts) WHEN app_name IN ('click', 'error') THEN floor(avg(value) + 0.5) ELSE avg(value) END + 1e-9, 6) AS value FROM cut WHERE active GROUP BY host_name, app_name, frame""")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("app_name").isin("click", "error"), "int64").when(F.col("app_name") == "view", "bool").otherwise("float64")
    rec = events(spark, sf_dir).select(*K, F.lit("/v").alias("path"), F.lit(0).alias("group_id"), "ts", kind.alias("kind"), "value", F.lit(None).cast("string").alias("value_string"), (F.col("k") % 7 != 0).alias("active"))
    return rounded(R.rollup(rec, _SPAN).select(*K, "ts", "kind", "value"), "value")


@query(f"WITH {EV}, {LV}, {_FR}, r AS (SELECT *, dense_rank() OVER (PARTITION BY host_name, app_name ORDER BY frame) AS n FROM cut) SELECT host_name, app_name, ts, frame FROM r WHERE n <= 3")
def chop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chop_incomplete(levels(spark, sf_dir), _SPAN, 3).select(*K, "ts", "frame")


#: A reader that has written all before its host's own position; the first hosts have none.
_POS = f"pr AS (SELECT DISTINCT host_name, app_name, ({START} + (user_id % 29) * 86400)::DOUBLE AS position FROM ev WHERE user_id % 3 <> 0)"


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("user_id % 3 <> 0")
    return e.select(F.lit("a").alias("reader"), *K, F.lit(0).alias("group_id"), (F.lit(START) + (F.col("user_id") % 29) * 86400).cast("double").alias("position")).distinct()


@query(f"WITH {EV}, {LV}, {_POS} SELECT host_name, app_name, ts, value FROM lv LEFT JOIN pr USING (host_name, app_name) WHERE position IS NULL OR ts > position")
def unread_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader that starts where another stands is handed."""
    progress = R.copy_position(_progress(spark, sf_dir), "a", "b")
    return R.unread(levels(spark, sf_dir), progress, "b").select(*K, "ts", "value")


@query(f"""WITH {EV}, {LV}, {_POS}, g AS (SELECT host_name, app_name, min(ts) AS lo, max(ts) AS hi, max(position) AS position, min(ts) FILTER (position IS NULL OR ts > position) AS pending FROM lv LEFT JOIN pr USING (host_name, app_name) GROUP BY ALL)
SELECT host_name, app_name, round(hi - coalesce(least(position, hi), lo) + 1e-9, 6) AS seconds_left, round(CASE WHEN hi > lo THEN (coalesce(pending, hi) - lo) * 100 / (hi - lo) ELSE 100 END + 1e-9, 6) AS percent, coalesce(position < lo, false) AS skipped FROM g""")
def reader_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.reader_progress(levels(spark, sf_dir), _progress(spark, sf_dir), "a"), "seconds_left", "percent")


@query(f"WITH {EV}, {LV}, {_POS}, n AS (SELECT host_name, app_name, max(ts) AS position FROM lv GROUP BY ALL), u AS (SELECT * FROM pr UNION ALL SELECT * FROM n) SELECT 'a' AS reader, host_name, app_name, max(position) AS position FROM u GROUP BY ALL")
def commit_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.commit(_progress(spark, sf_dir), "a", levels(spark, sf_dir)).drop("group_id")
