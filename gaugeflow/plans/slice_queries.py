"""Queries: the ordered rules where one endpoint has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators import series as S
from gaugeflow.operators import slices as C
from gaugeflow.plans.adapters import EV, events
from gaugeflow.plans.registry import query

#: A third of the hosts report as one endpoint with one metric for each application; every seventh batch is late.
_HOT = """hv AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE host_name END AS host_name, CASE WHEN user_id % 3 = 0 THEN 'all' ELSE app_name END AS app_name, '/' || app_name AS path, CASE WHEN app_name IN ('click', 'view') THEN 0 ELSE 1 END AS group_id,
batch_seq, (batch_seq * 10 - CASE WHEN batch_seq % 7 = 0 THEN 5000 ELSE 0 END)::DOUBLE AS ts, (batch_seq * 10)::DOUBLE AS fine_ts, floor(value / 25) AS value, k % 7 <> 0 AS active FROM ev)"""
_W = "(PARTITION BY host_name, app_name, path ORDER BY batch_seq)"
_CH = f"cw AS (SELECT *, lag(value) OVER w AS pv, lag(active) OVER w AS pa, row_number() OVER w AS rn FROM hv WINDOW w AS {_W}), ch AS (SELECT * FROM cw WHERE rn = 1 OR value IS DISTINCT FROM pv OR active IS DISTINCT FROM pa)"


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    hot, fine = F.col("user_id") % 3 == 0, F.col("batch_seq") * 10.0
    late = F.when(F.col("batch_seq") % 7 == 0, 5000.0).otherwise(0.0)
    return e.select(
        F.when(hot, "hot").otherwise(F.col("host_name")).alias("host_name"), F.when(hot, "all").otherwise(F.col("app_name")).alias("app_name"), F.concat(F.lit("/"), "app_name").alias("path"),
        F.when(F.col("app_name").isin("click", "view"), 0).otherwise(1).alias("group_id"), "batch_seq", (fine - late).alias("ts"), fine.alias("fine_ts"), F.floor(F.col("value") / 25).cast("double").alias("value"), (F.col("k") % 7 != 0).alias("active"),
    )


def _fine(rows: DataFrame) -> DataFrame:
    return rows.drop("ts").withColumnRenamed("fine_ts", "ts")


#: The table is small: an endpoint counts as hot from its share alone.
_FEW = 100


@query(f"WITH {EV}, {_HOT}, w AS (SELECT *, max(ts) OVER (PARTITION BY host_name, app_name, group_id ORDER BY batch_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, min(batch_seq) OVER (PARTITION BY host_name, app_name, path, group_id) AS f FROM hv) SELECT host_name, app_name, path, batch_seq, ts FROM w WHERE m IS NULL OR ts > m OR batch_seq = f")
def drop_late_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _hot(spark, sf_dir)
    return C.drop_late(obs, C.find_slices(obs, "batch_seq", few=_FEW)).select("host_name", "app_name", "path", "batch_seq", "ts")


@query(f"WITH {EV}, {_HOT}, {_CH} SELECT host_name, app_name, path, fine_ts AS ts, value, active FROM ch")
def compress_changes_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _fine(_hot(spark, sf_dir))
    return C.compress_changes(obs, C.find_slices(obs, few=_FEW)).select("host_name", "app_name", "path", "ts", "value", "active")


@query(f"""WITH {EV}, {_HOT}, b AS (SELECT *, lead(batch_seq) OVER (PARTITION BY host_name, app_name ORDER BY batch_seq) AS nb, lead(batch_seq) OVER {_W} AS ob FROM hv)
SELECT b.host_name, b.app_name, b.path, round(coalesce(n.ts, b.ts + 0.001), 3) AS ts FROM b LEFT JOIN hv n ON n.host_name = b.host_name AND n.app_name = b.app_name AND n.batch_seq = b.nb AND n.group_id = b.group_id WHERE nb IS NOT NULL AND (b.ob IS NULL OR b.ob > nb)""")
def mark_inactive_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _hot(spark, sf_dir)
    return C.mark_inactive(obs, C.find_slices(obs, "batch_seq", few=_FEW)).select("host_name", "app_name", "path", F.round("ts", 3).alias("ts"))


@query(f"""WITH {EV}, {_HOT}, {_CH}, se AS (SELECT host_name, app_name, path, group_id, min(fine_ts) AS first FROM ch GROUP BY ALL),
t AS (SELECT se.host_name, se.app_name, se.path, se.group_id, hv.fine_ts AS ts FROM se JOIN hv ON hv.host_name = se.host_name AND hv.app_name = se.app_name AND hv.group_id = se.group_id AND hv.fine_ts >= first)
SELECT t.host_name, t.app_name, t.path, t.ts, ch.value, ch.active FROM t ASOF JOIN ch ON t.host_name = ch.host_name AND t.app_name = ch.app_name AND t.path = ch.path AND t.ts >= ch.fine_ts""")
def densify_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of a group at every timestamp of the group, from compressed changes."""
    obs = _fine(_hot(spark, sf_dir))
    slices = C.find_slices(obs, few=_FEW)
    changes = S.compress_changes(obs).drop("batch_seq")
    return C.densify(changes, obs, slices).drop("group_id")
