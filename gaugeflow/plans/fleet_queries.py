"""Queries: machine health, inventories, endpoints and their activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions import scalars as C
from gaugeflow.model import K
from gaugeflow.operators import batches as B
from gaugeflow.operators import endpoints as E
from gaugeflow.operators import export as X
from gaugeflow.operators import health as H
from gaugeflow.operators import inventory as I
from gaugeflow.operators import slices as L
from gaugeflow.plans.adapters import EP, EV, PTS, endpoints, events, points, rounded, table
from gaugeflow.plans.registry import query


def health_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a poll of its host: cpu, memory (of a wrong kind where k is a multiple of 10), the mount "/", and "/boot" where k is a multiple of 3."""
    e = events(spark, sf_dir)

    def cell(path: str, kind: Column | str, real: Column | None = None, whole: Column | None = None, where: Column | None = None) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        s = F.struct(F.lit(path).alias("path"), kind.alias("kind"), (real if real is not None else F.lit(None)).cast("double").alias("value_double"), (whole if whole is not None else F.lit(None)).cast("long").alias("value_long"))
        return s if where is None else F.when(where, s)

    k = F.col("k")
    cells = [
        cell("/sys/sched/cpu/user-time-fraction", "float64", real=F.col("value") / 300),
        cell("/sys/memory/total", "uint64", whole=F.lit(1_000_000) + F.col("user_id") * 1000),
        cell("/sys/memory/available", F.when(k % 10 == 0, "int64").otherwise("uint64"), whole=k * 10_000),
        cell("/sys/fs/METRICS/size", "uint64", whole=(k + 1) * 1000),
        cell("/sys/fs/METRICS/free", "uint64", whole=k * 700),
        cell("/sys/fs/boot/METRICS/size", "uint64", whole=(k + 2) * 10, where=k % 3 == 0),
        cell("/sys/fs/boot/METRICS/free", "uint64", whole=(k + 1) * 5, where=(k % 3 == 0) & (k % 5 != 0)),
    ]
    return e.select(*K, "batch_seq", "ts", F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*K, "batch_seq", "ts", "c.*")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = H.instance_stats(health_obs(spark, sf_dir))
    return s.select(F.lit("acct").alias("account"), F.col("host_name").alias("instance"), F.lit("r1").alias("region"), "*")


_ST = "st AS (SELECT host_name, app_name, batch_seq, ts, value / 300 AS f, CASE WHEN k % 10 <> 0 THEN k * 10000 END AS free, 1000000 + user_id * 1000 AS total, (k + 1) * 1000 AS rs, k * 700 AS rf, CASE WHEN k % 3 = 0 THEN (k + 2) * 10 END AS bs, CASE WHEN k % 3 = 0 AND k % 5 <> 0 THEN (k + 1) * 5 END AS bf, k FROM ev)"
_CPU = "greatest(0, least(100, f * 100))"
_MEM = "CASE WHEN total > 0 THEN greatest(0, (total - free) * 100.0::DOUBLE / total) END"


@query(f"WITH {EV}, {_ST} SELECT host_name, app_name, batch_seq, round(f, 9) AS f, free, total, '/:' || rs || ':' || rf || CASE WHEN k % 3 = 0 THEN ',/boot:' || bs || ':' || coalesce(bf::VARCHAR, '') ELSE '' END AS fss FROM st")
def instance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("fss", lambda x: F.concat(x["mount_point"], F.lit(":"), x["size"].cast("string"), F.lit(":"), F.coalesce(x["free"].cast("string"), F.lit("")))), ",")
    return stats(spark, sf_dir).select(*K, "batch_seq", F.round("user_time_fraction", 9).alias("f"), F.col("memory_free").alias("free"), F.col("memory_total").alias("total"), shown.alias("fss"))


@query(f"WITH {EV}, {_ST} SELECT batch_seq, round({_CPU} + 1e-9, 6) AS cpu_percent, round(CASE WHEN free IS NOT NULL THEN {_MEM} END + 1e-9, 6) AS memory_percent FROM st")
def health_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.health_percents(stats(spark, sf_dir)).select("batch_seq", "cpu_percent", "memory_percent"), "cpu_percent", "memory_percent")


@query(f"WITH {EV}, {_ST} SELECT batch_seq, rs + CASE WHEN bf IS NOT NULL THEN bs ELSE 0 END AS size, rf + coalesce(bf, 0) AS free FROM st")
def combine_fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.combine_fs(stats(spark, sf_dir)).select("batch_seq", F.col("fss")[0]["size"].alias("size"), F.col("fss")[0]["free"].alias("free"))


_HOUR = "CAST(floor(ts / 86400 + 0.5) * 86400 AS BIGINT)"


def _vars(x: str, name: str, whole: bool) -> str:
    r = (lambda e: f"({e})::BIGINT") if whole else (lambda e: f"round({e} + 1e-9, 4)")
    return f"count({x}) AS {name}_count, {r(f'min({x})')} AS {name}_min, {r(f'max({x})')} AS {name}_max, {r(f'sum({x})')} AS {name}_sum"


@query(f"WITH {EV}, {_ST}, p AS (SELECT *, {_HOUR} AS d, {_CPU} AS cpu, CASE WHEN free IS NOT NULL THEN {_MEM} END AS mem FROM st) SELECT 'acct' AS account, host_name AS instance, 'r1' AS region, d AS ts, {_vars('cpu', 'cpu', False)}, {_vars('free', 'memory_free', True)}, {_vars('total', 'memory_size', True)}, {_vars('mem', 'memory_percent', False)} FROM p GROUP BY host_name, d")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = H.health_rollup(stats(spark, sf_dir), 86400)
    return rounded(out, *[c for c in out.columns if c.startswith(("cpu_m", "cpu_s", "memory_percent_m", "memory_percent_s"))], digits=4)


@query(f"""WITH {EV}, {_ST}, f AS (SELECT host_name, {_HOUR} AS d, '/' AS m, rs AS s, rf AS f FROM st UNION ALL SELECT host_name, {_HOUR}, '/boot', bs, bf FROM st WHERE bs IS NOT NULL),
p AS (SELECT *, greatest(s - f, 0) AS u, CASE WHEN s > 0 AND f IS NOT NULL THEN greatest(0, (s - f) * 100.0::DOUBLE / s) END AS up FROM f)
SELECT host_name AS instance, d AS ts, m AS mount_point, {_vars('s', 'size', True)}, {_vars('f', 'free', True)}, {_vars('CASE WHEN f IS NOT NULL THEN u END', 'used', True)}, {_vars('up', 'used_percent', False)} FROM p GROUP BY host_name, d, m""")
def fs_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = H.fs_rollup(stats(spark, sf_dir), 86400).drop("account", "region")
    return rounded(out, "used_percent_min", "used_percent_max", "used_percent_sum", digits=4)


@query(f"WITH {EV}, {_ST} SELECT batch_seq, CASE WHEN k % 2 = 1 THEN round(f, 9) END AS f, free, CASE WHEN k % 2 = 1 THEN 1 + (k % 3 = 0)::INTEGER END AS n_fs FROM st")
def memory_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats(spark, sf_dir).join(events(spark, sf_dir).select("batch_seq", "k"), "batch_seq")
    return H.memory_only(s, F.col("k") % 2 == 0).select("batch_seq", F.round("user_time_fraction", 9).alias("f"), F.col("memory_free").alias("free"), F.when(F.col("fss").isNotNull(), F.size("fss")).alias("n_fs"))


@query(f"WITH {EV}, m AS (SELECT *, max(ts) OVER (PARTITION BY host_name) AS m FROM ev) SELECT host_name, batch_seq FROM m WHERE ts >= m - 172800")
def retain_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.retain(events(spark, sf_dir), 172800, ["host_name"]).select("host_name", "batch_seq")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = events(spark, sf_dir).select("host_name", "ts", (F.col("k") * F.when(F.col("k") % 9 == 0, 5).otherwise(1)).alias("n_fs"))
    return H.pack_batches(snaps, ["host_name"])


@query(f"""WITH RECURSIVE {EV}, s AS (SELECT host_name, ts, k * CASE WHEN k % 9 = 0 THEN 5 ELSE 1 END AS n, row_number() OVER (PARTITION BY host_name ORDER BY ts, k * CASE WHEN k % 9 = 0 THEN 5 ELSE 1 END) AS i FROM ev),
r AS (SELECT host_name, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS nxt, NULL::DOUBLE AS ts, 0::BIGINT AS n, 0::BIGINT AS batch, false AS big FROM (SELECT DISTINCT host_name FROM s)
 UNION ALL SELECT s.host_name, s.i, CASE WHEN 12 + 9 * s.n > 1000 THEN 0 WHEN r.used + 12 + 9 * s.n > 1000 THEN 12 + 9 * s.n ELSE r.used + 12 + 9 * s.n END,
  CASE WHEN 12 + 9 * s.n > 1000 THEN r.nxt + (r.used > 0)::BIGINT + 1 + (s.n - 109 + 110) // 111 WHEN r.used + 12 + 9 * s.n > 1000 THEN r.nxt + 1 ELSE r.nxt END, s.ts, s.n,
  CASE WHEN 12 + 9 * s.n > 1000 THEN r.nxt + (r.used > 0)::BIGINT WHEN r.used + 12 + 9 * s.n > 1000 THEN r.nxt + 1 ELSE r.nxt END, 12 + 9 * s.n > 1000 FROM r JOIN s ON s.host_name = r.host_name AND s.i = r.i + 1)
SELECT host_name, ts, CASE WHEN big AND j > 0 THEN 109 + (j - 1) * 111 ELSE 0 END AS fs_from, CASE WHEN NOT big THEN n WHEN j = 0 THEN 109 ELSE least(111, n - 109 - (j - 1) * 111) END AS fs_count, j = 0 AS with_instance, batch + j AS batch
FROM r, LATERAL (SELECT unnest(range(CASE WHEN big THEN 1 + (n - 109 + 110) // 111 ELSE 1 END)) AS j) WHERE i > 0""")
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


#: The calls of the snapshots s (host_name, ts, n, i: the place in a host's order).
_CALLS = """r AS (SELECT host_name, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS nxt, NULL::DOUBLE AS ts, 0::BIGINT AS n, 0::BIGINT AS batch, false AS big FROM (SELECT DISTINCT host_name FROM s)
 UNION ALL SELECT s.host_name, s.i, CASE WHEN 12 + 9 * s.n > 1000 THEN 0 WHEN r.used + 12 + 9 * s.n > 1000 THEN 12 + 9 * s.n ELSE r.used + 12 + 9 * s.n END,
  CASE WHEN 12 + 9 * s.n > 1000 THEN r.nxt + (r.used > 0)::BIGINT + 1 + (s.n - 109 + 110) // 111 WHEN r.used + 12 + 9 * s.n > 1000 THEN r.nxt + 1 ELSE r.nxt END, s.ts, s.n,
  CASE WHEN 12 + 9 * s.n > 1000 THEN r.nxt + (r.used > 0)::BIGINT WHEN r.used + 12 + 9 * s.n > 1000 THEN r.nxt + 1 ELSE r.nxt END, 12 + 9 * s.n > 1000 FROM r JOIN s ON s.host_name = r.host_name AND s.i = r.i + 1)
SELECT host_name, ts, CASE WHEN big AND j > 0 THEN 109 + (j - 1) * 111 ELSE 0 END AS fs_from, CASE WHEN NOT big THEN n WHEN j = 0 THEN 109 ELSE least(111, n - 109 - (j - 1) * 111) END AS fs_count, j = 0 AS with_instance, batch + j AS batch
FROM r, LATERAL (SELECT unnest(range(CASE WHEN big THEN 1 + (n - 109 + 110) // 111 ELSE 1 END)) AS j) WHERE i > 0"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("host_name", "user_id", "ts", (F.col("k") * F.when(F.col("k") % 9 == 0, 5).otherwise(1)).alias("n_fs"))


_N_FS = "k * CASE WHEN k % 9 = 0 THEN 5 ELSE 1 END"


@query(f"WITH RECURSIVE {EV}, m AS (SELECT *, max(ts) OVER (PARTITION BY host_name) AS m FROM ev), s AS (SELECT host_name, ts, {_N_FS} AS n, row_number() OVER (PARTITION BY host_name ORDER BY ts, {_N_FS}) AS i FROM m WHERE ts >= m - 172800), {_CALLS}")
def pack_batches_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of the snapshots that are kept, those of a host's last 48 hours."""
    return H.pack_batches(H.retain(_snapshots(spark, sf_dir).drop("user_id"), 172800, ["host_name"]), ["host_name"])


@query(f"WITH RECURSIVE {EV}, o AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE host_name END AS host_name, ts, {_N_FS} AS n FROM ev), s AS (SELECT *, row_number() OVER (PARTITION BY host_name ORDER BY ts, n) AS i FROM o), {_CALLS}")
def pack_batches_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key has a third of all snapshots: it is packed over slices."""
    snaps = _snapshots(spark, sf_dir).withColumn("host_name", F.when(F.col("user_id") % 3 == 0, "hot").otherwise(F.col("host_name"))).drop("user_id")
    return B.pack_batches(snaps, ["host_name"], L.find_slices(snaps, few=100, keys=["host_name"]))


@query(f"WITH {EV}, {_ST} SELECT DISTINCT host_name, app_name, '/' AS mount_point FROM st UNION ALL SELECT DISTINCT host_name, app_name, '/boot' FROM st WHERE bs IS NOT NULL")
def file_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.file_systems(health_obs(spark, sf_dir))


@query(f"""WITH {EV}, {_ST}, p AS (SELECT *, {_HOUR} AS d, {_CPU} AS cpu, CASE WHEN free IS NOT NULL THEN {_MEM} END AS mem FROM st), f AS (SELECT host_name, d, greatest(rs - rf, 0) AS u, (rs - rf) * 100.0::DOUBLE / rs AS up, rs FROM p),
a AS (SELECT host_name, d, unnest([('CpuUsedPercentAvg', avg(cpu)), ('CpuUsedPercentMax', max(cpu)), ('CpuUsedPercentMin', min(cpu)), ('MemoryFreeBytesAvg', (sum(free) // count(free))::DOUBLE), ('MemoryFreeBytesMax', max(free)::DOUBLE), ('MemoryFreeBytesMin', min(free)::DOUBLE), ('MemorySizeBytesAvg', (sum(total) // count(total))::DOUBLE), ('MemorySizeBytesMax', max(total)::DOUBLE), ('MemorySizeBytesMin', min(total)::DOUBLE), ('MemoryUsedPercentAvg', avg(mem)), ('MemoryUsedPercentMax', max(mem)), ('MemoryUsedPercentMin', min(mem))]) AS c FROM p GROUP BY host_name, d
UNION ALL SELECT host_name, d, unnest([('FsSizeBytesAvg', (sum(rs) // count(rs))::DOUBLE), ('FsSizeBytesMax', max(rs)::DOUBLE), ('FsSizeBytesMin', min(rs)::DOUBLE), ('FsUsedBytesAvg', (sum(u) // count(u))::DOUBLE), ('FsUsedBytesMax', max(u)::DOUBLE), ('FsUsedBytesMin', min(u)::DOUBLE), ('FsUsedPercentAvg', avg(greatest(up, 0))), ('FsUsedPercentMax', max(greatest(up, 0))), ('FsUsedPercentMin', min(greatest(up, 0)))]) FROM f GROUP BY host_name, d)
SELECT host_name AS instance, d AS ts, c[1] AS metric, round(c[2] + 1e-9, 4) AS value FROM a""")
def snapshot_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats(spark, sf_dir)
    return rounded(X.snapshot_to_long(H.health_rollup(s, 86400), H.fs_rollup(s, 86400)).select("instance", "ts", "metric", "value"), "value", digits=4)


@query(f"""WITH {EV}, {_ST}, p AS (SELECT *, {_HOUR} AS d, {_CPU} AS cpu, CASE WHEN free IS NOT NULL THEN {_MEM} END AS mem, rs + CASE WHEN bf IS NOT NULL THEN bs ELSE 0 END AS s, rf + coalesce(bf, 0) AS f2 FROM st)
SELECT instance, ts, metric, round(value + 1e-9, 4) AS value FROM (SELECT host_name AS instance, d AS ts, 'CpuUsedPercent' AS metric, avg(cpu) AS value FROM p GROUP BY ALL UNION ALL SELECT host_name, d, 'MemoryUsedPercent', avg(mem) FROM p GROUP BY ALL UNION ALL SELECT host_name, d, 'FileSystemUsedPercent', avg(greatest(0, (s - f2) * 100.0::DOUBLE / s)) FROM p GROUP BY ALL) WHERE value IS NOT NULL""")
def snapshot_to_datums(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = H.combine_fs(stats(spark, sf_dir))
    return rounded(X.snapshot_to_datums(H.health_rollup(s, 86400), H.fs_rollup(s, 86400)).drop("region"), "value", digits=4)


def _cells(names: tuple, values: tuple) -> str:
    """SQL: one struct (column, value) for each cell: average, largest and smallest of each variable."""
    out = []
    for k, (x, whole) in enumerate(values):
        mean = f"(sum({x}) // count({x}))::DOUBLE" if whole else f"avg({x})"
        out += [f"('{n}', {v})" for n, v in zip(names[3 * k : 3 * k + 3], (mean, f"max({x})::DOUBLE", f"min({x})::DOUBLE"))]
    return f"unnest([{', '.join(out)}])"


@query(f"""WITH {EV}, {_ST}, p AS (SELECT *, {_HOUR} AS d, {_CPU} AS cpu, CASE WHEN free IS NOT NULL THEN {_MEM} END AS mem FROM st),
f AS (SELECT host_name, {_HOUR} AS d, '/' AS m, rs AS s, rf AS f FROM st UNION ALL SELECT host_name, {_HOUR}, '/boot', bs, bf FROM st WHERE bs IS NOT NULL),
u AS (SELECT *, CASE WHEN f IS NOT NULL THEN greatest(s - f, 0) END AS u, CASE WHEN s > 0 AND f IS NOT NULL THEN greatest(0, (s - f) * 100.0::DOUBLE / s) END AS up FROM f),
c AS (SELECT host_name, d, 'aws:ec2:instance' AS kind, 'dc:main:' || host_name AS asset, {_cells(X.INSTANCE_COLUMNS, (("cpu", False), ("free", True), ("total", True), ("mem", False)))} AS c FROM p GROUP BY host_name, d
UNION ALL SELECT host_name, d, 'aws:ec2:instance:fs', 'dc:main:' || host_name || ':' || m, {_cells(X.FS_COLUMNS, (("s", True), ("u", True), ("up", False)))} FROM u GROUP BY host_name, d, m)
SELECT host_name AS instance, d AS ts, kind, asset, strftime(make_timestamp(d * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS stamp, c[1] AS name, round(c[2] + 1e-9, 4) AS value FROM c""")
def to_dashboard_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the payloads, read back from the JSON."""
    s = stats(spark, sf_dir).withColumn("account", F.lit(""))
    out = X.to_dashboard_payload(H.health_rollup(s, 86400), "dc", "main", H.fs_rollup(s, 86400))
    parsed = F.from_json("payload", "struct<metrics: struct<datasets: array<struct<metadata: struct<assetType: string, keys: array<string>>, values: array<array<string>>>>>>")
    sets = out.select("instance", "ts", F.explode(parsed["metrics"]["datasets"]).alias("set")).select("instance", "ts", F.col("set.metadata.assetType").alias("kind"), F.col("set.metadata.keys").alias("keys"), F.explode("set.values").alias("row"))
    cells = sets.select("instance", "ts", "kind", F.col("row")[0].alias("asset"), F.col("row")[1].alias("stamp"), F.explode(F.slice(F.arrays_zip("keys", "row"), 3, 99)).alias("c"))
    return rounded(cells.select("instance", "ts", "kind", "asset", "stamp", F.col("c.keys").alias("name"), F.col("c.row").cast("double").alias("value")), "value", digits=4)


def _package_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages: ten to a machine, two management types, sizes of a wrong kind where p_size is a multiple of 7."""
    p = table(spark, sf_dir, "part")
    base = p.select(F.concat(F.lit("host"), F.expr("p_partkey div 10")).alias("host_name"), F.lit("a").alias("app_name"), F.lit(1).cast("long").alias("batch_seq"), F.when(F.expr("p_partkey div 10 % 2 = 0"), "debs").otherwise("rpms").alias("mgmt"), F.concat(F.lit("p."), "p_partkey").alias("name"), F.col("p_size").cast("long").alias("size"), "p_type", (F.col("p_partkey") + 0.5).alias("ts"))
    path = lambda leaf: F.concat(F.lit("/sys/packages/"), "mgmt", F.lit("/"), "name", F.lit(f"/{leaf}"))
    cells = F.array(F.struct(path("size").alias("path"), F.when(F.col("size") % 7 == 0, "string").otherwise("uint64").alias("kind"), F.col("size").alias("value_long"), F.lit(None).cast("string").alias("value_string")), F.struct(path("version").alias("path"), F.lit("string").alias("kind"), F.lit(None).cast("long").alias("value_long"), F.col("p_type").alias("value_string")))
    obs = base.select(*K, "batch_seq", "ts", F.explode(cells).alias("c")).select(*K, "batch_seq", "ts", "c.*")
    ids = base.select(*K, "batch_seq", F.lit(0.0).alias("ts"), F.lit("/sys/cloud/aws/instance-id").alias("path"), F.lit("string").alias("kind"), F.lit(None).cast("long").alias("value_long"), F.concat(F.lit("i-"), "host_name").alias("value_string")).distinct()
    return obs.unionByName(ids)


_PKG = "pk AS (SELECT 'host' || (p_partkey // 10) AS host_name, CASE WHEN (p_partkey // 10) % 2 = 0 THEN 'debs' ELSE 'rpms' END AS mgmt, 'p.' || p_partkey AS name, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END AS size, p_type AS version, p_partkey + 0.5 AS ts FROM part)"


@query(f"WITH {_PKG} SELECT 'i-' || host_name AS instance_id, mgmt, min_by(ts, name)::DOUBLE AS ts, string_agg(name || '=' || version || '=' || size, ',' ORDER BY name) AS packages FROM pk GROUP BY host_name, mgmt")
def package_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("packages", lambda p: F.concat(p["name"], F.lit("="), p["version"], F.lit("="), p["size"].cast("string"))), ",")
    return I.package_inventory(_package_obs(spark, sf_dir)).select("instance_id", "mgmt", "ts", shown.alias("packages"))


@query(f"WITH {_PKG} SELECT 'i-' || host_name AS instance_id, '{{\"pkgMgmtType\":\"' || mgmt || '\",\"installed\":{{' || string_agg('\"' || replace(name, '.', '_') || '\":{{\"version\":\"' || version || '\",\"size\":' || size || '}}', ',' ORDER BY name) || '}}}}' AS body FROM pk GROUP BY host_name, mgmt")
def inventory_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.inventory_to_json(I.package_inventory(_package_obs(spark, sf_dir)))


@query(f"WITH {_PKG}, b AS (SELECT host_name, mgmt, '{{\"pkgMgmtType\":\"' || mgmt || '\",\"installed\":{{' || string_agg('\"' || replace(name, '.', '_') || '\":{{\"version\":\"' || version || '\",\"size\":' || size || '}}', ',' ORDER BY name) || '}}}}' AS body FROM pk GROUP BY host_name, mgmt) SELECT right(host_name, 1) AS call, '{{' || string_agg('\"i-' || host_name || '\":' || body, ',' ORDER BY 'i-' || host_name) || '}}' AS body FROM b GROUP BY 1")
def bulk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for all machines whose name ends in the same digit."""
    bodies = I.inventory_to_json(I.package_inventory(_package_obs(spark, sf_dir)))
    return I.bulk_json(bodies.withColumn("call", F.substring("instance_id", -1, 1)), ["call"])


def _levels_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("host_name").alias("instance_id"), "ts", F.array(F.struct(F.lit("n").alias("name"), (F.floor(F.col("value") / 40)).cast("string").alias("version"), F.lit(1).alias("size"))).alias("packages"))


@query(f"WITH {EV}, w AS (SELECT host_name, ts, CAST(floor(value / 40) AS BIGINT) AS v, lag(CAST(floor(value / 40) AS BIGINT)) OVER (PARTITION BY host_name ORDER BY ts) AS p FROM ev) SELECT host_name AS instance_id, ts, v::VARCHAR AS version FROM w WHERE v IS DISTINCT FROM p")
def changed_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.changed_inventories(_levels_inventories(spark, sf_dir)).select("instance_id", "ts", F.col("packages")[0]["version"].alias("version"))


@query(f"WITH {EV} SELECT host_name AS instance_id, max(ts) AS ts, CAST(floor(max_by(value, ts) / 40) AS BIGINT)::VARCHAR AS version FROM ev GROUP BY host_name")
def newest_pending_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.newest_pending(_levels_inventories(spark, sf_dir)).select("instance_id", "ts", F.col("packages")[0]["version"].alias("version"))


@query(f"WITH {EV} SELECT host_name, batch_seq, app_name AS name, 6900 + k AS port, k % 2 = 0 AS use_tls FROM ev WHERE k % 3 <> 0 AND k % 7 <> 0")
def discover_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    path = lambda leaf: F.concat(F.lit("/health-checks/"), "app_name", F.lit(f"/{leaf}")).alias("path")
    none = lambda kind: F.lit(None).cast(kind)
    k = F.col("k")
    cells = F.array(
        F.struct(path("has-own-metrics"), F.lit("bool").alias("kind"), (k % 3 != 0).alias("value_bool"), none("long").alias("value_long")),
        F.struct(path("port-number"), F.when(k % 7 == 0, "string").otherwise("int32").alias("kind"), none("boolean").alias("value_bool"), (k + 6900).alias("value_long")),
        F.struct(path("use-tls"), F.lit("bool").alias("kind"), F.when(k % 2 == 0, True).alias("value_bool"), none("long").alias("value_long")),
    )
    return I.discover_apps(e.select("host_name", "batch_seq", F.explode(cells).alias("c")).select("host_name", "batch_seq", "c.*"), "has-own-metrics")


_HALF = 1704067200 + 14 * 86400


@query(f"WITH {EV}, o AS (SELECT host_name, (max(k) % 2 = 0) AS was FROM ev WHERE ts < {_HALF} GROUP BY 1), n AS (SELECT DISTINCT host_name FROM ev WHERE ts >= {_HALF} AND app_name = 'click') SELECT coalesce(o.host_name, n.host_name) AS host_name, n.host_name IS NOT NULL AS active, CASE WHEN was IS NULL THEN 'added' WHEN n.host_name IS NULL THEN CASE WHEN was THEN 'removed' ELSE 'gone' END ELSE CASE WHEN was THEN 'kept' ELSE 'returned' END END AS status FROM o FULL JOIN n ON o.host_name = n.host_name")
def diff_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    old = e.where(F.col("ts") < _HALF).groupBy("host_name").agg((F.max("k") % 2 == 0).alias("active"))
    return E.diff_machines(old, e.where((F.col("ts") >= _HALF) & (F.col("app_name") == "click")).select("host_name"))


@query(f"WITH {EV}, w AS (SELECT host_name, batch_seq // 3 AS s, batch_seq, app_name, k, max(batch_seq // 3) OVER (PARTITION BY host_name ORDER BY batch_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev) SELECT host_name, count(*) AS seq_no, max_by(app_name || ':' || k, s) AS app FROM w WHERE m IS NULL OR s > m GROUP BY host_name")
def host_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    apps = F.array(F.struct("app_name", F.col("k").alias("port"), F.lit(False).alias("is_tls")))
    reports = e.select("host_name", F.expr("batch_seq div 3").alias("batch_seq"), F.col("batch_seq").alias("arrival"), apps.alias("apps"))
    return E.host_reports(reports).select("host_name", "seq_no", F.concat(F.col("apps")[0]["app_name"], F.lit(":"), F.col("apps")[0]["port"].cast("string")).alias("app"))


@query(f"WITH {EV}, w AS (SELECT host_name, batch_seq // 3 AS s, batch_seq, app_name, k, max(batch_seq // 3) OVER (PARTITION BY host_name ORDER BY batch_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev), l AS (SELECT host_name, count(*) AS seq_no, max_by(app_name, s) AS app, max_by(k, s) AS port FROM w WHERE m IS NULL OR s > m GROUP BY host_name) SELECT host_name, seq_no, app || ':' || port || CASE WHEN port = 6 THEN '' ELSE ',extra:6' END AS apps FROM l")
def add_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host's newest list with one more application, unless its port is taken."""
    e = events(spark, sf_dir)
    apps = F.array(F.struct("app_name", F.col("k").alias("port"), F.lit(False).alias("is_tls")))
    reports = E.host_reports(e.select("host_name", F.expr("batch_seq div 3").alias("batch_seq"), F.col("batch_seq").alias("arrival"), apps.alias("apps")))
    extra = e.select("host_name", F.lit("extra").alias("app_name"), F.lit(6).cast("long").alias("port"), F.lit(False).alias("is_tls")).distinct()
    shown = F.array_join(F.transform("apps", lambda a: F.concat_ws(":", a["app_name"], a["port"].cast("string"))), ",")
    return E.add_application(reports, extra).select("host_name", "seq_no", shown.alias("apps"))


@query(f"WITH {_PKG} SELECT DISTINCT host_name FROM pk WHERE regexp_matches(host_name, 't[12]') AND NOT regexp_matches(host_name, '5$')")
def hosts_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines that feed the inventory: those of one host pattern that another does not match."""
    hosts = _package_obs(spark, sf_dir).select("host_name").distinct()
    return E.hosts_matching(hosts, "t[12]").join(E.hosts_matching(hosts, "5$"), "host_name", "left_anti")


@query(f"""WITH {EV}, r AS (SELECT host_name, batch_seq AS seq_no, app_name AS here, row_number() OVER (PARTITION BY host_name ORDER BY batch_seq) AS i FROM ev), a AS (SELECT host_name, here AS app_name, min(i) AS f FROM r GROUP BY ALL),
x AS (SELECT r.host_name, seq_no, app_name, i, max(CASE WHEN here = app_name THEN i END) OVER (PARTITION BY r.host_name, app_name ORDER BY i) AS l FROM r JOIN a ON a.host_name = r.host_name AND i >= f) SELECT host_name, seq_no, app_name, i - l < 3 AS active FROM x""")
def app_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = events(spark, sf_dir).select("host_name", F.col("batch_seq").alias("seq_no"), "app_name")
    return E.app_activity(listed, listed, 3)


_ACT = f"m AS (SELECT host_name, max(k) % 2 = 0 AS active FROM ev WHERE app_name <> 'view' GROUP BY 1), a AS (SELECT host_name, app_name, max(k) % 3 <> 0 AS active FROM ev GROUP BY ALL)"


@query(f"WITH {EV}, {_ACT} SELECT a.host_name, app_name, coalesce(m.active, false) AND a.active AS active FROM a LEFT JOIN m USING (host_name)")
def endpoint_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    machines = e.where("app_name <> 'view'").groupBy("host_name").agg((F.max("k") % 2 == 0).alias("active"))
    return E.endpoint_activity(machines, e.groupBy(*K).agg((F.max("k") % 3 != 0).alias("active")))


@query(f"WITH {EV}, s AS (SELECT host_name, app_name, max(k) % 2 = 0 AS h, max(k) % 3 <> 0 AS a, min(k) % 5 = 0 AS d FROM ev GROUP BY ALL) SELECT count(*) AS total, count(*) FILTER (h AND a) AS active, count(*) FILTER (h AND a AND d) AS failed, count(*) FILTER (h AND a AND NOT d) AS up FROM s")
def endpoint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy(*K).agg((F.max("k") % 2 == 0).alias("host_active"), (F.max("k") % 3 != 0).alias("app_active"), (F.min("k") % 5 == 0).alias("down"))
    return E.endpoint_summary(s)


@query(f"WITH {EV}, w AS (SELECT *, row_number() OVER (PARTITION BY host_name, app_name ORDER BY batch_seq) AS n FROM ev) SELECT host_name, app_name, max(k) FILTER (n = 1) AS initial, round(coalesce(avg(k) FILTER (n > 1), 0) + 1e-9, 6) AS average FROM w GROUP BY ALL")
def changed_metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.changed_metric_stats(events(spark, sf_dir).select(*K, "batch_seq", F.col("k").alias("changed"))), "average")


@query(f"""WITH {EV}, s AS (SELECT host_name, batch_seq // 40 AS sweep, app_name, ts, ts - lag(ts) OVER (PARTITION BY host_name, batch_seq // 40 ORDER BY ts) AS d FROM ev),
p AS (SELECT host_name, sweep, max(d) FILTER (app_name = 'click') AS wait_connect, max(d) FILTER (app_name = 'error') AS connect, max(d) FILTER (app_name = 'purchase') AS wait_poll, max(d) FILTER (app_name = 'view') AS poll FROM s GROUP BY ALL)
SELECT host_name, sweep, round(wait_connect + 1e-9, 3) AS wait_connect, round(connect + 1e-9, 3) AS connect, round(wait_poll + 1e-9, 3) AS wait_poll, round(poll + 1e-9, 3) AS poll, round(CASE WHEN poll IS NOT NULL THEN wait_connect + connect + wait_poll + poll END + 1e-9, 3) AS total FROM p""")
def poll_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"click": "connecting", "error": "waiting_to_poll", "purchase": "polling", "view": "synced"}
    state = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("app_name")]
    s = events(spark, sf_dir).select("host_name", F.lit("a").alias("app_name"), F.expr("batch_seq div 40").alias("sweep"), F.coalesce(state, F.lit("start")).alias("state"), "ts")
    return rounded(E.poll_durations(s).drop("app_name"), "wait_connect", "connect", "wait_poll", "poll", "total", digits=3)


@query(f"WITH {EV}, l AS (SELECT host_name, app_name, max(ts) AS ts, max_by(k, ts) AS k FROM ev GROUP BY ALL) SELECT host_name, app_name, ts, 'e' || k AS error FROM l WHERE k % 3 = 0")
def current_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return E.current_errors(e.select(*K, "ts", F.when(F.col("k") % 3 == 0, F.concat(F.lit("e"), "k")).alias("error")))


@query(f"""WITH {EV}, m AS (SELECT DISTINCT user_id FROM ev), t AS (SELECT user_id, user_id % 2 = 0 AS test, CASE user_id % 5 WHEN 0 THEN '15m' WHEN 1 THEN '30s' WHEN 2 THEN '1h30m' WHEN 3 THEN 'often' END AS p FROM m)
SELECT 'host' || user_id AS host_name, NOT test AS health_export, NOT test AND p IS NULL AS memory_only, CASE WHEN test THEN 0 WHEN p = '15m' THEN 900 WHEN p = '1h30m' THEN 5400 ELSE 300 END::DOUBLE AS alarm_period FROM t""")
def aws_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir).select("host_name", "user_id").distinct()
    u = F.col("user_id")
    period = F.when(u % 5 == 0, "15m").when(u % 5 == 1, "30s").when(u % 5 == 2, "1h30m").when(u % 5 == 3, "often")
    entries = F.array_compact(F.array(F.when(u % 2 == 0, F.struct(F.lit("HealthTest").alias("k"), F.lit("").alias("v"))), F.when(period.isNotNull(), F.struct(F.lit("AlarmPeriod").alias("k"), period.alias("v")))))
    return E.aws_policy(m.withColumn("tags", F.map_from_entries(entries)), test_mode=False, default_seconds=300).select("host_name", "health_export", "memory_only", "alarm_period")


@query(f"WITH {PTS}, {EP} SELECT host_name, app_name, path, ts, region, ip_address FROM pts JOIN ep USING (host_name, app_name)")
def join_endpoint_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_tags(points(spark, sf_dir).select(*K, "path", "ts"), endpoints(spark, sf_dir))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '10.0.0.' || s_suppkey ELSE 'box' || s_suppkey END AS connect_id FROM supplier")
def connect_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    ip = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("10.0.0."), "s_suppkey")).otherwise("")
    return s.select("s_suppkey", C.connect_id(F.concat(F.lit("box"), "s_suppkey", F.lit("*old")), ip).alias("connect_id"))
