"""Queries: selection for export, payloads, monitoring, scalar functions, parameters and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions import params as P
from gaugeflow.functions import scalars as C
from gaugeflow.model import K
from gaugeflow.operators import export as X
from gaugeflow.operators import monitor as M
from gaugeflow.operators import query as Q
from gaugeflow.plans.adapters import END, EP, EV, PTS, START, endpoints, events, points, rounded, table
from gaugeflow.plans.registry import query
from gaugeflow.sources import readers as S
from gaugeflow.sources.shared import scratch

#: Each event as a record of some kind: float64, int64, string, bool or duration by application.
_KIND = "CASE app_name WHEN 'click' THEN 'float64' WHEN 'error' THEN 'int64' WHEN 'purchase' THEN 'string' WHEN 'signup' THEN 'bool' ELSE 'duration' END"
_REC = f"rec AS (SELECT *, {_KIND} AS kind, CASE WHEN app_name = 'view' THEN 'ms' ELSE '' END AS unit FROM ev)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("click", "float64", "error", "int64", "purchase", "string", "signup", "bool", "view", "duration")])[F.col("app_name")]
    e = events(spark, sf_dir).withColumn("kind", kind)
    return e.select(
        *K,
        F.lit("/events/value").alias("path"),
        "batch_seq",
        "ts",
        "kind",
        F.lit("").alias("sub_type"),
        F.when(F.col("app_name") == "view", "ms").otherwise("").alias("unit"),
        F.when(F.col("kind").isin("float64", "duration"), F.col("value")).alias("value_double"),
        F.when(F.col("kind") == "int64", F.col("k")).alias("value_long"),
        F.when(F.col("kind") == "bool", F.col("k") % 2 == 0).alias("value_bool"),
        F.when(F.col("kind") == "string", F.concat(F.lit("s"), "k")).alias("value_string"),
        (F.col("k") % 7 != 0).alias("active"),
    )


_NUM = "CASE kind WHEN 'float64' THEN value WHEN 'int64' THEN k WHEN 'bool' THEN (k % 2 = 0)::INTEGER WHEN 'duration' THEN value * 1000 END"


@query(f"WITH {EV}, {_REC} SELECT batch_seq, round({_NUM}, 6)::DOUBLE AS number FROM rec")
def as_float64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("batch_seq", F.round(C.as_float64("kind", unit="unit"), 6).alias("number"))


@query(f"WITH {EV}, {EP}, {_REC} SELECT host_name AS host, app_name, region, ip_address, kind, count(*) AS n FROM rec JOIN ep USING (host_name, app_name) GROUP BY ALL")
def to_export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.to_export_records(records(spark, sf_dir), endpoints(spark, sf_dir))
    return out.groupBy("host", F.col("tags")["appname"].alias("app_name"), F.col("tags")["region"].alias("region"), F.col("tags")["ipaddress"].alias("ip_address"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV}, {_REC} SELECT host_name, kind, count(*) AS n FROM rec WHERE kind IN ('int64', 'float64', 'bool', 'duration') AND k % 7 <> 0 AND NOT regexp_matches('/events/' || app_name, 'k$|^/events/v') GROUP BY ALL")
def export_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active records of some kinds without the paths that either pattern matches (clicks and views)."""
    rec = records(spark, sf_dir).withColumn("path", F.concat(F.lit("/events/"), "app_name"))
    own = X.exclude_metrics(X.active_only(X.filter_supported(rec, [k for k in X.TSDB_KINDS if k != "string"])), ["k$", "^/events/v"])
    return own.groupBy("host_name", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PTS} SELECT host_name, path, count(*) AS n FROM pts WHERE regexp_matches(path, 'val') AND regexp_matches(host_name, '1$') GROUP BY ALL")
def debug_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.debug_filter(points(spark, sf_dir), "val", "1$").groupBy("host_name", "path").agg(F.count(F.lit(1)).alias("n"))


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.to_export_records(records(spark, sf_dir), endpoints(spark, sf_dir))


@query(f"WITH {EV}, {EP}, {_REC} SELECT host_name AS key, '_events_value' AS name, strftime(make_timestamp(CAST(floor(round(ts * 1000000) / 1000) AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp, '1' AS version, 'tenant' AS tenant, 'key' AS api_key, app_name, region, CASE WHEN kind = 'string' THEN 's' || k END AS string_value, round(CASE WHEN kind = 'string' THEN 0 ELSE {_NUM} END, 6)::DOUBLE AS value FROM rec JOIN ep USING (host_name, app_name)")
def to_json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads' fields, read back from the JSON."""
    out = X.to_json_payload(_exported(spark, sf_dir), "tenant", "key", slashes_to_underscores=True)
    f = lambda name: F.get_json_object("payload", f"$['{name}']")
    return out.select("key", f("name").alias("name"), f("@timestamp").alias("stamp"), f("@version").alias("version"), f("tenant_id").alias("tenant"), f("apikey").alias("api_key"), f("appname").alias("app_name"), f("region").alias("region"), f("stringValue").alias("string_value"), F.round(f("value").cast("double"), 6).alias("value"))


_TEXT = "CASE WHEN kind = 'string' THEN 's' || k END"


@query(f"""WITH {EV}, {EP}, {_REC} SELECT '/events/value,@version=1,appname=' || app_name || ',host=' || host_name || ',ipaddress=' || ip_address || ',region=' || replace(region, ' ', '\\ ') || ' name="/events/value"' AS head, {_TEXT} AS text, CASE WHEN kind <> 'string' THEN round({_NUM} + 1e-9, 6) END::DOUBLE AS number, CAST(round(ts * 1000000) AS BIGINT) * 1000 AS nanos FROM rec JOIN ep USING (host_name, app_name)""")
def to_influx_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all kinds, cut up again: measurement, tags and name; the value as text or number; the time."""
    parts = lambda i: F.regexp_extract("line", r'^(.*),value=(?:"(.*)"|([^" ]+)) (\d+)$', i)
    cut = X.to_influx_points(_exported(spark, sf_dir)).select(parts(1).alias("head"), F.nullif(parts(2), F.lit("")).alias("text"), parts(3).try_cast("double").alias("number"), parts(4).cast("long").alias("nanos"))
    return rounded(cut, "number")


@query(f"""WITH {EV}, {EP}, {_REC} SELECT '/events/"' || app_name || '"' AS metric, CAST(floor(ts) AS BIGINT) AS timestamp, {_TEXT} AS text, CASE WHEN kind <> 'string' THEN round({_NUM} + 1e-9, 6) END::DOUBLE AS number, host_name, app_name, ip_address, region || ' \\' AS region FROM rec JOIN ep USING (host_name, app_name)""")
def to_tsdb_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the payloads of all kinds, read back from the JSON; paths hold quotes and tags a backslash."""
    rec = records(spark, sf_dir).withColumn("path", F.concat(F.lit('/events/"'), "app_name", F.lit('"')))
    tags = endpoints(spark, sf_dir).withColumn("region", F.concat("region", F.lit(" \\")))
    out = X.to_tsdb_put(X.filter_supported(X.to_export_records(rec, tags), X.TSDB_KINDS))
    f = lambda name: F.get_json_object("payload", f"$.{name}")
    text = F.col("payload").rlike(r'"value":"')
    out = out.select(f("metric").alias("metric"), f("timestamp").cast("long").alias("timestamp"), F.when(text, f("value")).alias("text"), F.when(~text, f("value").try_cast("double")).alias("number"), f("tags.HostName").alias("host_name"), f("tags.appname").alias("app_name"), f("tags.ipaddress").alias("ip_address"), f("tags.region").alias("region"))
    return rounded(out, "number")


@query(f"""WITH RECURSIVE {EV}, s AS (SELECT host_name, k // 10 AS path, batch_seq, k % 3 AS ms, row_number() OVER (PARTITION BY host_name, k // 10 ORDER BY batch_seq) AS i FROM ev),
r AS (SELECT host_name, path, 0::BIGINT AS i, NULL::BIGINT AS batch_seq, NULL::BIGINT AS ms, []::BIGINT[] AS taken FROM (SELECT DISTINCT host_name, path FROM s)
UNION ALL SELECT s.host_name, s.path, s.i, s.batch_seq, list_min(list_filter(range(s.ms, s.ms + s.i + 1), lambda x: NOT list_contains(r.taken, x))), list_append(r.taken, list_min(list_filter(range(s.ms, s.ms + s.i + 1), lambda x: NOT list_contains(r.taken, x)))) FROM r JOIN s ON s.host_name = r.host_name AND s.path = r.path AND s.i = r.i + 1)
SELECT batch_seq AS seq, ms FROM r WHERE i > 0""")
def shift_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    rec = e.select(F.col("host_name").alias("batch"), F.expr("k div 10").alias("path"), F.col("batch_seq").alias("seq"), (F.col("k") % 3 / 1000).alias("ts"))
    return X.shift_duplicates(rec).select("seq", "ms")


@query(f"""WITH RECURSIVE {EV}, s AS (SELECT batch_seq // 1000 AS batch, app_name AS path, batch_seq, k % 40 AS ms, row_number() OVER (PARTITION BY batch_seq // 1000, app_name ORDER BY batch_seq) AS i FROM ev),
r AS (SELECT batch, path, 0::BIGINT AS i, NULL::BIGINT AS batch_seq, NULL::BIGINT AS ms, []::BIGINT[] AS taken FROM (SELECT DISTINCT batch, path FROM s)
UNION ALL SELECT s.batch, s.path, s.i, s.batch_seq, list_min(list_filter(range(s.ms, s.ms + s.i + 1), lambda x: NOT list_contains(r.taken, x))), list_append(r.taken, list_min(list_filter(range(s.ms, s.ms + s.i + 1), lambda x: NOT list_contains(r.taken, x)))) FROM r JOIN s ON s.batch = r.batch AND s.path = r.path AND s.i = r.i + 1)
SELECT batch_seq AS seq, ms FROM r WHERE i > 0""")
def shift_duplicates_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 1000 records, as a store takes them."""
    e = events(spark, sf_dir)
    rec = e.select(F.expr("batch_seq div 1000").alias("batch"), F.col("app_name").alias("path"), F.col("batch_seq").alias("seq"), (F.col("k") % 40 / 1000).alias("ts"))
    return X.shift_duplicates(rec).select("seq", "ms")


@query(f"""WITH {EV}, r AS (SELECT host_name, app_name, '/d' AS path, 'dist' AS kind, ts, k::DOUBLE AS value, k % 7 <> 0 AS active FROM ev UNION ALL SELECT host_name, app_name, '/v', 'int64', ts, floor(value), true FROM ev)
SELECT host_name, app_name, path, kind, CASE WHEN kind = 'int64' THEN 64 END AS bits, CASE WHEN kind = 'dist' THEN 2 END AS n_limits, CASE WHEN kind = 'dist' THEN true END AS is_not_cumulative, count(*) AS n, max(CAST(round(ts * 1000000) AS BIGINT)) AS newest, max_by(value, ts) AS value, max_by(active, ts) AS active FROM r GROUP BY ALL""")
def endpoint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of two metrics, one of them a distribution: their fields, number of values and first value."""
    e = events(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    rec = e.select(*K, F.lit("/d").alias("path"), F.lit("dist").alias("kind"), "ts", F.col("k").cast("double").alias("value"), (F.col("k") % 7 != 0).alias("active"), F.array(F.lit(1.0), F.lit(2.0)).alias("upper_limits"), F.lit(True).alias("is_not_cumulative"))
    rec = rec.unionByName(e.select(*K, F.lit("/v").alias("path"), F.lit("int64").alias("kind"), "ts", F.floor("value").cast("double").alias("value"), F.lit(True).alias("active"), none("array<double>").alias("upper_limits"), F.lit(False).alias("is_not_cumulative")))
    doc = X.endpoint_metrics(rec.withColumns({"unit": F.lit("s"), "description": F.lit(""), "sub_type": F.lit("")}))
    d = F.from_json("document", "struct<kind: string, bits: int, upperLimits: array<double>, isNotCumulative: boolean, values: array<struct<timestamp: string, value: double, active: boolean>>>")
    first = d["values"][0]
    micros = F.replace(F.substring(first["timestamp"], F.lit(1), F.length(first["timestamp"]) - 3), F.lit("."), F.lit("")).cast("long")
    return doc.select(*K, "path", d["kind"].alias("kind"), d["bits"].alias("bits"), F.when(d["upperLimits"].isNotNull(), F.size(d["upperLimits"])).alias("n_limits"), d["isNotCumulative"].alias("is_not_cumulative"), F.size(d["values"]).cast("long").alias("n"), micros.alias("newest"), first["value"].alias("value"), first["active"].alias("active"))


@query(f"""WITH {EV}, p AS (SELECT app_name, ts, value, (row_number() OVER (PARTITION BY app_name ORDER BY ts DESC, value DESC) - 1) // 100 AS page FROM ev)
SELECT app_name, page::INTEGER AS page, count(*) AS n, round(max_by(value, ts), 6) AS newest, round(min_by(value, ts), 6) AS oldest FROM p GROUP BY ALL""")
def endpoint_metrics_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at most a hundred values: their number of values, first and last one."""
    e = events(spark, sf_dir)
    rec = e.select(F.lit("all").alias("host_name"), "app_name", F.lit("/v").alias("path"), F.lit("float64").alias("kind"), F.lit("").alias("unit"), F.lit("").alias("description"), "ts", "value", F.lit(True).alias("active"))
    values = F.from_json("document", "struct<values: array<struct<value: double>>>")["values"]
    doc = X.endpoint_metrics(rec, 100).withColumn("v", values)
    return doc.select("app_name", "page", F.size("v").cast("long").alias("n"), F.round(F.col("v")[0]["value"], 6).alias("newest"), F.round(F.element_at("v", -1)["value"], 6).alias("oldest"))


@query(f"WITH {PTS}, {EP} SELECT 'metrics' AS type, path AS name FROM pts GROUP BY path UNION ALL SELECT DISTINCT 'tagv', host_name FROM ep UNION ALL SELECT DISTINCT 'tagv', ip_address FROM ep")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = points(spark, sf_dir).withColumn("kind", F.lit("float64")).join(endpoints(spark, sf_dir).select(*K, "ip_address"), K)
    return M.distinct_names(obs)


@query("SELECT DISTINCT p_type AS name FROM part WHERE starts_with(p_type, 'S') ORDER BY name LIMIT 25")
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.suggest(table(spark, sf_dir, "part").select(F.col("p_type").alias("name")), "S")


@query(f"WITH {PTS} SELECT max(e) AS earliest FROM (SELECT min(ts) AS e FROM pts WHERE path = '/events/k' GROUP BY host_name, app_name)")
def earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.earliest(points(spark, sf_dir).groupBy(*K, "path").agg(F.min("ts").alias("earliest")), "/events/k")


@query("SELECT o_orderpriority AS writer, sum(o_custkey % 100)::BIGINT AS total, sum(o_custkey % 100 // 2)::BIGINT AS written, sum(o_custkey % 3)::BIGINT AS skipped, greatest(0, sum(o_custkey % 100) - sum(o_custkey % 3) - sum(o_custkey % 100 // 2))::BIGINT AS not_written, round(avg((o_orderstatus = 'O')::INTEGER) + 1e-9, 6) AS success_ratio FROM orders GROUP BY 1")
def writer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    log = o.select(F.col("o_orderpriority").alias("writer"), (F.col("o_custkey") % 100).alias("to_write"), F.expr("o_custkey % 100 div 2").alias("written"), (F.col("o_custkey") % 3).alias("skipped"), (F.col("o_orderstatus") == "O").alias("ok"))
    return rounded(M.writer_counts(log), "success_ratio")


@query("""WITH l AS (SELECT o_orderpriority AS writer, o_orderkey AS ts, CASE WHEN o_orderkey % 4 = 0 THEN 'e' || o_custkey END AS error, o_custkey % 100 AS written, (o_custkey % 10) / 4.0 AS seconds FROM orders)
SELECT writer, count(*) AS attempts, count(*) FILTER (error IS NULL) AS successes, count(error) AS failures, sum(written) FILTER (error IS NULL)::BIGINT AS values_written, sum(seconds)::DOUBLE AS total_seconds, max_by(error, ts) FILTER (error IS NOT NULL) AS last_error, max(ts) FILTER (error IS NOT NULL) AS last_error_ts, max(ts) FILTER (error IS NULL) AS last_success_ts FROM l GROUP BY writer""")
def writer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    log = o.select(F.col("o_orderpriority").alias("writer"), F.col("o_orderkey").alias("ts"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("e"), "o_custkey")).alias("error"), (F.col("o_custkey") % 100).alias("written"), (F.col("o_custkey") % 10 / 4).alias("seconds"))
    return M.writer_metrics(log)


@query("SELECT (l_quantity >= 5)::INT + (l_quantity >= 10)::INT + (l_quantity >= 25)::INT + (l_quantity >= 50)::INT AS bucket, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", [5, 10, 25, 50])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    dist = F.struct(F.array(F.lit(10.0), F.when(F.col("k") < 80, 20.0).otherwise(30.0)).alias("upper_limits"), F.array(F.col("k"), F.col("k") % 10, F.lit(1).cast("long")).alias("counts"), F.col("value").alias("sum"), (F.col("k") % 13).alias("generation"), F.lit(False).alias("is_not_cumulative"))
    return e.select(*K, F.lit("/d").alias("path"), "batch_seq", "ts", dist.alias("dist"))


@query(f"WITH {EV}, w AS (SELECT batch_seq, host_name, app_name, ts, k < 80 AS low, k % 13 AS g, lag(k < 80) OVER o AS pl, lag(k % 13) OVER o AS pg FROM ev WINDOW o AS (PARTITION BY host_name, app_name ORDER BY ts)) SELECT batch_seq, sum((pl IS NULL OR low <> pl OR g < pg)::INTEGER) OVER (PARTITION BY host_name, app_name ORDER BY ts)::BIGINT AS roll_over_count FROM w")
def dist_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dist_rollover(_samples(spark, sf_dir)).select("batch_seq", "roll_over_count")


@query(f"WITH {EV} SELECT batch_seq, k + k % 10 + 1 AS n FROM ev")
def dist_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("batch_seq", C.dist_count("dist").alias("n"))


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY host_name ORDER BY ts) AS n FROM ev) SELECT host_name, batch_seq FROM r WHERE n <= 5")
def limit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.limit_records(events(spark, sf_dir), 5, ["host_name"], ["ts"]).select("host_name", "batch_seq")


_LEASES = f"ls AS (SELECT ({START} + o_orderkey % 29 * 86400)::DOUBLE AS s, ({START} + o_orderkey % 29 * 86400 + 3600 * (1 + o_custkey % 5))::DOUBLE AS e FROM orders)"


def _leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.lit(START) + F.col("o_orderkey") % 29 * 86400
    return o.select(F.lit("me").alias("owner"), start.cast("double").alias("start"), (start + 3600 * (1 + F.col("o_custkey") % 5)).cast("double").alias("end"))


@query(f"WITH {EV}, {_LEASES} SELECT host_name, batch_seq, ts FROM ev WHERE EXISTS (SELECT 1 FROM (SELECT s, max(e) AS e FROM ls GROUP BY s) l WHERE ts >= l.s AND ts < l.e)")
def lease_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lease_filter(events(spark, sf_dir), _leases(spark, sf_dir), "me")[0].select("host_name", "batch_seq", "ts")


@query(f"WITH {EV}, {_LEASES} SELECT count(*) AS skipped FROM ev WHERE NOT EXISTS (SELECT 1 FROM (SELECT s, max(e) AS e FROM ls GROUP BY s) l WHERE ts >= l.s AND ts < l.e) AND ts < (SELECT max(s) FROM ls)")
def lease_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lease_filter(events(spark, sf_dir), _leases(spark, sf_dir), "me")[1]


# --- scalar functions -------------------------------------------------------


@query("SELECT c_custkey, regexp_replace(regexp_replace(c_mktsegment || ' +_' || c_custkey, '_', '_5F', 'g'), '[ ]', '_20', 'g').replace('+', '_2B') AS escaped FROM customer")
def tsdb_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", C.tsdb_escape(F.concat("c_mktsegment", F.lit(" +_"), F.col("c_custkey").cast("string"))).alias("escaped"))


@query("SELECT c_custkey, c_mktsegment || ' _9/' || c_custkey AS plain FROM customer")
def tsdb_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unescapes what holds escapes of either case and one malformed."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", C.tsdb_unescape(F.concat("c_mktsegment", F.lit("_20_9_2f"), F.col("c_custkey").cast("string"))).alias("plain"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE '/a/' || o_orderkey END AS path FROM orders")
def canonical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 3, "//").when(k % 4 == 0, F.concat(F.lit("//a/"), k, F.lit("/"))).when(k % 4 == 1, F.concat(F.lit("a/"), k)).otherwise(F.concat(F.lit("/a/"), k))
    return o.select("o_orderkey", C.canonical_path(raw).alias("path"))


@query("WITH p AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN '/' || p_brand || '/' || (p_size % 10) ELSE '/' || p_brand || '.' || (p_size % 10) END AS path FROM part) SELECT path, row_number() OVER (ORDER BY string_split(ltrim(path, '/'), '/')) AS place FROM p")
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each path in component order; a report over the few distinct paths."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("/"), "p_brand", F.when(F.col("p_partkey") % 2 == 0, "/").otherwise("."), (F.col("p_size") % 10).cast("string"))
    return p.select(path.alias("path")).distinct().withColumn("place", F.row_number().over(Window.orderBy(C.path_sort_key("path"))))


@query(f"WITH {EV} SELECT batch_seq, CAST(floor(ts) AS BIGINT) // 3600 AS h, CAST(floor(ts) AS BIGINT) // 60 AS m, CAST(floor(ts) AS BIGINT) AS s, CAST(floor(ts) AS BIGINT) * 1000 AS ms, CAST(floor(ts) AS BIGINT) * 1000000 AS u, CAST(floor(ts) AS BIGINT) * 1000000000 AS ns FROM ev")
def to_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("batch_seq", *[C.to_epoch("ts", u).cast("long").alias(u) for u in ("h", "m", "s", "ms", "u", "ns")])


@query(f"WITH {EV} SELECT batch_seq, CAST(floor(ts / 300 + 0.5) * 300 AS BIGINT) AS frame, round(coalesce({END} - CASE WHEN k % 5 <> 0 THEN ts END, 0), 6) AS staleness FROM ev")
def frames_and_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("batch_seq", C.frame_id("ts", 300).cast("long").alias("frame"), F.round(C.staleness(END, F.when(F.col("k") % 5 != 0, F.col("ts"))), 6).alias("staleness"))


@query(f"WITH {EV}, {_REC} SELECT kind, kind IN ('float64', 'int64') AS is_numeric, count(*) AS n FROM rec GROUP BY ALL")
def grouping_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series counted by kind under two grouping strategies."""
    rec = records(spark, sf_dir).withColumn("description", F.lit(""))
    by_key = rec.groupBy(*C.grouping_key("key"), C.grouping_key("path_and_numeric")[1]).agg(F.count(F.lit(1)).alias("n"))
    return by_key.groupBy("kind", "is_numeric").agg(F.sum("n").alias("n"))


@query(f"WITH {EV}, {EP} SELECT host_name, app_name, region FROM ep WHERE app_name IN ('click', 'view') AND region IN ('MIDDLE EAST', 'ASIA')")
def filter_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.filter_endpoints(endpoints(spark, sf_dir), app="click|view", region="MIDDLE_20EAST|ASIA").select(*K, "region")


@query(f"WITH {PTS} SELECT host_name, path, count(*) AS n FROM pts WHERE (path = '/events/k' OR starts_with(path, '/events/k/')) AND ts >= {START + 86400} AND ts < {START + 9 * 86400} GROUP BY ALL")
def under_path_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Q.time_range(points(spark, sf_dir).where(C.under_path("path", "/events/k")), START + 86400, START + 9 * 86400)
    return own.groupBy("host_name", "path").agg(F.count(F.lit(1)).alias("n"))


# --- parameters over a table of queries -------------------------------------

_QS = "qs AS (SELECT o_orderkey AS id, (o_orderkey % 1000)::DOUBLE AS start, (o_orderkey % 1000 + o_custkey % 5000)::DOUBLE AS \"end\", (o_custkey % 7)::DOUBLE AS step FROM orders)"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 1000
    return o.select(F.col("o_orderkey").alias("id"), start.cast("double").alias("start"), (start + F.col("o_custkey") % 5000).cast("double").alias("end"), (F.col("o_custkey") % 7).cast("double").alias("step"))


@query(f'WITH {_QS} SELECT id, greatest(start, "end" - greatest(step, 2) * 1000) AS start, "end", greatest(step, 2) AS step FROM qs')
def guard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.guard_ranges(_queries(spark, sf_dir), 2)


@query(f'WITH {_QS} SELECT id, greatest(start, 500) AS start, least("end", 900) AS "end", step FROM qs WHERE greatest(start, 500) < least("end", 900)')
def clip_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clip_range(_queries(spark, sf_dir), 500, 900)


@query(f'WITH {_QS} SELECT min(start) AS start, max("end") AS "end" FROM qs')
def union_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.union_range(_queries(spark, sf_dir))


# --- sources ----------------------------------------------------------------


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS value_double, CASE WHEN s_suppkey % 2 = 1 THEN s_nationkey END AS value_long FROM supplier")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    raw = s.select(F.col("s_suppkey").alias("id"), F.when(even, "float64").otherwise("int64").alias("kind"), F.when(even, F.col("s_acctbal").cast("string")).otherwise(F.col("s_nationkey").cast("string")).alias("value"))
    return S.typed_values(raw).select("id", "value_double", F.col("value_long").alias("value_long"))


@query(f"""WITH {EV}, w AS (SELECT host_name, batch_seq, k, sum(k % 5) OVER (PARTITION BY host_name ORDER BY batch_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev) SELECT host_name AS file, batch_seq AS idx, ({START} + coalesce(before, 0))::DOUBLE AS ts, k AS value_long FROM w""")
def replay_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    commands = e.select(F.col("host_name").alias("file"), F.col("batch_seq").alias("idx"), (F.col("k") % 5).cast("double").alias("sleep"), F.array(F.struct(F.lit("/k").alias("path"), F.lit("int64").alias("kind"), F.col("k").cast("string").alias("value"))).alias("values"))
    return S.replay_commands(commands, START).select("file", "idx", "ts", "value_long")


@query("""WITH s AS (SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier) SELECT 'r' || s_nationkey AS region, 'acct' AS account, 'i' || s_suppkey AS instance, 1704067200 AS ts, 'CpuUsedPercentAvg' AS metric, s_acctbal AS value FROM s WHERE s_suppkey % 3 <> 0
UNION ALL SELECT 'r' || s_nationkey, 'acct', 'i' || s_suppkey, 1704067200, 'MemoryUsedPercentMin', 12.5 FROM s
UNION ALL SELECT 'r' || s_nationkey, 'acct', 'i' || s_suppkey, 1704067200, 'FsSizeBytesAvg', s_suppkey::DOUBLE FROM s""")
def parse_dashboard_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    asset = F.concat(F.lit("r"), "s_nationkey", F.lit(":acct:i"), "s_suppkey")
    cpu = F.when(F.col("s_suppkey") % 3 == 0, "null").otherwise(F.col("s_acctbal").cast("string"))
    row = lambda name, *v: F.concat(F.lit('["'), name, F.lit('","2024-01-01T00:00:00+00:00",'), F.concat_ws(",", *v), F.lit("]"))
    payload = F.concat(
        F.lit('{"metrics":{"datasets":[{"metadata":{"assetType":"aws:ec2:instance","granularity":"hour","keys":["assetId","timestamp","cpu:used:percent.avg","memory:used:percent.min","other:key"]},"values":['), row(asset, cpu, F.lit("12.5"), F.lit("1")),
        F.lit(']},{"metadata":{"assetType":"aws:ec2:volume","keys":["assetId","timestamp","fs:size:bytes.avg"]},"values":['), row(F.concat(asset, F.lit(":/")), F.lit("3")),
        F.lit(']},{"metadata":{"assetType":"aws:ec2:instance:fs","granularity":"hour","keys":["assetId","timestamp","fs:size:bytes.avg"]},"values":['), row(F.concat(asset, F.lit(":/boot")), F.lit("1")), F.lit(","),
        row(F.concat(asset, F.lit(":/")), F.col("s_suppkey").cast("string")), F.lit(","), row(F.concat(asset, F.lit(":/")), F.lit("7")), F.lit("]}]}}"),
    )
    return S.parse_dashboard_payload(s.select(F.col("s_suppkey").alias("payload_id"), payload.alias("payload")))


@query("SELECT s_suppkey AS group_id, s_name AS path, CASE s_suppkey % 4 WHEN 0 THEN s_acctbal END AS value_double, CASE s_suppkey % 4 WHEN 1 THEN s_nationkey END AS value_long, CASE s_suppkey % 4 WHEN 2 THEN s_name || ',' || s_suppkey END AS items, CASE s_suppkey % 4 WHEN 3 THEN s_nationkey + s_suppkey END AS dist_count, CASE s_suppkey % 4 WHEN 3 THEN 10.0::DOUBLE END AS first_limit, (s_suppkey + 0.5)::DOUBLE AS ts FROM supplier")
def read_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as dumps, a JSON array for each nation, written and read back: numbers, lists and distributions."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 4
    ranges = F.array(F.struct(F.lit(0.0).alias("lower"), F.lit(10.0).alias("upper"), F.col("s_nationkey").cast("long").alias("count")), F.struct(F.lit(10.0).alias("lower"), F.lit(None).cast("double").alias("upper"), F.col("s_suppkey").cast("long").alias("count")))
    value = F.when(k == 0, F.to_json(F.array("s_acctbal"))).when(k == 1, F.to_json(F.array("s_nationkey"))).when(k == 2, F.to_json(F.array(F.array("s_name", F.col("s_suppkey").cast("string"))))).otherwise(F.to_json(F.array(F.struct(F.lit(1.0).alias("sum"), F.lit(2).alias("generation"), ranges.alias("ranges")))))
    head = F.to_json(F.struct(F.col("s_name").alias("path"), F.when(k == 0, "float64").when(k == 1, "int64").when(k == 2, "list").otherwise("dist").alias("kind"), F.col("s_suppkey").alias("groupId"), (F.col("s_suppkey") + 0.5).alias("timestamp")))
    cut = lambda c, a, b: F.substring(c, F.lit(1 + a), F.length(c) - a - b)
    one = F.concat(cut(head, 0, 1), F.lit(',"value":'), cut(value, 1, 1), F.lit("}"))
    folder = scratch(spark, "dumps")
    s.select("s_nationkey", one.alias("m")).groupBy("s_nationkey").agg(F.collect_list("m").alias("m")).select("s_nationkey", F.concat(F.lit("["), F.array_join("m", ","), F.lit("]")).alias("value")).write.partitionBy("s_nationkey").text(folder)
    got = S.read_metrics_json(spark, folder)
    d = F.col("value_dist")
    return got.select("group_id", "path", "value_double", "value_long", F.array_join("value_list", ",").alias("items"), C.dist_count(d).alias("dist_count"), d["upper_limits"][0].alias("first_limit"), "ts")


@query(f"WITH {EV} SELECT host_name, app_name, batch_seq, ts, value AS value_double FROM ev WHERE ts >= {START + 86400} AND ts < {START + 9 * 86400}")
def load_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an observations table, written and loaded again, cut to a range."""
    folder = scratch(spark, "observations")
    events(spark, sf_dir).select(*K, "batch_seq", F.lit("/events/value").alias("path"), F.lit("float64").alias("kind"), "ts", F.col("value").alias("value_double")).write.parquet(folder)
    return Q.time_range(S.load_observations(spark, folder), START + 86400, START + 9 * 86400).select(*K, "batch_seq", "ts", "value_double")


@query("SELECT o_orderkey AS id, ((o_orderkey % 90 + 1) * CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 60 ELSE 3600 END)::DOUBLE AS seconds, CASE WHEN o_orderkey % 2 = 0 THEN 'avg' ELSE 'sum' END AS aggregator, CASE o_orderkey % 4 WHEN 0 THEN 'zero' WHEN 1 THEN 'nan' ELSE 'none' END AS fill FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0")
def parse_downsamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications made of orders; those of every fifth are empty."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    unit = F.when(F.col("o_custkey") % 3 == 0, "s").when(F.col("o_custkey") % 3 == 1, "m").otherwise("h")
    policy = F.when(k % 4 == 0, "-zero").when(k % 4 == 1, "-nan").when(k % 4 == 2, "-odd").otherwise("")
    spec = F.when(k % 5 == 0, "").otherwise(F.concat((k % 90 + 1).cast("string"), unit, F.lit("-"), F.when(k % 2 == 0, "avg").otherwise("sum"), policy))
    return P.parse_downsamples(o.select(k.alias("id"), spec.alias("spec"))).drop("spec")
