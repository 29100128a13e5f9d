"""Readers of metric dumps, tables, dashboard payloads and timed command files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.model import FLOAT_KINDS, INTEGER_KINDS, OBSERVATIONS
from gaugeflow.operators.export import FS_COLUMNS, FS_TYPE, INSTANCE_COLUMNS, INSTANCE_TYPE, metric_name

DUMP = "path string, description string, unit string, kind string, subType string, value string, timestamp double, groupId int"


def typed_values(df: DataFrame, value: str = "value", kind: str = "kind") -> DataFrame:
    """Adds the typed value columns of a text value, decoded by its kind; text that does not fit is null."""
    v, k = F.col(value), F.col(kind)
    return df.select(
        "*",
        F.when(k.isin(*FLOAT_KINDS, "time", "duration"), v.try_cast("double")).alias("value_double"),
        F.when(k.isin(*INTEGER_KINDS), v.try_cast("bigint")).alias("value_long"),
        F.when(k == "bool", v.try_cast("boolean")).alias("value_bool"),
        F.when(k == "string", v).alias("value_string"),
        F.when(k == "list", F.from_json(v, "array<string>")).alias("value_list"),
        F.when(k == "dist", distribution(v)).alias("value_dist"),
        F.when((k == "uint64") & v.try_cast("bigint").isNull(), unsigned(v)).alias("value_unsigned"),
    )


def unsigned(text: Column) -> Column:
    """A whole number from 0 to 2^64 - 1, exactly; else null."""
    number = F.when(text.rlike("^[0-9]{1,20}$"), text).try_cast("decimal(20,0)")
    return F.when(number <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), number)


def distribution(text: Column) -> Column:
    """A distribution from its JSON {"sum","generation","isNotCumulative","ranges":[{"lower","upper","count"},…]}; the last range has no upper limit."""
    d = F.from_json(text, "struct<sum: double, generation: bigint, isNotCumulative: boolean, ranges: array<struct<upper: double, count: bigint>>>")
    limits = F.transform(F.slice(d["ranges"], F.lit(1), F.greatest(F.size(d["ranges"]) - 1, F.lit(0))), lambda r: r["upper"])
    counts = F.transform(d["ranges"], lambda r: F.coalesce(r["count"], F.lit(0)))
    made = F.struct(limits.alias("upper_limits"), counts.alias("counts"), d["sum"].alias("sum"), d["generation"].alias("generation"), F.coalesce(d["isNotCumulative"], F.lit(False)).alias("is_not_cumulative"))
    return F.when(d["ranges"].isNotNull(), made)


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON arrays of metrics, each value decoded by its kind; nothing is inferred. An array is read whole by one task: a dump is one poll."""
    raw = spark.read.schema(DUMP).option("multiLine", True).json(path)
    out = typed_values(raw).withColumnsRenamed({"subType": "sub_type", "timestamp": "ts", "groupId": "group_id"})
    return out.drop("value")


def load_observations(spark: SparkSession, path: str) -> DataFrame:
    """An observations table in Parquet; filters and columns are pushed to the files."""
    return spark.read.schema(OBSERVATIONS).parquet(path)


def _metric_names(columns: tuple[str, ...]) -> dict[str, str]:
    return {c: metric_name(c) for c in columns}


#: Columns of the dashboard's rows and the names of their metrics, by asset type.
DASHBOARD_METRICS = {INSTANCE_TYPE: _metric_names(INSTANCE_COLUMNS), FS_TYPE: _metric_names(FS_COLUMNS)}
_PAYLOAD = "struct<metrics: struct<datasets: array<struct<metadata: struct<assetType: string, keys: array<string>>, values: array<array<string>>>>>>"


def parse_dashboard_payload(df: DataFrame, column: str = "payload", names: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(region, account, instance, ts, metric, value) of nested payloads (column: JSON, id: `payload_id`).

    Null cells, unknown columns and other asset types are skipped; of a dataset's filesystem rows only the first of mount "/" counts.
    """
    names = DASHBOARD_METRICS if names is None else names
    table = F.create_map(*[F.lit(x) for kind, own in names.items() for k, v in own.items() for x in (f"{kind} {k}", v)])
    data = df.select("payload_id", F.from_json(column, _PAYLOAD).alias("p")).select("payload_id", F.posexplode("p.metrics.datasets").alias("d", "set"))
    rows = data.select("payload_id", "d", F.col("set.metadata.assetType").alias("type"), F.col("set.metadata.keys").alias("keys"), F.posexplode("set.values").alias("r", "row")).where(F.col("type").isin(*names))
    cell = lambda key: F.get("row", F.array_position("keys", key).cast("int") - 1)
    rows = rows.withColumn("asset", F.split(cell("assetId"), ":"))
    fs = F.col("type") == FS_TYPE
    first = F.row_number().over(Window.partitionBy("payload_id", "d").orderBy("r"))
    root = F.element_at("asset", -1) == "/"
    rows = rows.where(~fs | root).withColumn("_n", first).where(~fs | (F.col("_n") == 1))
    stamp = F.unix_timestamp(F.to_timestamp(cell("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxxx")).alias("ts")
    out = rows.select(F.col("asset")[0].alias("region"), F.col("asset")[1].alias("account"), F.col("asset")[2].alias("instance"), stamp, "type", F.explode(F.arrays_zip("keys", "row")).alias("c"))
    metric = table[F.concat_ws(" ", "type", "c.keys")]
    return out.select("region", "account", "instance", "ts", metric.alias("metric"), F.col("c.row").try_cast("double").alias("value")).where("metric is not null and value is not null")


def replay_commands(commands: DataFrame, start: float) -> DataFrame:
    """Records of a timed command file (file, idx, sleep, values array<struct<path,kind,value>>): each at the start plus the sleeps before its command, the text cast by kind."""
    w = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    timed = commands.withColumn("ts", F.lit(float(start)) + F.coalesce(F.sum("sleep").over(w), F.lit(0.0)))
    return typed_values(timed.select("file", "idx", "ts", F.posexplode("values").alias("pos", "v")).select("file", "idx", "pos", "ts", "v.*")).drop("value")
