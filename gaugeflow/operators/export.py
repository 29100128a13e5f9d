"""Export: record selection and the payloads of the stores that take them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.scalars import as_float64, is_finite, json_number, json_text, path_sort_key
from gaugeflow.model import FLOAT_KINDS, INTEGER_KINDS, K

#: Kinds that the stores take (fixed values).
JSON_KINDS = ("bool", *INTEGER_KINDS, *FLOAT_KINDS, "string", "time", "duration")
TSDB_KINDS = ("bool", *INTEGER_KINDS, *FLOAT_KINDS, "string", "time", "duration")
STRING_BYTES = 100


def filter_supported(records: DataFrame, kinds: Sequence[str], sub_types: Sequence[str] = ()) -> DataFrame:
    """Records whose kind the store takes; lists need a supported sub-type."""
    kind = F.col("kind")
    good = kind.isin(*[k for k in kinds if k != "list"])
    if "list" in kinds:
        good |= (kind == "list") & F.col("sub_type").isin(*sub_types)
    return records.where(good)


def active_only(records: DataFrame) -> DataFrame:
    return records.where("active")


def exclude_metrics(records: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Without the records whose path any of the regular expressions matches anywhere."""
    return records.where(~F.col("path").rlike("|".join(f"(?:{p})" for p in patterns))) if patterns else records


def debug_filter(records: DataFrame, metric_pattern: str = "", host_pattern: str = "") -> DataFrame:
    """Records that match both patterns; an empty one is ignored."""
    for column, pattern in (("path", metric_pattern), ("host_name", host_pattern)):
        records = records.where(F.col(column).rlike(pattern)) if pattern else records
    return records


def to_export_records(records: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(host, path, tags map, kind, sub_type, unit, value columns, ts); region and ipaddress are tags if they are not empty."""
    out = records.join(endpoints.select(*K, "region", "ip_address"), K, "left")
    tags = F.create_map(F.lit("appname"), F.col("app_name"), F.lit("region"), F.coalesce("region", F.lit("")), F.lit("ipaddress"), F.coalesce("ip_address", F.lit("")))
    tags = F.map_filter(tags, lambda k, v: (k == "appname") | (v != ""))
    rest = [c for c in records.columns if c not in (*K, "path", "region", "ip_address", "tags")]
    return out.select(F.col("host_name").alias("host"), "path", tags.alias("tags"), *rest)


def _number(records: DataFrame) -> Column:
    return as_float64("kind", unit="unit", value_unsigned="value_unsigned" if "value_unsigned" in records.columns else None)


def to_json_payload(records: DataFrame, tenant: str, api_key: str, slashes_to_underscores: bool = False) -> DataFrame:
    """(key, payload) of export records: one flat JSON object each, tags at its top level; strings have the value 0 and are cut to 100 bytes. NaN and infinity, which JSON does not have, become null."""
    name = F.replace("path", F.lit("/"), F.lit("_")) if slashes_to_underscores else F.col("path")
    # Whole milliseconds: the rest of the microseconds is cut off.
    millis = F.floor(F.round(F.col("ts") * 1_000_000) / 1000)
    when = F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.decode(F.expr(f"substring(encode(value_string, 'UTF-8'), 1, {STRING_BYTES})"), "UTF-8")
    base = F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in ("@version", F.lit("1"), "tenant_id", F.lit(tenant), "apikey", F.lit(api_key), "@timestamp", when, "name", name, "host", F.col("host"))])
    strings = F.map_concat(base, "tags", F.when(F.col("kind") == "string", F.create_map(F.lit("stringValue"), text)).otherwise(F.create_map().cast("map<string,string>")))
    head = F.to_json(strings)
    value = F.when(F.col("kind") == "string", F.lit(0.0)).otherwise(_number(records))
    shown = F.when(value.isNull() | is_finite(value), value.cast("string")).otherwise("null")
    body = F.concat(F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(',"value":'), shown, F.lit("}"))
    return records.withColumn("_h", head).select(F.col("host").alias("key"), body.alias("payload"))


def to_influx_points(records: DataFrame) -> DataFrame:
    """(line): measurement, sorted tags with @version and host, fields name and value, nanoseconds."""
    esc = lambda c: F.regexp_replace(c, r"([,= ])", r"\\$1")
    tags = F.map_concat(F.create_map(F.lit("@version"), F.lit("1"), F.lit("host"), F.col("host")), "tags")
    tag = F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(esc(e["key"]), F.lit("="), esc(e["value"]))), ",")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    value = F.when(F.col("kind") == "string", quoted(F.col("value_string"))).otherwise(_number(records).cast("string"))
    nanos = F.round(F.col("ts") * 1_000_000).cast("long") * 1000
    return records.select(F.concat(esc(F.col("path")), F.lit(","), tag, F.lit(" name="), quoted(F.col("path")), F.lit(",value="), value, F.lit(" "), nanos.cast("string")).alias("line"))


def to_tsdb_put(records: DataFrame) -> DataFrame:
    """(payload): {"metric","timestamp" in whole seconds,"value","tags"} with HostName among the tags. Whole kinds give whole numbers, text its string, all else a number as in as_float64. Records with NaN or infinity, which no put row can hold, are left out."""
    tags = F.map_concat(F.create_map(F.lit("HostName"), F.col("host")), "tags")
    entries = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(e["value"])))
    whole = F.col("value_long").cast("string")
    if "value_unsigned" in records.columns:
        whole = F.coalesce(whole, F.col("value_unsigned").cast("string"))
    number = _number(records)
    value = F.when(F.col("kind").isin(*INTEGER_KINDS), whole).when(F.col("kind") == "string", json_text("value_string")).otherwise(json_number(number))
    return records.where(number.isNull() | is_finite(number)).select(F.concat(F.lit('{"metric":'), json_text("path"), F.lit(',"timestamp":'), F.floor("ts").cast("string"), F.lit(',"value":'), value, F.lit(',"tags":{'), F.array_join(entries, ","), F.lit("}}")).alias("payload"))


class _Shift:
    """Moves times to the first free millisecond of their group from their own on. `free` leads on from a taken one, and is shortened on the way."""

    def __init__(self):
        self.free: dict[int, int] = {}

    def __call__(self, times: list[int | None], begins: list[bool]) -> list[int | None]:
        """begins: whether a time is the first of its group; else it goes on with the one before, of an earlier call too."""
        free, out = self.free, []
        for at, begin in zip(times, begins):
            if begin:
                free = {}
            if at in free:
                passed = []
                while at in free:
                    passed.append(at)
                    at = free[at]
                for p in passed:
                    free[p] = at + 1
            if at is not None:
                free[at] = at + 1
            out.append(at)
        self.free = free
        return out


def _shift(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one group, in their order."""
    return pdf.assign(ms=_Shift()(pdf["ms"].tolist(), [False] * len(pdf)))


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of batch, path and seq, with their ms moved: many groups go through Python at once, and a large one in pieces."""
    shift, last = _Shift(), None
    for rows in batches:
        if not rows.num_rows:
            continue
        keys = [rows.column(rows.schema.get_field_index(c)) for c in ("batch", "path")]
        # A row without a batch or path is a group of its own.
        same = [pc.fill_null(pc.equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False) for x in keys]
        first = [x[0].as_py() for x in keys]
        begins = [first != last or None in first, *(~(same[0] & same[1])).tolist()]
        last = [x[-1].as_py() for x in keys]
        at = rows.schema.get_field_index("ms")
        yield rows.set_column(at, rows.schema.field(at), pa.array(shift(rows.column(at).to_pylist(), begins), pa.int64()))


def shift_duplicates(records: DataFrame) -> DataFrame:
    """Adds ms (cut to whole milliseconds): of one batch's records of a path at the same millisecond, later ones (by seq) move on to the next free one.

    records: batch, path, seq, ts. The rule is sequential, so the records of one path in one batch are in one task: a batch is what a store takes
    in one call, 1000 records by default.
    """
    rows = records.withColumn("ms", (F.col("ts") * 1000).cast("long"))
    dealt = rows.repartition("batch", "path").sortWithinPartitions("batch", "path", F.asc_nulls_last("seq"))
    return dealt.mapInArrow(_shifted, rows.schema)


#: Columns of the dashboard's instance and filesystem rows, and their asset types (fixed values).
INSTANCE_TYPE, FS_TYPE = "aws:ec2:instance", "aws:ec2:instance:fs"
INSTANCE_COLUMNS = (
    "cpu:used:percent.avg", "cpu:used:percent.max", "cpu:used:percent.min",
    "memory:free:bytes.avg", "memory:free:bytes.max", "memory:free:bytes.min",
    "memory:size:bytes.avg", "memory:size:bytes.max", "memory:size:bytes.min",
    "memory:used:percent.avg", "memory:used:percent.max", "memory:used:percent.min",
)
FS_COLUMNS = (
    "fs:size:bytes.avg", "fs:size:bytes.max", "fs:size:bytes.min",
    "fs:used:bytes.avg", "fs:used:bytes.max", "fs:used:bytes.min",
    "fs:used:percent.avg", "fs:used:percent.max", "fs:used:percent.min",
)
#: Variables of a roll-up in the order of those columns, and whether they are whole numbers.
_INSTANCE_VARIABLES = (("cpu", False), ("memory_free", True), ("memory_size", True), ("memory_percent", False))
_FS_VARIABLES = (("size", True), ("used", True), ("used_percent", False))


def metric_name(column: str) -> str:
    """cpu:used:percent.avg -> CpuUsedPercentAvg."""
    return "".join(part.capitalize() for part in re.split("[:.]", column))


def _triplet(name: str, whole: bool) -> list[Column]:
    n = F.col(f"{name}_count") > 0
    mean = F.when(n, F.expr(f"{name}_sum div {name}_count").cast("double")) if whole else F.when(n, F.col(f"{name}_sum") / F.col(f"{name}_count"))
    return [mean, F.when(n, F.col(f"{name}_max").cast("double")), F.when(n, F.col(f"{name}_min").cast("double"))]


def snapshot_to_long(rollup: DataFrame, fs: DataFrame) -> DataFrame:
    """(account, instance, region, ts, metric, value): 12 instance metrics, and 9 filesystem metrics of the mount "/"; an empty variable is null."""
    def long(df: DataFrame, columns: tuple, variables: tuple) -> DataFrame:
        values = [c.cast("double") for name, whole in variables for c in _triplet(name, whole)]
        cells = [F.struct(F.lit(metric_name(c)).alias("metric"), v.alias("value")) for c, v in zip(columns, values)]
        return df.select("account", "instance", "region", "ts", F.explode(F.array(*cells)).alias("c")).select("account", "instance", "region", "ts", "c.*")

    return long(rollup, INSTANCE_COLUMNS, _INSTANCE_VARIABLES).unionByName(long(fs.where("mount_point = '/'"), FS_COLUMNS, _FS_VARIABLES))



def snapshot_to_datums(rollup: DataFrame, fs: DataFrame) -> DataFrame:
    """(instance, region, ts, metric, value): average percents of cpu, memory and the one filesystem, each only if it has values; more than one filesystem is an error."""
    one = fs.groupBy("account", "instance", "region", "ts").agg(F.count(F.lit(1)).alias("_n"), F.sum("used_percent_count").alias("used_percent_count"), F.sum("used_percent_sum").alias("used_percent_sum"))
    one = one.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one filesystem"))).otherwise(F.col("_n")))
    both = rollup.join(one, ["account", "instance", "region", "ts"], "left").where("_n is null or _n = 1")
    cells = [F.struct(F.lit(m).alias("metric"), F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_count")).alias("value")) for m, c in (("CpuUsedPercent", "cpu"), ("MemoryUsedPercent", "memory_percent"), ("FileSystemUsedPercent", "used_percent"))]
    return both.select("instance", "region", "ts", F.explode(F.array(*cells)).alias("c")).select("instance", "region", "ts", "c.*").where("value is not null")


def to_dashboard_payload(rollup: DataFrame, data_center: str, default_account: str, fs: DataFrame | None = None) -> DataFrame:
    """(instance, ts, payload) for each instance and period: {"metrics":{"datasets":[{"metadata":{"assetType","granularity","keys"},"values":[[…]]}]}}.

    A dataset of one instance row and, if `fs` (the roll-up by mount) has any for it, one of a row for each mount. Empty variables are null.
    """
    keys = ["account", "instance", "region", "ts"]
    account = F.coalesce(F.nullif("account", F.lit("")), F.lit(default_account))
    asset = F.concat_ws(":", F.lit(data_center), account, F.col("instance"))
    stamp = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ssxxx")

    def row(asset: Column, variables: tuple) -> Column:
        cells = [json_number(c) for name, whole in variables for c in _triplet(name, whole)]
        return F.concat(F.lit("["), F.concat_ws(",", json_text(asset), json_text(stamp), *[F.coalesce(c, F.lit("null")) for c in cells]), F.lit("]"))

    def dataset(asset_type: str, columns: tuple, rows: Column) -> Column:
        names = ",".join(f'"{c}"' for c in ("assetId", "timestamp", *columns))
        return F.concat(F.lit(f'{{"metadata":{{"assetType":"{asset_type}","granularity":"hour","keys":[{names}]}},"values":['), rows, F.lit("]}"))

    out = rollup.select(*keys, dataset(INSTANCE_TYPE, INSTANCE_COLUMNS, row(asset, _INSTANCE_VARIABLES)).alias("sets"))
    if fs is not None:
        mounts = fs.select(*keys, F.struct("mount_point", row(F.concat_ws(":", asset, "mount_point"), _FS_VARIABLES).alias("row")).alias("m")).groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias("m"))
        out = out.join(mounts, keys, "left")
        out = out.withColumn("sets", F.concat_ws(",", "sets", F.when(F.col("m").isNotNull(), dataset(FS_TYPE, FS_COLUMNS, F.array_join("m.row", ",")))))
    return out.select("instance", "ts", F.concat(F.lit('{"metrics":{"datasets":['), F.col("sets"), F.lit("]}}")).alias("payload"))


def endpoint_metrics(records: DataFrame, most: int | None = None) -> DataFrame:
    """(endpoint, path, document), by endpoint and path components: one JSON document for each metric (all info but the group id) with its values newest first.

    most: values of one document at most; a metric with more has several, numbered by a column `page` from 0, the newest first. Without it, bound the records: a document
    holds its metric's whole history.
    records: path, kind, unit, description, ts, value, active, and, where they have them, sub_type, upper_limits and is_not_cumulative
    (of distributions). Fields that are null or false are left out of a document; a time is text, seconds with nine decimals.
    """
    more = [c for c in ("sub_type", "upper_limits", "is_not_cumulative") if c in records.columns]
    names = {"sub_type": "subType", "upper_limits": "upperLimits", "is_not_cumulative": "isNotCumulative"}
    bits = F.nullif(F.regexp_extract("kind", r"(\d+)$", 1), F.lit("")).cast("int")
    values = F.reverse(F.array_sort(F.collect_list(F.struct("ts", "value", "active"))))
    metric, page = [*K, "path", "kind", "unit", "description", *more], []
    if most is not None:
        place = F.row_number().over(Window.partitionBy(*metric).orderBy(F.desc("ts"), F.desc("value"), F.desc("active")))
        records, page = records.withColumn("page", F.floor((place - 1) / most).cast("int")), ["page"]
    out = records.groupBy(*metric, *page).agg(values.alias("values"))

    def shown(v: Column) -> Column:
        micros = F.round(v["ts"] * 1_000_000).cast("long")
        rest = F.pmod(micros, F.lit(1_000_000))
        stamp = F.concat(((micros - rest) / 1_000_000).cast("long").cast("string"), F.lit("."), F.lpad(rest.cast("string"), 6, "0"), F.lit("000"))
        return F.struct(stamp.alias("timestamp"), v["value"].alias("value"), v["active"].alias("active"))

    fields = ["path", "description", "unit", "kind", bits.alias("bits"), F.transform("values", shown).alias("values")]
    for c in more:
        value = F.nullif(c, F.lit("")) if c == "sub_type" else F.when(F.col(c), True) if c == "is_not_cumulative" else F.col(c)
        fields.append(value.alias(names[c]))
    return out.select(*K, "path", *page, F.to_json(F.struct(*fields)).alias("document")).orderBy(*K, path_sort_key("path"), *page)
