"""Schemas of the data model. Timestamps are float seconds since the epoch; tags that a result is not grouped by are the empty string."""

from __future__ import annotations

from pyspark.sql import types as T

#: Kinds of values that count as numbers, and those that hold whole numbers.
INTEGER_KINDS = ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64")
FLOAT_KINDS = ("float32", "float64")
NUMERIC_KINDS = INTEGER_KINDS + FLOAT_KINDS
KINDS = (*NUMERIC_KINDS, "bool", "string", "time", "duration", "list", "dist")

#: The endpoint key.
K = ["host_name", "app_name"]

DIST = T.StructType([T.StructField("upper_limits", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("sum", T.DoubleType()), T.StructField("generation", T.LongType()), T.StructField("is_not_cumulative", T.BooleanType())])

OBSERVATIONS = T.StructType(
    [
        T.StructField("host_name", T.StringType()),
        T.StructField("app_name", T.StringType()),
        T.StructField("batch_seq", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("sub_type", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("group_id", T.IntegerType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("batch_ts", T.DoubleType()),
        T.StructField("value_double", T.DoubleType()),
        T.StructField("value_long", T.LongType()),
        T.StructField("value_bool", T.BooleanType()),
        T.StructField("value_string", T.StringType()),
        T.StructField("value_list", T.ArrayType(T.StringType())),
        T.StructField("value_dist", DIST),
        # Unsigned values beyond a bigint; value_long is null then.
        T.StructField("value_unsigned", T.DecimalType(20, 0)),
    ]
)
