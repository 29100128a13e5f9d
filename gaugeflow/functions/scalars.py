"""Column functions: paths, escapes, numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeflow.model import FLOAT_KINDS, INTEGER_KINDS, NUMERIC_KINDS

#: Seconds of a unit (fixed values).
UNIT_SECONDS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "min": 60.0, "h": 3600.0}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_float64(kind: Column | str, value_double: Column | str = "value_double", value_long: Column | str = "value_long", value_bool: Column | str = "value_bool", unit: Column | str | None = None, value_unsigned: Column | str | None = None) -> Column:
    """A value as a number: bool 1 or 0, numbers and times as they are, a duration (seconds) in its unit; other kinds null. value_unsigned: where unsigned values beyond a bigint are."""
    kind, real, whole = _c(kind), _c(value_double), _c(value_long).cast("double")
    if value_unsigned is not None:
        whole = F.coalesce(whole, _c(value_unsigned).cast("double"))
    factor = F.lit(1.0)
    if unit is not None:
        for name, seconds in UNIT_SECONDS.items():
            factor = F.when(_c(unit) == name, F.lit(1 / seconds)).otherwise(factor)
    return (
        F.when(kind == "bool", _c(value_bool).cast("int").cast("double"))
        .when(kind.isin(*INTEGER_KINDS), whole)
        .when(kind.isin(*FLOAT_KINDS, "time"), real)
        .when(kind == "duration", real * factor)
    )


def is_numeric(kind: Column | str) -> Column:
    return _c(kind).isin(*NUMERIC_KINDS)


#: Parts of a unit in which the fractions of values of whole kinds are added up.
FRACTIONS = 1e9


def addends(value: Column | str, kind: Column | str) -> tuple[Column, Column]:
    """A value in two parts, whose sums are put together by `mean_of`: (itself, 0) or, of a whole kind, (its whole part, its fraction in whole 10^-9).

    Sums of whole numbers are exact below 2^53, so that the mean of a whole kind does not depend on the order of addition: an exact half rounds up whatever the order.
    """
    value = _c(value)
    whole = F.coalesce(_c(kind).isin(*INTEGER_KINDS), F.lit(False))
    return F.when(whole, F.rint(value)).otherwise(value), F.when(whole, F.rint((value - F.rint(value)) * FRACTIONS)).when(value.isNotNull(), 0.0)


def mean_of(value: Column | str, kind: Column | str) -> Column:
    """Aggregate: the mean, exact for whole kinds."""
    part, rest = addends(value, kind)
    return F.try_divide(F.sum(part) + F.sum(rest) / FRACTIONS, F.count(_c(value)))


def tsdb_escape(x: Column | str) -> Column:
    """Bytes outside [-./0-9A-Za-z] become _HH (upper-case hex); so the underscore becomes _5F."""
    pairs = F.regexp_extract_all(F.hex(F.encode(_c(x), "UTF-8")), F.lit("(..)"))
    safe = F.array(*[F.lit(f"{ord(c):02X}") for c in "-./" + "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123))))])
    # A safe byte is below 0x80, so its hex decodes to one character.
    return F.array_join(F.transform(pairs, lambda p: F.when(F.array_contains(safe, p), F.decode(F.unhex(p), "UTF-8")).otherwise(F.concat(F.lit("_"), p))), "")


def tsdb_unescape(x: Column | str) -> Column:
    """_HH (hex of either case) becomes its byte; what is not of that form stays."""
    parts = F.regexp_extract_all(_c(x), F.lit("(?s)(_[0-9A-Fa-f]{2}|.)"))
    hexed = F.transform(parts, lambda p: F.when(F.length(p) == 3, F.upper(F.substring(p, 2, 2))).otherwise(F.hex(F.encode(p, "UTF-8"))))
    return F.decode(F.unhex(F.array_join(hexed, "")), "UTF-8")


def canonical_path(x: Column | str) -> Column:
    """One leading slash, none at the end; an empty path stays empty."""
    inner = F.regexp_replace(_c(x), "^/+|/+$", "")
    return F.when(inner == "", "").otherwise(F.concat(F.lit("/"), inner))


def path_sort_key(x: Column | str) -> Column:
    """Orders paths component by component."""
    return F.split(F.regexp_replace(_c(x), "^/", ""), "/")


def under_path(path: Column | str, p: str) -> Column:
    """The path itself or anything below it."""
    return (_c(path) == p) | _c(path).startswith(p.rstrip("/") + "/")


def connect_id(host: Column | str, ip: Column | str) -> Column:
    """The ip address if there is one, else the host name up to its first asterisk."""
    return F.coalesce(F.nullif(_c(ip), F.lit("")), F.substring_index(_c(host), "*", 1))


def to_epoch(seconds: Column | str, unit: str) -> Column:
    """Whole seconds in an epoch unit: h and m divide, s, ms, u and ns multiply; any other is ns."""
    s = _c(seconds).cast("long")
    if unit in ("h", "m"):
        size = {"h": 3600, "m": 60}[unit]
        return ((s - s % size) / size).cast("long")
    return s * {"s": 1, "ms": 1_000, "u": 1_000_000}.get(unit, 1_000_000_000)


def frame_id(ts: Column | str, span: float) -> Column:
    """The centre (a double, as all times) of the frame that a time belongs to: frames are centred on multiples of the span."""
    return F.floor(_c(ts) / span + 0.5) * F.lit(float(span))


def staleness(now: float, last_read: Column | str) -> Column:
    """Seconds since the last read, 0 if there was none."""
    return F.coalesce(F.lit(float(now)) - _c(last_read), F.lit(0.0))


def json_text(x: Column | str) -> Column:
    """A string as a JSON string, quoted and escaped."""
    array = F.to_json(F.array(_c(x)))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def json_number(x: Column) -> Column:
    """A double in its shortest decimal form, whole numbers without a point; null for NaN and infinity, which JSON does not have."""
    whole = F.when(F.abs(x) < 1e18, F.floor(x).cast("string")).otherwise(x.cast("string"))
    return F.when(is_finite(x), F.when(x == F.floor(x), whole).otherwise(x.cast("string")))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def literal_or(col: Column | str, spec: str) -> Column:
    """Membership in the escaped alternatives of "a|b", case-sensitive."""
    return _c(col).isin(*[unescape(p) for p in spec.split("|")])


def unescape(text: str) -> str:
    """tsdb_unescape of a parameter."""
    out, raw, i = bytearray(), text.encode(), 0
    while i < len(raw):
        pair = raw[i + 1 : i + 3]
        if raw[i : i + 1] == b"_" and len(pair) == 2 and all(chr(c) in "0123456789abcdefABCDEF" for c in pair):
            out.append(int(pair, 16))
            i += 3
        else:
            out.append(raw[i])
            i += 1
    return out.decode(errors="replace")


def dist_count(dist: Column | str) -> Column:
    """Values in a distribution."""
    return F.aggregate(_c(dist)["counts"], F.lit(0).cast("long"), lambda a, x: a + x)


def grouping_key(strategy: str) -> list[Column]:
    """Columns that decide which series of one endpoint belong together."""
    info = ["path", "description", "unit", "kind", "sub_type"]
    if strategy == "exact":
        return [F.col(c) for c in [*info, "group_id"]]
    if strategy == "key":
        return [F.col(c) for c in info]
    if strategy == "path_and_numeric":
        return [F.col("path"), is_numeric("kind").alias("is_numeric")]
    raise ValueError(f"no such grouping: {strategy}")
