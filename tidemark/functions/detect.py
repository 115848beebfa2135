"""Column types from values, and conversion of values to those types.

A value is a (kind, text) pair as the decoder produces it; kinds are null, bool, int, float,
string, array, and time for values that are already timestamps.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tidemark.functions.coerce import LAST_MILLI, layout_time, strict_bigint

STRING, BOOL, INT, FLOAT, TIME = "String", "Bool", "Int64", "Float64", "DateTime"

SPARK_TYPES = {
    STRING: T.StringType(),
    BOOL: T.BooleanType(),
    INT: T.LongType(),
    FLOAT: T.DoubleType(),
    TIME: T.TimestampType(),
}

# Text detection. Integers strictly between the bounds are millisecond times.
BOOL_TEXTS = ["true", "false", "True", "False"]
TIME_AFTER, TIME_BEFORE = 946_684_800_000, 4_102_444_800_000

# Texts a conversion to bool accepts.
TRUE_WORDS = ["1", "t", "T", "TRUE", "true", "True"]
FALSE_WORDS = ["0", "f", "F", "FALSE", "false", "False"]

# Number grammar of text detection.
DECIMAL_FLOAT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
NAMED_FLOAT = r"(?i)\A([+-]?inf|[+-]?infinity|nan)\z"
HEX_FLOAT = r"(?i)\A[+-]?0x_?([0-9a-f](_?[0-9a-f])*)?\.?([0-9a-f](_?[0-9a-f])*)?p[+-]?[0-9]+\z"


def text_double(text: Column) -> Column:
    """Decimal or named float text -> double; NULL when malformed or out of range."""
    named = F.lower(F.regexp_replace(text, r"\A[+-]", ""))
    infinite = F.when(F.startswith(text, F.lit("-")), float("-inf")).otherwise(float("inf"))
    value = text.try_cast("double")
    return F.when(text.rlike(NAMED_FLOAT), F.when(named == "nan", float("nan")).otherwise(infinite)).when(
        text.rlike(DECIMAL_FLOAT) & (F.abs(value) < float("inf")), value
    )


def detect_text(text: Column) -> Column:
    number = strict_bigint(text)
    return (
        F.when(text == "", STRING)
        .when(text.isin(BOOL_TEXTS), BOOL)
        .when((number > TIME_AFTER) & (number < TIME_BEFORE), TIME)
        .when(number.isNotNull(), INT)
        .when(text_double(text).isNotNull() | text.rlike(HEX_FLOAT), FLOAT)
        .when(layout_time(text).isNotNull(), TIME)
        .otherwise(STRING)
    )


def detect_type(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "bool", BOOL)
        .when(kind == "int", F.when(text.try_cast("bigint").isNotNull(), INT).otherwise(FLOAT))
        .when(kind == "float", FLOAT)
        .when(kind == "string", detect_text(text))
        .when(kind == "time", TIME)
        .otherwise(STRING)
    )


def merge_types(detected: Column) -> Column:
    """Aggregate: the one type that fits every sample."""

    def seen(name: str) -> Column:
        return F.coalesce(F.bool_or(detected == name), F.lit(False))

    others = seen(BOOL) | seen(INT) | seen(FLOAT)
    return (
        F.when(seen(STRING) | (seen(TIME) & others), STRING)
        .when(seen(TIME), TIME)
        .when(seen(FLOAT), FLOAT)
        .when(seen(INT), INT)
        .when(seen(BOOL), BOOL)
        .otherwise(STRING)
    )


def to_bool(kind: Column, text: Column) -> Column:
    worded = F.when(text.isin(TRUE_WORDS), True).when(text.isin(FALSE_WORDS), False)
    return (
        F.when(kind == "bool", text == "true")
        .when(kind == "string", worded)
        .when(kind == "int", text.try_cast("decimal(38,0)") != 0)
    )


def to_int(kind: Column, text: Column) -> Column:
    whole = F.regexp_extract(text, r"\A(-?[0-9]+)", 1)
    return (
        F.when(kind == "int", text.try_cast("bigint"))
        .when(kind == "float", whole.try_cast("bigint"))
        .when(kind == "string", strict_bigint(text))
    )


def to_float(kind: Column, text: Column) -> Column:
    return F.when(kind.isin("int", "float"), text.try_cast("double")).when(
        kind == "string", text_double(text)
    )


def to_time(kind: Column, text: Column) -> Column:
    millis = strict_bigint(text)
    from_millis = F.when(F.abs(millis) <= LAST_MILLI, F.timestamp_millis(millis))
    return (
        F.when(kind == "string", F.coalesce(layout_time(text), from_millis))
        .when(kind == "int", from_millis)
        .when(kind == "time", text.try_cast("timestamp"))
    )


def general_number(text: Column) -> Column:
    """Plain float text -> general format: an exponent below -4 and from 6 up."""
    sign = F.regexp_extract(text, r"\A(-?)", 1)
    whole = F.regexp_extract(text, r"\A-?0*([0-9]*)", 1)
    zeros = F.regexp_extract(text, r"\A-?0*\.(0*)", 1)
    fraction = F.regexp_extract(text, r"\.([0-9]*)\z", 1)
    digits = F.regexp_replace(
        F.regexp_replace(F.concat(whole, fraction), r"\A0+", ""), r"0+\z", ""
    )
    exponent = F.when(whole != "", F.length(whole) - 1).otherwise(-1 - F.length(zeros))
    tail = F.substring(digits, F.lit(2), F.length(digits))
    scientific = F.concat(
        sign,
        F.left(digits, F.lit(1)),
        F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    return F.when((digits != "") & ((exponent < -4) | (exponent >= 6)), scientific).otherwise(text)


def to_string(kind: Column, text: Column) -> Column:
    return F.when(kind == "float", general_number(text)).otherwise(text)


CONVERTERS = {BOOL: to_bool, INT: to_int, FLOAT: to_float, TIME: to_time, STRING: to_string}

# What a null becomes, per type, as SQL literals.
NULL_DEFAULTS = {
    BOOL: "false",
    INT: "0L",
    FLOAT: "0.0D",
    TIME: "timestamp_seconds(0)",
    STRING: "''",
}


def null_default(type_name: str) -> Column:
    return F.expr(NULL_DEFAULTS.get(type_name, NULL_DEFAULTS[STRING]))


def convert(kind: Column, text: Column, type_name: str) -> tuple[Column, Column]:
    """(value, error): the value is NULL exactly when the error is true."""
    target = type_name if type_name in CONVERTERS else STRING
    value = F.when(kind == "null", null_default(target)).otherwise(CONVERTERS[target](kind, text))
    return value, value.isNull()


# Column definitions; text is never null, other types may be.
def column_definition(name: Column, type_name: Column) -> Column:
    quoted = F.concat(F.lit("`"), name, F.lit("` "))
    nullable = type_name.isin(BOOL, INT, FLOAT, TIME)
    return F.when(
        nullable, F.concat(quoted, F.lit("Nullable("), type_name, F.lit(")"))
    ).otherwise(F.concat(quoted, F.lit("String DEFAULT ''")))


def struct_field(name: str, type_name: str) -> T.StructField:
    spark_type = SPARK_TYPES.get(type_name, T.StringType())
    if isinstance(spark_type, T.StringType):
        return T.StructField(name, spark_type, False, {"default": ""})
    return T.StructField(name, spark_type, True)
