"""Registered queries for value coercion and type detection.

Every event row is given one of the listed values by its number; half of the values are
edge cases, the others come from the row itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import coerce, detect
from tidemark.operators import evolve
from tidemark.workload.fixture import event_view

MS_SQL = "WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)\n"
UINT64_MAX = str(coerce.UINT64_MAX)

# (raw text, milliseconds, unsigned 64, unsigned 16, signed 16, bool), all as SQL.
RAW_TEXTS = [
    ("''", "NULL", "0", "0", "0", "false"),
    ("' 5 '", "5000", "5", "5", "5", "false"),
    ("'+5'", "5000", "0", "0", "5", "false"),
    ("'-1'", "NULL", "0", "0", "-1", "false"),
    ("'0'", "NULL", "0", "0", "0", "false"),
    ("'1.5'", "NULL", "0", "0", "0", "false"),
    ("'99999999999'", "99999999999000", "99999999999", "65535", "32767", "false"),
    ("'100000000000'", "100000000000", "100000000000", "65535", "32767", "false"),
    ("'18446744073709551615'", "NULL", UINT64_MAX, "65535", "32767", "false"),
    ("'18446744073709551616'", "NULL", UINT64_MAX, "65535", "32767", "false"),
    ("REPEAT('9', 40)", "NULL", UINT64_MAX, "65535", "32767", "false"),
    ("'-32769'", "NULL", "0", "0", "-32768", "false"),
    ("'32768'", "32768000", "32768", "32768", "32767", "false"),
    ("'65536'", "65536000", "65536", "65535", "32767", "false"),
    ("' YES '", "NULL", "0", "0", "0", "true"),
    ("'y'", "NULL", "0", "0", "0", "true"),
    ("'TRUE'", "NULL", "0", "0", "0", "true"),
    ("'t'", "NULL", "0", "0", "0", "false"),
    (
        "CAST(event_id AS STRING)",
        "CASE WHEN event_id > 0 THEN event_id * 1000 END",
        "event_id",
        "least(event_id, 65535)",
        "least(event_id, 32767)",
        "event_id = 1",
    ),
    ("CAST(ms AS STRING)", "ms", "ms", "65535", "32767", "false"),
    ("CONCAT('-', CAST(user_id AS STRING))", "NULL", "0", "0", "-user_id", "false"),
    ("event_type", "NULL", "0", "0", "0", "false"),
]

NOW = 1_700_000_000_000

# (kind, text, milliseconds), the text and result as SQL.
TIME_VALUES = [
    ("int", "'0'", str(NOW)),
    ("int", "'-5'", str(NOW)),
    ("int", "'1'", "1000"),
    ("int", "'99999999999'", "99999999999000"),
    ("int", "'100000000000'", "100000000000"),
    ("int", "'99999999999999'", "99999999999000"),
    ("int", "'100000000000000'", "100000000000"),
    ("int", "'99999999999999999'", "99999999999000"),
    ("int", "'100000000000000000'", "100000000000"),
    ("int", "CAST(ms AS STRING)", "ms // 1000 * 1000"),
    ("int", "CAST(ms * 1000 + 7 AS STRING)", "ms // 1000 * 1000"),
    ("int", "CAST(ms * 1000000 + 7 AS STRING)", "ms // 1000 * 1000"),
    ("float", "CONCAT(CAST(ms AS STRING), '.75')", "ms // 1000 * 1000"),
    ("string", "'2024-01-01T10:00:00.9+08:00'", "1704074400000"),
    ("string", "'2024-01-01 10:00:00'", str(NOW)),
    ("string", "CAST(ms AS STRING)", str(NOW)),
    ("bool", "'true'", str(NOW)),
    ("null", "''", str(NOW)),
]

# (kind, text as SQL, type)
TYPED_VALUES = [
    ("null", "''", "String"),
    ("bool", "'true'", "Bool"),
    ("int", "CAST(event_id AS STRING)", "Int64"),
    ("int", "'9223372036854775808'", "Float64"),
    ("float", "CONCAT(CAST(event_id AS STRING), '.5')", "Float64"),
    ("array", "'[1]'", "String"),
    ("time", "'2024-01-01 00:00:00'", "DateTime"),
    ("string", "''", "String"),
    ("string", "'true'", "Bool"),
    ("string", "'False'", "Bool"),
    ("string", "'TRUE'", "String"),
    ("string", "'946684800000'", "Int64"),
    ("string", "'946684800001'", "DateTime"),
    ("string", "'4102444799999'", "DateTime"),
    ("string", "'4102444800000'", "Int64"),
    ("string", "'-456'", "Int64"),
    ("string", "'9223372036854775808'", "Float64"),
    ("string", "'1e400'", "String"),
    ("string", "'1e3'", "Float64"),
    ("string", "'NaN'", "Float64"),
    ("string", "'+nan'", "String"),
    ("string", "'-Infinity'", "Float64"),
    ("string", "'0x1p-2'", "Float64"),
    ("string", "'0x10'", "String"),
    ("string", "'5d'", "String"),
    ("string", "' 5'", "String"),
    ("string", "'2024'", "Int64"),
    ("string", "'2024-1-1'", "String"),
    ("string", "'2024-01-01'", "DateTime"),
    ("string", "'2024-02-30'", "String"),
    ("string", "'2024-01-01 10:00:00.5'", "DateTime"),
    ("string", "'2024-01-01T10:00:00+08:00'", "DateTime"),
    ("string", "'2024-01-01T10:00:00'", "String"),
    ("string", "event_type", "String"),
    ("string", "CAST(ms AS STRING)", "DateTime"),
    ("string", "CAST(event_id AS STRING)", "Int64"),
    ("string", "CONCAT(CAST(event_id AS STRING), '.25')", "Float64"),
]

# (kind, text as SQL, target, value as SQL text or NULL for an error)
CONVERSIONS = [
    ("bool", "'true'", "Bool", "'true'"),
    ("string", "'T'", "Bool", "'true'"),
    ("string", "'0'", "Bool", "'false'"),
    ("string", "'yes'", "Bool", "NULL"),
    ("int", "CAST(event_id % 2 AS STRING)", "Bool", "CASE event_id % 2 WHEN 0 THEN 'false' ELSE 'true' END"),
    ("float", "'1.5'", "Bool", "NULL"),
    ("null", "''", "Bool", "'false'"),
    ("int", "CAST(event_id AS STRING)", "Int64", "CAST(event_id AS VARCHAR)"),
    ("float", "CONCAT('-', CAST(event_id AS STRING), '.75')", "Int64", "CAST(-event_id AS VARCHAR)"),
    ("string", "'+12'", "Int64", "'12'"),
    ("string", "'abc'", "Int64", "NULL"),
    ("bool", "'true'", "Int64", "NULL"),
    ("null", "''", "Int64", "'0'"),
    ("string", "'123.45'", "Float64", "'123.45'"),
    ("int", "CAST(event_id % 100 AS STRING)", "Float64", "concat(event_id % 100, '.0')"),
    ("string", "'xyz'", "Float64", "NULL"),
    ("string", "'1e400'", "Float64", "NULL"),
    ("string", "'inf'", "Float64", "'Infinity'"),
    ("null", "''", "Float64", "'0.0'"),
    ("string", "CAST(ms AS STRING)", "DateTime", "CAST(ms AS VARCHAR)"),
    ("int", "CAST(ms AS STRING)", "DateTime", "CAST(ms AS VARCHAR)"),
    ("float", "'1.5'", "DateTime", "NULL"),
    ("string", "'2024-01-01'", "DateTime", "'1704067200000'"),
    ("string", "'2024-01-01T10:00:00+08:00'", "DateTime", "'1704074400000'"),
    ("string", "'soon'", "DateTime", "NULL"),
    ("null", "''", "DateTime", "'0'"),
    ("float", "'1234567.5'", "String", "'1.2345675e+06'"),
    ("float", "'0.00001'", "String", "'1e-05'"),
    ("float", "'123.5'", "String", "'123.5'"),
    ("int", "CAST(event_id AS STRING)", "String", "CAST(event_id AS VARCHAR)"),
    ("string", "event_type", "String", "event_type"),
    ("null", "''", "String", "''"),
]

TYPES = ["String", "Bool", "Int64", "Float64", "DateTime", "Other"]
DEFAULTS = ["''", "'false'", "'0'", "'0.0'", "'0'", "''"]


def pick(expressions: list[str]) -> str:
    """SQL that gives row n the expression at n modulo the list's length."""
    cases = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(expressions))
    return f"CASE event_id % {len(expressions)} {cases} END"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    event_view(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def coerce_fixed_columns(spark, sf_dir):
    raw = F.col("raw")
    rows = numbered(spark, sf_dir).select(
        "event_id", F.expr(pick([row[0] for row in RAW_TEXTS])).alias("raw")
    )
    return rows.select(
        "event_id",
        coerce.epoch_millis(raw).alias("millis"),
        coerce.uint64(raw).cast("string").alias("unsigned64"),
        coerce.uint16(raw).alias("unsigned16"),
        coerce.int16(raw).cast("int").alias("signed16"),
        coerce.true_text(raw).alias("truth"),
    )


def valued(spark: SparkSession, sf_dir: str, values: list[tuple]) -> DataFrame:
    return numbered(spark, sf_dir).select(
        "event_id",
        F.expr(pick([f"'{row[0]}'" for row in values])).alias("kind"),
        F.expr(pick([row[1] for row in values])).alias("text"),
    )


def epoch_normalize(spark, sf_dir):
    now = F.lit(NOW).cast("bigint")
    millis = coerce.any_event_millis(F.col("kind"), F.col("text"), now)
    return valued(spark, sf_dir, TIME_VALUES).select("event_id", millis.alias("millis"))


def detect_value_types(spark, sf_dir):
    found = detect.detect_type(F.col("kind"), F.col("text"))
    return valued(spark, sf_dir, TYPED_VALUES).select("event_id", found.alias("type"))


def convert_typed(spark, sf_dir):
    rows = valued(spark, sf_dir, CONVERSIONS).withColumn(
        "target", F.expr(pick([f"'{row[2]}'" for row in CONVERSIONS]))
    )
    value = F.lit(None).cast("string")
    for name in detect.CONVERTERS:
        converted, _ = detect.convert(F.col("kind"), F.col("text"), name)
        if name == detect.TIME:
            converted = F.unix_millis(converted)
        value = F.when(F.col("target") == name, converted.cast("string")).otherwise(value)
    return rows.select("event_id", "target", value.alias("value"), value.isNull().alias("error"))


def typed_defaults(spark, sf_dir):
    rows = numbered(spark, sf_dir).withColumn("type", F.expr(pick([f"'{t}'" for t in TYPES])))
    default = F.lit("")
    for name in detect.NULL_DEFAULTS:
        value = detect.null_default(name)
        if name == detect.TIME:
            value = F.unix_millis(value)
        default = F.when(F.col("type") == name, value.cast("string")).otherwise(default)
    return rows.select(
        "event_id",
        "type",
        default.alias("default_text"),
        detect.column_definition(F.col("event_type"), F.col("type")).alias("definition"),
    )


def infer_column_types(spark, sf_dir):
    """Columns with pure and mixed samples, named by what they hold."""

    def leaf(key: str, kind: str, text: str):
        return F.struct(
            F.lit(key).alias("key"), F.expr(kind).alias("kind"), F.expr(text).alias("text")
        )

    number = "CAST(event_id AS STRING)"
    leaves = F.array(
        leaf("ints", "'int'", number),
        leaf("floats", "'float'", f"CONCAT({number}, '.5')"),
        leaf("int_float", "CASE event_id % 2 WHEN 0 THEN 'int' ELSE 'float' END", number),
        leaf("bools", "'bool'", "'true'"),
        leaf("bool_int", "CASE event_id % 2 WHEN 0 THEN 'bool' ELSE 'int' END", number),
        leaf("texts", "'string'", "event_type"),
        leaf("int_text", "'string'", f"CASE event_id % 2 WHEN 0 THEN {number} ELSE event_type END"),
        leaf("int_null", "CASE event_id % 2 WHEN 0 THEN 'int' ELSE 'null' END", number),
        leaf("times", "'string'", "CAST(ms AS STRING)"),
        leaf("time_int", "'string'", f"CASE event_id % 2 WHEN 0 THEN CAST(ms AS STRING) ELSE {number} END"),
    )
    return evolve.infer_column_types(numbered(spark, sf_dir).select(F.inline(leaves)))


QUERIES = {
    "coerce_fixed_columns": coerce_fixed_columns,
    "epoch_normalize": epoch_normalize,
    "detect_value_types": detect_value_types,
    "convert_typed": convert_typed,
    "typed_defaults": typed_defaults,
    "infer_column_types": infer_column_types,
}

_columns = list(zip(*RAW_TEXTS))
_definition = """CASE WHEN t IN ('String', 'Other') THEN concat('`', event_type, '` String DEFAULT ''''')
  ELSE concat('`', event_type, '` Nullable(', t, ')') END"""

ORACLES = {
    "coerce_fixed_columns": f"""{MS_SQL}SELECT event_id, CAST({pick(_columns[1])} AS BIGINT) AS millis,
      CAST({pick([f"CAST({e} AS UBIGINT)" for e in _columns[2]])} AS VARCHAR) AS unsigned64,
      CAST({pick(_columns[3])} AS INTEGER) AS unsigned16, CAST({pick(_columns[4])} AS INTEGER) AS signed16,
      {pick(_columns[5])} AS truth FROM e""",
    "epoch_normalize": f"{MS_SQL}SELECT event_id, {pick([row[2] for row in TIME_VALUES])} AS millis FROM e",
    "detect_value_types": f"{MS_SQL}SELECT event_id, {pick([repr(row[2]) for row in TYPED_VALUES])} AS type FROM e",
    "convert_typed": f"""{MS_SQL}, c AS (SELECT event_id, {pick([repr(row[2]) for row in CONVERSIONS])} AS target,
      {pick([row[3] for row in CONVERSIONS])} AS value FROM e)
    SELECT event_id, target, value, value IS NULL AS error FROM c""",
    "typed_defaults": f"""WITH c AS (SELECT event_id, event_type, {pick([repr(t) for t in TYPES])} AS t,
      {pick(DEFAULTS)} AS default_text FROM events)
    SELECT event_id, t AS type, default_text, {_definition} AS definition FROM c""",
    "infer_column_types": """SELECT c AS "column", t AS type, (SELECT count(*) FROM events) AS samples FROM (VALUES
      ('ints', 'Int64'), ('floats', 'Float64'), ('int_float', 'Float64'), ('bools', 'Bool'), ('bool_int', 'Int64'),
      ('texts', 'String'), ('int_text', 'String'), ('int_null', 'String'), ('times', 'DateTime'), ('time_int', 'String')) v(c, t)""",
}
