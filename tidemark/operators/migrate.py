"""Migration of the all-text event table to typed columns, and reports on both copies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.coerce import int_or_null, three_state_bool
from tidemark.sources.footers import open_file
from tidemark.sources.tables import write_events, write_users

# The typed table's core columns.
EVENT_TEXT = [
    "os", "os_version", "model", "brand", "network_type", "app_version", "app_name", "lib",
    "lib_version", "user_id",
]
INT_COLUMNS = ["screen_width", "screen_height"]
BOOL_COLUMNS = ["wifi", "is_first_day"]
EVENT_CORE = ["time", "ds", "event", "distinct_id", *EVENT_TEXT, *INT_COLUMNS, *BOOL_COLUMNS]
USER_CORE = [
    "distinct_id", "ds", "user_id", "first_visit_time", "last_visit_time", "name", "email",
    "phone", "avatar",
]

TYPED_EVENT = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("ds", T.DateType()),
        T.StructField("event", T.StringType()),
        T.StructField("distinct_id", T.StringType()),
        *[T.StructField(name, T.StringType()) for name in EVENT_TEXT],
        *[T.StructField(name, T.IntegerType()) for name in INT_COLUMNS],
        *[T.StructField(name, T.BooleanType()) for name in BOOL_COLUMNS],
    ]
)


def extra_columns(table: DataFrame, core: list[str]) -> list[str]:
    """Columns beyond the core; they are carried over as they are."""
    return [name for name in table.columns if name not in core]


def _typed(name: str) -> Column:
    if name == "ds":
        return F.to_date("ds").alias("ds")
    if name in INT_COLUMNS:
        return int_or_null(F.col(name)).alias(name)
    if name in BOOL_COLUMNS:
        return three_state_bool(F.col(name)).alias(name)
    return F.col(name)


def typed_events(legacy: DataFrame) -> DataFrame:
    """The typed projection of the all-text table, extra columns included."""
    present = [name for name in EVENT_CORE if name in legacy.columns]
    return legacy.select(*[_typed(n) for n in present], *extra_columns(legacy, EVENT_CORE))


def typed_users(legacy: DataFrame) -> DataFrame:
    present = [name for name in USER_CORE if name in legacy.columns]
    return legacy.select(*[_typed(n) for n in present], *extra_columns(legacy, USER_CORE))


def backup(table: DataFrame, path: str) -> int:
    """Copy a table; fails unless the copy has as many rows."""
    table.write.mode("overwrite").parquet(path)
    before, after = table.count(), table.sparkSession.read.parquet(path).count()
    if before != after:
        raise ValueError(f"backup holds {after} rows, the table {before}")
    return after


def verify(legacy: DataFrame, typed: DataFrame) -> DataFrame:
    """One row per check: counts, the type of ``ds``, and values lost by each cast.

    All losses come from one pass over the legacy table and one over the typed one.
    """
    lossy = [name for name in [*INT_COLUMNS, *BOOL_COLUMNS] if name in legacy.columns]
    given = legacy.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(name) != "").alias(name) for name in lossy],
    )
    kept = typed.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(name).alias(name) for name in lossy]
    )

    def unpivoted(totals: DataFrame, value: str) -> DataFrame:
        return totals.unpivot([], ["rows", *lossy], "check", value)

    date_type = typed.schema["ds"].dataType.simpleString()
    compared = unpivoted(given, "legacy").join(unpivoted(kept, "typed"), "check")
    ok = F.when(F.col("check") == "rows", F.col("legacy") == F.col("typed")).otherwise(True)
    return compared.select(
        "check",
        "legacy",
        "typed",
        (F.col("legacy") - F.col("typed")).alias("lost"),
        (ok & F.lit(date_type == "date")).alias("ok"),
    )


def migrate(spark: SparkSession, legacy: DataFrame, root: str, version: int, table: str = "event") -> DataFrame:
    """Back up, convert into a new version folder, verify; the caller decides on the swap.

    ``table`` is ``event`` or ``user`` and decides on the columns and the layout.
    """
    backup(legacy, f"{root}/backup/version={version}")
    saved = spark.read.parquet(f"{root}/backup/version={version}")
    path = f"{root}/data/version={version}"
    if table == "user":
        write_users(typed_users(saved), path)
    else:
        write_events(typed_events(saved), path, mode="overwrite")
    return verify(saved, spark.read.parquet(path))


def swap(spark: SparkSession, root: str, version: int) -> None:
    """Make a version current; earlier versions stay in place for a way back."""
    pointer = spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"), F.current_timestamp().alias("at")
    )
    pointer.coalesce(1).write.mode("append").json(f"{root}/pointer")


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The version swapped in last, or None before the first swap."""
    try:
        pointers = spark.read.schema("version BIGINT, at TIMESTAMP").json(f"{root}/pointer")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    version = pointers.agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{root}/data/version={version}")


def append_rows(spark: SparkSession, path: str, rows: int = 1000) -> None:
    """Append that many of a table's own rows to it."""
    spark.read.parquet(path).limit(rows).write.mode("append").parquet(path)


_CHUNKS = "column string, rows bigint, compressed bigint, uncompressed bigint"


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and bytes of every column in every file, from the footers alone."""
    import pyarrow.parquet as pq

    for batch in batches:
        sums: dict[str, list[int]] = {}
        for path in batch.column("path").to_pylist():
            with open_file(path) as source:
                footer = pq.ParquetFile(source).metadata
            for group in range(footer.num_row_groups):
                for k in range(footer.num_columns):
                    chunk = footer.row_group(group).column(k)
                    own = sums.setdefault(chunk.path_in_schema, [0, 0, 0])
                    own[0] += footer.row_group(group).num_rows
                    own[1] += chunk.total_compressed_size
                    own[2] += chunk.total_uncompressed_size
        rows = [(name, *own) for name, own in sums.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["column", "rows", "compressed", "uncompressed"])


def storage_report(spark: SparkSession, paths: dict[str, str], files_per_task: int = 256) -> DataFrame:
    """Stored bytes per table and column, and of each table as a whole (column ``*``).

    ``table, column, rows, compressed_bytes, uncompressed_bytes, ratio_percent``: the sizes of
    the column chunks as the Parquet footers have them. Spark lists the files without reading
    them; tasks read the footers, through a file system that pyarrow knows.
    """
    report = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
        tasks = max(1, -(-files.count() // files_per_task))
        sums = files.repartition(tasks).mapInArrow(_footers, _CHUNKS).groupBy("column").agg(
            F.sum("rows").alias("rows"), F.sum("compressed").alias("compressed_bytes"), F.sum("uncompressed").alias("uncompressed_bytes")
        )
        whole = sums.agg(F.lit("*").alias("column"), F.max("rows").alias("rows"), F.sum("compressed_bytes").alias("compressed_bytes"), F.sum("uncompressed_bytes").alias("uncompressed_bytes"))
        own = sums.unionByName(whole).select(F.lit(name).alias("table"), "*")
        report = own if report is None else report.unionAll(own)
    ratio = F.try_divide(F.col("compressed_bytes").cast("double") * 100, F.col("uncompressed_bytes").cast("double"))
    return report.withColumn("ratio_percent", F.round(ratio, 2))


def _value_bytes(field: T.StructField) -> Column:
    widths = {"boolean": 1, "smallint": 2, "int": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8}
    kind = field.dataType.simpleString()
    value = F.col(field.name)
    size = F.lit(widths[kind]) if kind in widths else F.octet_length(value.cast("string"))
    return F.when(value.isNotNull(), size).otherwise(0).cast("bigint")


def value_bytes(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, column, rows, value_bytes``: bytes of the values alone, however they are stored.

    One pass per table; fixed-size values count their width, others their text.
    """
    report = None
    for name, table in tables.items():
        sums = table.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(_value_bytes(field)).alias(field.name) for field in table.schema.fields])
        own = sums.unpivot(["rows"], list(table.columns), "column", "value_bytes").select(F.lit(name).alias("table"), "column", "rows", "value_bytes")
        report = own if report is None else report.unionAll(own)
    return report
