"""Columns of the event and user tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import coerce
from tidemark.functions.variant import once

# The core columns of the two tables.
EVENT_TEXT = [
    "distinct_id", "anonymous_id", "lib", "lib_method", "lib_version", "os", "os_version",
    "model", "brand", "manufacturer", "network_type", "app_id", "app_version", "app_name",
    "device_id", "user_id",
]
USER_TEXT = ["user_id", "name", "email", "phone", "avatar"]

# Columns with a parser of their own, by name.
PARSED = {
    "_flush_time": coerce.uint64,
    "screen_width": coerce.uint16,
    "screen_height": coerce.uint16,
    "timezone_offset": coerce.int16,
    "wifi": coerce.true_text,
    "is_first_day": coerce.true_text,
}
SPARK_TYPE = {
    "_flush_time": T.DecimalType(20, 0),
    "screen_width": T.IntegerType(),
    "screen_height": T.IntegerType(),
    "timezone_offset": T.ShortType(),
    "wifi": T.BooleanType(),
    "is_first_day": T.BooleanType(),
}

EVENT_CORE = ["time", "ds", "event", *EVENT_TEXT, *PARSED]
USER_CORE = ["distinct_id", "ds", "first_visit_time", "last_visit_time", *USER_TEXT]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("ds", T.DateType()),
        T.StructField("event", T.StringType()),
        *[T.StructField(name, SPARK_TYPE[name]) for name in PARSED],
        *[T.StructField(name, T.StringType()) for name in EVENT_TEXT],
    ]
)


# Up to this many columns are looked up in the map of properties one by one.
FEW_COLUMNS = 32

# Columns that rows carry beside their properties, and that folders are named by.
RESERVED = ["seq", "pos", "received_at", "props", "other", "payload_hash", "ds_month", "batch_id", "unconverted"]


def taken_names(columns: Iterable[str] = (), core: Iterable[str] = EVENT_CORE) -> set[str]:
    """Names that no new column may have; Parquet readers and Spark don't tell case apart."""
    return {name.lower() for name in (*core, *RESERVED, *columns)}


def other_properties(props: Column, columns: Iterable[str], core: Iterable[str] = EVENT_CORE) -> Column:
    """The properties that no column holds: refused names, clashing ones, those beyond the limit."""
    held = sorted({*columns, *core} - {"ds"})
    return F.map_filter(props, lambda key, _: ~key.isin(held))


def column_value(name: str, props: Column) -> Column:
    """One stored value, parsed by its column name; other columns are text."""
    raw = props[name]
    if name in PARSED:
        return PARSED[name](raw)
    if name in ("first_visit_time", "last_visit_time"):
        return coerce.epoch_time(raw)
    if name == "revenue":
        return F.coalesce(raw.try_cast("double"), F.lit(0.0))
    return F.coalesce(raw, F.lit(""))


def event_rows(
    records: DataFrame, extra: list[str] | tuple[str, ...] = (), tz: str = "UTC", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Event records -> typed rows of the event table, as one projection."""
    props = F.col("props")
    timed = once(records, time=coerce.event_time(props["time"], F.col("received_at")))
    # Two steps, so that the generated code of each stays small enough to be compiled.
    parsed = once(timed, **{name: column_value(name, props) for name in PARSED})
    names = [name for name in extra if name not in EVENT_CORE]
    texts = [name for name in names if name != "revenue"]
    if len(texts) > FEW_COLUMNS:
        # A map is searched entry by entry for every column, so only what columns hold is kept.
        held = F.map_filter(props, lambda key, _: key.isin(texts))
        parsed, source = once(parsed, _held=held), "_held['{}']"
    else:
        source = "props['{}']"
    return parsed.select(
        *keep,
        "time",
        coerce.event_date(F.col("time"), tz).alias("ds"),
        "event",
        *PARSED,
        *[column_value(name, props).alias(name) for name in EVENT_TEXT],
        *[text_column(name, source) for name in names],
    )


def text_column(name: str, source: str) -> Column:
    """A property beyond the core columns, as one expression; tables may have many."""
    if name == "revenue":
        return column_value(name, F.col("props")).alias(name)
    return F.expr(f"coalesce({source.format(name)}, '') AS `{name}`")


def user_rows(
    merged: DataFrame, extra: list[str] | tuple[str, ...] = (), tz: str = "UTC", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Merged profiles -> typed rows of the user table.

    A visit time that is absent is the receipt time; one that does not parse is NULL and is
    counted by ``bad_visit_times``.
    """
    props = F.col("props")
    time = coerce.event_time(props["time"], F.col("received_at"))

    def visit(name: str) -> Column:
        absent = F.coalesce(props[name], F.lit("")) == ""
        return F.when(absent, F.col("received_at")).otherwise(column_value(name, props))

    def unparsed(name: str) -> Column:
        return (F.coalesce(props[name], F.lit("")) != "") & column_value(name, props).isNull()

    names = [*USER_TEXT, *[n for n in extra if n not in USER_CORE]]
    visits = ["first_visit_time", "last_visit_time"]
    return merged.select(
        *keep,
        "distinct_id",
        coerce.event_date(time, tz).alias("ds"),
        *[visit(name).alias(name) for name in visits],
        *[column_value(name, props).alias(name) for name in names],
        sum(unparsed(name).cast("int") for name in visits).alias("bad_visit_times"),
    )
