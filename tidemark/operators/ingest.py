"""Messages -> stored tables: one decode gives events, profiles and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import detect
from tidemark.operators import evolve
from tidemark.operators.dedup import drop_exact_duplicates
from tidemark.operators.profiles import ProfileStore
from tidemark.schema import EVENT_CORE, FEW_COLUMNS, RESERVED, event_rows, other_properties
from tidemark.session import stage, staged
from tidemark.sources import tables
from tidemark.sources.messages import (
    MAX_PAYLOAD_BYTES,
    decode,
    event_records,
    profile_records,
    rejects,
)

KEEP = ("seq", "pos", "received_at")


def ingest_events(
    messages: DataFrame,
    max_bytes: int = MAX_PAYLOAD_BYTES,
    tz: str = "UTC",
    keep: tuple[str, ...] = (*KEEP, "props"),
) -> DataFrame:
    """Decode a batch once into a staged table, find its new columns, project the rows."""
    records = stage(event_records(decode(messages, max_bytes)), "decoded")
    columns = evolve.collect_columns(evolve.new_text_columns(records, EVENT_CORE))
    return event_rows(records, [name for name, _ in columns], tz, keep)


def stored_columns(table: dict[str, tuple[str, bool]]) -> list[tuple[str, str]]:
    """(name, detected type) of a stored table's columns beyond the core."""
    types = {spark_type.simpleString(): name for name, spark_type in detect.SPARK_TYPES.items()}
    fixed = {*EVENT_CORE, *RESERVED}
    return [(name, types.get(kind, detect.STRING)) for name, (kind, _) in table.items() if name not in fixed]


def store_records(
    records: DataFrame,
    path: str,
    batch: str,
    typed: bool = False,
    tz: str = "UTC",
    max_columns: int = evolve.MAX_COLUMNS,
) -> list[tuple[str, str]]:
    """Append event records to the table at ``path`` and return the columns they added.

    New columns are judged against those the table has, whose types stay. Properties that get no
    column are in the map ``other``. Files of text rows lack columns that none of their rows hold;
    where few rows of a batch hold most of its columns, the others are stored apart without these.
    """
    table = tables.stored_schema(records.sparkSession, path)
    stored = stored_columns(table)
    names = [name for name, _ in stored]
    known = {*EVENT_CORE, *names}
    if typed:
        added = evolve.collect_columns(evolve.new_typed_columns(records, known), names, max_columns)
        rows = evolve.typed_table(records, [*stored, *added], "received_at", *KEEP, "event")
        tables.append_batch(rows, path, batch)
        return added
    with staged(evolve.key_counts(records), "keys") as counts:
        added = evolve.collect_columns(evolve.fresh_text_columns(counts, known), names, max_columns)
        names += [name for name, _ in added]
        held = {row["column"]: row["rows"] for row in counts.filter(F.col("column").isin(names)).collect()}
    # Columns that don't read as empty text where they lack are in every file.
    fixed = {name for name in names if name == "revenue" or not table.get(name, ("", True))[1]}
    held = {name: rows for name, rows in held.items() if name not in fixed}
    rare = evolve.rare_columns(held, records.count()) if len(held) > FEW_COLUMNS else set()
    other = other_properties(F.col("props"), names).alias("other")

    def rows(part: DataFrame, columns: set[str]) -> DataFrame:
        return event_rows(part, [name for name in names if name in columns], tz, (*KEEP, other))

    if rare:
        holds_rare = F.coalesce(F.exists(F.map_keys("props"), lambda key: key.isin(sorted(rare))), F.lit(False))
        wide, narrow = records.filter(holds_rare), rows(records.filter(~holds_rare), {*fixed, *held} - rare)
    else:
        wide, narrow = records, None
    tables.append_batch(rows(wide, {*fixed, *held}), path, batch, empty_text=True, narrow=narrow)
    return added


def ingest(
    messages: DataFrame,
    root: str,
    batch: str,
    store: ProfileStore | None = None,
    typed: bool = False,
    max_bytes: int = MAX_PAYLOAD_BYTES,
    tz: str = "UTC",
    max_columns: int = evolve.MAX_COLUMNS,
) -> None:
    """One batch into ``root/events`` and ``root/rejects``, and profiles into the store.

    The batch is decoded once, exact duplicates go, and writing a batch key again replaces it.
    The staged copies are removed.
    """
    with staged(decode(messages, max_bytes), "decoded") as decoded:
        rejects(decoded).write.mode("overwrite").parquet(f"{root}/rejects/batch_id={batch}")
        with staged(drop_exact_duplicates(event_records(decoded)), "records") as records:
            store_records(records, f"{root}/events", batch, typed, tz, max_columns)
        if store is not None:
            store.upsert(profile_records(decoded), batch)


def read_rejects(spark, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/rejects")
