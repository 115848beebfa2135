"""Exact duplicates of records, and the registry of event names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.variant import once
from tidemark.sources.messages import text_map


def payload_hash(leaves: Column) -> Column:
    """Hash of the canonical record: its properties in key order with their kinds."""
    return F.sha2(F.to_json(F.array_sort(leaves)), 256)


def with_hash(records: DataFrame) -> DataFrame:
    return records.withColumn("payload_hash", payload_hash(F.col("leaves")))


def drop_exact_duplicates(records: DataFrame) -> DataFrame:
    """Keep the first arrival of each (event, canonical payload).

    An aggregate rather than a window: copies of a hot payload fold together before the
    shuffle, so no task receives them all.
    """
    first = F.min_by(
        F.struct("seq", "pos", "received_at", "leaves"), F.struct("received_at", "seq", "pos")
    )
    kept = with_hash(records).groupBy("event", "payload_hash").agg(first.alias("first"))
    return once(
        kept.select("event", "payload_hash", "first.*"), props=text_map(F.col("leaves"))
    )


def duplicate_rate(records: DataFrame) -> DataFrame:
    """Share of rows that are extra copies."""
    groups = with_hash(records).groupBy("event", "payload_hash").agg(
        F.count(F.lit(1)).alias("copies")
    )
    totals = groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra_copies"),
    )
    rate = F.try_divide(F.col("extra_copies").cast("double"), F.col("rows").cast("double"))
    return totals.withColumn("duplicate_rate", F.round(F.coalesce(rate, F.lit(0.0)), 6))


def event_registry(records: DataFrame) -> DataFrame:
    """Last receipt time per event name."""
    return records.groupBy("event").agg(F.max("received_at").alias("last_seen"))
