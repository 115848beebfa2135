"""Measures kept up to date by streams: distinct users, top lists and shares, delay quantiles.

Every flush writes its own share of a measure under its batch key, and readers merge the shares of
the windows they ask for. Distinct users merge as bitmaps, top lists as lists of candidates with a
bound on what was left out, quantiles as counts by value range; all answers are exact. No
watermark drops rows, so late files only add to their own windows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.plans.quality import count_quantiles
from tidemark.session import staged
from tidemark.streaming.flush import EVENT_FLUSH, start_stream, writer_name
from tidemark.streaming.seen import STATE_SETTINGS


def _window(width: str) -> Column:
    return F.window("time", width)["start"].alias("window_start")


def _shares(spark: SparkSession, path: str, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    """Stored shares of the windows from start up to, not including, end."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.filter(F.col("window_start") >= F.lit(start))
    return rows if end is None else rows.filter(F.col("window_start") < F.lit(end))


def _write(rows: DataFrame, path: str, key: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={key}")


# Distinct users: ids get lasting numbers, windows hold bitmaps of numbers.

#: Groups that the numbering is dealt to; a stream keeps the number it started with.
ID_BUCKETS = 64
_NUMBERED = "window_start timestamp, number bigint"


class Numbers(StatefulProcessor):
    """Numbers a bucket's ids in the order they come, for good: number * buckets + bucket + 1."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "id string", "number bigint")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found: dict[str, int] = {}
        stored = self.count.get()
        count = before = stored[0] if stored is not None else 0
        for frame in rows:
            for user in frame["distinct_id"].unique():
                if user in found:
                    continue
                old = self.known.getValue((user,))
                if old is None:
                    self.known.updateValue((user,), (count,))
                    found[user], count = count, count + 1
                else:
                    found[user] = old[0]
            numbers = frame["distinct_id"].map(found) * self.buckets + key[0] + 1
            yield pd.DataFrame({"window_start": frame["window_start"], "number": numbers})
        if count > before:
            self.count.update((count,))

    def close(self) -> None:
        pass


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of an Arrow batch folded before the shuffle."""
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).select(batch.schema.names).to_batches()


def start_live_users(
    events: DataFrame,
    path: str,
    checkpoint: str,
    width: str = "1 day",
    every: str | None = EVENT_FLUSH,
    name: str = "live_users",
    buckets: int = ID_BUCKETS,
) -> StreamingQuery:
    """Keep bitmaps of the users of each window; ``events`` has ``time`` and ``distinct_id``.

    Bitmaps need small whole numbers. Keyed state gives each id one at its first sight, so a
    flush looks up its own ids and not the dictionary. Null ids are not counted.
    """
    writer = writer_name(events.sparkSession, checkpoint)
    rows = events.filter("distinct_id IS NOT NULL").select(
        F.pmod(F.xxhash64("distinct_id"), F.lit(buckets)).cast("int").alias("bucket"), _window(width), "distinct_id"
    )
    rows = rows.mapInArrow(_once, "bucket int, window_start timestamp, distinct_id string")
    numbered = rows.groupBy("bucket").transformWithStateInPandas(Numbers(buckets), _NUMBERED, "Append", "ProcessingTime")

    def flush(batch: DataFrame, batch_id: int) -> None:
        by = ["window_start", F.expr("bitmap_bucket_number(number)").alias("chunk")]
        maps = batch.groupBy(*by).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("users"))
        _write(maps, path, f"{writer}-{batch_id}")

    return start_stream(numbered, flush, name, checkpoint, every, STATE_SETTINGS)


def read_live_users(
    spark: SparkSession, path: str, start: dt.datetime | None = None, end: dt.datetime | None = None, by: Column | None = None
) -> DataFrame:
    """Distinct users per window, or per ``by``, a coarser grouping of ``window_start``.

    Users of several windows count once in a group that unites them; no event is read.
    """
    group = (F.col("window_start") if by is None else by).alias("window_start" if by is None else "period")
    united = _shares(spark, path, start, end).groupBy(group, "chunk").agg(F.expr("bitmap_or_agg(users)").alias("users"))
    name = "window_start" if by is None else "period"
    return united.groupBy(name).agg(F.sum(F.expr("bitmap_count(users)")).alias("users"))


# Top lists: full counts by value, and the head of each list with the count just below it.

#: Values that the head of a share keeps for each window and column.
HEAD = 100


def start_live_top(
    events: DataFrame,
    path: str,
    checkpoint: str,
    columns: Sequence[str],
    width: str = "1 hour",
    every: str | None = EVENT_FLUSH,
    name: str = "live_top",
    head: int = HEAD,
) -> StreamingQuery:
    """Keep counts of the columns' values by window, and the ``head`` largest of each share.

    ``events`` has ``time`` and the columns, which are counted as text. The first value below a
    head is kept with it: its count bounds that of every value the head leaves out.
    """
    writer = writer_name(events.sparkSession, checkpoint)

    def flush(batch: DataFrame, batch_id: int) -> None:
        key = f"{writer}-{batch_id}"
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        values = batch.select(_window(width), F.explode(pairs).alias("p")).select("window_start", "p.*")
        counts = values.groupBy("window_start", "column", "value").agg(F.count(F.lit(1)).alias("events"))
        with staged(counts, "live-counts") as stored:
            _write(stored.sortWithinPartitions("column", "value"), f"{path}/counts", key)
            ranks = Window.partitionBy("window_start", "column").orderBy(F.desc("events"), "value")
            ranked = stored.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= head + 1)
            below = F.coalesce(F.max(F.when(F.col("rank") == head + 1, F.col("events"))).over(ranks.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0))
            _write(ranked.withColumn("below", below).filter(F.col("rank") <= head), f"{path}/heads", key)

    return start_stream(events, flush, name, checkpoint, every)


def _candidates(heads: DataFrame, k: int) -> tuple[DataFrame | None, int]:
    """Values that may be among the k most frequent, None if the heads don't settle it.

    A value's count lies between the sum over the heads that hold it and that sum plus what the
    other heads may have left out. A value in no head has at most the sum of all ``below``.
    """
    lists = heads.groupBy("window_start", "batch_id").agg(F.max("below").alias("below"))
    hidden = lists.agg(F.coalesce(F.sum("below"), F.lit(0))).first()[0]
    sums = heads.groupBy("value").agg(F.sum("events").alias("least"), (F.sum("events") + hidden - F.sum("below")).alias("most"))
    least = sums.orderBy(F.desc("least")).limit(k).agg(F.count(F.lit(1)), F.min("least")).first()
    if hidden and (least[0] < k or hidden >= least[1]):
        return None, hidden
    return sums.filter(F.col("most") >= (least[1] or 0)).select("value"), hidden


def read_live_top(
    spark: SparkSession,
    path: str,
    column: str,
    k: int,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """The k most frequent values of a column with their exact counts, ties to the smaller value.

    The heads give candidates that provably hold the answer, and only these are counted again
    over all shares; if the heads cannot settle it, every value is.
    """
    wanted = F.col("column") == column
    candidates, _ = _candidates(_shares(spark, f"{path}/heads", start, end).filter(wanted), k)
    counts = _shares(spark, f"{path}/counts", start, end).filter(wanted)
    if candidates is not None:
        own = candidates.select(F.col("value").alias("candidate"))
        counts = counts.join(own, F.col("value").eqNullSafe(F.col("candidate")), "left_semi")
    totals = counts.groupBy("value").agg(F.sum("events").alias("events"))
    return totals.orderBy(F.desc("events"), F.asc("value")).limit(k).withColumnRenamed("value", column)


def read_live_share(spark: SparkSession, path: str, column: str, k: int = 10, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """The k most frequent values with each one's share of the slices shown."""
    slices = read_live_top(spark, path, column, k, start, end)
    return slices.selectExpr(f"`{column}`", "events", "round(cast(events AS DOUBLE) * 100 / cast(sum(events) OVER () AS DOUBLE), 6) AS percent")


# Quantiles: counts by value, and their sums by value range.


def value_range(v: Column) -> Column:
    """Number of the value's range: ranges grow with the value, by a 32nd of it at most."""
    size = F.when(v < 0, -v - 1).otherwise(v)
    shift = F.greatest(F.length(F.bin(size)) - 6, F.lit(0))
    place = shift * 32 + F.call_function("shiftright", size, shift)
    return F.when(v < 0, -place - 1).otherwise(place).cast("int")


def start_live_values(
    events: DataFrame,
    path: str,
    checkpoint: str,
    column: str,
    width: str = "1 hour",
    every: str | None = EVENT_FLUSH,
    name: str = "live_values",
) -> StreamingQuery:
    """Keep counts of a whole-number column by window and value, and sums by value range."""
    writer = writer_name(events.sparkSession, checkpoint)

    def flush(batch: DataFrame, batch_id: int) -> None:
        key = f"{writer}-{batch_id}"
        known = batch.filter(F.col(column).isNotNull()).select(_window(width), F.col(column).cast("bigint").alias("v"))
        counts = known.groupBy("window_start", "v").agg(F.count(F.lit(1)).alias("n"))
        with staged(counts.withColumn("range", value_range(F.col("v"))), "live-values") as stored:
            _write(stored.sortWithinPartitions("range", "v"), f"{path}/values", key)
            sums = stored.groupBy("window_start", "range").agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            _write(sums, f"{path}/ranges", key)

    return start_stream(events, flush, name, checkpoint, every)


def _hit_ranges(ranges: DataFrame, probabilities: Sequence[float]) -> list[int]:
    """Ranges that hold a wanted rank, two a probability at most."""
    order = Window.orderBy("range")  # a few thousand rows: 32 ranges for each power of two
    placed = ranges.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    ranks = [f(F.lit(float(p)) * (F.col("total") - 1).cast("double")) for p in probabilities for f in (F.floor, F.ceil)]
    holds = [(r >= F.col("upto") - F.col("n")) & (r < F.col("upto")) for r in ranks]
    anyone = holds[0]
    for other in holds[1:]:
        anyone |= other
    return [row["range"] for row in placed.filter(anyone).select("range").collect()]


def read_live_quantiles(
    spark: SparkSession,
    path: str,
    probabilities: Sequence[float],
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """One row ``rows, low, high, q0, q1, ...``: exact interpolated quantiles of the windows.

    The sums by range tell which ranges hold the wanted ranks. Only their values are read; every
    other range stands in as one value, which no wanted rank meets.
    """
    ranges = _shares(spark, f"{path}/ranges", start, end).groupBy("range").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    hit = _hit_ranges(ranges, probabilities)
    values = _shares(spark, f"{path}/values", start, end).filter(F.col("range").isin(hit))
    counts = values.groupBy("v").agg(F.sum("n").alias("n")).union(ranges.filter(~F.col("range").isin(hit)).select(F.col("low").alias("v"), "n"))
    whole = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    quantiles = count_quantiles(counts, probabilities).select(F.struct("*")).scalar()
    return whole.withColumn("q", quantiles).select("rows", "low", "high", "q.*")

