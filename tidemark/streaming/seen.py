"""Copies of records across flushes, found by keyed state.

Digests of records are dealt to buckets. A bucket's state is a list with one entry for each flush
that brought it new records: their digests and receipt times. A flush reads the entries that are
still remembered and appends one of its own, so what it reads follows the memory span and what it
writes follows the flush, however long the day is; entries go by themselves when the span is
over. Rows have no watermark to be late for, so none is ever dropped for being late.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.dedup import payload_hash

#: Groups that state is dealt to; a stream keeps the number it started with.
BUCKETS = 256

#: What a query with this state runs with. State goes by the clock, for which Spark would start
#: batch after batch without data; expired entries wait for the next batch with data instead.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

_LEAVES = "array<struct<key:string,kind:string,text:string>>"
_ROW = "seq bigint, pos int, received_us bigint, route string, event string, method string, reason string, body string"
_KEYED = f"bucket int, digest binary, {_ROW}"
_ENTRY = "low bigint, high bigint, digests binary"
_DIGEST = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("at", "<i8")])
_FIRST = ["digest", "received_us", "seq", "pos"]


def _micros(spark: SparkSession, interval: str) -> int:
    span = F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {interval}")
    return spark.range(1).select(F.unix_micros(span)).first()[0]


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the copies in one Arrow batch the first arrival; rows without a digest all stay.

    Runs before the shuffle, so a payload that makes up much of a flush is folded by then.
    """
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch, [(name, "ascending") for name in _FIRST]))
        digest = batch.column("digest")
        new = np.ones(len(batch), bool)
        new[1:] = pc.fill_null(pc.not_equal(digest[1:], digest[:-1]), True).to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(new))


def keyed_rows(decoded: DataFrame, buckets: int) -> DataFrame:
    """Events, profiles and refusals of a decoded stream: bucket, digest (of events alone), record."""
    event = F.col("route") == "event"
    whole = F.sha2(F.concat_ws("\0", "event", payload_hash(F.col("leaves"))), 256)
    digest = F.when(event, F.substring(F.unhex(whole), 1, 16))
    rows = decoded.filter(F.col("route").isin("event", "profile", "reject")).select(
        digest.alias("digest"),
        "seq",
        F.col("pos").cast("int").alias("pos"),
        F.unix_micros("received_at").alias("received_us"),
        "route",
        "event",
        "method",
        "reason",
        F.when(F.col("route") != "reject", F.to_json("leaves")).alias("body"),
    )
    bucket = F.pmod(F.xxhash64(F.coalesce("digest", F.col("seq").cast("string").cast("binary"))), F.lit(buckets)).cast("int")
    return rows.select(bucket.alias("bucket"), *rows.columns).mapInArrow(_firsts, _KEYED)


class SeenDigests(StatefulProcessor):
    """Passes a bucket's records on without copies of remembered ones."""

    def __init__(self, horizon_us: int, remember_ms: int) -> None:
        self.horizon_us, self.remember_ms = horizon_us, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", _ENTRY, self.remember_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            others = frame["digest"].isna()
            if others.any():
                yield frame.loc[others, list(self._columns())]
            frame = pd.concat([x for x in (first, frame[~others]) if x is not None])
            first = frame.sort_values(_FIRST).drop_duplicates("digest")
        if first is None or not len(first):
            return
        halves = np.frombuffer(b"".join(map(bytes, first["digest"])), "<u8").reshape(-1, 2)
        own = np.zeros(len(first), _DIGEST)
        own["hi"], own["lo"], own["at"] = halves[:, 0], halves[:, 1], first["received_us"].to_numpy()
        kept = ~self._copies(own)
        if kept.any():
            at = own["at"][kept]
            self.seen.appendValue((int(at.min()), int(at.max()), own[kept].tobytes()))
            yield first.loc[kept, list(self._columns())]

    @staticmethod
    def _columns() -> Iterator[str]:
        return (column.split(" ")[0] for column in _ROW.split(", "))

    def _copies(self, own: np.ndarray) -> np.ndarray:
        """Which of the records have a remembered copy within the horizon, before or after."""
        place = {(hi, lo): i for i, (hi, lo) in enumerate(zip(own["hi"].tolist(), own["lo"].tolist(), strict=True))}
        low, high = int(own["at"].min()) - self.horizon_us, int(own["at"].max()) + self.horizon_us
        out = np.zeros(len(own), bool)
        for entry_low, entry_high, digests in self.seen.get():
            if entry_high < low or entry_low > high:
                continue
            entry = np.frombuffer(digests, _DIGEST)
            for hi, lo, at in entry[np.isin(entry["hi"], own["hi"])].tolist():
                i = place.get((hi, lo))
                if i is not None and abs(at - int(own["at"][i])) <= self.horizon_us:
                    out[i] = True
        return out

    def close(self) -> None:
        pass


def without_seen(decoded: DataFrame, horizon: str, remember: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A decoded stream's events, free of copies, and its profiles and refusals as they are.

    Of copies in one flush the first arrival stays. It goes too if a copy that was kept earlier
    is still remembered and was received within the horizon, before or after. ``remember`` is
    the time by the stream's clock for which a kept record is remembered, the horizon unless
    given: a copy that is read later than that is kept. ``body`` holds the properties.
    """
    spark = decoded.sparkSession
    keep_ms = max(1, _micros(spark, remember or horizon) // 1000)
    processor = SeenDigests(_micros(spark, horizon), keep_ms)
    grouped = keyed_rows(decoded, buckets).groupBy("bucket")
    return grouped.transformWithStateInPandas(processor, _ROW, "Append", "ProcessingTime")


def unpacked(rows: DataFrame) -> DataFrame:
    """``without_seen`` rows in the form of decoded ones."""
    at = F.timestamp_micros("received_us").alias("received_at")
    return rows.select("seq", "pos", at, "route", "event", "method", "reason", F.from_json("body", _LEAVES).alias("leaves"))
