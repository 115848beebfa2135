"""Streaming jobs: event flush, profile flush, live counts.

Input streams carry raw messages as ``tidemark.sources.messages`` describes them. Every sink
writes one folder per stream and batch id in overwrite mode, so a batch that is replayed after
a failure replaces its own output.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.dedup import drop_exact_duplicates
from tidemark.operators.evolve import MAX_COLUMNS
from tidemark.operators.ingest import store_records
from tidemark.operators.profiles import ProfileStore
from tidemark.session import configure, staged
from tidemark.sources.messages import (
    MAX_PAYLOAD_BYTES,
    decode,
    event_records,
    profile_records,
    rejects,
)
from tidemark.sources.tables import read_events
from tidemark.streaming.seen import STATE_SETTINGS, unpacked, without_seen

MESSAGE_SCHEMA = "seq BIGINT, received_at TIMESTAMP, data_list STRING, data STRING"

# How often events and profiles are flushed.
EVENT_FLUSH = "6 seconds"
PROFILE_FLUSH = "5 seconds"

# A message may have megabytes. The columnar reader would hold thousands of them in each task;
# by rows they come one at a time.
BY_ROWS = "spark.sql.parquet.enableVectorizedReader"


def read_messages(
    spark: SparkSession, path: str, files_per_batch: int = 1000, file_format: str = "parquet"
) -> DataFrame:
    """A stream over a folder that receives message files.

    Files are read under the settings of the session that opens the stream, so it is one of the
    stream's own, with the given session's settings.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    configure(own).conf.set(BY_ROWS, "false")
    return (
        own.readStream.format(file_format)
        .schema(MESSAGE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def writer_name(spark: SparkSession, checkpoint: str) -> str:
    """A name for the stream that owns the checkpoint; a new checkpoint gets a new one.

    Batch numbers start again with a new checkpoint, so folders carry this name as well.
    """
    path = f"{checkpoint.rstrip('/')}_writer"
    try:
        return spark.read.schema("name STRING").json(path).first()["name"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    name = uuid.uuid4().hex
    spark.createDataFrame([(name,)], "name STRING").coalesce(1).write.json(path)
    return name


def start_stream(
    stream: DataFrame, flush, query_name: str, checkpoint: str, every: str | None, settings: dict[str, str] | None = None
) -> StreamingQuery:
    """Run continuously every so often, or once over what is there when ``every`` is None.

    ``settings`` hold for this query alone, which takes its own copy of the session at its start.
    """
    writer = stream.writeStream.foreachBatch(flush).queryName(query_name).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    conf = stream.sparkSession.conf
    before = {key: conf.get(key, None) for key in settings or {}}
    try:
        for key, value in (settings or {}).items():
            conf.set(key, value)
        return writer.trigger(**trigger).start()
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def start_event_flush(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = EVENT_FLUSH,
    horizon: str | None = None,
    max_bytes: int = MAX_PAYLOAD_BYTES,
    tz: str = "UTC",
    name: str = "event_flush",
    typed: bool = False,
    max_columns: int = MAX_COLUMNS,
    remember: str | None = None,
    profiles: ProfileStore | None = None,
) -> StreamingQuery:
    """Decode, drop duplicates, add new columns, store events and refusals.

    Without a horizon, duplicates are dropped among the messages of one flush, and a repeat
    after the flush is stored again. With one, copies of what was stored within it are dropped
    as well, by keyed state (``seen.without_seen``, which explains ``remember``). Of copies in
    one flush the first arrival stays. No message is dropped for being late, and event times are
    kept however late it is.

    Given a profile store, profile messages go into it in the same flush, so one stream with one
    decode serves all three; a flush that is repeated replaces its events and refusals, and the
    store passes it over.
    """
    writer = writer_name(messages.sparkSession, checkpoint)

    def store(decoded: DataFrame, records: DataFrame, key: str) -> None:
        rejects(decoded).write.mode("overwrite").parquet(f"{path}/rejects/batch_id={key}")
        store_records(records, f"{path}/events", key, typed, tz, max_columns)
        if profiles is not None:
            profiles.upsert(profile_records(decoded), key)

    def flush(batch: DataFrame, batch_id: int) -> None:
        with staged(decode(batch, max_bytes), "decoded") as decoded:
            with staged(drop_exact_duplicates(event_records(decoded)), "records") as records:
                store(decoded, records, f"{writer}-{batch_id}")

    def flush_unseen(batch: DataFrame, batch_id: int) -> None:
        # One action on the stateful plan; everything else reads what it wrote, the records too.
        with staged(unpacked(batch), "unseen") as fresh:
            store(fresh, event_records(fresh), f"{writer}-{batch_id}")

    if horizon is None:
        return start_stream(messages, flush, name, checkpoint, every)
    fresh = without_seen(decode(messages, max_bytes), horizon, remember)
    return start_stream(fresh, flush_unseen, name, checkpoint, every, STATE_SETTINGS)


def read_flushed(spark: SparkSession, path: str) -> DataFrame:
    """All flushed events, with the columns of all batches."""
    return read_events(spark, f"{path}/events")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rejects")


def start_profile_flush(
    messages: DataFrame,
    store: ProfileStore,
    checkpoint: str,
    every: str | None = PROFILE_FLUSH,
    name: str = "profile_flush",
) -> StreamingQuery:
    """Append each batch of profile messages to the store."""
    writer = writer_name(messages.sparkSession, checkpoint)

    def flush(batch: DataFrame, batch_id: int) -> None:
        store.upsert(profile_records(decode(batch, only="profile")), f"{writer}-{batch_id}")

    return start_stream(messages, flush, name, checkpoint, every)


def window_counts(events: DataFrame, width: str) -> DataFrame:
    """Rows per tumbling window and event."""
    return (
        events.groupBy(F.window("time", width).alias("w"), "event")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("window_start"), "event", "events")
    )


def start_live_counts(
    events: DataFrame,
    path: str,
    checkpoint: str,
    width: str = "1 hour",
    every: str | None = EVENT_FLUSH,
    name: str = "live_counts",
) -> StreamingQuery:
    """Write each batch's share of the window counts; ``read_live_counts`` adds them up.

    No state is kept and no watermark drops rows, so a row counts however late it is.
    """
    writer = writer_name(events.sparkSession, checkpoint)

    def flush(batch: DataFrame, batch_id: int) -> None:
        window_counts(batch, width).write.mode("overwrite").parquet(f"{path}/batch_id={writer}-{batch_id}")

    return start_stream(events, flush, name, checkpoint, every)


def read_live_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("window_start", "event").agg(F.sum("events").alias("events"))
