"""Registered queries for tables over their life: growth, late rows, deletion, migration.

The messages of the growth queries come in two batches, even event numbers first. They carry
names that clash: with a core column (``OS``), with each other (``Level``, ``level``), with
reserved ones (``seq``, ``ds_month``). ``shift`` is a number first and text later, every
five-thousandth message has 1,001 keys more, and ``later`` comes when the table is full.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import coerce
from tidemark.operators import ingest, migrate, profiles
from tidemark.operators.evolve import MAX_COLUMNS
from tidemark.session import scratch_dir
from tidemark.sources import messages as source
from tidemark.sources import tables
from tidemark.streaming import flush, live
from tidemark.workload.fixture import APP_ID, VIEW_SQL, event_view, table
from tidemark.workload.messages import MAX_BYTES, messages, received_at, with_copies
from tidemark.workload.pipelines import (
    MESSAGE_SQL,
    REASON_SQL,
    SPLIT,
    customer_records,
    table_rows,
)

WIDE = MAX_COLUMNS + 1
WIDE_JSON = f"""CASE WHEN event_id % 5000 = 0 THEN ARRAY_JOIN(TRANSFORM(SEQUENCE(0, {WIDE - 1}),
  n -> CONCAT(',"k', LPAD(CAST(n AS STRING), 4, '0'), '":', CAST(n AS STRING))), '') ELSE '' END"""
GROWTH_JSON = f"""CONCAT('[{{"event":"', event, '","distinct_id":"', distinct_id, '","time":', CAST(ms AS STRING),
  ',"properties":{{"OS":"A', CAST(event_id % 7 AS STRING), '","os":"b","Level":', CAST(event_id % 5 AS STRING),
  ',"level":"l","seq":"s', CAST(event_id AS STRING), '","ds_month":"m","shift":',
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS STRING) ELSE CONCAT('"t-', CAST(event_id AS STRING), '","later":true') END,
  {WIDE_JSON}, '}}}}]')"""


# The typed table of the growth query has room for fewer columns.
TYPED_COLUMNS = 100


def growth_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = event_view(spark, sf_dir).withColumn("ms", F.unix_millis("time"))
    return view.select(F.col("event_id").alias("seq"), received_at().alias("received_at"), F.expr(GROWTH_JSON).alias("data_list"), F.lit("").alias("data"))


def _listed(other: str) -> Column:
    entries = F.array_sort(F.map_entries(other))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def _grown(events: DataFrame) -> DataFrame:
    return events.select("seq", "event", "distinct_id", "os", F.unix_millis("time").alias("time_ms"), "Level", "shift", "k0000", "k0097", _listed("other").alias("other"))


def _batches(spark, sf_dir, typed: bool) -> DataFrame:
    root, sent = scratch_dir(spark, "growth"), growth_messages(spark, sf_dir)
    for n in (0, 1):
        limit = TYPED_COLUMNS if typed else MAX_COLUMNS
        ingest.ingest(sent.filter(F.col("seq") % 2 == n), root, f"batch-{n}", typed=typed, max_columns=limit)
    return tables.read_events(spark, f"{root}/events")


def growth_batch(spark, sf_dir):
    return _grown(_batches(spark, sf_dir, False))


def growth_typed(spark, sf_dir):
    events = _batches(spark, sf_dir, True)
    return _grown(events).join(events.select("seq", "unconverted"), "seq")


def growth_stream(spark, sf_dir):
    root, sent = scratch_dir(spark, "growth-stream"), growth_messages(spark, sf_dir)
    for n in (0, 1):
        sent.filter(F.col("seq") % 2 == n).write.mode("append").parquet(f"{root}/in")
        stream = flush.read_messages(spark, f"{root}/in")
        flush.start_event_flush(stream, f"{root}/out", f"{root}/checkpoint", every=None).awaitTermination()
    return _grown(flush.read_flushed(spark, f"{root}/out"))


def _growth_oracle(level: str, shift: str, k: str, typed: bool) -> str:
    failed = "CASE WHEN event_id % 2 = 1 THEN concat(';shift=t-', event_id) ELSE '' END" if typed else "''"
    return f"""WITH ev AS ({VIEW_SQL}) SELECT event_id AS seq, event, distinct_id, 'b' AS os, epoch_us(time) // 1000 {'// 1000 * 1000' if typed else ''} AS time_ms,
  {level} AS "Level", {shift} AS shift, {k.format(0)} AS k0000, {k.format(97)} AS k0097,
  concat('OS=A', event_id % 7, ';ds_month=m', CASE WHEN event_id % 5000 = 0 THEN (SELECT string_agg(concat(';k', lpad(CAST(n AS VARCHAR), 4, '0'), '=', n), '' ORDER BY n)
      FROM range({TYPED_COLUMNS - 2 if typed else MAX_COLUMNS - 2}, {WIDE}) t(n)) ELSE '' END,
    CASE WHEN event_id % 2 = 1 THEN ';later=true' ELSE '' END, ';level=l;seq=s', event_id, {failed}) AS other
  {', CAST(event_id % 2 AS INTEGER) AS unconverted' if typed else ''} FROM ev"""


TEXT_GROWTH = _growth_oracle(
    "CAST(event_id % 5 AS VARCHAR)", "CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE concat('t-', event_id) END",
    "CASE WHEN event_id % 5000 = 0 THEN '{0}' ELSE '' END", False,
)
TYPED_GROWTH = _growth_oracle(
    "event_id % 5", "CASE WHEN event_id % 2 = 0 THEN event_id END", "CASE WHEN event_id % 5000 = 0 THEN CAST({0} AS BIGINT) END", True,
)


# Late files: the later half of the messages arrives first.


def _late_half_last(df: DataFrame, column: str, path: str, run) -> None:
    early = F.col(column) < F.lit(SPLIT).cast("timestamp")
    for part in (df.filter(~early), df.filter(early)):
        part.write.mode("append").parquet(path)
        run().awaitTermination()


def stream_late(spark, sf_dir):
    root = scratch_dir(spark, "stream-late")

    def run():
        stream = flush.read_messages(spark, f"{root}/in")
        return flush.start_event_flush(stream, f"{root}/out", f"{root}/checkpoint", every=None, horizon="10 minutes", max_bytes=MAX_BYTES)

    _late_half_last(with_copies(messages(spark, sf_dir)), "received_at", f"{root}/in", run)
    events = flush.read_flushed(spark, f"{root}/out").select("event", "seq", "pos", "distinct_id", F.unix_millis("time").alias("time_ms"), "tags")
    refused = flush.read_rejects(spark, f"{root}/out")
    empty = F.lit(None).cast("string")
    return events.union(refused.select("reason", "seq", "pos", empty, F.lit(None).cast("bigint"), empty))


STREAM_LATE_ORACLE = f"""{MESSAGE_SQL}, u AS (SELECT *,
    event_id % 9 = 0 AND rms < epoch_ms(TIMESTAMP '{SPLIT}') AND rms + 1000 >= epoch_ms(TIMESTAMP '{SPLIT}') AS copied FROM ev),
  r AS (SELECT *, CASE WHEN copied THEN rms + 1000 ELSE rms END AS seen, event_id + CASE WHEN copied THEN 1000000000000 ELSE 0 END AS id FROM u)
SELECT event, id AS seq, 0 AS pos, distinct_id, CASE event_id % 5 WHEN 0 THEN ms // 1000 * 1000 WHEN 4 THEN seen ELSE ms END AS time_ms,
  concat('["t', event_id % 7, '",{{"a":1.5,"b":', event_id % 3, '}},100]') AS tags
FROM r WHERE shape IN (3, 4, 5) OR shape >= 7
UNION ALL SELECT 'heartbeat', id, 1, distinct_id, ms, '' FROM r WHERE shape = 5
UNION ALL SELECT {REASON_SQL}, event_id + extra, 0, NULL, NULL, NULL FROM ev, (VALUES (0), (1000000000000)) v(extra)
  WHERE shape = 6 AND (event_id // 16) % 8 <> 6 AND (extra = 0 OR event_id % 9 = 0)"""


def stream_hourly_late(spark, sf_dir):
    root = scratch_dir(spark, "stream-hourly-late")
    events = event_view(spark, sf_dir).select("time", "event")

    def run():
        incoming = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        return flush.start_live_counts(incoming, f"{root}/out", f"{root}/checkpoint", every=None)

    _late_half_last(events, "time", f"{root}/in", run)
    return flush.read_live_counts(spark, f"{root}/out").withColumn("window_start", F.unix_seconds("window_start"))


# Live measures: the later half of the events arrives first here too.


def _live(spark, sf_dir, label: str, columns: list[str], start) -> str:
    root = scratch_dir(spark, label)
    events = event_view(spark, sf_dir).filter(F.col("app_id") == APP_ID).select("time", *columns)

    def run():
        incoming = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        return start(incoming, f"{root}/out", f"{root}/checkpoint")

    _late_half_last(events, "time", f"{root}/in", run)
    return f"{root}/out"


def stream_daily_active(spark, sf_dir):
    path = _live(spark, sf_dir, "live-users", ["distinct_id"], lambda e, out, at: live.start_live_users(e, out, at, every=None))
    users = live.read_live_users(spark, path)
    return users.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "users")


def stream_weekly_active(spark, sf_dir):
    """Weeks united from days, then all days in one."""
    path = _live(spark, sf_dir, "live-weeks", ["distinct_id"], lambda e, out, at: live.start_live_users(e, out, at, every=None))
    weeks = live.read_live_users(spark, path, by=F.date_format(F.date_trunc("week", "window_start"), "yyyy-MM-dd"))
    return weeks.union(live.read_live_users(spark, path, by=F.lit("all")))


def _live_lists(spark, sf_dir) -> str:
    columns = ["event", "country", "app_version"]
    return _live(spark, sf_dir, "live-top", columns, lambda e, out, at: live.start_live_top(e, out, at, columns, width="1 day", every=None))


def stream_top_events(spark, sf_dir):
    return live.read_live_top(spark, _live_lists(spark, sf_dir), "event", 25)


def stream_app_versions(spark, sf_dir):
    start, end = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25)
    return live.read_live_top(spark, _live_lists(spark, sf_dir), "app_version", 20, start, end)


def stream_share_country(spark, sf_dir):
    return live.read_live_share(spark, _live_lists(spark, sf_dir), "country")


def stream_delay_quantiles(spark, sf_dir):
    """Of all hours, and of a range of hours."""
    path = _live(spark, sf_dir, "live-delays", ["delay_s"], lambda e, out, at: live.start_live_values(e, out, at, "delay_s", every=None))
    wanted = [0.5, 0.95, 0.99]
    spans = {"all": (None, None), "days": (dt.datetime(2024, 1, 5, 3), dt.datetime(2024, 1, 9, 17))}
    rows = [live.read_live_quantiles(spark, path, wanted, *span).select(F.lit(name).alias("hours"), "*") for name, span in spans.items()]
    both = rows[0].union(rows[1])
    return both.select("hours", "rows", F.col("low").alias("min_s"), F.col("high").alias("max_s"), *[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


# Profiles: seeded by a batch, then two streams, the second with a checkpoint of its own.

LEVELS = ["name", "level", "phone", "segment"]


def user_table(spark, sf_dir):
    root = scratch_dir(spark, "users")
    store = profiles.ProfileStore(spark, f"{root}/store", buckets=8)
    store.upsert(customer_records(spark, sf_dir), "seed-0")
    sent = messages(spark, sf_dir)
    early = F.col("received_at") < F.lit(SPLIT).cast("timestamp")
    for n, part in enumerate((sent.filter(early), sent.filter(~early))):
        part.write.mode("append").parquet(f"{root}/in")
        stream = flush.read_messages(spark, f"{root}/in")
        flush.start_profile_flush(stream, store, f"{root}/checkpoint-{n}", every=None).awaitTermination()
    gone = table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("distinct_id"))
    store.delete(gone, "delete-0")
    store.compact()
    store.write_user_table(f"{root}/user")
    users = spark.read.parquet(f"{root}/user")
    return users.select(
        "distinct_id", F.col("ds").cast("string").alias("ds"), "name", "level", "phone", "segment", "email",
        F.unix_seconds("first_visit_time").alias("first_visit_s"), "bad_visit_times", F.size("other").alias("others"),
    )


USER_TABLE_ORACLE = f"""{MESSAGE_SQL}, p AS (SELECT *, epoch_us(time) + delay_s * 1000000 AS seen FROM ev WHERE shape < 3),
  o AS (SELECT *, CAST(seen AS HUGEINT) * 10000000 + event_id AS ord, shape < 2 AS merges FROM p),
  m AS (SELECT distinct_id, arg_max(concat('name-', event_id), ord) FILTER (WHERE merges) AS name,
    arg_max(CAST(event_id % 5 AS VARCHAR), ord) FILTER (WHERE merges) AS level, arg_max(concat('p-', event_id), ord) FILTER (WHERE shape = 1) AS phone,
    arg_max(ms, ord) FILTER (WHERE merges) AS ms, max(seen) // 1000000 AS received_s, count(*) FILTER (WHERE merges) AS merged FROM o GROUP BY distinct_id),
  c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_mktsegment FROM customer),
  u AS (SELECT coalesce(id, distinct_id) AS distinct_id, coalesce(name, c_name) AS name, coalesce(level, CASE WHEN id IS NULL THEN '' ELSE 'new' END) AS level,
    coalesce(phone, '') AS phone, coalesce(c_mktsegment, '') AS segment, ms, coalesce(received_s, epoch(TIMESTAMP '1994-01-01')::BIGINT) AS received_s
    FROM c FULL JOIN m ON id = distinct_id WHERE id IS NOT NULL OR merged > 0)
SELECT distinct_id, strftime(make_timestamp(coalesce(ms * 1000, received_s * 1000000)), '%Y-%m-%d') AS ds, name, level, phone, segment, '' AS email,
  received_s AS first_visit_s, 0 AS bad_visit_times, 0 AS others
FROM u WHERE NOT (CAST(distinct_id AS BIGINT) % 7 = 0 AND distinct_id IN (SELECT id FROM c))"""


# Deletion, retention and compaction of flushed tables.


def _flushed(spark: SparkSession, sf_dir: str, root: str, rows: DataFrame) -> str:
    """The rows as a stream would leave them, in eight batches."""
    for n in range(8):
        tables.append_batch(rows.filter(F.col("event_id") % 8 == n), f"{root}/events", f"w-{n}")
    return f"{root}/events"


def delete_stored(spark, sf_dir):
    path = _flushed(spark, sf_dir, scratch_dir(spark, "delete"), table_rows(spark, sf_dir))
    ids, _ = profiles.split_delete_ids(
        event_view(spark, sf_dir).select(F.expr("CASE WHEN CAST(distinct_id AS BIGINT) % 3 = 0 THEN distinct_id ELSE CONCAT(distinct_id, ' x') END").alias("distinct_id"))
    )
    tables.delete_from_events(spark, path, ids)
    return tables.read_events(spark, path).select("event_id", "event", "distinct_id", F.unix_millis("time").alias("time_ms"))


def retention_streamed(spark, sf_dir):
    age = F.make_dt_interval((F.col("event_id") % 800).cast("int"))
    aged = table_rows(spark, sf_dir).withColumn("time", F.col("time") - age).withColumn("ds", F.to_date("time"))
    path = _flushed(spark, sf_dir, scratch_dir(spark, "retention-stream"), aged)
    tables.apply_retention(spark, path, dt.datetime(2024, 1, 31))
    return tables.read_events(spark, path).groupBy("ds_month").agg(F.count(F.lit(1)).alias("events"), F.min(F.unix_millis("time")).alias("first_ms"))


def compacted(spark, sf_dir):
    path = _flushed(spark, sf_dir, scratch_dir(spark, "compact"), table_rows(spark, sf_dir))
    tables.compact(spark, path)
    merged = F.col("batch_id").startswith("merged")
    return tables.read_events(spark, path).groupBy(merged.alias("merged")).agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("total"))


def migrate_user(spark, sf_dir):
    root = scratch_dir(spark, "migrate-user")
    legacy = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("distinct_id"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")), "yyyy-MM-dd").alias("ds"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
    )
    migrate.migrate(spark, legacy, root, 1, "user")
    migrate.swap(spark, root, 1)
    users = migrate.current(spark, root)
    return users.select("distinct_id", F.col("ds").cast("string").alias("ds"), F.lit(users.schema["ds"].dataType.simpleString()).alias("ds_type"), "name", "segment")


def safe_text(spark, sf_dir):
    """Top-level members of each payload as text; null where absent or null."""
    sent = messages(spark, sf_dir).select("seq", F.try_parse_json(source.pick_payload(F.col("data_list"), F.col("data"))).alias("body"))
    keys = {"type": "type", "event": "event", "distinct_id": "user", "time": "time", "lib": "lib", "none": "none"}
    return sent.select("seq", *[source.get_text(F.col("body"), key).alias(name) for key, name in keys.items()])


def zone_times(spark, sf_dir):
    """Local times as text, read in a zone of their own."""
    view = event_view(spark, sf_dir).withColumn("local", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    parsed = coerce.zone_time(F.col("local"), "yyyy-MM-dd HH:mm:ss", "Asia/Shanghai")
    return view.select("event_id", F.unix_seconds(parsed).alias("seconds"))


QUERIES = {
    "zone_times": zone_times,
    "growth_batch": growth_batch,
    "growth_typed": growth_typed,
    "growth_stream": growth_stream,
    "stream_late": stream_late,
    "stream_hourly_late": stream_hourly_late,
    "stream_daily_active": stream_daily_active,
    "stream_weekly_active": stream_weekly_active,
    "stream_top_events": stream_top_events,
    "stream_app_versions": stream_app_versions,
    "stream_share_country": stream_share_country,
    "stream_delay_quantiles": stream_delay_quantiles,
    "user_table": user_table,
    "delete_stored": delete_stored,
    "retention_streamed": retention_streamed,
    "compacted": compacted,
    "migrate_user": migrate_user,
    "safe_text": safe_text,
}

_APP = f"WITH ev AS (SELECT * FROM ({VIEW_SQL}) WHERE app_id = '{APP_ID}')"
_DELAYS = """count(*) AS rows, min(delay_s) AS min_s, max(delay_s) AS max_s, round(quantile_cont(delay_s, 0.5), 6) AS p50,
  round(quantile_cont(delay_s, 0.95), 6) AS p95, round(quantile_cont(delay_s, 0.99), 6) AS p99 FROM ev"""

ORACLES = {
    "stream_daily_active": f"{_APP} SELECT strftime(time, '%Y-%m-%d') AS day, count(DISTINCT distinct_id) AS users FROM ev GROUP BY 1",
    "stream_weekly_active": f"""{_APP} SELECT strftime(date_trunc('week', time), '%Y-%m-%d') AS period, count(DISTINCT distinct_id) AS users
      FROM ev GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT distinct_id) FROM ev""",
    "stream_top_events": f"{_APP} SELECT event, count(*) AS events FROM ev GROUP BY event ORDER BY events DESC, event LIMIT 25",
    "stream_app_versions": f"""{_APP} SELECT app_version, count(*) AS events FROM ev
      WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-25' GROUP BY 1 ORDER BY events DESC, app_version LIMIT 20""",
    "stream_share_country": f"""{_APP}, top AS (SELECT country, count(*) AS events FROM ev GROUP BY 1 ORDER BY events DESC, country LIMIT 10)
      SELECT country, events, round(CAST(events AS DOUBLE) * 100 / CAST(sum(events) OVER () AS DOUBLE), 6) AS percent FROM top""",
    "stream_delay_quantiles": f"""{_APP} SELECT 'all' AS hours, {_DELAYS} UNION ALL SELECT 'days', {_DELAYS}
      WHERE time >= TIMESTAMP '2024-01-05 03:00:00' AND time < TIMESTAMP '2024-01-09 17:00:00'""",
    "zone_times": "SELECT event_id, epoch_us(ts) // 1000000 - 28800 AS seconds FROM events",
    "growth_batch": TEXT_GROWTH,
    "growth_typed": TYPED_GROWTH,
    "growth_stream": TEXT_GROWTH,
    "stream_late": STREAM_LATE_ORACLE,
    "stream_hourly_late": f"""WITH ev AS ({VIEW_SQL}) SELECT epoch_us(time) // 3600000000 * 3600 AS window_start, event,
      count(*) AS events FROM ev GROUP BY 1, 2""",
    "user_table": USER_TABLE_ORACLE,
    "delete_stored": f"""WITH ev AS ({VIEW_SQL}) SELECT event_id, event, distinct_id, epoch_us(time) // 1000 AS time_ms
      FROM ev WHERE CAST(distinct_id AS BIGINT) % 3 <> 0""",
    "retention_streamed": """WITH e AS (SELECT ts - INTERVAL 1 DAY * (event_id % 800) AS time FROM events)
    SELECT CAST(year(time) * 100 + month(time) AS INTEGER) AS ds_month, count(*) AS events,
      min(epoch_us(time) // 1000) AS first_ms FROM e WHERE time >= TIMESTAMP '2023-01-31' GROUP BY 1""",
    "compacted": """SELECT event_id % 8 < 7 AS merged, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1""",
    "migrate_user": """SELECT CAST(c_custkey AS VARCHAR) AS distinct_id, CAST(DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) AS VARCHAR) AS ds,
      'date' AS ds_type, c_name AS name, c_mktsegment AS segment FROM customer""",
    "safe_text": f"""{MESSAGE_SQL}, s AS (SELECT *, shape < 4 OR (shape = 6 AND (event_id // 16) % 8 = 5) AS object FROM ev)
      SELECT event_id AS seq,
        CASE WHEN shape IN (3, 6) AND object THEN 'track' WHEN object THEN ['profile_set', 'track_signup', 'profile_increment'][shape + 1] END AS type,
        CASE WHEN shape = 3 THEN event WHEN object AND shape = 6 THEN '7' END AS event,
        CASE WHEN shape < 4 THEN distinct_id END AS user,
        CASE WHEN shape < 3 THEN CAST(ms AS VARCHAR) WHEN shape = 3 THEN CASE event_id % 5 WHEN 0 THEN CAST(ms // 1000 AS VARCHAR)
          WHEN 1 THEN concat(' ', ms, ' ') WHEN 4 THEN 'n/a' ELSE CAST(ms AS VARCHAR) END END AS time,
        CASE WHEN shape = 3 THEN concat('{{"$lib":"js","$lib_method":"code","$lib_version":"1.', event_id % 3, '"}}') END AS lib,
        NULL AS none FROM s""",
}
