"""Registered queries for the pipelines: ingest, types, profiles, storage, streaming."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import dedup, evolve, migrate, profiles
from tidemark.operators.ingest import ingest_events, store_records
from tidemark.plans import quality
from tidemark.schema import EVENT_CORE
from tidemark.session import scratch_dir, stage, staged
from tidemark.sources import demo, tables
from tidemark.sources import messages as source
from tidemark.streaming import flush
from tidemark.workload import edges
from tidemark.workload.fixture import VIEW_SQL, event_view, table
from tidemark.workload.messages import FULL_BYTES, MAX_BYTES, messages, with_copies
from tidemark.workload.reports import legacy_table

# Expected values of the messages, straight from the table: ms and rms are the event's own
# and its receipt time, shape is the message shape.
MESSAGE_SQL = f"""WITH ev AS (SELECT *, epoch_us(time) // 1000 AS ms,
    (epoch_us(time) + delay_s * 1000000) // 1000 AS rms, event_id % 16 AS shape FROM ({VIEW_SQL})),
  main AS (SELECT * FROM ev WHERE shape IN (3, 4, 5) OR shape >= 7),
  beat AS (SELECT * FROM ev WHERE shape = 5)
"""


def decoded(spark: SparkSession, sf_dir: str, limit: int = MAX_BYTES) -> DataFrame:
    return source.decode(messages(spark, sf_dir, limit), limit)


def ingest_roundtrip(spark, sf_dir):
    rows = ingest_events(messages(spark, sf_dir, FULL_BYTES))
    return rows.select(
        "seq",
        "pos",
        F.unix_millis("time").alias("time_ms"),
        F.col("ds").cast("string").alias("ds"),
        "event", "distinct_id", "device_id", "os", "app_id", "app_version", "network_type",
        "lib", "lib_method", "lib_version", "anonymous_id", "screen_width", "screen_height",
        F.col("timezone_offset").cast("int").alias("timezone_offset"),
        "wifi",
        "is_first_day",
        F.col("_flush_time").cast("string").alias("flush_time"),
        "k", "value", "tags", "type",
        F.size(evolve.rejected_properties(F.col("props"))).alias("rejected_keys"),
    )


INGEST_ORACLE = f"""{MESSAGE_SQL}
SELECT event_id AS seq, 0 AS pos, t AS time_ms, strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS ds,
  event, distinct_id, device_id, os, app_id, app_version, network_type, 'js' AS lib, 'code' AS lib_method,
  concat('1.', event_id % 3) AS lib_version, '' AS anonymous_id,
  CASE WHEN screen_width_text IN ('', 'abc') THEN 0 ELSE CAST(screen_width_text AS INTEGER) END AS screen_width,
  CAST(CASE event_id % 4 WHEN 0 THEN 65535 WHEN 3 THEN event_id % 1000 ELSE 0 END AS INTEGER) AS screen_height,
  CAST(CASE event_id % 3 WHEN 0 THEN -480 WHEN 1 THEN 32767 ELSE 0 END AS INTEGER) AS timezone_offset,
  event_id % 6 < 3 AS wifi, event_id % 2 = 0 AS is_first_day,
  CASE event_id % 3 WHEN 0 THEN CAST(ms AS VARCHAR) WHEN 1 THEN '18446744073709551615' ELSE '0' END AS flush_time,
  json_extract_string(props, '$.k') AS k, regexp_replace(CAST(value AS VARCHAR), '[.]0$', '') AS value,
  concat('["t', event_id % 7, '",{{"a":1.5,"b":', event_id % 3, '}},100]') AS tags, 'track' AS type, 1 AS rejected_keys
FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN ms // 1000 * 1000 WHEN 4 THEN rms ELSE ms END AS t FROM main)
UNION ALL
SELECT event_id, 1, ms, strftime(make_timestamp(ms * 1000), '%Y-%m-%d'), 'heartbeat', distinct_id, '', '', '', '', '',
  '', '', '', '', 0, 0, 0, false, false, '0', '', '', '', '', 0 FROM beat"""


def dedup_exact(spark, sf_dir):
    sent = with_copies(messages(spark, sf_dir))
    records = source.event_records(source.decode(sent, MAX_BYTES))
    return dedup.drop_exact_duplicates(records).select("event", "seq", "pos")


def duplicate_rate(spark, sf_dir):
    sent = with_copies(messages(spark, sf_dir))
    return dedup.duplicate_rate(source.event_records(source.decode(sent, MAX_BYTES)))


def event_registry(spark, sf_dir):
    registry = dedup.event_registry(source.event_records(decoded(spark, sf_dir)))
    return registry.select("event", F.unix_micros("last_seen").alias("last_seen_us"))


def reject_windows(spark, sf_dir):
    windows = quality.reject_windows(source.rejects(decoded(spark, sf_dir)), "1 day")
    return windows.withColumn("window_start", F.unix_seconds("window_start"))


REASON_SQL = """CASE (event_id // 16) % 8 WHEN 0 THEN 'invalid_format' WHEN 1 THEN 'invalid_format'
  WHEN 2 THEN 'undecodable' WHEN 3 THEN 'payload_missing' WHEN 4 THEN 'payload_too_large'
  WHEN 5 THEN 'event_not_string' WHEN 7 THEN 'invalid_format' END"""


def evolve_schema_text(spark, sf_dir):
    return evolve.new_text_columns(source.event_records(decoded(spark, sf_dir)), EVENT_CORE)


def evolve_schema_typed(spark, sf_dir):
    return evolve.new_typed_columns(source.event_records(decoded(spark, sf_dir)), EVENT_CORE)


CORE_TEXT = [
    "distinct_id", "device_id", "os", "app_id", "app_version", "network_type", "lib", "lib_method",
    "lib_version", "anonymous_id",
]


def typed_sink(spark, sf_dir):
    """Core and extra columns of the typed table, as it is read back."""
    path = scratch_dir(spark, "typed-sink")
    with staged(source.event_records(decoded(spark, sf_dir)), "decoded") as records:
        store_records(records, path, "batch-0", typed=True)
    return tables.read_events(spark, path).select(
        "seq", "pos", "event", F.unix_millis("time").alias("time_ms"),
        F.col("ds").cast("string").alias("ds"), *CORE_TEXT, "screen_width", "screen_height",
        F.col("timezone_offset").cast("int").alias("timezone_offset"), "wifi", "is_first_day",
        F.col("_flush_time").cast("string").alias("flush_time"), "k", "value", "tags", "type",
        F.size("other").alias("others"), "unconverted",
    )


TYPED_SINK_ORACLE = f"""{MESSAGE_SQL}, r AS (SELECT *, CASE WHEN event_id % 5 IN (1, 4) THEN rms ELSE ms END // 1000 * 1000 AS t FROM main)
SELECT event_id AS seq, 0 AS pos, event, t AS time_ms, strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS ds,
  distinct_id, device_id, os, app_id, app_version, network_type, 'js' AS lib, 'code' AS lib_method,
  concat('1.', event_id % 3) AS lib_version, '' AS anonymous_id,
  CASE WHEN screen_width_text IN ('', 'abc') THEN 0 ELSE CAST(screen_width_text AS INTEGER) END AS screen_width,
  CAST(CASE event_id % 4 WHEN 0 THEN 65535 WHEN 3 THEN event_id % 1000 ELSE 0 END AS INTEGER) AS screen_height,
  CAST(CASE event_id % 3 WHEN 0 THEN -480 WHEN 1 THEN 32767 ELSE 0 END AS INTEGER) AS timezone_offset,
  event_id % 6 < 3 AS wifi, event_id % 2 = 0 AS is_first_day,
  CASE event_id % 3 WHEN 0 THEN CAST(ms AS VARCHAR) WHEN 1 THEN '18446744073709551615' ELSE '0' END AS flush_time,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value,
  concat('["t', event_id % 7, '",{{"a":1.5,"b":', event_id % 3, '}},100]') AS tags, 'track' AS type, 1 AS others, 0 AS unconverted FROM r
UNION ALL SELECT event_id, 1, 'heartbeat', ms // 1000 * 1000, strftime(make_timestamp(ms * 1000), '%Y-%m-%d'), distinct_id,
  '', '', '', '', '', '', '', '', '', 0, 0, 0, false, false, '0', NULL, NULL, NULL, NULL, 0, 0 FROM beat"""


def property_profile(spark, sf_dir):
    records = stage(source.event_records(decoded(spark, sf_dir)), "decoded")
    total = records.agg(F.count(F.lit(1))).scalar()
    return quality.property_profile(evolve.leaf_rows(records), total)


# Type of every property of every message, by key.
PROPERTY_TYPES = {
    "type": "'String'",
    "event": "'String'",
    "distinct_id": "'Int64'",
    "time": "CASE WHEN event_id % 5 IN (1, 4) THEN 'String' ELSE 'Int64' END",
    "_flush_time": "CASE event_id % 3 WHEN 1 THEN 'Float64' ELSE 'Int64' END",
    "lib": "'String'",
    "lib_method": "'String'",
    "lib_version": "'Float64'",
    "os": "'String'",
    "device_id": "'String'",
    "app_id": "'String'",
    "app_version": "'String'",
    "network_type": "'String'",
    "screen_width": "CASE WHEN screen_width_text IN ('', 'abc') THEN 'String' ELSE 'Int64' END",
    "screen_height": "CASE event_id % 4 WHEN 2 THEN 'Float64' ELSE 'Int64' END",
    "timezone_offset": "CASE event_id % 3 WHEN 2 THEN 'String' ELSE 'Int64' END",
    "wifi": "CASE event_id % 6 WHEN 0 THEN 'Bool' WHEN 4 THEN 'Bool' WHEN 2 THEN 'Int64' ELSE 'String' END",
    "is_first_day": "CASE event_id % 2 WHEN 0 THEN 'String' ELSE 'Int64' END",
    "value": "CASE WHEN value = floor(value) THEN 'Int64' ELSE 'Float64' END",
    "tags": "'String'",
    "bad-key!": "'Int64'",
    "k": "'Int64'",
}

PROPERTY_ORACLE = (
    MESSAGE_SQL
    + ", leaf AS ("
    + " UNION ALL ".join(f"SELECT '{key}' AS key, {t} AS t FROM main" for key, t in PROPERTY_TYPES.items())
    + """ UNION ALL SELECT 'event', 'String' FROM beat UNION ALL SELECT 'distinct_id', 'Int64' FROM beat
      UNION ALL SELECT 'time', 'Int64' FROM beat),
    n AS (SELECT (SELECT count(*) FROM main) + (SELECT count(*) FROM beat) AS total),
    c AS (SELECT key, count(*) AS present, count(*) FILTER (WHERE t = 'String') AS strings,
      count(*) FILTER (WHERE t = 'Bool') AS bools, count(*) FILTER (WHERE t = 'Int64') AS ints,
      count(*) FILTER (WHERE t = 'Float64') AS floats, count(*) FILTER (WHERE t = 'DateTime') AS times
      FROM leaf GROUP BY key)
    SELECT c.*, CASE WHEN strings > 0 THEN 'String' WHEN floats > 0 THEN 'Float64' WHEN ints > 0 THEN 'Int64'
      ELSE 'Bool' END AS type, round(CAST(present AS DOUBLE) * 100 / CAST(total AS DOUBLE), 6) AS present_percent
    FROM c, n"""
)

DEMO_ANCHOR = "2024-06-30 12:34:56.789"


def demo_source(spark, sf_dir):
    view = event_view(spark, sf_dir)
    numbers = view.select(F.col("event_id").alias("number"))
    rows = demo.seed_demo(view, numbers, F.lit(DEMO_ANCHOR).cast("timestamp"))
    return rows.withColumn("time_ms", F.unix_millis("time")).drop("time")


# The values that the demo source must have (fixed), once more for the check.
DEMO_ORACLE = f"""WITH n AS (SELECT event_id AS number FROM events),
  t AS (SELECT number, TIMESTAMP '{DEMO_ANCHOR}' - INTERVAL 1 HOUR * (number * 3) AS time FROM n)
SELECT number, CASE WHEN number % 12 < 5 THEN 'demo_app_open' WHEN number % 12 < 9 THEN 'demo_product_view'
    WHEN number % 12 < 11 THEN 'demo_add_to_cart' ELSE 'demo_purchase' END AS event,
  concat('demo-user-', number % 48 + 1) AS distinct_id, (['Android', 'iOS', 'Web'])[number % 3 + 1] AS os,
  (['wifi', '5G', '4G'])[number % 3 + 1] AS network_type, 'demo' AS app_id,
  (['1.0.0', '1.1.0', '2.0.0'])[number % 3 + 1] AS app_version, 'Demo' AS app_name,
  concat('demo-device-', number % 60 + 1) AS device_id,
  (['Organic', 'Search Ads', 'Social', 'Partner'])[number % 4 + 1] AS channel,
  (['CN', 'US', 'SG', 'DE'])[number % 4 + 1] AS country,
  (['Home', 'Pricing', 'Product', 'Checkout'])[number % 4 + 1] AS page_name,
  strftime(time, '%m-%d %H:00') AS demo_hour, strftime(time, '%Y-%m-%d') AS demo_day,
  CAST(CASE WHEN number % 12 = 11 THEN 49 + (number % 5) * 25 ELSE 0 END AS DOUBLE) AS revenue,
  number < 48 AS is_first_day, epoch_us(time) // 1000 AS time_ms FROM t"""


# Profiles: customers are the base, orders are updates.

ORDER_METHOD = """CASE o_orderkey % 3 WHEN 0 THEN 'profile_set' WHEN 1 THEN 'track_signup'
  ELSE 'profile_increment' END"""


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    always = F.create_map(
        F.lit("level"), "o_orderpriority",
        F.lit("status"), "o_orderstatus",
        F.lit("last_visit_time"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string"),
    )
    spend = F.create_map(F.lit("spend"), F.col("o_orderkey").cast("string"))
    return orders.select(
        F.col("o_custkey").cast("string").alias("distinct_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").cast("timestamp").alias("received_at"),
        F.expr(ORDER_METHOD).alias("method"),
        F.when(F.col("o_orderkey") % 2 == 0, F.map_concat(always, spend)).otherwise(always).alias("props"),
    )


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("distinct_id"),
        F.col("c_custkey").alias("seq"),
        F.lit("1994-01-01").cast("timestamp").alias("received_at"),
        F.lit("profile_set").alias("method"),
        F.create_map(
            F.lit("name"), "c_name", F.lit("level"), F.lit("new"), F.lit("segment"), "c_mktsegment"
        ).alias("props"),
    )


def props_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(
        "distinct_id",
        *[F.col("props")[name].alias(name) for name in names],
        F.unix_seconds("received_at").alias("received_s"),
    )


def configured(spark: SparkSession, sf_dir: str) -> None:
    event_view(spark, sf_dir)


def profile_merge(spark, sf_dir):
    configured(spark, sf_dir)
    changes = profiles.profile_changes(order_records(spark, sf_dir))
    return props_columns(changes, "level", "status", "spend", "last_visit_time")


LATEST_ORDER = "CAST(epoch(o_orderdate) AS BIGINT) * 10000000 + o_orderkey"

PROFILE_MERGE_ORACLE = f"""WITH o AS (SELECT *, {LATEST_ORDER} AS ord, o_orderkey % 3 <> 2 AS merges FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS distinct_id, arg_max(o_orderpriority, ord) FILTER (WHERE merges) AS level,
  arg_max(o_orderstatus, ord) FILTER (WHERE merges) AS status,
  arg_max(CAST(o_orderkey AS VARCHAR), ord) FILTER (WHERE merges AND o_orderkey % 2 = 0) AS spend,
  arg_max(CAST(epoch_us(o_orderdate) // 1000 AS VARCHAR), ord) FILTER (WHERE merges) AS last_visit_time,
  CAST(max(epoch(o_orderdate)) AS BIGINT) AS received_s FROM o GROUP BY o_custkey"""


def profile_upsert(spark, sf_dir):
    configured(spark, sf_dir)
    store = profiles.ProfileStore(spark, scratch_dir(spark, "profiles"), buckets=8)
    orders = order_records(spark, sf_dir)
    store.upsert(customer_records(spark, sf_dir), "seed-0")
    store.upsert(orders.filter(F.col("seq") % 2 == 1), "orders-1")
    store.upsert(orders.filter(F.col("seq") % 2 == 0), "orders-2")
    return props_columns(store.read(), "name", "segment", "level", "status", "spend")


PROFILE_UPSERT_ORACLE = f"""WITH o AS (SELECT *, o_orderkey % 3 <> 2 AS merges,
    CAST(2 - o_orderkey % 2 AS HUGEINT) * 1000000000000000000 + {LATEST_ORDER} AS ord FROM orders),
  u AS (SELECT o_custkey, arg_max(o_orderpriority, ord) FILTER (WHERE merges) AS level,
    arg_max(o_orderstatus, ord) FILTER (WHERE merges) AS status,
    arg_max(CAST(o_orderkey AS VARCHAR), ord) FILTER (WHERE merges AND o_orderkey % 2 = 0) AS spend,
    coalesce(CAST(max(epoch(o_orderdate)) FILTER (WHERE o_orderkey % 2 = 0) AS BIGINT),
      CAST(max(epoch(o_orderdate)) AS BIGINT)) AS received_s, count(*) FILTER (WHERE merges) AS merged
    FROM o GROUP BY o_custkey)
SELECT CAST(coalesce(c_custkey, o_custkey) AS VARCHAR) AS distinct_id, c_name AS name, c_mktsegment AS segment,
  coalesce(level, CASE WHEN c_custkey IS NOT NULL THEN 'new' END) AS level, status, spend,
  coalesce(received_s, CAST(epoch(TIMESTAMP '1994-01-01') AS BIGINT)) AS received_s
FROM customer FULL JOIN u ON c_custkey = o_custkey WHERE c_custkey IS NOT NULL OR merged > 0"""


def profile_delete(spark, sf_dir):
    configured(spark, sf_dir)
    customers = table(spark, sf_dir, "customer")
    users = migrate.typed_users(
        customers.select(
            F.col("c_custkey").cast("string").alias("distinct_id"),
            F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")), "yyyy-MM-dd").alias("ds"),
            F.col("c_name").alias("name"),
        )
    )
    ids = customers.select(F.expr("""CASE c_custkey % 7 WHEN 0 THEN CAST(c_custkey AS STRING)
      WHEN 1 THEN CONCAT(CAST(c_custkey AS STRING), ' x') WHEN 2 THEN '' WHEN 3 THEN REPEAT('9', 129)
      ELSE 'nobody@x.y' END""").alias("distinct_id"))
    left = profiles.delete_users(users, "user", ids)
    return left.withColumn("ds", F.col("ds").cast("string"))


def profile_refused(spark, sf_dir):
    configured(spark, sf_dir)
    ids = table(spark, sf_dir, "customer").select(F.expr("""CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS STRING)
      WHEN 1 THEN CONCAT(CAST(c_custkey AS STRING), ' x') WHEN 2 THEN REPEAT('9', 128)
      WHEN 3 THEN REPEAT('9', 129) ELSE '' END""").alias("distinct_id"))
    return profiles.split_delete_ids(ids)[1]


def profile_latest(spark, sf_dir):
    configured(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("distinct_id"),
        F.col("o_orderdate").cast("timestamp").alias("last_visit_time"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("status"),
    )
    newest = profiles.latest_versions(rows)
    return newest.withColumn("last_visit_s", F.unix_seconds("last_visit_time")).drop("last_visit_time")


# Storage.


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_view(spark, sf_dir).select(
        "event_id", "time", "ds", "event", "distinct_id", F.col("device_id").alias("user_id"), "os"
    )


def layout_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "layout")
    tables.write_events(table_rows(spark, sf_dir), path)
    events = tables.read_events(spark, path, dt.date(2024, 1, 5), dt.date(2024, 1, 20))
    return events.groupBy("ds_month", F.col("ds").cast("string").alias("ds")).agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("distinct_id").alias("users")
    )


def retention_1y(spark, sf_dir):
    path = scratch_dir(spark, "retention")
    age = F.make_dt_interval((F.col("event_id") % 800).cast("int"))
    aged = table_rows(spark, sf_dir).withColumn("time", F.col("time") - age)
    aged = aged.withColumn("ds", F.to_date("time"))
    tables.write_events(aged, path)
    tables.apply_retention(spark, path, dt.datetime(2024, 1, 31))
    return tables.read_events(spark, path).groupBy("ds_month").agg(
        F.count(F.lit(1)).alias("events"), F.min(F.unix_millis("time")).alias("first_ms")
    )


def append_1000(spark, sf_dir):
    path = scratch_dir(spark, "append")
    migrate.typed_events(legacy_table(spark, sf_dir)).write.parquet(path)
    migrate.append_rows(spark, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))


def _both_copies(spark, sf_dir) -> dict[str, str]:
    path = scratch_dir(spark, "storage")
    legacy = legacy_table(spark, sf_dir)
    legacy.write.parquet(f"{path}/text")
    migrate.typed_events(legacy).write.parquet(f"{path}/typed")
    return {name: f"{path}/{name}" for name in ("text", "typed")}


def storage_report(spark, sf_dir):
    """Compressed and uncompressed bytes of both copies by column; they depend on the writer, so SQL has none."""
    return migrate.storage_report(spark, _both_copies(spark, sf_dir))


def storage_values(spark, sf_dir):
    """Bytes of the values of both copies, by column."""
    return migrate.value_bytes({name: spark.read.parquet(path) for name, path in _both_copies(spark, sf_dir).items()})


def migrate_event(spark, sf_dir):
    root = scratch_dir(spark, "migrate")
    migrate.migrate(spark, legacy_table(spark, sf_dir), root, 1)
    migrate.swap(spark, root, 1)
    return migrate.current(spark, root).select(
        "event_id", F.col("ds").cast("string").alias("ds"), "event", "distinct_id", "os",
        "screen_width", "wifi", "channel",
    )


def migrate_verify(spark, sf_dir):
    return migrate.migrate(spark, legacy_table(spark, sf_dir), scratch_dir(spark, "verify"), 1)


_TEXTS = ["event", "distinct_id", "os", "channel"]
#: SQL of the bytes of each column's values in the all-text and in the typed table.
VALUE_BYTES = {
    "event_id": ("8", "8"),
    "time": ("8", "8"),
    "ds": ("10", "4"),
    **{name: (f"strlen({name})", f"strlen({name})") for name in _TEXTS},
    "screen_width": ("strlen(screen_width_text)", "CASE WHEN TRY_CAST(screen_width_text AS INTEGER) IS NOT NULL THEN 4 ELSE 0 END"),
    "wifi": ("strlen(wifi_text)", "CASE WHEN wifi_text IN ('true', 'false') THEN 1 ELSE 0 END"),
}
STORAGE_ORACLE = f"WITH ev AS ({VIEW_SQL}) " + " UNION ALL ".join(
    f"SELECT '{table}' AS \"table\", '{name}' AS \"column\", count(*) AS rows, CAST(sum({sizes[i]}) AS BIGINT) AS value_bytes FROM ev"
    for i, table in enumerate(("text", "typed"))
    for name, sizes in VALUE_BYTES.items()
)


# Streaming: the input arrives in two parts, each followed by a run to its end.

SPLIT = "2024-01-15 12:00:00"


def _in_two_parts(df: DataFrame, column: str, path: str, run) -> None:
    """The parts are compressed by zstd: the default codec makes no text smaller than about a twentieth,
    and messages beyond the limit have megabytes each."""
    early = F.col(column) < F.lit(SPLIT).cast("timestamp")
    for part in (df.filter(early), df.filter(~early)):
        part.write.mode("append").option("compression", "zstd").parquet(path)
        run().awaitTermination()


def stream_ingest(spark, sf_dir):
    root = scratch_dir(spark, "stream-events")

    def run():
        return flush.start_event_flush(
            flush.read_messages(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint", every=None
        )

    _in_two_parts(with_copies(messages(spark, sf_dir, FULL_BYTES)), "received_at", f"{root}/in", run)
    return flush.read_flushed(spark, f"{root}/out").select(
        "event", "distinct_id", F.unix_millis("time").alias("time_ms"), "k", "tags"
    )


STREAM_INGEST_ORACLE = f"""{MESSAGE_SQL}, u AS (SELECT *,
    event_id % 9 = 0 AND epoch_us(time) + delay_s * 1000000 < epoch_us(TIMESTAMP '{SPLIT}')
      AND epoch_us(time) + delay_s * 1000000 + 1000000 >= epoch_us(TIMESTAMP '{SPLIT}') AS twice FROM ev),
  r AS (SELECT *, rms AS seen FROM u UNION ALL SELECT *, rms + 1000 FROM u WHERE twice)
SELECT event, distinct_id, CASE event_id % 5 WHEN 0 THEN ms // 1000 * 1000 WHEN 4 THEN seen ELSE ms END AS time_ms,
  json_extract_string(props, '$.k') AS k, concat('["t', event_id % 7, '",{{"a":1.5,"b":', event_id % 3, '}},100]') AS tags
FROM r WHERE shape IN (3, 4, 5) OR shape >= 7
UNION ALL SELECT 'heartbeat', distinct_id, ms, '', '' FROM r WHERE shape = 5"""


def stream_dedup(spark, sf_dir):
    root = scratch_dir(spark, "stream-dedup")

    def run():
        return flush.start_event_flush(
            flush.read_messages(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint", every=None,
            horizon="10 minutes", max_bytes=MAX_BYTES,
        )

    _in_two_parts(with_copies(messages(spark, sf_dir)), "received_at", f"{root}/in", run)
    return flush.read_flushed(spark, f"{root}/out").groupBy("event").agg(F.count(F.lit(1)).alias("events"))


def stream_profiles(spark, sf_dir):
    root = scratch_dir(spark, "stream-profiles")
    store = profiles.ProfileStore(spark, f"{root}/store", buckets=8)

    def run():
        return flush.start_profile_flush(
            flush.read_messages(spark, f"{root}/in"), store, f"{root}/checkpoint", every=None
        )

    _in_two_parts(messages(spark, sf_dir), "received_at", f"{root}/in", run)
    return props_columns(store.read(), "name", "level", "phone")


STREAM_PROFILES_ORACLE = f"""{MESSAGE_SQL}, p AS (SELECT *, epoch_us(time) + delay_s * 1000000 AS seen FROM ev WHERE shape < 3),
  o AS (SELECT *, CAST(seen AS HUGEINT) * 10000000 + event_id AS ord, shape < 2 AS merges FROM p)
SELECT distinct_id, arg_max(concat('name-', event_id), ord) FILTER (WHERE merges) AS name,
  arg_max(CAST(event_id % 5 AS VARCHAR), ord) FILTER (WHERE merges) AS level,
  arg_max(concat('p-', event_id), ord) FILTER (WHERE shape = 1) AS phone,
  max(seen) // 1000000 AS received_s FROM o GROUP BY distinct_id HAVING count(*) FILTER (WHERE merges) > 0"""


def stream_together(spark, sf_dir):
    """Events, refusals and profiles of one stream that decodes each message once."""
    root = scratch_dir(spark, "stream-together")
    store = profiles.ProfileStore(spark, f"{root}/store", buckets=8)

    def run():
        stream = flush.read_messages(spark, f"{root}/in")
        return flush.start_event_flush(
            stream, f"{root}/out", f"{root}/checkpoint", every=None, horizon="10 minutes", max_bytes=MAX_BYTES, profiles=store
        )

    _in_two_parts(messages(spark, sf_dir), "received_at", f"{root}/in", run)
    parts = {
        "event": (flush.read_flushed(spark, f"{root}/out"), F.col("event")),
        "reject": (flush.read_rejects(spark, f"{root}/out"), F.col("reason")),
        "profile": (store.read(), F.concat_ws("-", F.lit("level"), F.col("props")["level"])),
    }
    found = None
    for kind, (rows, name) in parts.items():
        own = rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("kind"), "name", "rows")
        found = own if found is None else found.union(own)
    return found


def stream_hourly(spark, sf_dir):
    root = scratch_dir(spark, "stream-hourly")
    events = event_view(spark, sf_dir).select("time", "event")

    def run():
        incoming = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        return flush.start_live_counts(incoming, f"{root}/out", f"{root}/checkpoint", every=None)

    _in_two_parts(events, "time", f"{root}/in", run)
    counts = flush.read_live_counts(spark, f"{root}/out")
    return counts.withColumn("window_start", F.unix_seconds("window_start"))


QUERIES = {
    "ingest_roundtrip": ingest_roundtrip,
    "ingest_rejects_by_reason": lambda s, d: source.rejects_by_reason(decoded(s, d, FULL_BYTES)),
    "dedup_exact": dedup_exact,
    "duplicate_rate": duplicate_rate,
    "event_registry": event_registry,
    "reject_windows": reject_windows,
    "demo_source": demo_source,
    "evolve_schema_text": evolve_schema_text,
    "evolve_schema_typed": evolve_schema_typed,
    "typed_sink": typed_sink,
    "property_profile": property_profile,
    "profile_merge": profile_merge,
    "profile_upsert": profile_upsert,
    "profile_delete": profile_delete,
    "profile_refused": profile_refused,
    "profile_latest": profile_latest,
    "layout_roundtrip": layout_roundtrip,
    "retention_1y": retention_1y,
    "append_1000": append_1000,
    "storage_report": storage_report,
    "storage_values": storage_values,
    "migrate_event": migrate_event,
    "migrate_verify": migrate_verify,
    "stream_ingest": stream_ingest,
    "stream_dedup": stream_dedup,
    "stream_profiles": stream_profiles,
    "stream_together": stream_together,
    "stream_hourly": stream_hourly,
    **edges.QUERIES,
}

ORACLES = {
    "ingest_roundtrip": INGEST_ORACLE,
    "ingest_rejects_by_reason": f"""{MESSAGE_SQL} SELECT {REASON_SQL} AS reason, count(*) AS messages FROM ev
      WHERE shape = 6 AND (event_id // 16) % 8 <> 6 GROUP BY 1""",
    "dedup_exact": f"""{MESSAGE_SQL} SELECT event, event_id AS seq, 0 AS pos FROM main
      UNION ALL SELECT 'heartbeat', event_id, 1 FROM beat""",
    "duplicate_rate": f"""{MESSAGE_SQL}, r AS (SELECT event_id FROM main UNION ALL SELECT event_id FROM beat),
      c AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 9 = 0) AS extra FROM r)
    SELECT n + extra AS rows, extra AS extra_copies, round(CAST(extra AS DOUBLE) / CAST(n + extra AS DOUBLE), 6) AS duplicate_rate FROM c""",
    "event_registry": f"""{MESSAGE_SQL}, r AS (SELECT event, epoch_us(time) + delay_s * 1000000 AS seen FROM main
      UNION ALL SELECT 'heartbeat', epoch_us(time) + delay_s * 1000000 FROM beat)
    SELECT event, max(seen) AS last_seen_us FROM r GROUP BY event""",
    "reject_windows": f"""{MESSAGE_SQL} SELECT rms // 86400000 * 86400 AS window_start, {REASON_SQL} AS reason,
      count(*) AS messages FROM ev WHERE shape = 6 AND (event_id // 16) % 8 <> 6 GROUP BY 1, 2""",
    "demo_source": DEMO_ORACLE,
    "evolve_schema_text": f"""{MESSAGE_SQL} SELECT c AS "column", 'String' AS type,
      concat('`', c, '` String DEFAULT ''''') AS definition, (SELECT count(*) FROM main) AS rows
      FROM (VALUES ('k'), ('tags'), ('type'), ('value')) v(c)""",
    "evolve_schema_typed": f"""{MESSAGE_SQL} SELECT c AS "column", t AS type,
      (SELECT count(*) FROM main) AS samples, CASE WHEN t = 'String' THEN concat('`', c, '` String DEFAULT ''''')
        ELSE concat('`', c, '` Nullable(', t, ')') END AS definition
      FROM (VALUES ('k', 'Int64'), ('tags', 'String'), ('type', 'String'), ('value', 'Float64')) v(c, t)""",
    "typed_sink": TYPED_SINK_ORACLE,
    "property_profile": PROPERTY_ORACLE,
    "profile_merge": PROFILE_MERGE_ORACLE,
    "profile_upsert": PROFILE_UPSERT_ORACLE,
    "profile_delete": """SELECT CAST(c_custkey AS VARCHAR) AS distinct_id,
      CAST(DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) AS VARCHAR) AS ds, c_name AS name
      FROM customer WHERE c_custkey % 7 <> 0""",
    "profile_refused": """SELECT concat(c_custkey, ' x') AS distinct_id, 'invalid_character' AS reason
      FROM customer WHERE c_custkey % 5 = 1 UNION ALL SELECT repeat('9', 129), 'invalid_length'
      UNION ALL SELECT '', 'invalid_length'""",
    "profile_latest": """SELECT CAST(o_custkey AS VARCHAR) AS distinct_id, o_orderkey AS seq, o_orderstatus AS status,
      CAST(epoch(o_orderdate) AS BIGINT) AS last_visit_s FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "layout_roundtrip": f"""WITH ev AS ({VIEW_SQL}) SELECT 202401 AS ds_month, CAST(ds AS VARCHAR) AS ds,
      count(*) AS events, count(DISTINCT distinct_id) AS users FROM ev
      WHERE ds >= DATE '2024-01-05' AND ds < DATE '2024-01-20' GROUP BY ds""",
    "retention_1y": """WITH e AS (SELECT ts - INTERVAL 1 DAY * (event_id % 800) AS time FROM events)
    SELECT CAST(year(time) * 100 + month(time) AS INTEGER) AS ds_month, count(*) AS events,
      min(epoch_us(time) // 1000) AS first_ms FROM e WHERE time >= TIMESTAMP '2023-01-31' GROUP BY 1""",
    "append_1000": "SELECT count(*) + least(count(*), 1000) AS rows FROM events",
    "migrate_event": f"""WITH ev AS ({VIEW_SQL}) SELECT event_id, CAST(ds AS VARCHAR) AS ds, event, distinct_id, os,
      TRY_CAST(screen_width_text AS INTEGER) AS screen_width,
      CASE wifi_text WHEN 'true' THEN true WHEN 'false' THEN false END AS wifi, channel FROM ev""",
    "migrate_verify": f"""WITH ev AS ({VIEW_SQL}), c AS (
      SELECT 'rows' AS "check", count(*) AS legacy, count(*) AS typed FROM ev
      UNION ALL SELECT 'screen_width', count(*) FILTER (WHERE screen_width_text <> ''),
        count(TRY_CAST(screen_width_text AS INTEGER)) FROM ev
      UNION ALL SELECT 'wifi', count(*) FILTER (WHERE wifi_text <> ''),
        count(*) FILTER (WHERE wifi_text IN ('true', 'false')) FROM ev)
    SELECT "check", legacy, typed, legacy - typed AS lost, true AS ok FROM c""",
    "storage_values": STORAGE_ORACLE,
    "stream_ingest": STREAM_INGEST_ORACLE,
    "stream_dedup": f"""{MESSAGE_SQL}, r AS (SELECT event FROM main UNION ALL SELECT 'heartbeat' FROM beat)
      SELECT event, count(*) AS events FROM r GROUP BY event""",
    "stream_profiles": STREAM_PROFILES_ORACLE,
    "stream_together": f"""{MESSAGE_SQL}, r AS (SELECT event FROM main UNION ALL SELECT 'heartbeat' FROM beat),
      u AS (SELECT arg_max(event_id % 5, CAST(epoch_us(time) + delay_s * 1000000 AS HUGEINT) * 10000000 + event_id) AS level
        FROM ev WHERE shape < 2 GROUP BY distinct_id)
      SELECT 'event' AS kind, event AS name, count(*) AS rows FROM r GROUP BY event
      UNION ALL SELECT 'reject', {REASON_SQL}, count(*) FROM ev WHERE shape = 6 AND (event_id // 16) % 8 <> 6 GROUP BY 2
      UNION ALL SELECT 'profile', concat('level-', level), count(*) FROM u GROUP BY 2""",
    "stream_hourly": f"""WITH ev AS ({VIEW_SQL}) SELECT epoch_us(time) // 3600000000 * 3600 AS window_start, event,
      count(*) AS events FROM ev GROUP BY 1, 2""",
    **edges.ORACLES,
}
