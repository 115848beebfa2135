"""Raw messages made from the ``events`` table, in every accepted and refused shape.

Each event row becomes one message. Its shape is ``event_id % 16``: profile messages (0-2),
one object (3), arrays (4, 5, 7 and up), refused messages (6). Values appear in the
different spellings the decoder has to accept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources.messages import MAX_PAYLOAD_BYTES
from tidemark.workload.fixture import event_view

# A size limit that keeps the padded messages short. Some queries take the product's own
# limit (``FULL_BYTES``) and messages padded beyond it.
MAX_BYTES = 4096
FULL_BYTES = MAX_PAYLOAD_BYTES

TIME_JSON = """CASE event_id % 5
  WHEN 0 THEN CAST(ms DIV 1000 AS STRING)
  WHEN 1 THEN CONCAT('" ', CAST(ms AS STRING), ' "')
  WHEN 2 THEN CAST(ms AS STRING)
  WHEN 3 THEN CONCAT(SUBSTR(CAST(ms AS STRING), 1, 1), '.', SUBSTR(CAST(ms AS STRING), 2), 'e12')
  ELSE '"n/a"' END"""

WIDTH_JSON = """CASE WHEN screen_width_text IN ('', 'abc') OR event_id % 2 = 1
  THEN CONCAT('"', screen_width_text, '"') ELSE screen_width_text END"""

HEIGHT_JSON = """CASE event_id % 4 WHEN 0 THEN '70000' WHEN 1 THEN '"-5"' WHEN 2 THEN '"12.0"'
  ELSE CAST(event_id % 1000 AS STRING) END"""

OFFSET_JSON = "CASE event_id % 3 WHEN 0 THEN '-480' WHEN 1 THEN '\"40000\"' ELSE '\"x\"' END"

WIFI_JSON = """CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN '"yes"' WHEN 2 THEN '1'
  WHEN 3 THEN '"no"' WHEN 4 THEN 'false' ELSE 'null' END"""

FIRST_DAY_JSON = "CASE event_id % 2 WHEN 0 THEN '\" Y \"' ELSE '0' END"

FLUSH_JSON = """CASE event_id % 3 WHEN 0 THEN CAST(ms AS STRING)
  WHEN 1 THEN '"99999999999999999999999"' ELSE '-5' END"""

PROPERTIES_JSON = f"""CONCAT('{{"$os":', CASE WHEN event_id % 16 = 7 THEN '"other","$os":' ELSE '' END,
  '"', os, '","$device_id":"', device_id, '","$app_id":"', app_id,
  '","$app_version":"', app_version, '","$network_type":"', network_type,
  '","$screen_width":', {WIDTH_JSON}, ',"$screen_height":', {HEIGHT_JSON},
  ',"$timezone_offset":', {OFFSET_JSON}, ',"$wifi":', {WIFI_JSON},
  ',"$is_first_day":', {FIRST_DAY_JSON}, ',"value":', CAST(value AS STRING),
  ',"tags":["t', CAST(event_id % 7 AS STRING), '",{{"$b":', CAST(event_id % 3 AS STRING),
  ',"a":1.50}},1e2],"bad-key!":1,"none":{{}},"more":{{"still":', props, '}}}}')"""

EVENT_JSON = f"""CONCAT('{{"type":"track","event":"', event, '","distinct_id":"', distinct_id,
  '","time":', {TIME_JSON}, ',"_flush_time":', {FLUSH_JSON},
  ',"lib":{{"$lib":"js","$lib_method":"code","$lib_version":"1.', CAST(event_id % 3 AS STRING),
  '"}},"properties":', {PROPERTIES_JSON}, '}}')"""

PROFILE_JSON = """CONCAT('{"type":"',
  CASE event_id % 16 WHEN 0 THEN 'profile_set' WHEN 1 THEN 'track_signup' ELSE 'profile_increment' END,
  '","distinct_id":"', distinct_id, '","time":', CAST(ms AS STRING),
  ',"properties":{"$name":"name-', CAST(event_id AS STRING), '","$level":', CAST(event_id % 5 AS STRING),
  CASE WHEN event_id % 16 = 1 THEN CONCAT(',"phone":"p-', CAST(event_id AS STRING), '"') ELSE '' END,
  '}}')"""

REFUSED_JSON = """CASE (event_id DIV 16) % 8
  WHEN 0 THEN '[]' WHEN 1 THEN '[1]' WHEN 2 THEN 'bad' WHEN 3 THEN ''
  WHEN 4 THEN CONCAT('[{"event":"big","pad":"', REPEAT('x', pad), '"}]')
  WHEN 5 THEN '{"type":"track","event":7}' WHEN 6 THEN 'null' ELSE '"text"' END"""

DATA_LIST = f"""CASE
  WHEN event_id % 16 IN (0, 1, 2, 3, 6) THEN ''
  WHEN event_id % 16 = 4 THEN CONCAT('[', {EVENT_JSON}, ',{{"type":"track","distinct_id":"x"}},null]')
  WHEN event_id % 16 = 5 THEN CONCAT('[', {EVENT_JSON}, ',{{"event":"heartbeat","distinct_id":"',
    distinct_id, '","time":', CAST(ms AS STRING), '}}]')
  ELSE CONCAT('[', {EVENT_JSON}, ']') END"""

DATA = f"""CASE
  WHEN event_id % 16 IN (0, 1, 2) THEN {PROFILE_JSON}
  WHEN event_id % 16 = 3 THEN {EVENT_JSON}
  WHEN event_id % 16 = 6 THEN {REFUSED_JSON}
  ELSE '' END"""


def messages(spark: SparkSession, sf_dir: str, limit: int = MAX_BYTES) -> DataFrame:
    """(seq, received_at, data_list, data), one row per event row; some exceed the limit."""
    view = event_view(spark, sf_dir).withColumn("ms", F.unix_millis("time")).withColumn("pad", F.lit(limit))
    return view.select(
        F.col("event_id").alias("seq"),
        received_at().alias("received_at"),
        F.expr(DATA_LIST).alias("data_list"),
        F.expr(DATA).alias("data"),
    )


def received_at() -> Column:
    return F.timestamp_add("SECOND", F.col("delay_s").cast("int"), F.col("time"))


def with_copies(sent: DataFrame) -> DataFrame:
    """Every ninth message arrives twice; the copy comes a second later."""
    copies = sent.filter(F.col("seq") % 9 == 0).select(
        (F.col("seq") + 1_000_000_000_000).alias("seq"),
        (F.col("received_at") + F.expr("INTERVAL 1 SECOND")).alias("received_at"),
        "data_list",
        "data",
    )
    return sent.unionAll(copies)
