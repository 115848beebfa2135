"""The canonical event view over the given ``events`` table.

The expressions below run unchanged in Spark SQL and in the SQL the results are checked
with, so both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import configure

APP_ID = "demo-app"
PURCHASE = "purchase"
FUNNEL = ["signup", "view", "click", "purchase"]

VIEW_COLUMNS = {
    "event_id": "event_id",
    "time": "ts",
    "ds": "CAST(ts AS DATE)",
    "event": """CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'wishlist'
       WHEN event_type = 'click' AND user_id % 5 = 0 THEN 'scroll'
       WHEN event_type = 'error' THEN CONCAT('error_', CAST(event_id % 40 AS STRING))
       ELSE event_type END""",
    "distinct_id": "CAST(user_id AS STRING)",
    "device_id": "CONCAT('device-', CAST(user_id % 40 AS STRING))",
    "app_id": "CASE WHEN event_id % 10 = 9 THEN 'other-app' ELSE 'demo-app' END",
    "os": "CASE user_id % 3 WHEN 0 THEN 'Android' WHEN 1 THEN 'iOS' ELSE 'Web' END",
    "network_type": "CASE event_id % 3 WHEN 0 THEN 'wifi' WHEN 1 THEN '5G' ELSE '4G' END",
    "app_version": """CASE event_id % 7 WHEN 0 THEN '1.0.0' WHEN 1 THEN '1.1.0'
       ELSE CONCAT('2.', CAST(event_id % 29 AS STRING), '.0') END""",
    "channel": """CASE user_id % 4 WHEN 0 THEN 'Organic' WHEN 1 THEN 'Search Ads'
       WHEN 2 THEN 'Social' ELSE 'Partner' END""",
    "country": "CASE user_id % 5 WHEN 0 THEN 'CN' WHEN 1 THEN 'US' WHEN 2 THEN 'SG' ELSE 'DE' END",
    "page_name": """CASE WHEN event_id % 4 = 0 THEN 'Home'
       ELSE CONCAT('page-', CAST(event_id % 23 AS STRING)) END""",
    "revenue": """CASE WHEN event_type = 'purchase' AND user_id % 3 <> 0 THEN value
       ELSE CAST(0 AS DOUBLE) END""",
    "screen_width_text": """CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'abc'
       ELSE CAST(320 + event_id % 1600 AS STRING) END""",
    "wifi_text": "CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END",
    "delay_s": "(event_id * 37) % 7200",
    "props": "props",
    "value": "value",
}

VIEW_SQL = "SELECT " + ",\n  ".join(f"{e} AS {n}" for n, e in VIEW_COLUMNS.items()) + ", user_id FROM events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One projection over the scan; unused columns never leave the Parquet reader."""
    configure(spark)
    columns = [f"{e} AS {n}" for n, e in VIEW_COLUMNS.items()]
    view = table(spark, sf_dir, "events").selectExpr(*columns)
    return view.withColumn("time", F.col("time").cast("timestamp"))


def with_first_day(df: DataFrame, salts: int = 32) -> DataFrame:
    """Add ``is_first_day`` by a join with each user's first date.

    The first dates come from a partial aggregate. They are repeated once per salt, so that
    the rows of a hot user meet them in many tasks.
    """
    first = df.groupBy("distinct_id").agg(F.min("ds").alias("first_ds"))
    copies = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"))
    return (
        salted.join(copies, ["distinct_id", "salt"])
        .withColumn("is_first_day", F.col("ds") == F.col("first_ds"))
        .drop("first_ds", "salt")
    )
