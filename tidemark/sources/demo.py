"""Synthetic events: a numbered sequence -> dimensioned demo rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The dimension lists, picked by number.
OS = ["Android", "iOS", "Web"]
NETWORK = ["wifi", "5G", "4G"]
VERSION = ["1.0.0", "1.1.0", "2.0.0"]
CHANNEL = ["Organic", "Search Ads", "Social", "Partner"]
COUNTRY = ["CN", "US", "SG", "DE"]
PAGE = ["Home", "Pricing", "Product", "Checkout"]


def _pick(values: list[str], number: Column) -> Column:
    position = (number % len(values) + 1).cast("int")
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), position)


def _year(time: Column) -> Column:
    """The year as signed text; long sequences reach back beyond year 1, where ``yyyy`` counts eras."""
    year = F.year(time)
    text = year.cast("string")
    return F.when(year.between(0, 999), F.lpad(text, 4, "0")).otherwise(text)


def demo_events(numbers: DataFrame, anchor: Column, app_id: str, app_name: str) -> DataFrame:
    """One event per ``number``, each three hours before the previous, back from the anchor."""
    n = F.col("number")
    slot = n % 12
    event = (
        F.when(slot < 5, "demo_app_open")
        .when(slot < 9, "demo_product_view")
        .when(slot < 11, "demo_add_to_cart")
        .otherwise("demo_purchase")
    )
    timed = numbers.select(
        n, F.timestamp_millis(F.unix_millis(anchor) - n * 3 * 3_600_000).alias("time")
    )
    return timed.select(
        "number",
        "time",
        event.alias("event"),
        F.concat(F.lit("demo-user-"), (n % 48 + 1).cast("string")).alias("distinct_id"),
        _pick(OS, n).alias("os"),
        _pick(NETWORK, n).alias("network_type"),
        F.lit(app_id).alias("app_id"),
        _pick(VERSION, n).alias("app_version"),
        F.lit(app_name).alias("app_name"),
        F.concat(F.lit("demo-device-"), (n % 60 + 1).cast("string")).alias("device_id"),
        _pick(CHANNEL, n).alias("channel"),
        _pick(COUNTRY, n).alias("country"),
        _pick(PAGE, n).alias("page_name"),
        F.date_format("time", "MM-dd HH:00").alias("demo_hour"),
        F.concat(_year(F.col("time")), F.date_format("time", "-MM-dd")).alias("demo_day"),
        F.when(slot == 11, 49 + (n % 5) * 25).otherwise(0).cast("double").alias("revenue"),
        (n < 48).alias("is_first_day"),
    )


def seed_demo(
    events: DataFrame, numbers: DataFrame, anchor: Column, app_id: str = "demo", app_name: str = "Demo"
) -> DataFrame:
    """Demo rows to insert: all of them, or none when the table already has the app's rows."""
    present = events.filter(F.col("app_id") == app_id).agg(F.count(F.lit(1))).scalar()
    return demo_events(numbers, anchor, app_id, app_name).filter(present == 0)
