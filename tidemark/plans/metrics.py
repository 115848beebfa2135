"""Product metrics: the dashboard charts and the benchmark reports.

Every report takes the event table as a DataFrame and declares one aggregate over it. The
columns and filters it names are all that the Parquet scan reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.coerce import int_or_zero


def for_app(df: DataFrame, app_id: str | None) -> DataFrame:
    return df if app_id is None else df.filter(F.col("app_id") == app_id)


def latest_day(df: DataFrame) -> Column:
    """The last date in the data, standing in for "today" on historical data."""
    return df.agg(F.max("ds")).scalar()


def kpi_summary(
    df: DataFrame, purchase_event: str, app_id: str | None = None, as_of: Column | None = None
) -> DataFrame:
    """Seven headline numbers in one pass.

    Several distinct counts in one aggregate would multiply every row. Here each user is
    reduced to one row of flags first (partial aggregates absorb hot users), and the numbers
    are plain counts over those rows.
    """
    as_of = latest_day(df) if as_of is None else as_of
    per_user = for_app(df, app_id).groupBy("distinct_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.bool_or(F.col("ds") == as_of).alias("active_today"),
        F.bool_or("is_first_day").alias("is_new"),
        F.bool_or(F.col("event") == purchase_event).alias("purchased"),
        F.sum("revenue").alias("revenue"),
    )
    known = F.col("distinct_id").isNotNull()
    totals = per_user.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
        F.count_if(known).alias("users"),
        F.count_if(known & F.col("active_today")).alias("dau"),
        F.count_if(known & F.col("is_new")).alias("new_users"),
        F.count_if(known & F.col("purchased")).alias("purchasers"),
        F.round(F.coalesce(F.sum("revenue"), F.lit(0.0)), 2).alias("gmv"),
    )
    rate = F.col("purchasers").cast("double") / F.greatest("users", F.lit(1)).cast("double")
    return totals.withColumn("paid_conversion", F.round(rate, 6))


def hourly_trend(df: DataFrame, app_id: str | None = None) -> DataFrame:
    """Rows per month-day-hour label. The label has no year, as in the charts."""
    label = F.date_format("time", "MM-dd HH:00").alias("hour")
    return for_app(df, app_id).groupBy(label).agg(F.count(F.lit(1)).alias("events"))


def daily_active(df: DataFrame, app_id: str | None = None) -> DataFrame:
    label = F.date_format("time", "yyyy-MM-dd").alias("day")
    return for_app(df, app_id).groupBy(label).agg(F.countDistinct("distinct_id").alias("users"))


def top_values(df: DataFrame, column: str, k: int, app_id: str | None = None) -> DataFrame:
    """The k most frequent values; ties go to the smaller value."""
    counts = for_app(df, app_id).groupBy(column).agg(F.count(F.lit(1)).alias("events"))
    return counts.orderBy(F.desc("events"), F.asc(column)).limit(k)


def top_events(df: DataFrame, k: int = 25, app_id: str | None = None) -> DataFrame:
    return top_values(df, "event", k, app_id)


def app_versions(df: DataFrame, k: int = 20, app_id: str | None = None) -> DataFrame:
    return top_values(df, "app_version", k, app_id)


def share(df: DataFrame, column: str, app_id: str | None = None, k: int = 10) -> DataFrame:
    """Top values with each one's share of the slices shown.

    The denominator is summed over at most k rows that are already reduced.
    """
    slices = top_values(df, column, k, app_id)
    return slices.selectExpr(
        column,
        "events",
        "round(cast(events AS DOUBLE) * 100 / cast(sum(events) OVER () AS DOUBLE), 6) AS percent",
    )


def funnel_stages(
    df: DataFrame, stages: list[str], app_id: str | None = None, k: int = 10
) -> DataFrame:
    """Distinct users per stage event, without any order test between the stages."""
    counts = (
        for_app(df, app_id)
        .filter(F.col("event").isin(stages))
        .groupBy("event")
        .agg(F.countDistinct("distinct_id").alias("users"))
    )
    return counts.orderBy(F.desc("users"), F.asc("event")).limit(k)


def recent_events(df: DataFrame, event: str, k: int = 10) -> DataFrame:
    """The newest k raw rows of one event; ``event_id`` settles equal times."""
    return (
        df.filter(F.col("event") == event)
        .orderBy(F.desc("time"), F.desc("event_id"))
        .limit(k)
    )


def count_named_event(df: DataFrame, event: str) -> DataFrame:
    return (
        df.filter(F.col("event") == event)
        .groupBy("event")
        .agg(F.count(F.lit(1)).alias("events"))
    )


# The five benchmark reports, each over the all-text table and over the typed table.


def wide_screens_text(df: DataFrame, above: int = 1000) -> DataFrame:
    return df.filter(int_or_zero(F.col("screen_width")) > above).agg(
        F.count(F.lit(1)).alias("events")
    )


def wide_screens_typed(df: DataFrame, above: int = 1000) -> DataFrame:
    return df.filter(F.col("screen_width") > above).agg(F.count(F.lit(1)).alias("events"))


def days_between_text(df: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open range on ISO date text, compared as text."""
    return df.filter((F.col("ds") >= start) & (F.col("ds") < end)).agg(
        F.count(F.lit(1)).alias("events")
    )


def days_between_typed(df: DataFrame, start: str, end: str) -> DataFrame:
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    return df.filter((F.col("ds") >= low) & (F.col("ds") < high)).agg(
        F.count(F.lit(1)).alias("events")
    )


def mean_width_text(df: DataFrame) -> DataFrame:
    """Non-numeric text counts as 0 here, and is left out by the typed form."""
    width = int_or_zero(F.col("screen_width"))
    return df.filter(F.col("screen_width") != "").agg(
        F.round(F.avg(width), 6).alias("mean_width")
    )


def mean_width_typed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("screen_width").isNotNull()).agg(
        F.round(F.avg("screen_width"), 6).alias("mean_width")
    )


def wifi_text(df: DataFrame) -> DataFrame:
    return df.filter(F.col("wifi") == "true").agg(F.count(F.lit(1)).alias("events"))


def wifi_typed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("wifi")).agg(F.count(F.lit(1)).alias("events"))


def last_days(df: DataFrame, k: int = 10) -> DataFrame:
    """Rows per day, newest k days; serves both tables."""
    counts = df.groupBy("ds").agg(F.count(F.lit(1)).alias("events"))
    return counts.orderBy(F.desc("ds")).limit(k)
