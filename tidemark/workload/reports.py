"""Registered queries on the canonical event view: metrics, behaviour, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import migrate
from tidemark.plans import behavior, metrics, quality
from tidemark.workload.fixture import APP_ID, FUNNEL, PURCHASE, VIEW_SQL, event_view, with_first_day
from tidemark.workload.messages import received_at

EV = f"WITH ev AS ({VIEW_SQL})\n"
APP = f"FROM ev WHERE app_id = '{APP_ID}'"


def legacy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The all-text form of the event table."""
    return event_view(spark, sf_dir).select(
        "event_id",
        "time",
        F.col("ds").cast("string").alias("ds"),
        "event",
        "distinct_id",
        "os",
        F.col("screen_width_text").alias("screen_width"),
        F.col("wifi_text").alias("wifi"),
        "channel",
    )


def typed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrate.typed_events(legacy_table(spark, sf_dir))


def day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("ds", F.col("ds").cast("string"))


def kpi_summary(spark, sf_dir):
    view = event_view(spark, sf_dir)
    as_of = metrics.latest_day(view)
    return metrics.kpi_summary(with_first_day(view), PURCHASE, APP_ID, as_of)


def top_events(spark, sf_dir):
    return metrics.top_events(event_view(spark, sf_dir), app_id=APP_ID)


def share(column):
    return lambda spark, sf_dir: metrics.share(event_view(spark, sf_dir), column, APP_ID)


def share_oracle(column):
    return f"""{EV}, top AS (SELECT {column}, count(*) AS events {APP}
      GROUP BY {column} ORDER BY events DESC, {column} LIMIT 10)
    SELECT {column}, events,
      round(CAST(events AS DOUBLE) * 100 / CAST(sum(events) OVER () AS DOUBLE), 6) AS percent FROM top"""


def recent_events(spark, sf_dir):
    newest = metrics.recent_events(event_view(spark, sf_dir), PURCHASE)
    return newest.select(
        "event_id", F.unix_millis("time").alias("time_ms"), "event", "distinct_id", "revenue"
    )


def batch_reconcile(spark, sf_dir):
    view = event_view(spark, sf_dir)
    properties = F.from_json("props", "map<string,string>")
    observed = quality.with_property(view, properties, "k", "7")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").filter(
        F.from_json("props", "map<string,string>")["k"] == "7"
    )
    expected = quality.count_events_and_users(
        raw.select(F.col("event_type").alias("event"), F.col("user_id").alias("distinct_id"))
    )
    return quality.batch_reconcile(observed, expected)


def negative_checks(spark, sf_dir):
    view = event_view(spark, sf_dir)
    dirty = view.select(
        F.when(F.col("event_id") % 17 == 0, "").otherwise(F.col("distinct_id")).alias("distinct_id"),
        F.when(F.col("event_id") % 19 != 0, F.col("time")).alias("time"),
        F.when(F.col("event_id") % 23 == 0, F.col("time") - F.expr("INTERVAL 25 HOUR"))
        .otherwise(received_at())
        .alias("received_at"),
    )
    return quality.negative_checks(dirty)


def identity_split(spark, sf_dir):
    view = event_view(spark, sf_dir)
    return quality.identity_split(view, "device_id", "distinct_id")


def name_variants(spark, sf_dir):
    view = event_view(spark, sf_dir)
    spelled = F.expr(
        """CASE event_id % 8 WHEN 0 THEN UPPER(event) WHEN 1 THEN CONCAT(event, '-') WHEN 2 THEN '登录'
        WHEN 3 THEN '登-录' WHEN 4 THEN '注销' WHEN 5 THEN '!?' WHEN 6 THEN '--' ELSE event END"""
    )
    return quality.name_variants(view.withColumn("event", spelled))


OUTLIER = "CASE WHEN event_id = 0 THEN 4000000000000000 ELSE event_id * 3 + delay_s END"


def delay_outlier(spark, sf_dir):
    """The distribution of values of which one is far beyond all others."""
    view = event_view(spark, sf_dir).withColumn("delay_s", F.expr(OUTLIER))
    return quality.delay_distribution(view, 3600)


def field_diff(spark, sf_dir):
    view = event_view(spark, sf_dir)
    fields = F.array(
        *[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in ("os", "channel", "country")]
    )
    sent = view.select(F.col("event_id").alias("record_id"), F.inline(fields))
    sent = sent.withColumn("type", F.lit("String"))
    number = F.col("record_id")
    stored = (
        sent.filter((number % 7 != 0) | (F.col("key") != "os"))
        .withColumn(
            "type", F.when((number % 5 == 0) & (F.col("key") == "channel"), "Int64").otherwise(F.col("type"))
        )
        .withColumn(
            "value", F.when((number % 11 == 0) & (F.col("key") == "country"), "??").otherwise(F.col("value"))
        )
        .withColumn(
            "key", F.when((number % 13 == 0) & (F.col("key") == "country"), "nation").otherwise(F.col("key"))
        )
    )
    return quality.field_diff(sent, stored)


FIELD_DIFF_ORACLE = f"""{EV}
SELECT event_id AS record_id, 'os' AS key, CASE WHEN event_id % 7 = 0 THEN 'missing' ELSE 'equal' END AS status FROM ev
UNION ALL
SELECT event_id, 'channel', CASE WHEN event_id % 5 = 0 THEN 'type_changed' ELSE 'equal' END FROM ev
UNION ALL
SELECT event_id, 'country', CASE WHEN event_id % 13 = 0 THEN 'missing'
  WHEN event_id % 11 = 0 THEN 'changed' ELSE 'equal' END FROM ev
UNION ALL
SELECT event_id, 'nation', 'extra' FROM ev WHERE event_id % 13 = 0"""


def two_path_totals(spark, sf_dir):
    view = event_view(spark, sf_dir)
    a = view.select("time", "event", "distinct_id")
    b = view.filter((F.col("event") != "signup") | (F.col("app_id") == APP_ID)).select(
        "time", "event", "distinct_id"
    )
    totals = quality.two_path_totals(a, b, "1 day")
    return totals.withColumn("window_start", F.unix_seconds("window_start"))


def retention(spark, sf_dir):
    cells = behavior.retention(event_view(spark, sf_dir), "signup")
    return cells.withColumn("cohort", F.col("cohort").cast("string"))


def unique_devices(spark, sf_dir):
    return behavior.unique_devices(event_view(spark, sf_dir)).drop("devices_approx")


FUNNEL_STEPS = ["view", "click", "purchase"]


def ordered_funnel(hours):
    return lambda spark, sf_dir: behavior.ordered_funnel(
        event_view(spark, sf_dir), FUNNEL_STEPS, hours * 3600
    )


def funnel_oracle(hours):
    """Greedy earliest match, one range join per step."""
    return f"""{EV}, s1 AS (SELECT distinct_id, time AS t1 FROM ev WHERE event = 'view'),
    s2 AS (SELECT s.distinct_id, s.t1, min(e.time) AS t2 FROM s1 s JOIN ev e
      ON e.distinct_id = s.distinct_id AND e.event = 'click' AND e.time > s.t1
      AND e.time <= s.t1 + INTERVAL {hours} HOUR GROUP BY 1, 2),
    s3 AS (SELECT s.distinct_id, s.t1, min(e.time) AS t3 FROM s2 s JOIN ev e
      ON e.distinct_id = s.distinct_id AND e.event = 'purchase' AND e.time > s.t2
      AND e.time <= s.t1 + INTERVAL {hours} HOUR GROUP BY 1, 2)
    SELECT 1 AS step_no, 'view' AS event, count(DISTINCT distinct_id) AS users FROM s1
    UNION ALL SELECT 2, 'click', count(DISTINCT distinct_id) FROM s2
    UNION ALL SELECT 3, 'purchase', count(DISTINCT distinct_id) FROM s3"""


def segment_rollup(spark, sf_dir):
    rolled = behavior.segment_rollup(event_view(spark, sf_dir), ["os", "app_version"])
    return rolled.withColumn("level", F.col("level").cast("bigint"))


QUERIES = {
    "kpi_summary": kpi_summary,
    "hourly_trend": lambda s, d: metrics.hourly_trend(event_view(s, d), APP_ID),
    "daily_active": lambda s, d: metrics.daily_active(event_view(s, d), APP_ID),
    "top_events": top_events,
    "top_20_events": lambda s, d: metrics.top_events(event_view(s, d), 20),
    "funnel_stages": lambda s, d: metrics.funnel_stages(event_view(s, d), FUNNEL, APP_ID),
    "app_versions": lambda s, d: metrics.app_versions(event_view(s, d), app_id=APP_ID),
    "share_os": share("os"),
    "share_channel": share("channel"),
    "share_country": share("country"),
    "share_page": share("page_name"),
    "share_network": share("network_type"),
    "recent_events": recent_events,
    "count_named_event": lambda s, d: metrics.count_named_event(event_view(s, d), "signup"),
    "batch_reconcile": batch_reconcile,
    "negative_checks": negative_checks,
    "bench_width_text": lambda s, d: metrics.wide_screens_text(legacy_table(s, d)),
    "bench_width_typed": lambda s, d: metrics.wide_screens_typed(typed_table(s, d)),
    "bench_range_text": lambda s, d: metrics.days_between_text(legacy_table(s, d), "2024-01-05", "2024-01-20"),
    "bench_range_typed": lambda s, d: metrics.days_between_typed(typed_table(s, d), "2024-01-05", "2024-01-20"),
    "bench_avg_text": lambda s, d: metrics.mean_width_text(legacy_table(s, d)),
    "bench_avg_typed": lambda s, d: metrics.mean_width_typed(typed_table(s, d)),
    "bench_wifi_text": lambda s, d: metrics.wifi_text(legacy_table(s, d)),
    "bench_wifi_typed": lambda s, d: metrics.wifi_typed(typed_table(s, d)),
    "bench_days_text": lambda s, d: metrics.last_days(legacy_table(s, d)),
    "bench_days_typed": lambda s, d: day_text(metrics.last_days(typed_table(s, d))),
    "field_diff": field_diff,
    "name_variants": name_variants,
    "identity_split": identity_split,
    "delay_distribution": lambda s, d: quality.delay_distribution(event_view(s, d), 3600),
    "delay_outlier": delay_outlier,
    "two_path_totals": two_path_totals,
    "ordered_funnel": ordered_funnel(6),
    "ordered_funnel_24h": ordered_funnel(24),
    "retention": retention,
    "unique_devices": unique_devices,
    "segment_rollup": segment_rollup,
    "day_boundary": lambda s, d: quality.day_boundary(event_view(s, d), "Asia/Shanghai"),
}

WIDTH = "coalesce(TRY_CAST(screen_width_text AS INTEGER), 0)"

ORACLES = {
    "kpi_summary": f"""{EV}, fd AS (SELECT user_id AS u, min(ds) AS first_ds FROM ev GROUP BY user_id),
      a AS (SELECT * FROM ev JOIN fd ON ev.user_id = fd.u WHERE app_id = '{APP_ID}')
    SELECT count(*) AS total_events, count(DISTINCT distinct_id) AS users,
      count(DISTINCT distinct_id) FILTER (WHERE ds = (SELECT max(ds) FROM ev)) AS dau,
      count(DISTINCT distinct_id) FILTER (WHERE ds = first_ds) AS new_users,
      count(DISTINCT distinct_id) FILTER (WHERE event = '{PURCHASE}') AS purchasers,
      round(sum(revenue), 2) AS gmv,
      round(CAST(count(DISTINCT distinct_id) FILTER (WHERE event = '{PURCHASE}') AS DOUBLE)
        / CAST(greatest(count(DISTINCT distinct_id), 1) AS DOUBLE), 6) AS paid_conversion FROM a""",
    "hourly_trend": f"{EV} SELECT strftime(time, '%m-%d %H:00') AS hour, count(*) AS events {APP} GROUP BY 1",
    "daily_active": f"{EV} SELECT strftime(time, '%Y-%m-%d') AS day, count(DISTINCT distinct_id) AS users {APP} GROUP BY 1",
    "top_events": f"{EV} SELECT event, count(*) AS events {APP} GROUP BY event ORDER BY events DESC, event LIMIT 25",
    "top_20_events": f"{EV} SELECT event, count(*) AS events FROM ev GROUP BY event ORDER BY events DESC, event LIMIT 20",
    "funnel_stages": f"""{EV} SELECT event, count(DISTINCT distinct_id) AS users {APP}
      AND event IN ('signup', 'view', 'click', 'purchase') GROUP BY event ORDER BY users DESC, event LIMIT 10""",
    "app_versions": f"{EV} SELECT app_version, count(*) AS events {APP} GROUP BY app_version ORDER BY events DESC, app_version LIMIT 20",
    "share_os": share_oracle("os"),
    "share_channel": share_oracle("channel"),
    "share_country": share_oracle("country"),
    "share_page": share_oracle("page_name"),
    "share_network": share_oracle("network_type"),
    "recent_events": f"""{EV} SELECT event_id, epoch_us(time) // 1000 AS time_ms, event, distinct_id, revenue FROM ev
      WHERE event = '{PURCHASE}' ORDER BY time DESC, event_id DESC LIMIT 10""",
    "count_named_event": f"{EV} SELECT event, count(*) AS events FROM ev WHERE event = 'signup' GROUP BY event",
    "batch_reconcile": f"""{EV}, o AS (SELECT event, count(*) AS events, count(DISTINCT distinct_id) AS users FROM ev
        WHERE json_extract_string(props, '$.k') = '7' GROUP BY event),
      x AS (SELECT event_type AS event, count(*) AS events, count(DISTINCT user_id) AS users FROM events
        WHERE json_extract_string(props, '$.k') = '7' GROUP BY event_type)
    SELECT coalesce(o.event, x.event) AS event, coalesce(o.events, 0) AS events, coalesce(o.users, 0) AS users,
      coalesce(x.events, 0) AS expected_events, coalesce(x.users, 0) AS expected_users,
      coalesce(o.events, 0) = coalesce(x.events, 0) AND coalesce(o.users, 0) = coalesce(x.users, 0) AS ok
    FROM o FULL JOIN x ON o.event = x.event""",
    "negative_checks": """SELECT count(*) FILTER (WHERE event_id % 17 = 0) AS missing_identity,
      count(*) FILTER (WHERE event_id % 19 = 0) AS missing_event_time,
      count(*) FILTER (WHERE event_id % 23 = 0 AND event_id % 19 <> 0) AS suspicious_future_time FROM events""",
    "bench_width_text": f"{EV} SELECT count(*) AS events FROM ev WHERE {WIDTH} > 1000",
    "bench_width_typed": f"{EV} SELECT count(*) AS events FROM ev WHERE TRY_CAST(screen_width_text AS INTEGER) > 1000",
    "bench_range_text": f"{EV} SELECT count(*) AS events FROM ev WHERE CAST(ds AS VARCHAR) >= '2024-01-05' AND CAST(ds AS VARCHAR) < '2024-01-20'",
    "bench_range_typed": f"{EV} SELECT count(*) AS events FROM ev WHERE ds >= DATE '2024-01-05' AND ds < DATE '2024-01-20'",
    "bench_avg_text": f"{EV} SELECT round(avg({WIDTH}), 6) AS mean_width FROM ev WHERE screen_width_text <> ''",
    "bench_avg_typed": f"{EV} SELECT round(avg(TRY_CAST(screen_width_text AS INTEGER)), 6) AS mean_width FROM ev",
    "bench_wifi_text": f"{EV} SELECT count(*) AS events FROM ev WHERE wifi_text = 'true'",
    "bench_wifi_typed": f"{EV} SELECT count(*) AS events FROM ev WHERE wifi_text = 'true'",
    "bench_days_text": f"{EV} SELECT CAST(ds AS VARCHAR) AS ds, count(*) AS events FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "bench_days_typed": f"{EV} SELECT CAST(ds AS VARCHAR) AS ds, count(*) AS events FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "field_diff": FIELD_DIFF_ORACLE,
    "name_variants": f"""{EV}, n AS (SELECT CASE event_id % 8 WHEN 0 THEN upper(event)
        WHEN 1 THEN concat(event, '-') WHEN 2 THEN '登录' WHEN 3 THEN '登-录' WHEN 4 THEN '注销' WHEN 5 THEN '!?' WHEN 6 THEN '--' ELSE event END AS event FROM ev),
      r AS (SELECT event, lower(regexp_replace(event, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS norm, count(*) AS rows FROM n GROUP BY 1, 2),
      c AS (SELECT *, count(*) OVER (PARTITION BY norm) AS spellings FROM r)
    SELECT norm, event, spellings, rows FROM c WHERE spellings > 1 AND norm <> ''""",
    "identity_split": f"""{EV} SELECT device_id, count(DISTINCT distinct_id) AS ids FROM ev
      GROUP BY device_id HAVING count(DISTINCT distinct_id) > 1""",
    "delay_distribution": f"""{EV} SELECT count(*) AS rows, min(delay_s) AS min_s, max(delay_s) AS max_s,
      count(*) FILTER (WHERE delay_s > 3600) AS late_rows, round(quantile_cont(delay_s, 0.5), 6) AS p50,
      round(quantile_cont(delay_s, 0.95), 6) AS p95, round(quantile_cont(delay_s, 0.99), 6) AS p99 FROM ev""",
    "delay_outlier": f"""{EV}, d AS (SELECT {OUTLIER} AS v FROM ev) SELECT count(*) AS rows, min(v) AS min_s, max(v) AS max_s,
      count(*) FILTER (WHERE v > 3600) AS late_rows, round(quantile_cont(v, 0.5), 6) AS p50,
      round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM d""",
    "two_path_totals": f"""{EV}, a AS (SELECT CAST(epoch(ds) AS BIGINT) AS w, event, count(*) AS n,
        count(DISTINCT distinct_id) AS u FROM ev GROUP BY 1, 2),
      b AS (SELECT CAST(epoch(ds) AS BIGINT) AS w, event, count(*) AS n, count(DISTINCT distinct_id) AS u FROM ev
        WHERE event <> 'signup' OR app_id = '{APP_ID}' GROUP BY 1, 2)
    SELECT coalesce(a.w, b.w) AS window_start, coalesce(a.event, b.event) AS event,
      coalesce(a.n, 0) AS a_rows, coalesce(a.u, 0) AS a_users, coalesce(b.n, 0) AS b_rows, coalesce(b.u, 0) AS b_users,
      coalesce(a.n, 0) - coalesce(b.n, 0) AS rows_diff, coalesce(a.u, 0) - coalesce(b.u, 0) AS users_diff
    FROM a FULL JOIN b ON a.w = b.w AND a.event = b.event""",
    "ordered_funnel": funnel_oracle(6),
    "ordered_funnel_24h": funnel_oracle(24),
    "retention": f"""{EV}, c AS (SELECT distinct_id, min(ds) AS cohort FROM ev WHERE event = 'signup' GROUP BY 1),
      n AS (SELECT cohort, count(*) AS cohort_size FROM c GROUP BY 1),
      d AS (SELECT c.cohort, datediff('day', c.cohort, ev.ds) AS day_n, count(DISTINCT ev.distinct_id) AS users
        FROM ev JOIN c ON ev.distinct_id = c.distinct_id WHERE ev.ds >= c.cohort GROUP BY 1, 2)
    SELECT CAST(d.cohort AS VARCHAR) AS cohort, CAST(day_n AS INTEGER) AS day_n, users, cohort_size,
      round(CAST(users AS DOUBLE) / CAST(cohort_size AS DOUBLE), 6) AS rate FROM d JOIN n ON d.cohort = n.cohort""",
    "unique_devices": f"{EV} SELECT count(DISTINCT device_id) AS devices, count(*) AS events FROM ev",
    "segment_rollup": f"""{EV} SELECT os, app_version, count(*) AS events, count(DISTINCT distinct_id) AS users,
      CAST(grouping(os, app_version) AS BIGINT) AS level FROM ev GROUP BY ROLLUP (os, app_version)""",
    "day_boundary": f"""{EV} SELECT event, count(*) FILTER (WHERE CAST(time + INTERVAL 8 HOUR AS DATE) <> ds) AS moved,
      count(*) AS events FROM ev GROUP BY event""",
}
