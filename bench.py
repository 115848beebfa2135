"""Time the headline queries and print one JSON line.

Tables are written to a scratch folder first, so the timings cover the queries alone: the
event table in its all-text and its typed form (repeated twenty times), the sorted event layout,
and raw messages. ``ingest``, ``append_batch`` and ``stream_flush`` include their writes. Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from tidemark.operators import dedup, migrate, profiles
from tidemark.operators.ingest import ingest
from tidemark.plans import behavior, metrics, quality
from tidemark.schema import event_rows
from tidemark.session import ensure_checkpoint_dir, get_session, scratch_dir
from tidemark.sources import messages as source
from tidemark.sources import tables
from tidemark.streaming import flush
from tidemark.workload import pipelines, reports
from tidemark.workload.fixture import APP_ID, FUNNEL, PURCHASE, event_view, with_first_day
from tidemark.workload.messages import MAX_BYTES, messages, with_copies

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
COPIES = 20


def prepare(spark):
    """Write the input tables; returns a reader per table."""
    root = scratch_dir(spark, "bench")
    view = with_first_day(event_view(spark, SF_DIR)).withColumn("user_id", F.col("distinct_id"))
    tables.write_events(view, f"{root}/events")
    # Repeated, so that the scan outweighs the start of a job.
    copies = F.explode(F.sequence(F.lit(1), F.lit(COPIES)))
    legacy = reports.legacy_table(spark, SF_DIR).withColumn("copy", copies).drop("copy")
    legacy.repartition(int(CPUS)).write.parquet(f"{root}/text")
    migrate.typed_events(spark.read.parquet(f"{root}/text")).write.parquet(f"{root}/typed")
    with_copies(messages(spark, SF_DIR)).repartition(int(CPUS)).write.parquet(f"{root}/messages")
    return root


def workloads(spark, root):
    def events():
        return spark.read.parquet(f"{root}/events")

    def text():
        return spark.read.parquet(f"{root}/text")

    def typed():
        return spark.read.parquet(f"{root}/typed")

    def decoded():
        return source.decode(spark.read.parquet(f"{root}/messages"), MAX_BYTES)

    def ingested():
        """The whole job: decode, refusals, duplicates, new columns, sorted write."""
        path = scratch_dir(spark, "bench-ingest")
        ingest(spark.read.parquet(f"{root}/messages"), path, "batch-0", max_bytes=MAX_BYTES)
        return tables.read_events(spark, f"{path}/events").limit(1)

    def appended():
        path = scratch_dir(spark, "bench-append")
        tables.append_batch(events().drop("ds_month"), path, "batch-0")
        return tables.read_events(spark, path).limit(1)

    def streamed():
        """One flush of all messages, with a horizon."""
        path = scratch_dir(spark, "bench-stream")
        stream = flush.read_messages(spark, f"{root}/messages")
        flush.start_event_flush(stream, f"{path}/out", f"{path}/checkpoint", every=None, horizon="10 minutes").awaitTermination()
        return flush.read_flushed(spark, f"{path}/out").limit(1)

    def upsert():
        store = profiles.ProfileStore(spark, scratch_dir(spark, "bench-profiles"), buckets=8)
        store.upsert(pipelines.customer_records(spark, SF_DIR), "seed-0")
        store.upsert(pipelines.order_records(spark, SF_DIR), "orders-1")
        return store.read()

    return {
        "bench_width_text": lambda: metrics.wide_screens_text(text()),
        "bench_width_typed": lambda: metrics.wide_screens_typed(typed()),
        "bench_range_text": lambda: metrics.days_between_text(text(), "2024-01-05", "2024-01-20"),
        "bench_range_typed": lambda: metrics.days_between_typed(typed(), "2024-01-05", "2024-01-20"),
        "bench_avg_text": lambda: metrics.mean_width_text(text()),
        "bench_avg_typed": lambda: metrics.mean_width_typed(typed()),
        "bench_wifi_text": lambda: metrics.wifi_text(text()),
        "bench_wifi_typed": lambda: metrics.wifi_typed(typed()),
        "bench_days_text": lambda: metrics.last_days(text()),
        "bench_days_typed": lambda: metrics.last_days(typed()),
        "kpi_summary": lambda: metrics.kpi_summary(events(), PURCHASE, APP_ID),
        "hourly_trend": lambda: metrics.hourly_trend(events(), APP_ID),
        "daily_active": lambda: metrics.daily_active(events(), APP_ID),
        "top_events": lambda: metrics.top_events(events(), app_id=APP_ID),
        "funnel_stages": lambda: metrics.funnel_stages(events(), FUNNEL, APP_ID),
        "share_country": lambda: metrics.share(events(), "country", APP_ID),
        "ordered_funnel": lambda: behavior.ordered_funnel(events(), reports.FUNNEL_STEPS, 6 * 3600),
        "retention": lambda: behavior.retention(events(), "signup"),
        "segment_rollup": lambda: behavior.segment_rollup(events(), ["os", "app_version"]),
        "delay_distribution": lambda: quality.delay_distribution(events(), 3600),
        "decode": lambda: event_rows(source.event_records(decoded())),
        "ingest": ingested,
        "append_batch": appended,
        "stream_flush": streamed,
        "dedup_exact": lambda: dedup.drop_exact_duplicates(source.event_records(decoded())),
        "profile_merge": lambda: profiles.profile_changes(pipelines.order_records(spark, SF_DIR)),
        "profile_upsert": upsert,
    }


def run(query) -> float:
    start = time.perf_counter()
    query().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    settings = {
        "spark.master": f"local[{CPUS}]",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": CPUS,
    }
    spark = get_session("tidemark-bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    root = prepare(spark)
    report = migrate.storage_report(spark, {n: f"{root}/{n}" for n in ("text", "typed")}).filter("column = '*'")
    stored = {r["table"]: r["compressed_bytes"] for r in report.collect()}
    seconds = {}
    for name, query in workloads(spark, root).items():
        run(query)
        seconds[name] = round(statistics.median(run(query) for _ in range(RUNS)), 4)
    print(
        json.dumps(
            {
                "metric": "total of median seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "file_bytes": stored,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
