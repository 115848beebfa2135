"""Physical plans: what is read, shuffled and kept out of Python."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.plans import behavior, metrics, quality
from tidemark.sources import messages as source
from tidemark.workload.fixture import APP_ID, PURCHASE, event_view
from tidemark.workload.messages import messages

SF_DIR = "/root/testdata/sf0.001"

# These run jobs while they are built; their plans are covered by the parts they use.
RUN_JOBS = ("stream_", "profile_upsert", "layout_", "retention_1y", "append_", "storage_", "migrate_", "typed_sink", "ingest_roundtrip", "property_profile", "growth_", "user_table", "delete_stored", "retention_streamed", "compacted")
# The corpus operators have tests and a check of their own.
CORPUS = re.compile(r"op\d+_|pipeline$")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(RUN_JOBS) and not CORPUS.match(n)])
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for node in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def with_flag(df):
    return df.selectExpr("*", "event_id % 2 = 0 AS is_first_day")


def test_kpi_summary_shuffles_once_and_does_not_multiply_rows(spark):
    view = with_flag(event_view(spark, SF_DIR))
    as_of = F.lit("2024-01-30").cast("date")
    text = plan(metrics.kpi_summary(view, PURCHASE, APP_ID, as_of))
    assert "Expand" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_scans_read_only_what_is_used(spark):
    text = plan(metrics.daily_active(event_view(spark, SF_DIR), APP_ID))
    (schema,) = set(re.findall(r"ReadSchema: struct<(.*)>", text))
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_id", "ts", "user_id"}


def test_top_k_is_not_a_full_sort(spark):
    text = plan(metrics.top_events(event_view(spark, SF_DIR)))
    assert "TakeOrderedAndProject" in text and "Sort [" not in text


def test_funnel_shuffles_events_once_beyond_their_distinct(spark):
    view = event_view(spark, SF_DIR)
    text = plan(behavior.ordered_funnel(view, ["signup", "view", "click"], 3600))
    assert text.count("Exchange hashpartitioning") == 3
    assert text.count("Sort [") == 2
    assert "Join" not in text and "Expand" not in text


def test_decode_does_not_shuffle(spark):
    records = source.event_records(source.decode(messages(spark, SF_DIR)))
    assert "Exchange" not in plan(records)
    assert plan(records).count("map_from_entries") == 1


def test_quantiles_share_the_counted_values(spark):
    df = quality.delay_distribution(event_view(spark, SF_DIR), 10)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan parquet") <= 2


def test_no_bucket_holds_more_than_its_share(spark):
    values = spark.range(20_000).selectExpr("CASE WHEN id = 7 THEN 1000000000000000 ELSE id * id END AS v", "1L AS n")
    sizes = quality.quantile_buckets(values).groupBy("bucket").count()
    assert sizes.agg(F.max("count")).first()[0] < 20_000 * 0.01
