"""Behaviour and quality reports against brute force, on skewed random data."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import behavior, metrics, quality
from tidemark.sources import demo

START = dt.datetime(2024, 1, 1)


def random_events(seed, n=600):
    """A third of all rows belong to one user."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.34 else f"u{rng.randint(1, 25)}"
        at = START + dt.timedelta(seconds=rng.randint(0, 3 * 86400))
        rows.append((i, at, at.date(), rng.choice("abcdx"), user))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id INT, time TIMESTAMP, ds DATE, event STRING, distinct_id STRING")


def greedy(rows, steps, horizon):
    """Every first-step event starts a try; each later step takes the earliest match."""
    users = [set() for _ in steps]
    for _, start, _, event, user in rows:
        if event != steps[0]:
            continue
        at, limit = start, start + dt.timedelta(seconds=horizon)
        users[0].add(user)
        for k, name in enumerate(steps[1:], 1):
            later = [t for _, t, _, e, u in rows if u == user and e == name and at < t <= limit]
            if not later:
                break
            at = min(later)
            users[k].add(user)
    return [(k, name, len(users[k - 1])) for k, name in enumerate(steps, 1)]


@pytest.mark.parametrize("seed,steps,horizon,cell", [
    (1, "abc", 3600, None), (2, "abcd", 7200, 600), (3, "dcb", 600, 3600), (4, "ab", 1, None),
    (5, "abcd", 86400, None), (6, "a", 60, 7), (7, "xabc", 1800, 60), (8, "abcdx", 40000, 1000),
    (9, "abcd", 9000, 86400 * 5), (10, "bxa", 5000, 1),
])
def test_ordered_funnel(spark, seed, steps, horizon, cell):
    rows = random_events(seed)
    got = behavior.ordered_funnel(frame(spark, rows), list(steps), horizon, cell).collect()
    assert [tuple(r) for r in got] == greedy(rows, list(steps), horizon)


def test_funnel_boundaries(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [
        (0, at(0), START.date(), "a", "exact"), (1, at(60), START.date(), "b", "exact"),
        (2, at(0), START.date(), "a", "late"), (3, at(61), START.date(), "b", "late"),
        (4, at(5), START.date(), "a", "same"), (5, at(5), START.date(), "b", "same"),
        (6, at(9), START.date(), "b", "wrong"), (7, at(10), START.date(), "a", "wrong"),
    ]
    got = behavior.ordered_funnel(frame(spark, rows), ["a", "b"], 60).collect()
    assert [r["users"] for r in got] == [4, 1]
    empty = behavior.ordered_funnel(frame(spark, rows[:0]), ["a", "b"], 60).collect()
    assert [r["users"] for r in empty] == [0, 0]
    with pytest.raises(ValueError):
        behavior.ordered_funnel(frame(spark, rows), ["a", "a"], 60)


@pytest.mark.parametrize("values", [
    [5], [1, 2], [0] * 500 + [7], list(range(1000)), [-5, -5, 10**12, 3, 3, 3], [2**40 * i for i in range(50)],
])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v BIGINT")
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = quality.exact_quantiles(df, "v", probabilities).first()
    assert np.allclose(list(got), np.quantile(values, probabilities), rtol=1e-12, atol=1e-6)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "delay_s BIGINT")
    row = quality.delay_distribution(df, 10).first()
    assert row["rows"] == 0 and row["p50"] is None


def test_retention(spark):
    rows = random_events(11)
    got = {(r["cohort"], r["day_n"]): (r["users"], r["cohort_size"]) for r in behavior.retention(frame(spark, rows), "a").collect()}
    first = {}
    for _, _, ds, event, user in rows:
        if event == "a":
            first[user] = min(first.get(user, ds), ds)
    cells = {}
    for _, _, ds, _, user in rows:
        if user in first and ds >= first[user]:
            cells.setdefault((first[user], (ds - first[user]).days), set()).add(user)
    sizes = {d: list(first.values()).count(d) for d in first.values()}
    assert got == {key: (len(users), sizes[key[0]]) for key, users in cells.items()}


def test_two_path_totals_with_an_empty_path(spark):
    rows = random_events(12, 50)
    a = frame(spark, rows)
    got = quality.two_path_totals(a, a.limit(0), "1 day").agg(F.sum("a_rows"), F.sum("b_rows"), F.sum("b_users")).first()
    assert tuple(got) == (50, 0, 0)


def test_kpis_of_nothing(spark):
    df = frame(spark, []).withColumn("is_first_day", F.lit(True)).withColumn("revenue", F.lit(1.0)).withColumn("app_id", F.lit("x"))
    row = metrics.kpi_summary(df, "a", "x").first()
    assert (row["total_events"], row["users"], row["gmv"], row["paid_conversion"]) == (0, 0, 0.0, 0.0)


def test_demo_rows_are_inserted_once(spark):
    numbers = spark.range(240).withColumnRenamed("id", "number")
    anchor = F.lit("2024-06-30 12:00:00").cast("timestamp")
    none = spark.createDataFrame([("other",)], "app_id STRING")
    assert demo.seed_demo(none, numbers, anchor).count() == 240
    assert demo.seed_demo(none.unionAll(spark.createDataFrame([("demo",)], "app_id STRING")), numbers, anchor).count() == 0


def test_field_diff_statuses(spark):
    schema = "record_id INT, key STRING, value STRING, type STRING"
    sent = spark.createDataFrame([(1, "a", "x", "String"), (1, "b", "42", "Int64"), (1, "c", "y", "String"), (1, "d", None, "String")], schema)
    stored = spark.createDataFrame([(1, "a", "x", "String"), (1, "b", "42", "String"), (1, "c", "z", "String"), (1, "e", "n", "String"), (1, "d", None, "String")], schema)
    got = {r["key"]: r["status"] for r in quality.field_diff(sent, stored).collect()}
    assert got == {"a": "equal", "b": "type_changed", "c": "changed", "d": "equal", "e": "extra"}
    assert quality.field_diff(sent, stored.limit(0)).filter("status = 'missing'").count() == 4
    assert quality.field_diff(sent.limit(0), stored.limit(0)).count() == 0


@pytest.mark.parametrize("ranges", [1, 7, 1 << 20])
def test_field_diff_of_random_sides(spark, ranges):
    """Against a dictionary per side; nulls, swapped nulls, and rows without id or key."""
    rng = random.Random(ranges)
    sides = []
    for _ in range(2):
        side = {}
        for i in range(60):
            for key in "abc":
                if rng.random() < 0.9:
                    side[i, key] = rng.choice([("x", None), (None, "x"), ("x", "x")]) if i % 3 == 0 else ("v", "String")
        sides.append(side)
    none = {(None, "a"): ("x", "String"), (5, None): ("x", "String")}
    frames = [
        spark.createDataFrame([(*k, *v) for k, v in {**side, **none}.items()], "record_id INT, key STRING, value STRING, type STRING")
        for side in sides
    ]
    wanted = []
    for key in {*sides[0], *sides[1]}:
        a, b = sides[0].get(key), sides[1].get(key)
        status = "missing" if b is None else "extra" if a is None else "type_changed" if a[1] != b[1] else "changed" if a[0] != b[0] else "equal"
        wanted.append((*key, status))
    wanted += [(*key, status) for key in none for status in ("missing", "extra")]
    # One side may have wider ids than the other.
    got = quality.field_diff(frames[0], frames[1].withColumn("record_id", F.col("record_id").cast("bigint")), ranges)
    assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(map(str, wanted))


def test_field_diff_shuffles_little_when_little_changed(spark, tmp_path):
    records, keys = 20_000, 20
    pairs = spark.range(0, records, 1, 4).withColumn("key", F.explode(F.array(*[F.lit(str(i)) for i in range(keys)])))
    sent = pairs.select(F.col("id").alias("record_id"), "key", F.concat("id", "key").alias("value"), F.lit("String").alias("type"))
    stored = sent.withColumn("value", F.when((F.col("record_id") % 100 == 0) & (F.col("key") == "3"), "other").otherwise(F.col("value")))
    sent.write.parquet(str(tmp_path / "sent"))
    stored.write.parquet(str(tmp_path / "stored"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    got = quality.field_diff(*[spark.read.parquet(str(tmp_path / x)) for x in ("sent", "stored")])
    counts = {r["status"]: r["count"] for r in got.groupBy("status").count().collect()}
    assert counts == {"equal": records * keys - records // 100, "changed": records // 100}
    assert 0 < written() - before < 2 * records * keys / 10


def test_estimates_are_close(spark):
    df = spark.range(10000).select(F.col("id").alias("delay_s"), F.concat(F.lit("d"), F.col("id") % 500).alias("device_id"))
    row = quality.delay_estimate(df).first()
    assert abs(row["p50"] - 5000) < 50
    devices = behavior.unique_devices(df).first()
    assert devices["devices"] == 500 and abs(devices["devices_approx"] - 500) < 60


def test_demo_days_reach_back_beyond_year_one(spark):
    numbers = spark.createDataFrame([(0,), (3_500_000,), (5_913_000,), (6_300_000,)], "number BIGINT")
    rows = demo.demo_events(numbers, F.lit("2024-06-30 12:00:00").cast("timestamp"), "demo", "Demo")
    days = [row["demo_day"] for row in rows.orderBy("number").select("demo_day").collect()]
    since = "SELECT strftime(TIMESTAMP '2024-06-30 12:00:00' - INTERVAL 1 HOUR * (n * 3), '%Y-%m-%d') FROM (VALUES (0), (3500000), (5913000), (6300000)) t(n) ORDER BY n"
    assert days == [day for (day,) in duckdb.sql(since).fetchall()]
    assert days[0] == "2024-06-30" and days[2].startswith("0000-") and days[3].startswith("-")
