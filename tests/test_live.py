"""Live measures: merging of shares, bounds of top lists, value ranges."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import flush, live

AT = dt.datetime(2024, 1, 1)
EVENTS = "time TIMESTAMP, distinct_id STRING, event STRING, v BIGINT"


def feed(spark, root, rows, start):
    """One more file, and the stream over what is there."""
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{root}/in")
    start(stream, f"{root}/out", f"{root}/cp").awaitTermination()


def rows_of(seed, n, values):
    own = random.Random(seed)
    return [(AT + dt.timedelta(hours=own.randrange(96)), own.choice(["a", "b", None, *"cdefgh"]), own.choice(values), own.choice([own.randrange(-9, 9), own.randrange(10**6), None])) for _ in range(n)]


def test_users_keep_their_numbers_over_restarts(spark, tmp_path):
    root, rows = str(tmp_path), []
    for n in range(3):
        new = [*rows_of(n, 60, "xy"), (AT + dt.timedelta(days=n), f"only-{n}", "x", 0)]
        rows += new
        feed(spark, root, new, lambda e, out, cp: live.start_live_users(e, out, cp, every=None, buckets=4))
    days = {r["window_start"].date(): r["users"] for r in live.read_live_users(spark, f"{root}/out").collect()}
    want = Counter(t.date() for t, u in {(t.replace(hour=0), u) for t, u, *_ in rows if u})
    assert days == want
    whole = live.read_live_users(spark, f"{root}/out", AT, AT + dt.timedelta(days=2), by=F.lit("both")).first()
    assert whole["users"] == len({u for t, u, *_ in rows if u and t < AT + dt.timedelta(days=2)})


@pytest.mark.parametrize("head", [2, 5, 100])
def test_top_lists_are_exact_whatever_the_heads_hold(spark, tmp_path, head):
    root, rows = str(tmp_path), []
    values = ["hot"] * 30 + ["warm"] * 12 + [f"v{i}" for i in range(12)] + [None]
    for n in range(3):
        new = rows_of(n + 10, 200, values)
        rows += new
        feed(spark, root, new, lambda e, out, cp: live.start_live_top(e, out, cp, ["event"], every=None, width="2 days", head=head))
    for k in (1, 2, 4, 30):
        got = [tuple(r) for r in live.read_live_top(spark, f"{root}/out", "event", k).collect()]
        counts = Counter(r[2] for r in rows)
        assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k]
    heads = spark.read.parquet(f"{root}/out/heads")
    found, hidden = live._candidates(heads, 1)
    if head == 100:
        assert hidden == 0
    elif head == 5:  # the bound settles the first place without the other values
        assert 0 < found.count() < len(counts)
    assert live._candidates(heads, 30)[0] is None if head < 15 else True


def test_value_ranges_follow_the_order(spark):
    values = sorted({s * (2**e + d) for s in (1, -1) for e in range(62) for d in (-1, 0, 1)} | set(range(-200, 200)))
    got = [r["range"] for r in spark.createDataFrame([(v,) for v in values], "v BIGINT").coalesce(1).select(live.value_range(F.col("v")).alias("range")).collect()]
    assert got == sorted(got) and len(set(got)) <= 2 * 64 * 32
    spans: dict = {}
    for v, place in zip(values, got, strict=True):
        spans.setdefault(place, []).append(v)
    assert all(max(x) - min(x) <= max(map(abs, x)) / 32 for x in spans.values())


def test_quantiles_of_hours_are_exact_and_read_few_ranges(spark, tmp_path):
    root, rows = str(tmp_path), []
    for n in range(2):
        new = rows_of(n + 20, 300, "x")
        rows += new
        feed(spark, root, new, lambda e, out, cp: live.start_live_values(e, out, cp, "v", every=None))
    start, end = AT + dt.timedelta(hours=10), AT + dt.timedelta(hours=70)
    wanted = [0.0, 0.25, 0.5, 0.99, 1.0]
    frame = live.read_live_quantiles(spark, f"{root}/out", wanted, start, end)
    own = sorted(v for t, _, _, v in rows if v is not None and start <= t < end)
    got = frame.first()
    assert (got["rows"], got["low"], got["high"]) == (len(own), own[0], own[-1])
    for i, p in enumerate(wanted):
        at = p * (len(own) - 1)
        low, high = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
        assert got[f"q{i}"] == pytest.approx(low + (high - low) * (at - int(at)))
    plan = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [In(range" in plan or ", In(range" in plan


def test_quantiles_without_values(spark, tmp_path):
    feed(spark, str(tmp_path), [(AT, "a", "x", None)], lambda e, out, cp: live.start_live_values(e, out, cp, "v", every=None))
    row = live.read_live_quantiles(spark, f"{tmp_path}/out", [0.5]).first()
    assert row["rows"] == 0 and row["q0"] is None


def test_message_files_are_read_by_rows(spark, tmp_path):
    """A batch of the columnar reader would hold thousands of messages, each of up to megabytes."""
    root = str(tmp_path)
    sent = [(1, AT, "", '[{"event":"a","distinct_id":"u"}]'), (2, AT, "", "bad")]
    spark.createDataFrame(sent, flush.MESSAGE_SCHEMA).coalesce(1).write.parquet(f"{root}/in")
    before = spark.conf.get(flush.BY_ROWS)
    messages = flush.read_messages(spark, f"{root}/in")
    assert messages.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    query = flush.start_event_flush(messages, f"{root}/out", f"{root}/cp", every=None)
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "FileScan" in plan and "Batched: false" in plan and "ColumnarToRow" not in plan
    assert spark.conf.get(flush.BY_ROWS) == before
    assert [r["seq"] for r in flush.read_flushed(spark, f"{root}/out").collect()] == [1]
    assert [r["seq"] for r in flush.read_rejects(spark, f"{root}/out").collect()] == [2]
