"""Data-quality and reconciliation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import detect
from tidemark.functions.coerce import event_date

QUANTILE_BUCKETS = 256
SKETCH_ACCURACY = 10_000
DIGEST_RANGES = 1 << 20


def window_start(time: Column, width: str) -> Column:
    """Start of the tumbling window a time falls in."""
    return F.window(time, width)["start"]


def _marked(sent: DataFrame, stored: DataFrame, ranges: int) -> DataFrame:
    """Both sides as one table with ``side`` (0 sent, 1 stored) and the hash range of the record."""
    sides = [
        side.select("record_id", "key", "value", "type", F.lit(number).alias("side"))
        for number, side in enumerate((sent, stored))
    ]
    return sides[0].unionAll(sides[1]).withColumn("range", F.pmod(F.xxhash64("record_id"), F.lit(ranges)))


def differing_ranges(marked: DataFrame) -> DataFrame:
    """``range``: the ranges whose properties are not the same on both sides.

    A range's digest is the sum over its properties of two 64-bit hashes, so it folds before the
    shuffle and its order does not matter; halves are summed, which cannot overflow. Rows without
    id or key equal no others, so their ranges always differ.
    """
    content = ["record_id", "key", "value", F.col("value").isNull(), "type", F.col("type").isNull()]
    hashes = [F.xxhash64(F.lit(seed), *content) for seed in (1, 2)]
    halves = [half for h in hashes for half in (F.shiftright(h, 32), h.bitwiseAND(0xFFFFFFFF))]
    sign = 1 - 2 * F.col("side")
    sums = [F.sum(half * sign).alias(f"s{i}") for i, half in enumerate(halves)]
    alone = F.bool_or(F.col("record_id").isNull() | F.col("key").isNull()).alias("alone")
    digests = marked.groupBy("range").agg(*sums, alone)
    differs = F.col("alone")
    for i in range(len(halves)):
        differs |= F.col(f"s{i}") != 0
    return digests.filter(differs).select("range")


def field_diff(sent: DataFrame, stored: DataFrame, ranges: int = DIGEST_RANGES) -> DataFrame:
    """Status of every property of every record: sent against stored.

    Both inputs are ``(record_id, key, value, type)`` with unique keys per record. Digests per
    range of records tell where the sides differ; only properties of those ranges are shuffled
    and joined, all others are equal where they lie. The differing ranges are broadcast, so
    ``ranges`` bounds them; with far more differing records than ranges every range differs, and
    all properties meet in the join.
    """
    marked = _marked(sent, stored, ranges)
    differing = F.broadcast(differing_ranges(marked))
    near = marked.join(differing, "range", "left_semi")
    a, b = (
        near.filter(F.col("side") == number).select("record_id", "key", F.struct("value", "type").alias(name))
        for number, name in enumerate(("sent", "stored"))
    )
    status = (
        F.when(F.col("stored").isNull(), "missing")
        .when(F.col("sent").isNull(), "extra")
        .when(~F.col("sent.type").eqNullSafe(F.col("stored.type")), "type_changed")
        .when(~F.col("sent.value").eqNullSafe(F.col("stored.value")), "changed")
        .otherwise("equal")
    )
    joined = a.join(b, ["record_id", "key"], "full_outer").select("record_id", "key", status.alias("status"))
    same = marked.filter(F.col("side") == 0).join(differing, "range", "left_anti")
    return joined.unionAll(same.select("record_id", "key", F.lit("equal")))


def normal_name(name: Column) -> Column:
    """The letters and digits of a name, of any script, in lower case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def name_variants(df: DataFrame) -> DataFrame:
    """Event names that differ only in case or punctuation, one row per spelling.

    Rows are reduced to one per spelling first; spellings are never gathered in a list. Names
    without a letter or digit are no spellings of each other.
    """
    names = df.groupBy("event").agg(F.count(F.lit(1)).alias("rows"))
    names = names.withColumn("norm", normal_name(F.col("event")))
    groups = names.groupBy("norm").agg(F.count(F.lit(1)).alias("spellings"))
    several = groups.filter((F.col("spellings") > 1) & (F.col("norm") != ""))
    return names.join(several, "norm").select("norm", "event", "spellings", "rows")


def identity_split(df: DataFrame, by: str, id_column: str) -> DataFrame:
    """Values of ``by`` tied to more than one user id."""
    known = df.filter((F.col(by) != "") & (F.col(id_column) != ""))
    return (
        known.groupBy(by)
        .agg(F.countDistinct(id_column).alias("ids"))
        .filter(F.col("ids") > 1)
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``v, n``: how often each value of a column that isn't null occurs."""
    known = df.filter(F.col(column).isNotNull())
    return known.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def quantile_buckets(counts: DataFrame) -> DataFrame:
    """``v, n, total, bucket``: values dealt to buckets that hold about equally many.

    The cuts come from a quantile sketch of the distinct values, so an outlier takes no more room
    than any other value.
    """
    cuts = [i / QUANTILE_BUCKETS for i in range(1, QUANTILE_BUCKETS)]
    bounds = counts.agg(
        F.sum("n").alias("total"), F.percentile_approx("v", cuts, SKETCH_ACCURACY).alias("cuts")
    )
    marked = counts.withColumn("b", bounds.select(F.struct("*")).scalar())
    bucket = F.size(F.filter("b.cuts", lambda cut: cut <= F.col("v")))
    return marked.select("v", "n", F.col("b.total").alias("total"), bucket.alias("bucket"))


def count_quantiles(counts: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """One row ``q0, q1, ...`` of exact interpolated quantiles of counted integer values.

    A running total over the buckets tells which ones hold the wanted ranks, and only those are
    put in order. No task sorts more than the distinct values of one bucket.
    """
    spread = quantile_buckets(counts)
    positions = [F.lit(float(p)) * (F.col("total") - 1).cast("double") for p in probabilities]
    ranks = F.array_distinct(
        F.array(*[f(p).cast("bigint") for p in positions for f in (F.floor, F.ceil)])
    )
    in_order = Window.orderBy("bucket")
    hit = (
        spread.groupBy("bucket")
        .agg(F.sum("n").alias("size"), F.max("total").alias("total"))
        .withColumn("before", F.sum("size").over(in_order) - F.col("size"))
        .withColumn(
            "ranks",
            F.filter(
                ranks,
                lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")),
            ),
        )
        .filter(F.size("ranks") > 0)
        .select("bucket", "before", "ranks")
    )
    # At most two buckets per probability, so the broadcast is bounded.
    inside = Window.partitionBy("bucket").orderBy("v")
    found = (
        spread.join(F.broadcast(hit), "bucket")
        .withColumn("upto", F.col("before") + F.sum("n").over(inside))
        .select(
            "v",
            "total",
            F.explode(
                F.filter(
                    "ranks",
                    lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")),
                )
            ).alias("rank"),
        )
    )
    quantiles = []
    for i, p in enumerate(positions):
        below = F.max(F.when(F.col("rank") == F.floor(p), F.col("v"))).cast("double")
        above = F.max(F.when(F.col("rank") == F.ceil(p), F.col("v"))).cast("double")
        share = F.max(p - F.floor(p).cast("double"))
        quantiles.append((below + (above - below) * share).alias(f"q{i}"))
    return found.agg(*quantiles)


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """One row ``q0, q1, ...`` of exact interpolated quantiles of an integer column."""
    return count_quantiles(value_counts(df, column), probabilities)


def delay_distribution(df: DataFrame, late_s: int, delay: str = "delay_s") -> DataFrame:
    """Receipt minus event time: extremes, exact quantiles, late rows; all from one count by value."""
    counts = value_counts(df, delay)
    summary = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.min("v").alias("min_s"),
        F.max("v").alias("max_s"),
        F.coalesce(F.sum(F.when(F.col("v") > late_s, F.col("n"))), F.lit(0)).alias("late_rows"),
    )
    quantiles = count_quantiles(counts, [0.5, 0.95, 0.99])
    both = summary.withColumn("q", quantiles.select(F.struct("*")).scalar())
    named = [
        F.round(F.col(f"q.q{i}"), 6).alias(name) for i, name in enumerate(["p50", "p95", "p99"])
    ]
    return both.select("*", *named).drop("q")


def delay_estimate(df: DataFrame, delay: str = "delay_s", accuracy: int = 10000) -> DataFrame:
    """The same quantiles from a mergeable sketch, in one pass."""
    return df.agg(
        F.percentile_approx(delay, [0.5, 0.95, 0.99], accuracy).alias("quantiles")
    ).select(*[F.col("quantiles")[i].alias(n) for i, n in enumerate(["p50", "p95", "p99"])])


def property_profile(leaf_rows: DataFrame, records: Column) -> DataFrame:
    """Per key: records that have it, their share, values per type, and the merged type."""
    typed = leaf_rows.withColumn("t", detect.detect_type(F.col("kind"), F.col("text")))
    names = {
        "strings": detect.STRING,
        "bools": detect.BOOL,
        "ints": detect.INT,
        "floats": detect.FLOAT,
        "times": detect.TIME,
    }
    per_key = typed.groupBy("key").agg(
        F.count(F.lit(1)).alias("present"),
        *[F.count_if(F.col("t") == type_name).alias(n) for n, type_name in names.items()],
        detect.merge_types(F.col("t")).alias("type"),
    )
    share = F.col("present").cast("double") * 100 / records.cast("double")
    return per_key.withColumn("present_percent", F.round(share, 6))


def two_path_totals(a: DataFrame, b: DataFrame, width: str) -> DataFrame:
    """Rows and exact users per window and event on two paths, with the differences.

    The paths are counted in one aggregate, first per user, so no join is needed and a path
    without rows counts 0.
    """
    sides = [
        side.select(
            window_start(F.col("time"), width).alias("window_start"),
            "event",
            "distinct_id",
            F.lit(number).alias("side"),
        )
        for number, side in enumerate((a, b))
    ]
    per_user = sides[0].unionAll(sides[1]).groupBy("window_start", "event", "distinct_id").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")
    )
    totals = per_user.groupBy("window_start", "event").agg(
        F.sum("a").alias("a_rows"),
        F.count_if((F.col("a") > 0) & F.col("distinct_id").isNotNull()).alias("a_users"),
        F.sum("b").alias("b_rows"),
        F.count_if((F.col("b") > 0) & F.col("distinct_id").isNotNull()).alias("b_users"),
    )
    return totals.withColumn("rows_diff", F.col("a_rows") - F.col("b_rows")).withColumn(
        "users_diff", F.col("a_users") - F.col("b_users")
    )


def reject_windows(rejects: DataFrame, width: str) -> DataFrame:
    """Rejected messages per window and reason."""
    return rejects.groupBy(
        window_start(F.col("received_at"), width).alias("window_start"), "reason"
    ).agg(F.count(F.lit(1)).alias("messages"))


def count_events_and_users(df: DataFrame) -> DataFrame:
    return df.groupBy("event").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("distinct_id").alias("users")
    )


def with_property(df: DataFrame, properties: Column, key: str, value: str) -> DataFrame:
    """Rows whose property map holds the value, such as one validation run."""
    return df.filter(properties[key] == value)


def batch_reconcile(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts per event against an expected ``(event, events, users)`` list."""
    seen = count_events_and_users(observed)
    want = expected.select(
        "event", F.col("events").alias("expected_events"), F.col("users").alias("expected_users")
    )
    joined = seen.join(want, "event", "full_outer").fillna(
        0, ["events", "users", "expected_events", "expected_users"]
    )
    matches = (F.col("events") == F.col("expected_events")) & (
        F.col("users") == F.col("expected_users")
    )
    return joined.withColumn("ok", matches)


def negative_checks(df: DataFrame) -> DataFrame:
    """Rows that should not exist: no identity, no time, received before they happened."""
    early = F.col("received_at") < F.col("time") - F.expr("INTERVAL 1 DAY")
    return df.agg(
        F.count_if(F.col("distinct_id") == "").alias("missing_identity"),
        F.count_if(F.col("time").isNull()).alias("missing_event_time"),
        F.count_if(early).alias("suspicious_future_time"),
    )


def day_boundary(df: DataFrame, tz: str) -> DataFrame:
    """Rows per event whose UTC date differs from the date in ``tz``."""
    moved = event_date(F.col("time"), "UTC") != event_date(F.col("time"), tz)
    return df.groupBy("event").agg(F.count_if(moved).alias("moved"), F.count(F.lit(1)).alias("events"))
