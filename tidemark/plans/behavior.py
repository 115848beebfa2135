"""User behaviour: ordered funnels, retention, devices, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


MICROS = 1_000_000


def ordered_funnel(
    df: DataFrame, steps: list[str], horizon_seconds: int, cell_seconds: int | None = None
) -> DataFrame:
    """Users who get through the steps in strict time order within the horizon.

    A user reaches step k when some chain of events 1..k in strictly rising time spans at
    most the horizon. Time is cut into cells. Running maxima inside each (user, cell) give
    its summary: the latest start of chains that end in it, and the earliest ends of chains
    that come in from before. A second pass over each user's cells, in order, carries the
    latest starts forward. No events are paired with each other, a hot user's events are
    spread over its cells, and equal (user, step, time) rows fold before the shuffle. The
    cell width changes the speed only: events per cell against cells per user.
    """
    if not steps or len(set(steps)) != len(steps):
        raise ValueError("funnel steps must be one or more different event names")
    if horizon_seconds <= 0:
        raise ValueError("the horizon must be positive")
    horizon = horizon_seconds * MICROS
    cell = (cell_seconds or max(60, horizon_seconds // 64)) * MICROS
    cells = _cell_summaries(_moments(df, steps, cell), len(steps), horizon)
    reached = _reached(cells, len(steps), horizon)
    counts = reached.agg(
        *[F.count_if(f"reached{k}").alias(f"n{k}") for k in range(1, len(steps) + 1)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("step_no"), F.lit(name).alias("event"), F.col(f"n{k}").alias("users")
            )
            for k, name in enumerate(steps, 1)
        ]
    )
    return counts.select(F.inline(rows))


def _moments(df: DataFrame, steps: list[str], cell: int) -> DataFrame:
    """Distinct (user, step, time in microseconds), with the cell of the time."""
    step = F.lit(None).cast("int")
    for number, name in enumerate(steps, 1):
        step = F.when(F.col("event") == name, number).otherwise(step)
    found = df.filter(F.col("event").isin(steps)).select(
        "distinct_id", step.alias("step"), F.unix_micros("time").alias("t")
    )
    return found.distinct().withColumn("cell", F.expr(f"t div {cell}L"))


def _cell_summaries(moments: DataFrame, n: int, horizon: int) -> DataFrame:
    """Per (user, cell): ``start{k}``, ``near{k}`` and ``end{i}_{k}``.

    start: latest start of a chain 1..k inside the cell; near: whether one fits the horizon;
    end: earliest time at which steps i+1..k are done inside the cell.
    """
    earlier = (
        Window.partitionBy("distinct_id", "cell")
        .orderBy("t")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    step = F.col("step")
    rows = moments.withColumn("start", F.when(step == 1, F.col("t"))).withColumns(
        {f"from{i}": step == i + 1 for i in range(1, n)}
    )
    for k in range(2, n + 1):
        before = step == k - 1
        ending = {"start": F.max(F.when(before, F.col("start"))).over(earlier)}
        for i in range(1, k - 1):
            linked = F.bool_or(F.when(before, F.col(f"from{i}"))).over(earlier)
            ending[f"from{i}"] = F.coalesce(linked, F.lit(False))
        rows = rows.withColumns(
            {name: F.when(step == k, value).otherwise(F.col(name)) for name, value in ending.items()}
        )
    summary = []
    for k in range(1, n + 1):
        here = F.when(step == k, F.col("start"))
        summary.append(F.max(here).alias(f"start{k}"))
        summary.append(F.coalesce(F.bool_or(F.col("t") - here <= horizon), F.lit(False)).alias(f"near{k}"))
        for i in range(1, k):
            done = F.when((step == k) & F.col(f"from{i}"), F.col("t"))
            summary.append(F.min(done).alias(f"end{i}_{k}"))
    return rows.groupBy("distinct_id", "cell").agg(*summary)


def _reached(cells: DataFrame, n: int, horizon: int) -> DataFrame:
    """Per user, whether each step is reached: ``carry{k}`` is the latest start of a chain
    1..k that ended in an earlier cell."""
    earlier = (
        Window.partitionBy("distinct_id")
        .orderBy("cell")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for k in range(1, n):
        best = F.col(f"start{k}")
        for i in range(1, k):
            best = F.greatest(best, F.when(F.col(f"end{i}_{k}").isNotNull(), F.col(f"carry{i}")))
        cells = cells.withColumn("best", best).withColumn(f"carry{k}", F.max("best").over(earlier))
    reached = []
    for k in range(1, n + 1):
        hit = F.col(f"near{k}")
        for i in range(1, k):
            in_time = F.col(f"end{i}_{k}") - F.col(f"carry{i}") <= horizon
            hit = hit | F.coalesce(in_time, F.lit(False))
        reached.append(F.bool_or(hit).alias(f"reached{k}"))
    return cells.groupBy("distinct_id").agg(*reached)


def retention(df: DataFrame, cohort_event: str) -> DataFrame:
    """Users of each cohort day seen again n days later.

    Rows are first reduced to one per user and day, so the largest group behind the window
    is the number of days, however hot the user.
    """
    days = df.groupBy("distinct_id", "ds").agg(
        F.bool_or(F.col("event") == cohort_event).alias("joined")
    )
    per_user = Window.partitionBy("distinct_id")
    cohort = F.min(F.when(F.col("joined"), F.col("ds"))).over(per_user)
    cells = (
        days.withColumn("cohort", cohort)
        .withColumn("day_n", F.datediff("ds", "cohort"))
        .filter(F.col("day_n") >= 0)
        .groupBy("cohort", "day_n")
        .agg(F.count(F.lit(1)).alias("users"))
    )
    # Every member is active on day 0, so the day 0 cell holds the cohort size.
    by_day = Window.partitionBy("cohort").orderBy("day_n")
    size = F.first("users").over(by_day)
    return cells.withColumn("cohort_size", size).withColumn(
        "rate", F.round(F.col("users").cast("double") / F.col("cohort_size").cast("double"), 6)
    )


def unique_devices(df: DataFrame, relative_sd: float = 0.05) -> DataFrame:
    """Exact distinct non-empty devices, with the sketch estimate beside it."""
    device = F.when(F.col("device_id") != "", F.col("device_id"))
    per_device = df.groupBy(device.alias("device")).agg(F.count(F.lit(1)).alias("events"))
    return per_device.agg(
        F.count("device").alias("devices"),
        F.approx_count_distinct("device", relative_sd).alias("devices_approx"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
    )


def segment_rollup(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and exact users per segment, with subtotals.

    Rows are reduced to one per segment and user before the rollup multiplies them.
    """
    per_user = df.groupBy(*columns, "distinct_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.rollup(*columns).agg(
        F.sum("n").alias("events"),
        F.countDistinct("distinct_id").alias("users"),
        F.grouping_id().alias("level"),
    )
