"""The stored event table: layout, reads that prune, retention."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.session import staged
from tidemark.sources import footers

SORT = ["distinct_id", "event", "time"]
BLOOM = ["event", "distinct_id", "user_id"]


def month_of(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def with_month(events: DataFrame) -> DataFrame:
    return events.withColumn("ds_month", month_of(F.col("ds")))


def _writer(ordered: DataFrame, mode: str):
    writer = ordered.write.mode(mode).partitionBy("ds_month")
    for name in BLOOM:
        if name in ordered.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true")


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Bulk write: month folders, files that each cover a narrow range of the sort order.

    Range partitioning on the full sort order cuts a hot month or user over many tasks and
    keeps min/max statistics tight; it costs one sampling pass over the input, so give it a
    stored table rather than a long plan.
    """
    ranged = with_month(events).repartitionByRange("ds_month", *SORT)
    _writer(ranged.sortWithinPartitions("ds_month", *SORT), mode).parquet(path)


def append_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Small append: sorted where it is, without a shuffle."""
    _writer(with_month(events).sortWithinPartitions("ds_month", *SORT), mode).parquet(path)


def stored_schema(spark: SparkSession, path: str) -> dict[str, tuple[str, bool]]:
    """Column -> (Spark type, whether absent reads as empty text), as the table's record has them.

    The record lies beside the table, one small file for each batch that brought a column; it
    spares readers the footers of all files. The first type a column had stays. Empty if the
    table has no record.
    """
    try:
        rows = spark.read.schema("name STRING, type STRING, empty BOOLEAN, place INT").json(f"{path.rstrip('/')}_schema")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    found: dict[str, tuple[str, bool]] = {}
    for row in sorted(rows.collect(), key=lambda r: (r["place"], r["name"])):
        found.setdefault(row["name"], (row["type"], row["empty"]))
    return found


def append_batch(events: DataFrame, path: str, batch: str, empty_text: bool = False, narrow: DataFrame | None = None) -> None:
    """Write a batch under its own key, replacing what an earlier try wrote.

    Columns that are new to the table go into its record before the rows are written, so a
    reader never lacks a column that it finds. With ``empty_text`` text that older rows lack
    reads as empty. ``narrow`` are further rows of the batch, with some of the columns only; until
    they are written as well, a reader sees the others alone.
    """
    spark = events.sparkSession
    known = stored_schema(spark, path)
    fresh = [
        (field.name, field.dataType.simpleString(), empty_text and isinstance(field.dataType, T.StringType), len(known) + i)
        for i, field in enumerate(f for f in events.schema if f.name not in known)
    ]
    if fresh:
        record = spark.createDataFrame(fresh, "name STRING, type STRING, empty BOOLEAN, place INT")
        record.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_schema/batch={batch}")
    append_events(events, f"{path}/batch_id={batch}", mode="overwrite")
    if narrow is not None:
        append_events(narrow, f"{path}/batch_id={batch}")


def _stored(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """The table's rows, or those of some of its files, by the names ``inputFiles`` gives them."""
    schema = stored_schema(spark, path)
    if schema:
        events = spark.read.schema(", ".join(f"`{name}` {kind}" for name, (kind, _) in schema.items())).parquet(path)
    else:
        events = spark.read.option("mergeSchema", "true").parquet(path)
    if files is not None:
        # With the whole table's schema, so that folder names get the same types.
        events = spark.read.schema(events.schema).option("basePath", path).parquet(*map(unquote, files))
    if not schema:
        return events
    shown = [
        f"coalesce(`{name}`, '') AS `{name}`" if schema.get(name, ("", False))[1] else f"`{name}`"
        for name in events.columns
    ]
    return events.selectExpr(*shown)


def read_events(
    spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Events of the days from start up to, not including, end.

    A filter on ``ds`` alone does not prune the derived month folders, so the matching month
    range is added to it.
    """
    events = _stored(spark, path)
    if start is not None:
        events = events.filter(
            (F.col("ds_month") >= start.year * 100 + start.month) & (F.col("ds") >= F.lit(start))
        )
    if end is not None:
        last = end - dt.timedelta(days=1)
        events = events.filter(
            (F.col("ds_month") <= last.year * 100 + last.month) & (F.col("ds") < F.lit(end))
        )
    return events


def retained(events: DataFrame, as_of: Column) -> DataFrame:
    """Rows not older than one year by ``time``."""
    return events.filter(F.col("time") >= as_of - F.expr("INTERVAL 1 YEAR"))


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path
    return target, target(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _month_folders(spark: SparkSession, path: str) -> list[tuple[str | None, int]]:
    """(batch key, month) of every month folder, with or without batches above it."""
    target, fs = _file_system(spark, path)
    found = []
    for pattern in ("ds_month=*", "batch_id=*/ds_month=*"):
        for status in fs.globStatus(target(f"{path}/{pattern}")) or []:
            folder = status.getPath()
            above = folder.getParent().getName()
            batch = above.removeprefix("batch_id=") if "/" in pattern else None
            found.append((batch, int(folder.getName().split("=")[1])))
    return sorted(found, key=str)


def _folder(path: str, batch: str | None, month: int) -> str:
    return f"{path}/ds_month={month}" if batch is None else f"{path}/batch_id={batch}/ds_month={month}"


# Replacing folders. New files are complete in a hidden folder before a plan of moves is put beside
# them in one rename; from then on the replacement happens, by this call or by the next one.


def _move(fs, source, place) -> None:
    """One folder into its place, over what is there; nothing if that was done before."""
    if fs.exists(source):
        fs.delete(place, True)
        fs.rename(source, place)


def _drop(fs, place) -> None:
    fs.delete(place, True)


def _carry_out(spark: SparkSession, path: str, hidden: str) -> None:
    """Follow a hidden folder's plan. Every step may be repeated, so a stop between them is no loss.

    New folders come before old ones go: until the end a reader may see rows twice, none never.
    """
    target, fs = _file_system(spark, path)
    source = fs.open(target(f"{hidden}/_plan"))
    plan = json.loads(bytes(source.readAllBytes()).decode())
    source.close()
    for name, place in plan["moves"]:
        _move(fs, target(f"{hidden}/{name}"), target(f"{path}/{place}"))
    for place in plan["drops"]:
        _drop(fs, target(f"{path}/{place}"))
    _drop(fs, target(hidden))


def _replace(spark: SparkSession, path: str, hidden: str, moves: list[tuple[str, str]], drops: list[str]) -> None:
    """Move folders of the complete hidden folder to their places, then drop others."""
    target, fs = _file_system(spark, path)
    draft = target(f"{hidden}/_draft")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"moves": moves, "drops": drops}).encode()))
    out.close()
    fs.rename(draft, target(f"{hidden}/_plan"))
    _carry_out(spark, path, hidden)


def recover(spark: SparkSession, path: str) -> None:
    """Finish replacements that were stopped halfway, and remove those that had no plan yet.

    Every call that replaces folders starts with it; the table has one writing process.
    """
    target, fs = _file_system(spark, path)
    for status in fs.globStatus(target(f"{path}/_new-*")) or []:
        hidden = f"{path}/{status.getPath().getName()}"
        if fs.exists(target(f"{hidden}/_plan")):
            _carry_out(spark, path, hidden)
        else:
            _drop(fs, target(hidden))


def _relative(batch: str | None, month: int) -> str:
    return f"ds_month={month}" if batch is None else f"batch_id={batch}/ds_month={month}"


def _rewrite(spark: SparkSession, path: str, folders: list[tuple[str | None, int]], kept) -> None:
    """Replace the folders' rows by those that ``kept`` leaves of them; see ``_replace``."""
    if not folders:
        return
    target, fs = _file_system(spark, path)
    hidden = f"{path}/_new-{uuid.uuid4().hex}"
    old = _stored(spark, path)
    keys = ["batch_id", "ds_month"] if "batch_id" in old.columns else ["ds_month"]
    wanted = spark.createDataFrame(folders, "batch STRING, month INT")
    here = F.col("ds_month") == F.col("month")
    if len(keys) == 2:
        here &= F.col("batch_id").cast("string").eqNullSafe(F.col("batch"))
    rows = kept(old.join(F.broadcast(wanted), here, "left_semi")).sortWithinPartitions(*keys, *SORT)
    rows.write.partitionBy(*keys).parquet(hidden)
    places = [_relative(batch, month) for batch, month in folders]
    left = {place for place in places if fs.exists(target(f"{hidden}/{place}"))}
    _replace(spark, path, hidden, [(x, x) for x in places if x in left], [x for x in places if x not in left])


def apply_retention(spark: SparkSession, path: str, as_of: dt.datetime) -> list[int]:
    """Delete rows older than a year from the stored table; returns the months it removed whole.

    Month folders before the cutoff's month go as folders, wherever they lie; those around the
    cutoff are rewritten if they hold an expired row; later ones are not touched. The folders are
    listed by the driver. Times and folder dates may differ by the table's zone, so only months
    that ended two days before the cutoff go unread.
    """
    try:
        cutoff = as_of.replace(year=as_of.year - 1)
    except ValueError:
        cutoff = as_of.replace(year=as_of.year - 1, day=28)
    first_kept, last_cut = cutoff - dt.timedelta(days=2), cutoff + dt.timedelta(days=2)
    recover(spark, path)
    target, fs = _file_system(spark, path)
    folders = _month_folders(spark, path)
    expired = [x for x in folders if x[1] < first_kept.year * 100 + first_kept.month]
    near = [x for x in folders if x not in expired and x[1] <= last_cut.year * 100 + last_cut.month]
    for batch, month in expired:
        fs.delete(target(_folder(path, batch, month)), True)
    if near:
        old = _stored(spark, path).filter(F.col("ds_month").isin([m for _, m in near]) & (F.col("time") < F.lit(cutoff)))
        batch = F.col("batch_id").cast("string") if "batch_id" in old.columns else F.lit(None).cast("string")
        holding = [(r["batch"], r["ds_month"]) for r in old.select(batch.alias("batch"), "ds_month").distinct().collect()]
        _rewrite(spark, path, holding, lambda rows: rows.filter(F.col("time") >= F.lit(cutoff)))
    left = {month for _, month in _month_folders(spark, path)}
    return sorted({month for _, month in folders} - left)


def _files_within_reach(spark: SparkSession, bounds: DataFrame, ids: DataFrame) -> list[str]:
    """Files with a row group whose range of ids holds one of the given ids.

    Ids and range starts are put in one order over all tasks. In each task the next id after a
    start is a running minimum; where the task has none left, it is the first of a later task.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = bounds.filter("known").select(F.col("low").alias("at"), "file", "high")
    none = F.lit(None).cast("string")
    points = ids.select(F.col("distinct_id").alias("at"), none.alias("file"), none.alias("high")).unionAll(known)
    # A fixed number, since a merged partition would change its number from job to job.
    ordered = points.repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id())
    with staged(ordered, "delete-points") as points:
        own = F.when(F.col("file").isNull(), F.col("at"))
        onward = Window.partitionBy("part").orderBy(F.desc("at"))
        later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
        # One row a part, so the window without a key and the broadcast are bounded.
        firsts = points.groupBy("part").agg(F.min(own).alias("first")).select("part", F.min("first").over(later).alias("later"))
        starts = points.withColumn("next", F.min(own).over(onward)).filter("file IS NOT NULL").join(F.broadcast(firsts), "part")
        hit = starts.filter(F.coalesce("next", "later") <= F.col("high")).select("file").distinct()
        return [r["file"] for r in hit.collect()]


def delete_from_events(spark: SparkSession, path: str, ids: DataFrame) -> list[str]:
    """Delete the rows of the given valid ids (``distinct_id``) from the stored table.

    Only folders that hold such a row are rewritten. To find them, only files are read whose
    footers allow one of the ids; up to ``inFilterThreshold`` ids go to the scan as values, so it
    also skips row groups by their membership index. Returns the files that were read.
    """
    recover(spark, path)
    rows = _stored(spark, path)
    listed = rows.inputFiles()
    ids = ids.select("distinct_id").distinct()
    bounds = footers.text_bounds(spark, listed, "distinct_id")
    with staged(ids, "delete-ids") as ids, staged(bounds, "delete-bounds") as bounds:
        unknown = {r["file"] for r in bounds.filter("NOT known").select("file").distinct().collect()}
        read = sorted(unknown.union(_files_within_reach(spark, bounds, ids)))
        if not read:
            return read
        near = rows if len(read) == len(listed) else _stored(spark, path, read)
        few = int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold"))
        first = [r["distinct_id"] for r in ids.limit(few + 1).collect()]
        hit = near.filter(F.col("distinct_id").isin(first)) if len(first) <= few else near.join(ids, "distinct_id", "left_semi")
        batch = F.col("batch_id").cast("string") if "batch_id" in rows.columns else F.lit(None).cast("string")
        holding = [(r["batch"], r["ds_month"]) for r in hit.select(batch.alias("batch"), "ds_month").distinct().collect()]
        _rewrite(spark, path, holding, lambda kept: kept.join(ids, "distinct_id", "left_anti"))
    return read


def compact(spark: SparkSession, path: str) -> list[str]:
    """Merge batch folders into one, sorted as a bulk write; returns the keys that went.

    Keys are ``writer-number``. The newest batch of each writer stays as it is, since only that
    one can be written again.
    """
    recover(spark, path)
    keys = sorted({batch for batch, _ in _month_folders(spark, path) if batch is not None})
    newest: dict[str, int] = {}
    for key in keys:
        writer, _, number = key.rpartition("-")
        if number.isdigit():
            newest[writer] = max(newest.get(writer, -1), int(number))
    live = {f"{writer}-{number}" for writer, number in newest.items()}
    old = [key for key in keys if key not in live]
    if len(old) < 2:
        return []
    merged, hidden = f"merged{uuid.uuid4().hex}", f"{path}/_new-{uuid.uuid4().hex}"
    rows = _stored(spark, path).filter(F.col("batch_id").isin(old)).drop("batch_id", "ds_month")
    write_events(rows, f"{hidden}/rows")
    _replace(spark, path, hidden, [("rows", f"batch_id={merged}")], [f"batch_id={key}" for key in old])
    return old


USER_SORT = ["distinct_id"]


def write_users(users: DataFrame, path: str) -> None:
    """The user table: sorted by id, with a membership index on the ids."""
    ordered = users.repartitionByRange(*USER_SORT).sortWithinPartitions(*USER_SORT)
    writer = ordered.write.mode("overwrite")
    for name in ("distinct_id", "user_id"):
        if name in users.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def register_views(spark: SparkSession, events: DataFrame, users: DataFrame) -> None:
    """Open both tables to free SQL."""
    events.createOrReplaceTempView("event")
    users.createOrReplaceTempView("user")
