"""User profiles: merge, upsert, delete, latest version, and the bucketed store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tidemark.operators.evolve import MAX_COLUMNS, collect_columns, valid_name
from tidemark.schema import USER_CORE, other_properties, user_rows
from tidemark.sources import tables

# Methods that change a profile, and tables rows may be deleted from.
MERGING = ["track_signup", "profile_set"]
TABLES = ["event", "user"]
USER_ID = r"\A[A-Za-z0-9_@.-]{1,128}\z"

STATE_SCHEMA = "distinct_id STRING, props MAP<STRING, STRING>, received_at TIMESTAMP"


def profile_changes(records: DataFrame) -> DataFrame:
    """(distinct_id, props, received_at): what a batch of profile messages changes.

    Every message marks its user; only merging methods contribute properties, the last
    arrival winning per key. The first aggregate folds a hot user's rows per key before the
    shuffle, so the second sees each key of a user once.
    """
    entries = F.when(F.col("method").isin(MERGING), F.map_entries("props"))
    latest = (
        records.select("distinct_id", "received_at", "seq", F.explode_outer(entries).alias("e"))
        .select("distinct_id", "received_at", "seq", "e.key", "e.value")
        .groupBy("distinct_id", "key")
        .agg(
            F.max_by("value", F.struct("received_at", "seq")).alias("value"),
            F.max("received_at").alias("received_at"),
        )
    )
    pairs = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))
    return latest.groupBy("distinct_id").agg(
        F.map_from_entries(pairs).alias("props"), F.max("received_at").alias("received_at")
    )


def changed_users(records: DataFrame) -> DataFrame:
    return records.select("distinct_id").distinct()


def overlay(old: Column, new: Column) -> Column:
    """Old properties under new ones; a NULL map is empty."""
    empty = F.create_map().cast("map<string,string>")
    newer = F.coalesce(new, empty)
    kept = F.map_filter(F.coalesce(old, empty), lambda k, _: ~F.map_contains_key(newer, k))
    return F.map_concat(kept, newer)


def upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The next state: changed users get their merged row, others keep theirs.

    Both sides hold one row per user, so one join replaces delete and insert. A user that
    was only marked and never had a property gets no row.
    """
    old = state.select(
        "distinct_id", F.col("props").alias("old_props"), F.col("received_at").alias("old_at")
    )
    joined = old.join(changes, "distinct_id", "full_outer")
    merged = joined.select(
        "distinct_id",
        overlay(F.col("old_props"), F.col("props")).alias("props"),
        F.coalesce("received_at", "old_at").alias("received_at"),
    )
    return merged.filter(F.size("props") > 0)


def split_delete_ids(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid ids, refused ids with the reason)."""
    length = F.octet_length("distinct_id")
    refused = F.when(length.isNull() | (length == 0) | (length > 128), "invalid_length").when(
        ~F.col("distinct_id").rlike(USER_ID), "invalid_character"
    )
    marked = ids.select("distinct_id").distinct().withColumn("reason", refused)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(
        F.col("reason").isNotNull()
    )


def delete_users(rows: DataFrame, table: str, ids: DataFrame) -> DataFrame:
    """Rows of ``table`` without those of the given valid ids."""
    if table not in TABLES:
        raise ValueError(f"rows cannot be deleted from table {table!r}")
    valid, _ = split_delete_ids(ids)
    return rows.join(valid, "distinct_id", "left_anti")


def latest_versions(rows: DataFrame) -> DataFrame:
    """The row with the largest ``last_visit_time`` per user; ``seq`` settles ties.

    An aggregate, so versions of a hot user fold before the shuffle.
    """
    names = rows.columns
    newest = F.max_by(F.struct(*names), F.struct("last_visit_time", "seq"))
    return rows.groupBy(F.col("distinct_id").alias("_id")).agg(newest.alias("row")).select("row.*")


CHANGE_SCHEMA = f"{STATE_SCHEMA}, deleted BOOLEAN"


PART_SCHEMA = "version BIGINT, kind STRING, name STRING, first BIGINT, bytes BIGINT"


class ProfileStore:
    """Current profiles in Parquet: a base, and parts with the changes of later batches.

    A batch appends its changes alone and then one line to the log; nothing that a reader may be
    reading is replaced. Parts fold by size: ``fan`` neighbours of one level become one part of
    the next, and all become a new base once they hold ``base_share`` of its bytes. So a reader
    meets few parts, and a byte of change is rewritten once a level and ``1 / base_share`` times
    on average with a base, whatever the size of the base. ``compact`` writes a base at once.

    Batches are named by their writer (``writer-number``, as ``streaming.flush`` does). A name
    that the log has was applied before, and is passed over; so a replay changes nothing, and
    two writers never meet under one number. One process writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, fan: int = 8, base_share: float = 0.5):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets
        self.fan = fan
        self.base_share = base_share

    def _lines(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(PART_SCHEMA).json(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def parts(self) -> list[Row]:
        """The parts that make up the profiles, in order: a base or the first change, then later ones.

        A part covers the versions from its ``first`` on; parts it covers are read no more.
        """
        lines = self._lines()
        if lines is None:
            return []
        base = lines.filter(F.col("kind") == "base").agg(F.max("version")).scalar()
        rows = lines.filter(F.col("version") >= F.coalesce(base, F.lit(0))).collect()
        live: list[Row] = []
        for row in sorted(rows, key=lambda r: r["version"]):
            live = [x for x in live if x["version"] < row["first"]] + [row]
        return live

    def applied(self, name: str) -> bool:
        lines = self._lines()
        return lines is not None and not lines.filter(F.col("name") == name).isEmpty()

    def _add(self, rows: DataFrame, version: int, kind: str, name: str, first: int) -> None:
        """Write a part, then its line in the log; before that nobody reads it."""
        path = f"{self.path}/{kind}/version={version}"
        rows.repartition(self.buckets, "distinct_id").write.mode("overwrite").parquet(path)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        size = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
        line = self.spark.createDataFrame([(version, kind, name, first, size)], PART_SCHEMA)
        line.coalesce(1).write.mode("append").json(f"{self.path}/log")

    def _folded(self, parts: list[Row]) -> DataFrame:
        """One row per user: later versions over earlier ones, deletions ending what came before.

        ``deleted`` says that a deletion ended all that earlier parts hold of the user.
        """
        if not parts:
            return self.spark.createDataFrame([], CHANGE_SCHEMA)
        rows = None
        for part in parts:
            own = self.spark.read.schema(CHANGE_SCHEMA).parquet(f"{self.path}/{part['kind']}/version={part['version']}")
            own = own.withColumn("version", F.lit(part["version"]).cast("bigint"))
            rows = own if rows is None else rows.unionByName(own)
        if len(parts) == 1:
            return rows.drop("version")
        # At most one row per user and part, and parts are few.
        versions = F.array_sort(F.collect_list(F.struct("version", "deleted", F.map_entries("props").alias("entries"), "received_at")))
        empty = F.create_map().cast("map<string,string>")

        def step(state: Column, change: Column) -> Column:
            own = F.map_from_entries(change["entries"])
            return F.when(change["deleted"], own).otherwise(overlay(state, own))

        users = rows.groupBy("distinct_id").agg(versions.alias("versions"))
        return users.select(
            "distinct_id",
            F.aggregate("versions", empty, step).alias("props"),
            F.element_at("versions", -1)["received_at"].alias("received_at"),
            F.exists("versions", lambda v: v["deleted"]).alias("deleted"),
        )

    def read(self) -> DataFrame:
        return self._folded(self.parts()).filter(F.size("props") > 0).drop("deleted")

    def _level(self, part: Row) -> int:
        return int(part["kind"].removeprefix("level")) if part["kind"] != "change" else 0

    def _fold(self) -> None:
        """Fold the newest parts while their sizes ask for it."""
        while True:
            parts = self.parts()
            later = [x for x in parts if x["kind"] != "base"]
            held = sum(x["bytes"] for x in parts if x["kind"] == "base")
            if len(later) >= self.fan and sum(x["bytes"] for x in later) >= self.base_share * held:
                return self.compact()
            newest = later[-self.fan :]
            if len(newest) < self.fan or len({self._level(x) for x in newest}) > 1:
                return None
            version, kind = newest[-1]["version"] + 1, f"level{self._level(newest[0]) + 1}"
            merged = self._folded(newest).filter(F.col("deleted") | (F.size("props") > 0))
            self._add(merged, version, kind, f"{kind} {version}", newest[0]["first"])

    def _append(self, changes: DataFrame, name: str) -> None:
        version = max((x["version"] for x in self.parts()), default=-1) + 1
        self._add(changes, version, "change", name, version)
        self._fold()

    def upsert(self, records: DataFrame, name: str) -> None:
        """Apply profile records under the batch's name; safe to repeat."""
        if not self.applied(name):
            changes = profile_changes(records).withColumn("deleted", F.lit(False))
            self._append(changes, name)

    def delete(self, ids: DataFrame, name: str) -> None:
        """Delete the profiles of the valid ids; what arrives later starts anew."""
        if not self.applied(name):
            valid, _ = split_delete_ids(ids)
            props = F.create_map().cast("map<string,string>").alias("props")
            self._append(valid.select("distinct_id", props, F.lit(None).cast("timestamp").alias("received_at"), F.lit(True).alias("deleted")), name)

    def compact(self) -> None:
        """Write the current profiles as a new base."""
        parts = self.parts()
        if len(parts) > 1:
            version = parts[-1]["version"] + 1
            base = self._folded(parts).filter(F.size("props") > 0).withColumn("deleted", F.lit(False))
            self._add(base, version, "base", f"base {version}", 0)

    def write_user_table(self, path: str, tz: str = "UTC", max_columns: int = MAX_COLUMNS) -> None:
        """The typed user table of the current profiles, sorted and indexed by id."""
        current = self.read()
        keys = current.select(F.explode(F.map_keys("props")).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("rows"))
        fresh = keys.filter(valid_name(F.col("column")) & ~F.col("column").isin(USER_CORE)).withColumn("type", F.lit("String"))
        columns = [name for name, _ in collect_columns(fresh, (), max_columns, USER_CORE)]
        other = other_properties(F.col("props"), columns, USER_CORE).alias("other")
        tables.write_users(user_rows(current, columns, tz, (other,)), path)
