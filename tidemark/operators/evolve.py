"""Schema growth: which columns a batch adds to a table, as text or with inferred types."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import detect
from tidemark.functions.coerce import any_event_millis, event_date
from tidemark.functions.variant import once
from tidemark.schema import EVENT_CORE, EVENT_TEXT, PARSED, column_value, other_properties, taken_names

# Names a column may have; the typed path also takes dollar signs.
TEXT_NAME = r"\A[A-Za-z0-9_]{1,64}\z"
TYPED_NAME = r"\A[A-Za-z0-9_$]{1,64}\z"

MAX_COLUMNS = 1000


def valid_name(key: Column, typed: bool = False) -> Column:
    return key.rlike(TYPED_NAME if typed else TEXT_NAME)


def leaf_rows(records: DataFrame, *ids: str) -> DataFrame:
    """One row per property: the id columns, key, kind, text."""
    return records.select(*ids, F.inline("leaves"))


def key_counts(records: DataFrame) -> DataFrame:
    """(column, rows) for each key of the records.

    Keys are counted by a partial aggregate; only distinct keys are shuffled.
    """
    return leaf_rows(records).groupBy(F.col("key").alias("column")).agg(F.count(F.lit(1)).alias("rows"))


def fresh_text_columns(counts: DataFrame, known: Collection[str]) -> DataFrame:
    """(column, type, definition, rows) for each valid key that is not a column yet."""
    fresh = counts.filter(valid_name(F.col("column")) & ~F.col("column").isin(sorted(known)))
    name = F.lit(detect.STRING)
    return fresh.select(
        "column",
        name.alias("type"),
        detect.column_definition(F.col("column"), name).alias("definition"),
        "rows",
    )


def new_text_columns(records: DataFrame, known: Collection[str]) -> DataFrame:
    """``fresh_text_columns`` of the records' keys."""
    return fresh_text_columns(key_counts(records), known)


def rare_columns(held: Mapping[str, int], rows: int) -> set[str]:
    """The columns that only a few of a batch's rows hold, given how many hold each.

    Rows without them can be stored narrow. The columns are those that leave the fewest cells, were
    every value of theirs in a row of its own; none if that would not halve the cells.
    """
    order = sorted(held, key=lambda name: (-held[name], name))
    left, cells = sum(held.values()), []
    for n, name in enumerate(order):
        cells.append(rows * n + min(rows, left) * len(order))
        left -= held[name]
    fewest = min(cells, default=0)
    return set(order[cells.index(fewest) :]) if 0 < 2 * fewest <= rows * len(order) else set()


def infer_column_types(leaf_rows: DataFrame) -> DataFrame:
    """(column, type, samples): the type each key's samples agree on."""
    detected = leaf_rows.select(
        F.col("key").alias("column"), detect.detect_type(F.col("kind"), F.col("text")).alias("t")
    )
    return detected.groupBy("column").agg(
        detect.merge_types(F.col("t")).alias("type"), F.count(F.lit(1)).alias("samples")
    )


def new_typed_columns(records: DataFrame, known: Collection[str]) -> DataFrame:
    """As ``new_text_columns``, with types inferred from all samples."""
    types = infer_column_types(leaf_rows(records)).filter(
        valid_name(F.col("column"), typed=True) & ~F.col("column").isin(sorted(known))
    )
    return types.withColumn(
        "definition", detect.column_definition(F.col("column"), F.col("type"))
    )


def collect_columns(
    found: DataFrame, stored: Collection[str] = (), max_columns: int = MAX_COLUMNS, core: Collection[str] = EVENT_CORE
) -> list[tuple[str, str]]:
    """The (name, type) of the keys that become columns of a table that has ``stored`` ones.

    A key whose name differs from a column's or a reserved name only by case gets none, of new
    keys that differ only by case the first in order gets one, and beyond ``max_columns`` the
    most frequent do. The others stay in the map of other properties, so no batch is refused
    and no value is lost. The list is bounded by the limit.
    """
    taken = sorted(taken_names(stored, core))
    count = "rows" if "rows" in found.columns else "samples"
    name = F.lower("column")
    one = found.filter(~name.isin(taken)).groupBy(name.alias("lower")).agg(
        F.min_by(F.struct("column", "type", F.col(count).alias("n")), "column").alias("first")
    )
    room = max(0, max_columns - len(stored))
    rows = one.select("first.*").orderBy(F.desc("n"), "column").limit(room).collect()
    return sorted((row["column"], row["type"]) for row in rows)


def text_union(records: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """The given keys as text columns; an absent key is empty text."""
    wanted = [F.coalesce(F.col("props")[name], F.lit("")).alias(name) for name in columns]
    return records.select(*keep, *wanted)


def rejected_properties(props: Column) -> Column:
    """Properties whose key can never be a column; the record itself is kept."""
    return F.map_filter(props, lambda key, _: ~valid_name(key))


def typed_table(
    records: DataFrame, columns: Sequence[tuple[str, str]], received_at: str, *keep: str
) -> DataFrame:
    """Records as rows of the typed table: core columns, the given columns, other properties.

    Absent or unconvertible is NULL, times are whole seconds. A value that does not convert to
    its column's type is kept as text in ``other`` and counted in ``unconverted``.
    """
    # Only what is looked up: a map is searched entry by entry for every column.
    wanted = ["time", *[name for name, _ in columns if name not in EVENT_CORE]]
    by_key = F.map_from_entries(
        F.transform(
            F.filter("leaves", lambda e: e["key"].isin(wanted)),
            lambda e: F.struct(
                e["key"].alias("key"),
                F.struct(e["kind"].alias("kind"), e["text"].alias("text")).alias("value"),
            ),
        )
    )
    now_millis = F.unix_millis(F.col(received_at))
    with_keys = once(records, by_key=by_key)
    time_leaf = F.col("by_key")["time"]
    millis = any_event_millis(time_leaf["kind"], time_leaf["text"], now_millis)
    with_time = once(with_keys, event_time=F.timestamp_millis(millis))
    typed, failed = {}, []
    for name, type_name in columns:
        if name in EVENT_CORE:
            continue
        leaf = F.col("by_key")[name]
        value, error = detect.convert(leaf["kind"], leaf["text"], type_name)
        present = leaf.isNotNull() & (leaf["kind"] != "null")
        typed[name] = F.when(present, value)
        if type_name != detect.STRING:
            failed.append(F.when(present & error, F.lit(name)))
    converted = once(with_time, **typed) if typed else with_time
    lost = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    marked = once(converted, failed=lost)
    held = other_properties(F.col("props"), typed)
    kept_text = F.map_filter("props", lambda key, _: F.array_contains("failed", key))
    core = {name: column_value(name, F.col("props")) for name in (*PARSED, *EVENT_TEXT)}
    return marked.select(
        *keep,
        F.col("event_time").alias("time"),
        event_date(F.col("event_time")).alias("ds"),
        *[value.alias(name) for name, value in core.items()],
        *typed,
        F.map_concat(held, kept_text).alias("other"),
        F.size("failed").alias("unconverted"),
    )
