"""Profiles, stored tables, migration and streaming."""

import datetime as dt
import random
import time
import uuid
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup, evolve, migrate, profiles
from tidemark.operators.ingest import ingest, ingest_events
from tidemark.sources import footers, tables
from tidemark.sources import messages as source
from tidemark.session import scratch_dir
from tidemark.streaming import flush
from tidemark.workload import pipelines

AT = dt.datetime(2024, 1, 1)
RECORDS = "seq BIGINT, received_at TIMESTAMP, distinct_id STRING, method STRING, props MAP<STRING,STRING>"


def profile_rows(seed, n=200):
    rng = random.Random(seed)
    methods = ["profile_set", "track_signup", "profile_increment"]
    return [
        (i, AT + dt.timedelta(seconds=i // 3), "hot" if rng.random() < 0.4 else f"u{rng.randint(0, 9)}",
         rng.choice(methods), {rng.choice("abc"): str(i), rng.choice("abc"): f"{i}x"})
        for i in range(n)
    ]


def model(rows):
    state = {}
    for _, _, user, method, props in rows:
        if method in profiles.MERGING:
            state.setdefault(user, {}).update(props)
    return state


@pytest.mark.parametrize("cuts", [[], [100], [1, 2, 3, 50, 51, 199]])
def test_profiles_do_not_depend_on_batching(spark, tmp_path, cuts):
    rows = profile_rows(5)
    store = profiles.ProfileStore(spark, str(tmp_path / "s"), buckets=4)
    edges = [0, *cuts, len(rows)]
    for version, (start, end) in enumerate(zip(edges, edges[1:])):
        batch = spark.createDataFrame(rows[start:end], RECORDS)
        store.upsert(batch, f"w-{version}")
        store.upsert(batch, f"w-{version}")
    assert {r["distinct_id"]: r["props"] for r in store.read().collect()} == model(rows)


def test_parts_fold_by_size(spark, tmp_path):
    store = profiles.ProfileStore(spark, str(tmp_path / "s"), buckets=1, fan=3)
    seed = [(i, AT, f"s{i}", "profile_set", {"x": "y" * 40 + str(i)}) for i in range(3000)]
    store.upsert(spark.createDataFrame(seed, RECORDS), "seed-0")
    store.compact()
    store.upsert(spark.createDataFrame(seed[:1], RECORDS), "seed-1")
    store.compact()
    rows = [(10_000 + i, AT + dt.timedelta(seconds=i), f"u{i % 4}", "profile_set", {"k": str(i)}) for i in range(10)]
    for n, row in enumerate(rows):
        store.upsert(spark.createDataFrame([row], RECORDS), f"w-{n}")
        if n == 4:
            store.delete(spark.createDataFrame([("u0",), ("s7",)], "distinct_id STRING"), "d-0")
    parts = store.parts()
    # Small changes fold among themselves: few parts are left and the base is not written again.
    assert len(parts) <= 1 + 2 * 3 and [p["kind"] for p in parts].count("base") == 1
    assert sum(1 for _ in (tmp_path / "s" / "base").glob("version=*")) == 1
    assert any(p["kind"].startswith("level") for p in parts)
    written = sum(f.stat().st_size for kind in ("level1", "level2") for f in (tmp_path / "s").glob(f"{kind}/*/*.parquet"))
    assert written < next(p["bytes"] for p in parts if p["kind"] == "base")
    got = {r["distinct_id"]: r["props"] for r in store.read().collect()}
    assert len(got) == 3000 - 1 + 4 and "s7" not in got and got["u0"] == {"k": "8"} and got["u1"] == {"k": "9"}
    store.compact()
    assert {r["distinct_id"]: r["props"] for r in store.read().collect()} == got


def one_profile(spark, user, at, **props):
    return spark.createDataFrame([(at, AT + dt.timedelta(seconds=at), user, "profile_set", props)], RECORDS)


def test_writers_with_equal_numbers_do_not_meet(spark, tmp_path):
    store = profiles.ProfileStore(spark, str(tmp_path / "s"), buckets=2, fan=3)
    seed = one_profile(spark, "a", 1, x="1", y="1").union(one_profile(spark, "b", 1, x="2"))
    for name, batch in (("seed-0", seed), ("one-0", one_profile(spark, "a", 5, x="3")), ("two-0", one_profile(spark, "c", 6, x="4")), ("one-0", one_profile(spark, "a", 9, x="lost"))):
        store.upsert(batch, name)
    want = {"a": {"x": "3", "y": "1"}, "b": {"x": "2"}, "c": {"x": "4"}}
    assert {r["distinct_id"]: r["props"] for r in store.read().collect()} == want
    store.compact()
    assert {r["distinct_id"]: r["props"] for r in store.read().collect()} == want


def test_deleted_profiles_start_anew(spark, tmp_path):
    store = profiles.ProfileStore(spark, str(tmp_path / "s"), buckets=2)
    store.upsert(one_profile(spark, "a", 1, x="1", y="1").union(one_profile(spark, "b", 1, x="2")), "w-0")
    store.delete(spark.createDataFrame([("a",), ("b c",), ("b",)], "distinct_id STRING"), "gone-0")
    store.upsert(one_profile(spark, "a", 5, x="9"), "w-1")
    assert {r["distinct_id"]: r["props"] for r in store.read().collect()} == {"a": {"x": "9"}}


def test_marked_user_without_profile_gets_no_row(spark, tmp_path):
    store = profiles.ProfileStore(spark, str(tmp_path / "s"), buckets=2)
    store.upsert(spark.createDataFrame([(1, AT, "u", "profile_increment", {"a": "1"})], RECORDS), "w-0")
    assert store.read().count() == 0
    assert profiles.changed_users(spark.createDataFrame([(1, AT, "u", "other", {})], RECORDS)).count() == 1


def test_delete(spark):
    rows = spark.createDataFrame([("a@b.c",), ("a b",), ("x" * 128,), ("keep",)], "distinct_id STRING")
    ids = spark.createDataFrame([("a@b.c",), ("a b",), ("x" * 128,), ("y" * 129,), ("",), (None,)], "distinct_id STRING")
    left = profiles.delete_users(rows, "user", ids)
    assert sorted(r[0] for r in left.collect()) == ["a b", "keep"]
    _, refused = profiles.split_delete_ids(ids)
    assert {r["distinct_id"]: r["reason"] for r in refused.collect()} == {
        "a b": "invalid_character", "y" * 129: "invalid_length", "": "invalid_length", None: "invalid_length",
    }
    with pytest.raises(ValueError):
        profiles.delete_users(rows, "other", ids)


def event_rows(spark):
    return spark.range(2000).select(
        F.timestamp_seconds(F.lit(1672531200) + F.col("id") * 43200).alias("time"),
        F.concat(F.lit("e"), F.col("id") % 5).alias("event"),
        F.concat(F.lit("u"), F.col("id") % 50).alias("distinct_id"),
        F.lit("").alias("user_id"),
    ).withColumn("ds", F.to_date("time"))


def test_reads_prune_months(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_events(event_rows(spark), path)
    part = tables.read_events(spark, path, dt.date(2023, 3, 5), dt.date(2023, 4, 1))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ds_month" in plan
    months = {r[0] for r in part.select("ds_month").distinct().collect()}
    assert months == {202303}
    assert part.count() == 27 * 2
    assert part.schema["ds_month"].dataType.simpleString() == "int"


def test_retention_rewrites_only_the_boundary(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_events(event_rows(spark), path)
    late = {f.name for f in (tmp_path / "t" / "ds_month=202406").iterdir()}
    expired = tables.apply_retention(spark, path, dt.datetime(2024, 5, 10, 12))
    assert expired == [202301, 202302, 202303, 202304]
    assert {f.name for f in (tmp_path / "t" / "ds_month=202406").iterdir()} == late
    want = event_rows(spark).filter("time >= timestamp'2023-05-10 12:00:00'")
    got = tables.read_events(spark, path)
    assert got.select("time", "event").exceptAll(want.select("time", "event")).count() == 0
    assert got.count() == want.count()
    kept = tables.retained(event_rows(spark), F.lit(dt.datetime(2024, 5, 10, 12)))
    assert kept.count() == want.count()


def test_retention_drops_a_whole_boundary_month(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_events(event_rows(spark).filter("ds < '2023-03-15'"), path)
    tables.apply_retention(spark, path, dt.datetime(2024, 3, 31))
    assert not (tmp_path / "t" / "ds_month=202303").exists()


def test_batches_with_other_columns_read_together(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append_events(event_rows(spark).limit(10), path)
    tables.append_events(event_rows(spark).limit(10).withColumn("extra", F.lit("x")), path)
    assert tables.read_events(spark, path).filter("extra = 'x'").count() == 10


def test_bloom_filter_skips_absent_ids(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_events(event_rows(spark), path)
    plan = spark.read.parquet(path).filter("distinct_id = 'u7'")
    assert "PushedFilters: [IsNotNull(distinct_id), EqualTo(distinct_id,u7)]" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 40


def test_migration(spark, tmp_path):
    legacy = spark.createDataFrame(
        [("2024-01-01", "100", "true", "x"), ("2024-01-02", "abc", "maybe", "y"), ("2024-01-02", "", "", "z"), ("2024-01-03", "2147483648", "false", "w")],
        "ds STRING, screen_width STRING, wifi STRING, custom STRING",
    ).withColumn("time", F.to_timestamp("ds")).withColumn("event", F.lit("e")).withColumn("distinct_id", F.lit("u"))
    root = str(tmp_path / "m")
    checks = {r["check"]: (r["legacy"], r["typed"], r["lost"], r["ok"]) for r in migrate.migrate(spark, legacy, root, 1).collect()}
    assert checks == {"rows": (4, 4, 0, True), "screen_width": (3, 1, 2, True), "wifi": (3, 2, 1, True)}
    assert migrate.current(spark, root) is None
    migrate.swap(spark, root, 1)
    rows = migrate.current(spark, root).orderBy("ds", "custom").collect()
    assert [(r["screen_width"], r["wifi"], r["custom"]) for r in rows] == [(100, True, "x"), (None, None, "y"), (None, None, "z"), (None, False, "w")]
    assert rows[0]["ds"] == dt.date(2024, 1, 1)
    typed = migrate.typed_events(legacy).schema
    assert all(typed[f.name].dataType == f.dataType for f in migrate.TYPED_EVENT if f.name in typed.names)


def test_storage_report_has_the_footers_sizes(spark, tmp_path):
    path = tmp_path / "t"
    rows = event_rows(spark)
    for n in range(3):
        rows.repartition(2).write.mode("append").partitionBy("ds").parquet(str(path))
    want: dict = {}
    for file in path.rglob("*.parquet"):
        footer = pq.ParquetFile(file).metadata
        for g in range(footer.num_row_groups):
            for k in range(footer.num_columns):
                chunk = footer.row_group(g).column(k)
                own = want.setdefault(chunk.path_in_schema, [0, 0, 0])
                for i, size in enumerate((footer.row_group(g).num_rows, chunk.total_compressed_size, chunk.total_uncompressed_size)):
                    own[i] += size
    got = {r["column"]: r for r in migrate.storage_report(spark, {"t": str(path)}, files_per_task=5).collect()}
    assert {k: [r["rows"], r["compressed_bytes"], r["uncompressed_bytes"]] for k, r in got.items() if k != "*"} == want
    assert got["*"]["rows"] == 3 * rows.count() and got["*"]["compressed_bytes"] == sum(x[1] for x in want.values())
    assert got["*"]["ratio_percent"] == round(100 * got["*"]["compressed_bytes"] / got["*"]["uncompressed_bytes"], 2)
    values = {r["column"]: r["value_bytes"] for r in migrate.value_bytes({"t": spark.read.parquet(str(path))}).collect()}
    assert set(values) == set(rows.columns)


def message(seq, second, event, **props):
    text = '{"type":"track","event":"%s","distinct_id":"u%d"%s}' % (
        event, seq % 3, "".join(f',"{k}":"{v}"' for k, v in props.items()))
    return (seq, AT + dt.timedelta(seconds=second), "", text)


def write(spark, rows, path):
    spark.createDataFrame(rows, flush.MESSAGE_SCHEMA).write.mode("append").parquet(path)


def run_events(spark, root, **options):
    stream = flush.read_messages(spark, f"{root}/in")
    flush.start_event_flush(stream, f"{root}/out", f"{root}/cp", every=None, **options).awaitTermination()


def test_stream_grows_columns_and_keeps_late_events(spark, tmp_path):
    root = str(tmp_path)
    write(spark, [message(1, 0, "a"), message(1, 0, "a"), message(2, 1, "b")], f"{root}/in")
    run_events(spark, root)
    write(spark, [message(1, 0, "a"), message(3, 9, "c", time="1600000000", fresh="yes"), (9, AT, "", "bad")], f"{root}/in")
    run_events(spark, root)
    rows = flush.read_flushed(spark, f"{root}/out").collect()
    assert sorted(r["event"] for r in rows) == ["a", "a", "b", "c"]
    (late,) = [r for r in rows if r["event"] == "c"]
    assert late["fresh"] == "yes" and late["time"] == dt.datetime(2020, 9, 13, 12, 26, 40)
    assert spark.read.parquet(f"{root}/out/rejects").count() == 1


class Ended:
    def awaitTermination(self):
        pass


def test_parts_of_long_messages_take_little_disk(spark, tmp_path):
    rows = spark.range(16).select(
        F.col("id").alias("seq"),
        F.expr("timestamp'2024-01-01' + make_dt_interval(2 * id)").alias("received_at"),
        F.lit("").alias("data_list"),
        F.concat(F.col("id"), F.repeat(F.lit("x"), F.lit(1 << 20))).alias("data"),
    )
    pipelines._in_two_parts(rows, "received_at", str(tmp_path), Ended)
    assert sum(f.stat().st_size for f in tmp_path.glob("*.parquet")) < 100_000
    assert sorted(spark.read.parquet(str(tmp_path)).collect()) == sorted(rows.collect())


def test_stream_horizon_spans_flushes(spark, tmp_path):
    root = str(tmp_path)
    write(spark, [message(1, 0, "a"), message(2, 1, "b")], f"{root}/in")
    run_events(spark, root, horizon="1 hour")
    write(spark, [message(1, 60, "a"), *[message(40 + 3 * i, 61, "hot") for i in range(60)]], f"{root}/in")
    run_events(spark, root, horizon="1 hour")
    rows = flush.read_flushed(spark, f"{root}/out").collect()
    assert sorted(r["event"] for r in rows) == ["a", "b", "hot"]


def test_a_flush_with_a_horizon_is_staged_once(spark, tmp_path, monkeypatch):
    root, labels = str(tmp_path), []
    staged = flush.staged
    monkeypatch.setattr(flush, "staged", lambda df, label: labels.append(label) or staged(df, label))
    write(spark, [message(1, 0, "a"), message(1, 1, "a"), message(3, 2, "b")], f"{root}/in")
    run_events(spark, root, horizon="10 minutes")
    assert labels == ["unseen"]
    events = flush.read_flushed(spark, f"{root}/out")
    assert sorted(row["event"] for row in events.collect()) == ["a", "b"]


def remembered(spark, root):
    """Digests in the stream's state."""
    rows = spark.read.format("statestore").option("stateVarName", "seen").load(f"{root}/cp")
    entries = rows.selectExpr("explode(list_value) AS e") if "list_value" in rows.columns else rows.selectExpr("list_element AS e")
    digests = F.col("e.value.digests") if "value" in entries.schema["e"].dataType.names else F.col("e.digests")
    return entries.agg(F.coalesce(F.sum(F.length(digests) / 24), F.lit(0))).first()[0]


def test_remembered_digests_expire_and_late_rows_stay(spark, tmp_path):
    root = str(tmp_path)
    options = {"horizon": "10 days", "remember": "3 seconds"}
    for round_no in range(2):
        late = [message(100 * round_no + i, -86_400 * i, f"day{round_no}-{i}") for i in range(5)]
        write(spark, [*late, message(100 * round_no + 9, round_no, "again"), (7 + round_no, AT, "", "bad")], f"{root}/in")
        run_events(spark, root, **options)
        # Only what this flush brought is left, however many flushes went before.
        assert remembered(spark, root) == 6
        time.sleep(4)
    events = [r["event"] for r in flush.read_flushed(spark, f"{root}/out").collect()]
    assert events.count("again") == 2 and len(events) == 12
    assert flush.read_rejects(spark, f"{root}/out").count() == 2


def test_copies_beyond_the_horizon_are_kept(spark, tmp_path):
    root = str(tmp_path)
    for at in (0, 7200, 3702):
        write(spark, [message(at, at, "a")], f"{root}/in")
        run_events(spark, root, horizon="1 hour", remember="1 day")
    seqs = sorted(r["seq"] for r in flush.read_flushed(spark, f"{root}/out").collect())
    assert seqs == [0, 7200] and remembered(spark, root) == 2


def test_a_key_that_changes_type_stays_readable(spark, tmp_path):
    root = str(tmp_path)
    texts = ['[{"event":"e","n":5,"Os":"x"}]', '[{"event":"e","n":"five"}]', '[{"event":"e","n":"7","N":1}]']
    for i, text in enumerate(texts):
        ingest(spark.createDataFrame([(i, AT, text, "")], flush.MESSAGE_SCHEMA), root, f"b-{i}", typed=True)
    rows = tables.read_events(spark, f"{root}/events").orderBy("seq").collect()
    assert [(r["n"], r["other"], r["unconverted"]) for r in rows] == [(5, {"Os": "x"}, 0), (None, {"n": "five"}, 1), (7, {"N": "1"}, 0)]


def test_ingest_stores_refusals_and_removes_staged_copies(spark, tmp_path):
    before = set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir())
    rows = [message(1, 0, "a"), message(1, 0, "a"), (2, AT, "bad", "")]
    for _ in range(2):  # the same batch again replaces itself
        ingest(spark.createDataFrame(rows, flush.MESSAGE_SCHEMA), str(tmp_path), "b-0")
    assert tables.read_events(spark, f"{tmp_path}/events").count() == 1
    assert spark.read.parquet(f"{tmp_path}/rejects").count() == 1
    assert set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir()) == before


def test_rows_without_rare_columns_are_stored_narrow(spark, tmp_path):
    root, wide = str(tmp_path), {f"k{i:02d}": str(i) for i in range(60)}

    def extra(i):
        return {"usual": str(i), **({**wide, "revenue": "2.5"} if i == 7 else {}), **({"k01": "", "bad-key": "x"} if i == 8 else {})}

    for batch in ("b-0", "b-1", "b-1"):  # the same batch again replaces itself
        rows = [message(i, i, f"{batch}-{i}", **extra(i)) for i in range(200)]
        ingest(spark.createDataFrame(rows, flush.MESSAGE_SCHEMA), root, batch)
    rows = {r["event"]: r for r in tables.read_events(spark, f"{root}/events").collect()}
    assert len(rows) == 400 and tables.read_events(spark, f"{root}/events").count() == 400
    for batch in ("b-0", "b-1"):
        for i in range(200):
            row = rows[f"{batch}-{i}"]
            assert [row[k] for k in wide] == [v if i == 7 else "" for v in wide.values()]
            assert row["usual"] == str(i) and row["revenue"] == (2.5 if i == 7 else 0.0)
            assert row["other"] == ({"bad-key": "x"} if i == 8 else {})
    stored = [pq.ParquetFile(f) for f in stored_files(f"{root}/events")]
    assert sum(f.metadata.num_rows for f in stored if "k59" in f.schema_arrow.names) == 4
    assert all({"usual", "revenue"} <= set(f.schema_arrow.names) for f in stored)


@pytest.mark.parametrize(
    "held, rows, rare",
    [
        ({"a": 100, "c": 1, "d": 0, "e": 1}, 100, {"c", "d", "e"}),
        ({"a": 100, "b": 100}, 100, set()),
        ({"a": 30, "b": 30, "c": 30, "d": 30}, 100, set()),
        ({"a": 1, "b": 2}, 100, {"a", "b"}),
        ({}, 100, set()),
        ({"a": 0}, 0, set()),
    ],
)
def test_rare_columns_leave_fewer_than_half_the_cells(held, rows, rare):
    assert evolve.rare_columns(held, rows) == rare


def test_compaction_keeps_rows_and_the_newest_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        tables.append_batch(event_rows(spark).filter(F.month("ds") == i + 1), path, f"w-{i}")
    rows = tables.read_events(spark, path).count()
    assert tables.compact(spark, path) == ["w-0", "w-1", "w-2"]
    assert tables.read_events(spark, path).count() == rows and (tmp_path / "t" / "batch_id=w-3").exists()


def stored_files(path):
    return {str(f) for f in Path(path).rglob("*.parquet") if "_new-" not in str(f)}


@pytest.mark.parametrize("shape", ["random", "few", "none", "outside"])
def test_deletion_reads_only_files_that_may_hold_an_id(spark, tmp_path, shape):
    """Files of narrow id ranges, in random order; against the rows themselves."""
    rng = random.Random(shape)
    path, held = str(tmp_path / "t"), {}
    for batch in range(12):
        at = rng.randrange(0, 900)
        ids = [f"u{rng.randrange(at, at + 40):04d}" for _ in range(30)]
        rows = [(i, AT + dt.timedelta(days=batch), "e") for i in ids]
        frame = spark.createDataFrame(rows, "distinct_id STRING, time TIMESTAMP, event STRING").withColumn("ds", F.to_date("time"))
        tables.append_batch(frame.coalesce(1), path, f"w-{batch}")
        held[f"w-{batch}"] = ids
    gone = {
        "random": {f"u{rng.randrange(0, 1000):04d}" for _ in range(60)},
        "few": {held["w-3"][0], max(held["w-5"]), min(held["w-7"])},
        "none": set(),
        "outside": {"a", "z", *(f"u{i}x" for i in range(20))},
    }[shape]
    kept = sorted(i for ids in held.values() for i in ids if i not in gone)
    within = {b for b, ids in held.items() if any(min(ids) <= i <= max(ids) for i in gone)}
    before = stored_files(path)
    read = tables.delete_from_events(spark, path, spark.createDataFrame([(i,) for i in gone] * 2, "distinct_id STRING"))
    assert {f.split("batch_id=")[1].split("/")[0] for f in read} == within
    assert sorted(r[0] for r in tables.read_events(spark, path).select("distinct_id").collect()) == kept
    holding = {b for b, ids in held.items() if gone.intersection(ids)}
    assert {f.split("batch_id=")[1].split("/")[0] for f in before - stored_files(path)} == holding


def test_part_of_the_table_by_its_files(spark, tmp_path):
    path = str(tmp_path / "t")
    for key in ("01", "w 1%2-0", "w-2"):
        tables.append_batch(event_rows(spark).coalesce(1), path, key, empty_text=True)
    files = tables._stored(spark, path).inputFiles()
    for key, folder in (("01", "batch_id=01/"), ("w 1%2-0", "batch_id=w"), ("w-2", "batch_id=w-2/")):
        rows = tables._stored(spark, path, [f for f in files if folder in f and (key != "w 1%2-0" or "batch_id=w-" not in f)])
        assert {r["batch_id"] for r in rows.select("batch_id").distinct().collect()} == {key}
        assert rows.schema == tables._stored(spark, path).schema


def test_bounds_of_a_text_column(spark, tmp_path):
    frame = spark.createDataFrame([("b", 1), (None, 2), ("zz", 3)], "distinct_id STRING, n INT")
    frame.coalesce(1).write.parquet(str(tmp_path / "some"))
    frame.filter("n = 2").coalesce(1).write.parquet(str(tmp_path / "null"))
    frame.select("n").coalesce(1).write.parquet(str(tmp_path / "absent"))
    frame.filter("n = 1").coalesce(1).write.option("parquet.column.statistics.enabled", "false").parquet(str(tmp_path / "blind"))
    found = {}
    for name in ("some", "null", "absent", "blind"):
        files = spark.read.parquet(str(tmp_path / name)).inputFiles()
        found[name] = [tuple(r)[1:] for r in footers.text_bounds(spark, files, "distinct_id").collect()]
    assert found["some"] == [("", "zz", True)] and found["null"] == found["absent"] == [("", "", True)]
    assert found["blind"][0][2] is False
    assert [tuple(r)[1:] for r in footers.text_bounds(spark, ["nofs://x/y"], "distinct_id").collect()] == [("", "", False)]


class Stopped(Exception):
    pass


def stop_after(monkeypatch, steps):
    """Let so many folder steps happen, then fail as a killed process would."""
    left = [steps]
    for name in ("_move", "_drop"):
        def step(*args, real=getattr(tables, name)):
            if not left[0]:
                raise Stopped
            left[0] -= 1
            real(*args)

        monkeypatch.setattr(tables, name, step)


@pytest.mark.parametrize("job", ["compact", "delete"])
def test_a_stopped_replacement_is_finished_by_the_next(spark, tmp_path, monkeypatch, job):
    rows = event_rows(spark).filter("time < '2023-02-15'").withColumn("event_id", F.unix_seconds("time"))
    ids = rows.filter("event_id % 7 = 0").select("distinct_id").distinct()
    kept = sorted(r[0] for r in (rows if job == "compact" else rows.join(ids, "distinct_id", "left_anti")).select("event_id").collect())
    for steps in range(12):
        path = str(tmp_path / f"t{steps}")
        for i in range(3):
            tables.append_batch(rows.filter(F.col("event_id") / 43200 % 3 == i).coalesce(1), path, f"w-{i}")
        with monkeypatch.context() as patched:
            stop_after(patched, steps)
            try:
                tables.compact(spark, path) if job == "compact" else tables.delete_from_events(spark, path, ids)
                done = True
            except Stopped:
                done = False
        tables.recover(spark, path)
        assert sorted(r["event_id"] for r in tables.read_events(spark, path).collect()) == kept
        assert not list((tmp_path / f"t{steps}").glob("_new-*"))
        if done:
            break
    assert done and steps > 2


def test_a_replacement_without_plan_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append_batch(event_rows(spark), path, "w-0")
    event_rows(spark).write.parquet(f"{path}/_new-half/rows")
    tables.recover(spark, path)
    assert tables.read_events(spark, path).count() == event_rows(spark).count()
    assert not (tmp_path / "t" / "_new-half").exists()


def test_ingest_keeps_a_record_with_a_bad_key(spark):
    df = spark.createDataFrame([message(1, 0, "a", **{"no-column": "x", "fine": "y"})], flush.MESSAGE_SCHEMA)
    row = ingest_events(df).first()
    assert row["fine"] == "y" and "no-column" not in row.asDict() and row["props"]["no-column"] == "x"


def test_dedup_is_idempotent_and_keeps_the_first(spark):
    rows = [message(1, 5, "a"), message(4, 0, "a"), message(4, 9, "a"), message(2, 1, "a")]
    records = source.event_records(source.decode(spark.createDataFrame(rows, flush.MESSAGE_SCHEMA)))
    once = dedup.drop_exact_duplicates(records)
    assert sorted(r["seq"] for r in once.collect()) == [2, 4]
    assert dedup.drop_exact_duplicates(once).count() == 2
    assert dedup.duplicate_rate(records).first()["duplicate_rate"] == 0.5


def test_free_sql(spark):
    tables.register_views(spark, event_rows(spark), spark.createDataFrame([("u1",)], "distinct_id STRING"))
    got = spark.sql("SELECT count(*) FROM event JOIN user USING (distinct_id)").first()[0]
    assert got == 40


class Cluster:
    """Just the parts of a session that choose the scratch folder."""

    def __init__(self, master, folder):
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": staticmethod(lambda: None)})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder)})


def test_scratch_dir(spark):
    shared = scratch_dir(Cluster("spark://host", "hdfs://shared/dir/"), "x")
    assert shared.startswith("hdfs://shared/dir/x-") and uuid.UUID(shared.rsplit("-", 1)[1])
    with pytest.raises(ValueError):
        scratch_dir(Cluster("spark://host", None), "x")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
