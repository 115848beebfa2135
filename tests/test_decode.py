"""Decoding of raw messages, against fixed cases and a plain Python model."""

import datetime as dt
import json
import random
import re

from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions import plain_json, variant
from tidemark.schema import event_rows
from tidemark.sources import messages as source

AT = dt.datetime(2024, 1, 1)


def frame(spark, payloads):
    rows = [(i, AT, "", text) for i, text in enumerate(payloads)]
    return spark.createDataFrame(rows, "seq BIGINT, received_at TIMESTAMP, data_list STRING, data STRING")


def routes(spark, payloads, **options):
    decoded = source.decode(frame(spark, payloads), **options)
    found = {}
    for row in decoded.orderBy("seq", "pos").collect():
        found.setdefault(row["seq"], []).append((row["route"], row["reason"], row["event"]))
    return [found[i] for i in range(len(payloads))]


def test_shapes(spark):
    cases = [
        ('[{"event":"a"},{"event":"b"}]', [("event", None, "a"), ("event", None, "b")]),
        ('{"type":"track","event":"a"}', [("event", None, "a")]),
        ('{"type":"profile_set","distinct_id":"u"}', [("profile", None, None)]),
        ('{"distinct_id":"u"}', [("profile", None, None)]),
        ('[{"type":"profile_set","event":"a"}]', [("event", None, "a")]),
        ('[{"event":"a"},{"x":1},null]', [("event", None, "a"), ("unnamed", None, None), ("unnamed", None, None)]),
        ('{"type":"track","event":null}', [("unnamed", None, None)]),
        ('{"type":"track","event":""}', [("event", None, "")]),
        ('{"type":"track","event":5}', [("reject", "event_not_string", None)]),
        ("[]", [("reject", "invalid_format", None)]),
        ("[1]", [("reject", "invalid_format", None)]),
        ('[{"event":"a"},1]', [("reject", "invalid_format", None)]),
        ('"text"', [("reject", "invalid_format", None)]),
        ("bad", [("reject", "undecodable", None)]),
        ('{"event":"a"} x', [("reject", "undecodable", None)]),
        ('{"event":"a"}] x', [("reject", "undecodable", None)]),
        ("null", [("nothing", None, None)]),
        ("", [("reject", "payload_missing", None)]),
        ('{"type":"track","event":"a","event":"b"}', [("event", None, "b")]),
        (' [ {"event" : "a"} ] ', [("event", None, "a")]),
    ]
    got = routes(spark, [text for text, _ in cases])
    assert got == [want for _, want in cases]


def test_data_list_comes_first(spark):
    rows = [(0, AT, '[{"event":"list"}]', '{"type":"track","event":"one"}'), (1, AT, None, None)]
    df = spark.createDataFrame(rows, "seq BIGINT, received_at TIMESTAMP, data_list STRING, data STRING")
    got = source.decode(df).orderBy("seq").collect()
    assert [row["event"] for row in got] == ["list", None]
    assert got[1]["reason"] == source.MISSING


def test_size_limit_is_in_bytes(spark):
    limit = source.MAX_PAYLOAD_BYTES
    assert limit == 8 * 1024 * 1024
    frame_ = '{"type":"track","event":"a","pad":"%s"}'
    room = limit - len(frame_ % "")
    sent = [frame_ % ("x" * room), frame_ % ("x" * (room + 1)), frame_ % ("é" * (room // 2 + 1))]
    got = [r[0][:2] for r in routes(spark, sent)]
    assert got == [("event", None), ("reject", "payload_too_large"), ("reject", "payload_too_large")]


def leaves(spark, payload):
    (row,) = source.decode(frame(spark, [payload])).collect()
    return {leaf["key"]: (leaf["kind"], leaf["text"]) for leaf in row["leaves"]}, row["collisions"]


def test_values(spark):
    got, _ = leaves(
        spark,
        '{"type":"track","event":"e","none":null,"yes":true,"int":7,"big":123456789012345678901,'
        '"dec":1.50,"exp":1.7e12,"tiny":1e-7,"hundred":1e2,"whole":100.0,"zero":-0.0,"text":"a\\"b\\\\c",'
        '"arr":[1e2,1.50,"$x",{"$b":1,"a":[{"$c":2}]},[{"$kept":1}],null,1e-7,1e21],"html":["<&>"],"empty":{},"list":[]}',
    )
    assert got == {
        "type": ("string", "track"),
        "event": ("string", "e"),
        "none": ("null", ""),
        "yes": ("bool", "true"),
        "int": ("int", "7"),
        "big": ("int", "123456789012345678901"),
        "dec": ("float", "1.5"),
        "exp": ("int", "1700000000000"),
        "tiny": ("float", "0.0000001"),
        "hundred": ("int", "100"),
        "whole": ("int", "100"),
        "zero": ("int", "0"),
        "text": ("string", 'a"b\\c'),
        "arr": ("array", '[100,1.5,"$x",{"a":[{"c":2}],"b":1},[{"$kept":1}],null,1e-7,1e+21]'),
        "html": ("array", '["\\u003c\\u0026\\u003e"]'),
        "list": ("array", "[]"),
    }


def test_flatten_to_any_depth(spark):
    nested = '{"leaf":1}'
    for level in range(60):
        nested = '{"k%d":%s,"v%d":%d}' % (level, nested, level, level)
    got, collisions = leaves(spark, '{"type":"track","event":"e","p":%s}' % nested)
    assert collisions == 0
    assert got["leaf"] == ("int", "1")
    assert [got[f"v{i}"] for i in range(60)] == [("int", str(i)) for i in range(60)]


def test_deep_nesting_through_the_slow_walk(spark):
    nested = '{"leaf":1}'
    for level in range(40):
        nested = '{"k%d":%s}' % (level, nested)
    got, collisions = leaves(spark, '{"type":"track","event":"e","$a":1,"a":2,"p":%s}' % nested)
    assert collisions == 1
    assert got["a"] == ("int", "2") and got["leaf"] == ("int", "1")


def test_collisions(spark):
    got, collisions = leaves(
        spark,
        '{"type":"track","event":"top","z":{"x":{"y":1},"event":"deep"},"a":{"y":2,"$y":3},"b":{"y":4}}',
    )
    assert got["event"] == ("string", "top")
    assert got["y"] == ("int", "2")
    assert collisions == 4


def test_get_text(spark):
    df = spark.createDataFrame([('{"a":1.0,"b":null,"c":"x","d":[1,{"e":2}],"f":false}',)], "j STRING")
    value = F.parse_json("j")
    row = df.select(*[source.get_text(value, k).alias(k) for k in "abcdfg"]).first()
    assert tuple(row) == ("1", None, "x", '[1,{"e":2}]', "false", None)


# A plain Python model of the same rules.


def strip_item(item):
    """An object inside an array: keys stripped; of equal ones the last in order stays."""
    if not isinstance(item, dict):
        return item
    out = {}
    for key in sorted(item):
        value = item[key]
        if isinstance(value, dict):
            value = strip_item(value)
        elif isinstance(value, list):
            value = [strip_item(v) for v in value]
        out[key.removeprefix("$")] = value
    return out


def model(record):
    found = {}

    def walk(obj, depth, path):
        for key, value in obj.items():
            where = key if path is None else f"{path}.{key}"
            if isinstance(value, dict):
                walk(value, depth + 1, where)
            else:
                found.setdefault(key.removeprefix("$"), []).append(
                    ((depth, key.startswith("$"), where), value)
                )

    walk(record, 0, None)
    return {key: text(min(values, key=lambda v: v[0])[1]) for key, values in found.items()}


def text(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        plain = json.dumps([strip_item(v) for v in value], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return plain.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    return str(value)


names = st.sampled_from(["a", "b", "$a", "$b", "c", "$$c", "d e", ":x,", 'q"t', "$", "", "k\\", "[", "{"])
scalars = st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.sampled_from(
    ["", "x", "$a", '","$b":', "[[", "a<b>&c", "é中", "\\", '"', "{}", "1e5", "t\tn\n"]
)
values = st.recursive(
    scalars,
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(names, inner, max_size=3),
    max_leaves=8,
)
records = st.lists(st.dictionaries(names, values, max_size=4), min_size=20, max_size=60)


@settings(
    max_examples=8,
    deadline=None,
    phases=[Phase.generate],
    derandomize=True,
    suppress_health_check=list(HealthCheck),
)
@given(records)
def test_leaves_equal_the_model(spark, sample):
    payloads = [json.dumps([{**record, "event": "e"}]) for record in sample]
    decoded = source.decode(frame(spark, payloads)).orderBy("seq").collect()
    for record, row in zip(sample, decoded):
        got = {leaf["key"]: leaf["text"] for leaf in row["leaves"]}
        assert len(got) == len(row["leaves"])
        assert got == model({**record, "event": "e"}), (record, got)


def test_flat_input_stays(spark):
    payload = '{"type":"track","event":"e","a":1,"b":"x"}'
    first, _ = leaves(spark, payload)
    again, collisions = leaves(spark, json.dumps({k: t for k, (_, t) in first.items()}))
    assert collisions == 0
    assert {k: t for k, (_, t) in again.items()} == {k: t for k, (_, t) in first.items()}


def test_fast_and_slow_paths_agree(spark):
    rows = [('{"a":1,"b":{"$c":[1,{"$d":2}],"e":"x\\"y"},"f":null}',), ('{"x":{"y":{"z":1.5e3}}}',)]
    value = F.parse_json("j")
    df = spark.createDataFrame(rows, "j STRING").select(
        F.transform(
            F.array_sort(variant.leaves(variant.flat_entries(value))),
            lambda e: F.struct(e["key"], e["kind"], e["text"]),
        ).alias("slow"),
        F.array_sort(variant.pair_leaves(variant.pairs(F.to_json(value)))).alias("fast"),
    )
    for row in df.collect():
        assert [tuple(x) for x in row["slow"]] == [tuple(x) for x in row["fast"]]


def test_messages_of_one_partition_are_decoded_by_many_tasks(spark):
    own = random.Random(1)
    rows = [(n, None, "", '{"type":"track","event":"e","pad":"%s"}' % own.randbytes(1500).hex()) for n in range(4000)]
    rows.append((4000, None, "", '{"event":"big","pad":"%s"}' % ("x" * 5000)))
    schema = "seq BIGINT, received_at TIMESTAMP, data_list STRING, data STRING"
    sent = spark.createDataFrame(rows, schema).coalesce(1)
    decoded = source.decode(sent, 4096).withColumn("task", F.spark_partition_id())
    found = decoded.groupBy("route", "reason").agg(F.countDistinct("task").alias("tasks"), F.count(F.lit(1)).alias("rows")).collect()
    assert {(r["route"], r["reason"], r["rows"]) for r in found} == {("event", None, 4000), ("reject", "payload_too_large", 1)}
    assert max(r["tasks"] for r in found) > 1


def _any_message(own: random.Random) -> str:
    def number():
        return own.choice(["0", "-0", "7", "-5", "1.50", "-0.0", "12.0", "0.000000125", "1e2", "-2.5E3", "1.5e-7", "0e1",
                           "1.704067211172e12", "1e16", "99999999999999999999999", "9" * 39, "0.1" * 1, "3.14159", "1e400",
                           str(own.getrandbits(60)), f"{own.random():.6f}", "1.0e0", "100.00", "-1e-2"])

    def text():
        return own.choice(['"a"', '""', '"$x"', '"é"', '"a,[b"', '"<&>"', r'"q\"r"', r'"é"', '"{"', '"x:y"', '"\x7f"', '"1"', '" "'])

    def value(depth):
        kind = own.randrange(9 if depth < 4 else 6)
        if kind < 2:
            return number()
        if kind < 4:
            return text()
        if kind < 6:
            return own.choice(["true", "false", "null"])
        if kind < 8:
            return members(depth + 1)
        return "[" + own.choice([",", " , "]).join(value(depth + 1) for _ in range(own.randrange(4))) + "]"

    def members(depth):
        names = own.choices(["a", "$a", "b", "$c", "C", "d", "", "$", "$$e", "é", "g.h", "event", "type", "k1", "k2", "k3"], k=own.randrange(5))
        return "{" + ",".join(f'"{name}":{value(depth)}' for name in names) + "}"

    def record():
        name = own.choice(['"e1"', '"e2"', "7", "null", '"e3"'])
        return own.choice([members(0), "{" + f'"type":{own.choice([chr(34) + "track" + chr(34), chr(34) + "profile_set" + chr(34), "1", "null"])},"event":{name},"$properties":{members(0)}' + "}", "null"])

    return own.choice([record, record, lambda: "[" + ",".join(record() for _ in range(own.randrange(4))) + "]", lambda: value(0), lambda: "[" + record() + "] x", lambda: " " + record() + "\n"])()


def test_plain_messages_give_what_the_expressions_give(spark, monkeypatch):
    own = random.Random(5)
    rows = [(n, dt.datetime(2024, 1, 1), "", _any_message(own)) for n in range(3000)]
    sent = spark.createDataFrame(rows, "seq BIGINT, received_at TIMESTAMP, data_list STRING, data STRING")

    def found():
        decoded = source.decode(sent, 4096)
        sorted_leaves = F.to_json(F.array_sort("leaves")).alias("leaves")
        columns = [name for name in decoded.columns if name != "leaves"]
        return sorted(map(tuple, decoded.select(*columns, sorted_leaves).collect()), key=str)

    both = found()
    payload = F.col("data")
    settled = sent.filter(plain_json.settled(payload, F.octet_length(payload)).isNotNull()).count()
    assert 600 < settled < 2700
    monkeypatch.setattr(plain_json, "PLAIN_BYTES", -1)
    assert both == found()


def test_one_route_alone(spark, monkeypatch):
    own = random.Random(5)
    sent = frame(spark, [_any_message(own) for _ in range(600)]).cache()
    for _ in range(2):  # by the helper, then by the expressions
        both = source.decode(sent)
        for route in ("event", "profile"):
            alone = source.decode(sent, only=route)
            assert alone.filter(~F.col("route").isin(route, "unnamed", "reject")).isEmpty()
            wanted = both.filter(F.col("route") == route)
            assert wanted.count() > 20
            columns = ["seq", "pos", "route", "event", "method", "leaves"]
            found = alone.filter(F.col("route") == route).select(columns)
            assert found.exceptAll(wanted.select(columns)).isEmpty() and wanted.select(columns).exceptAll(found).isEmpty()
        monkeypatch.setattr(plain_json, "PLAIN_BYTES", -1)


def test_members_of_other_routes_are_not_looked_at():
    rows = plain_json._Rows("profile")
    for payload in (b'[{"event":"a","b":1}]', b'{"type":"track","event":"a"}', b'{"type":"profile_set","name":"x"}'):
        rows.add(payload)
    assert rows.column().to_pylist()[:2] == [{"route": "event", "items": []}] * 2
    assert rows.keys == ["name", "type"]


def test_payloads_beyond_the_limit_are_refused(spark):
    sent = frame(spark, ['{"event":"a"}', None, "", "x" * 5000, '"' + "\u00e9" * 30 + '"'])
    rows = source._spread(sent, 61).orderBy("seq").select("size", "payload").collect()
    assert [tuple(row) for row in rows] == [(13, '{"event":"a"}'), (None, None), (None, None), (5000, None), (62, None)]


def test_wide_projections_leave_whole_stages(spark):
    """A generated method over 8,000 bytes is never compiled by the JVM."""
    records = spark.createDataFrame([("a", AT, {"time": "1"})], "event STRING, received_at TIMESTAMP, props MAP<STRING, STRING>")
    plan = event_rows(records, [f"c{i}" for i in range(30)])._jdf.queryExecution()
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")))
    limit = int(spark.conf.get("spark.sql.codegen.hugeMethodLimit"))
    assert limit == 8000 and max(map(int, sizes)) > limit


def test_decoding_tasks_are_not_merged_by_size(spark):
    sent = frame(spark, ['[{"event":"a"}]'] * 400)
    tasks = source.decode(sent).select("seq", F.spark_partition_id().alias("task"))
    assert tasks.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
