"""Type detection, conversion and coercion on hand-written cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import coerce, detect
from tidemark.operators import evolve
from tidemark.schema import EVENT_CORE, EVENT_SCHEMA, event_rows, user_rows

# By rule: words and numbers of each kind, bounds of the integer and time ranges, layouts.
DETECT = [
    *[("bool", word, "Bool") for word in ("false", "true")],
    *[("string", word, "Bool") for word in ("false", "true")],
    *[(kind, text, "Int64") for kind in ("int", "string") for text in ("0", "-7", "86400")],
    *[(kind, text, "Float64") for kind in ("float", "string") for text in ("0.5", "-7.25")],
    ("time", "2031-07-08 09:10:11", "DateTime"),
    ("string", "946684800000", "Int64"), ("string", "946684800001", "DateTime"),
    ("string", "4102444799999", "DateTime"), ("string", "4102444800000", "Int64"),
    ("string", "2031-07-08", "DateTime"), ("string", "2031-07-08T09:10:11+02:00", "DateTime"),
    ("string", "2031-07-08 9:10", "String"),
    *[("string", text, "String") for text in ("", "word", "1_000", "12\n", "2024-13-01", "2024-01-01 24:00:00")],
    ("null", "", "String"), ("string", ".5", "Float64"), ("string", "5.", "Float64"),
    ("string", "Inf", "Float64"), ("string", "-inf", "Float64"), ("string", "0X1P+4", "Float64"),
    ("string", "2024-01-01T5:00:00Z", "DateTime"), ("string", "9223372036854775807", "Int64"),
]


def test_detect(spark):
    df = spark.createDataFrame(DETECT, "kind STRING, text STRING, want STRING")
    got = df.withColumn("got", detect.detect_type(F.col("kind"), F.col("text"))).collect()
    assert [(r["kind"], r["text"], r["got"]) for r in got] == DETECT


# By rule: one text of each type, alone and with each other one; the wider type of two wins.
OF_TYPE = {"Bool": "false", "Int64": "-407", "Float64": "6.25", "String": "birch"}
WIDTH = list(OF_TYPE)
SAMPLES = {
    **{f"{a}-{b}": ([OF_TYPE[a], OF_TYPE[b]], "string", max(a, b, key=WIDTH.index)) for a in WIDTH for b in WIDTH},
    "bool-kind": (["false"] * 2, "bool", "Bool"),
    "int-kind": (["-407", "88"], "int", "Int64"),
    "float-kind": (["6.25", "-0.5"], "float", "Float64"),
    "times": (["2031-11-05", "1924300800000"], "string", "DateTime"),
    "time-and-number": (["2031-11-05", "-407"], "string", "String"),
}


def test_column_types_do_not_depend_on_order(spark):
    rows = [(key, kind, text) for key, (texts, kind, _) in SAMPLES.items() for text in texts]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "key STRING, kind STRING, text STRING")
        got = {r["column"]: r["type"] for r in evolve.infer_column_types(df).collect()}
        assert got == {key: want for key, (_, _, want) in SAMPLES.items()}


def test_no_samples_is_text(spark):
    empty = spark.createDataFrame([], "t STRING")
    assert empty.agg(detect.merge_types(F.col("t"))).first()[0] == "String"


# By rule: what each kind becomes under each type, and texts that are of no such type.
CONVERT_ERRORS = [
    *[("bool", "false", target, target not in ("Bool", "String")) for target in ("Bool", "Int64", "Float64", "String")],
    *[("int", "-8", target, False) for target in ("Bool", "Int64", "Float64", "String")],
    *[("float", "-8.75", target, target == "Bool") for target in ("Bool", "Int64", "Float64", "String")],
    *[("null", "", target, False) for target in ("Bool", "Int64", "Float64", "String")],
    *[("string", "eight", target, target != "String") for target in ("Bool", "Int64", "Float64", "String")],
    ("string", "yes", "Bool", True), ("string", "8.75", "Int64", True), ("string", "8.75", "Float64", False),
]


@pytest.mark.parametrize("kind,text,target,error", CONVERT_ERRORS)
def test_convert_errors(spark, kind, text, target, error):
    _, failed = detect.convert(F.lit(kind), F.lit(text), target)
    assert spark.range(1).select(failed).first()[0] is error


def test_float_text(spark):
    cases = {
        "1000000": "1e+06", "123456.5": "123456.5", "0.0001": "0.0001", "0.00001234": "1.234e-05",
        "-2500000.25": "-2.50000025e+06", "0": "0", "100": "100",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    got = df.select(detect.general_number(F.col("t"))).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_column_definitions(spark):
    want = {
        "String": "`c` String DEFAULT ''", "Int64": "`c` Nullable(Int64)",
        "Float64": "`c` Nullable(Float64)", "Bool": "`c` Nullable(Bool)",
        "DateTime": "`c` Nullable(DateTime)",
    }
    for name, text in want.items():
        got = spark.range(1).select(detect.column_definition(F.lit("c"), F.lit(name))).first()[0]
        assert got == text
        assert detect.struct_field("c", name).nullable is (name != "String")


def test_column_names(spark):
    names = ["a", "x" * 64, "x" * 65, "", "a-b", "a.b", "$a", "é", "A_9", "a\n"]
    df = spark.createDataFrame([(n,) for n in names], "k STRING")
    text = [r[0] for r in df.select(evolve.valid_name(F.col("k"))).collect()]
    typed = [r[0] for r in df.select(evolve.valid_name(F.col("k"), typed=True)).collect()]
    assert text == [True, True, False, False, False, False, False, False, True, False]
    assert typed == [True, True, False, False, False, False, True, False, True, False]


def test_keys_beyond_the_limit_get_no_column(spark):
    rows = [("often", 9), ("b", 1), ("a", 1), ("OS", 50), ("Seq", 50), ("Case", 3), ("case", 4), ("Kept", 5)]
    found = spark.createDataFrame(rows, "column STRING, rows INT").withColumn("type", F.lit("String"))
    assert evolve.collect_columns(found, ["kept"], 4) == [("Case", "String"), ("a", "String"), ("often", "String")]
    assert evolve.collect_columns(found, ["kept"], 1) == []


def test_zone_time_and_date(spark):
    row = spark.range(1).select(
        F.unix_seconds(coerce.zone_time(F.lit("2024-01-01 00:30:00"), "yyyy-MM-dd HH:mm:ss", "Asia/Shanghai")),
        coerce.event_date(F.lit("2024-01-01 20:00:00").cast("timestamp"), "Asia/Shanghai").cast("string"),
    ).first()
    assert tuple(row) == (1704040200, "2024-01-02")


AT = dt.datetime(2024, 3, 1, 12, 0, 0, 123456)


def test_event_row_defaults(spark):
    df = spark.createDataFrame([(0, 0, AT, "e", {"new": "v"})], "seq BIGINT, pos INT, received_at TIMESTAMP, event STRING, props MAP<STRING,STRING>")
    rows = event_rows(df, ["new"])
    assert rows.select(*EVENT_CORE).schema.fieldNames() == EVENT_CORE
    assert [f.dataType for f in rows.select(*EVENT_SCHEMA.fieldNames()).schema] == [f.dataType for f in EVENT_SCHEMA]
    row = rows.first()
    assert row["time"] == dt.datetime(2024, 3, 1, 12, 0, 0, 123000)
    assert (row["os"], row["screen_width"], row["wifi"], row["timezone_offset"], row["new"]) == ("", 0, False, 0, "v")
    assert str(row["_flush_time"]) == "0" and row["ds"] == dt.date(2024, 3, 1)


def test_user_rows(spark):
    props = [
        {"name": "n", "last_visit_time": "1704067200"},
        {"last_visit_time": "soon", "time": "1704067200123"},
    ]
    df = spark.createDataFrame([(str(i), p, AT) for i, p in enumerate(props)], "distinct_id STRING, props MAP<STRING,STRING>, received_at TIMESTAMP")
    a, b = user_rows(df, ["time"]).orderBy("distinct_id").collect()
    assert a["last_visit_time"] == dt.datetime(2024, 1, 1) and a["first_visit_time"] == AT
    assert (a["ds"], a["bad_visit_times"], a["name"], a["email"]) == (dt.date(2024, 3, 1), 0, "n", "")
    assert b["last_visit_time"] is None and b["bad_visit_times"] == 1
    assert b["ds"] == dt.date(2024, 1, 1)


def test_text_union_and_rejected_properties(spark):
    df = spark.createDataFrame([({"a": "1", "b-c": "2"},)], "props MAP<STRING,STRING>")
    union = evolve.text_union(df, ["a", "z"]).first()
    assert (union["a"], union["z"]) == ("1", "")
    assert df.select(evolve.rejected_properties(F.col("props"))).first()[0] == {"b-c": "2"}
