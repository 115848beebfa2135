"""JSON values -> flat leaves of text, as Column expressions over the Variant type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Patterns over canonical JSON text, as to_json writes it. Loops are possessive, so long
# texts neither backtrack nor recurse.
STRING_BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
STRING = f'"{STRING_BODY}"'


def _array(depth: int) -> str:
    inner = "" if depth == 0 else "|" + _array(depth - 1)
    return rf'\[(?:[^\[\]"]++|{STRING}{inner})*+\]'


# A key without one leading $, then its value: a string, an array up to four deep, a number
# or word, or the bracket that opens an object or a deeper array.
PAIR = rf'"\$?({STRING_BODY})":({STRING}|{_array(3)}|[^\[\]{{}}",]++|[\[{{])'

# Strings (with the colon that marks a key), brackets, numbers, rest.
TOKEN = rf'{STRING}:?|[\[\]{{}}]|-?[0-9][0-9.eE+-]*|[^"\[\]{{}}0-9-]+'

# Characters that JSON text carries as escapes, and those escapes.
ESCAPES = {
    "&": "\\u0026",
    "<": "\\u003c",
    ">": "\\u003e",
    "\u2028": "\\u2028",
    "\u2029": "\\u2029",
}


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    Plain projections are merged, and filters on a computed column move below it; either
    repeats the expression. An explode of one row stops both.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


END_MARK = "end of message"


def parse_marked(text: Column) -> Column:
    """JSON text -> array of the parsed value and a closing mark.

    The JSON parser stops after the first value. Wrapped in an array with a mark at its
    end, trailing text breaks the array or changes its length.
    """
    return as_array(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END_MARK}"]'))))


def whole_value(marked: Column) -> Column:
    """The value of ``parse_marked``; NULL unless the whole text was exactly one value."""
    closed = F.try_variant_get(F.get(marked, 1), "$", "string") == END_MARK
    return F.when((F.size(marked) == 2) & closed, F.get(marked, 0))


def as_object(value: Column) -> Column:
    """The members of a JSON object, NULL for any other value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def strip_dollar(key: Column) -> Column:
    return F.regexp_replace(key, r"\A\$", "")


def _scientific(text: Column) -> tuple[Column, Column, Column, Column]:
    """Sign, first digit, other digits and exponent of a text like ``-1.25E-7``."""
    pattern = r"\A(-?)([0-9])\.?([0-9]*?)0*E(-?[0-9]+)\z"
    parts = [F.regexp_extract(text, pattern, group) for group in (1, 2, 3, 4)]
    return parts[0], parts[1], parts[2], parts[3].try_cast("int")


def plain_number(text: Column) -> Column:
    """Number text without an exponent and without a trailing ``.0``."""
    sign, first, rest, exponent = _scientific(text)
    digits = F.concat(first, rest)
    after = F.length(rest)
    spread = (
        F.when(
            exponent < 0,
            F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits),
        )
        .when(exponent >= after, F.concat(digits, F.repeat(F.lit("0"), exponent - after)))
        .otherwise(
            F.concat(
                F.substring(digits, F.lit(1), exponent + 1),
                F.lit("."),
                F.substring(digits, exponent + 2, after),
            )
        )
    )
    return F.when(F.contains(text, F.lit("E")), F.concat(sign, spread)).otherwise(
        F.regexp_replace(text, r"\.0\z", "")
    )


def json_number(text: Column) -> Column:
    """Number text inside JSON: plain, but with an exponent when very large or very small."""
    sign, first, rest, exponent = _scientific(text)
    mantissa = F.when(rest == "", first).otherwise(F.concat(first, F.lit("."), rest))
    marked = F.concat(
        sign, mantissa, F.lit("e"), F.when(exponent > 0, "+").otherwise(""), exponent.cast("string")
    )
    tiny = r"\A(-?)0\.(0{6,})([0-9])([0-9]*)\z"
    tail = F.regexp_extract(text, tiny, 4)
    small = F.concat(
        F.regexp_extract(text, tiny, 1),
        F.regexp_extract(text, tiny, 3),
        F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)),
        F.lit("e-"),
        (F.length(F.regexp_extract(text, tiny, 2)) + 1).cast("string"),
    )
    return (
        F.when(F.contains(text, F.lit("E")) & ((exponent < -6) | (exponent > 20)), marked)
        .when(text.rlike(tiny), small)
        .otherwise(plain_number(text))
    )


def _tokens(json: Column) -> Column:
    return F.regexp_extract_all(json, F.lit(TOKEN), F.lit(0))


def _bare_key(token: Column) -> Column:
    marked = F.startswith(token, F.lit('"$')) & F.endswith(token, F.lit('":'))
    return F.when(marked, F.concat(F.lit('"'), F.substring(token, 3, 1 << 30))).otherwise(token)


def _strip_all_keys(json: Column) -> Column:
    return F.regexp_replace(json, rf'([{{,])"\$({STRING_BODY}":)', '$1"$2')


def _strip_reachable_keys(json: Column) -> Column:
    """Strip keys, but leave whatever sits inside an array that is itself an array item.

    Walks the tokens with the open brackets as state; needed only for objects that hold
    arrays of arrays.
    """
    start = F.struct(
        F.lit("").alias("out"), F.lit("").alias("open"), F.lit(0).alias("frozen")
    )

    def step(state: Column, token: Column) -> Column:
        opens = token.isin("[", "{")
        closes = token.isin("]", "}")
        depth = F.length(state["open"])
        nested = (token == "[") & F.endswith(state["open"], F.lit("["))
        return F.struct(
            F.concat(
                state["out"], F.when(state["frozen"] == 0, _bare_key(token)).otherwise(token)
            ).alias("out"),
            F.when(opens, F.concat(state["open"], token))
            .when(closes, F.substring(state["open"], F.lit(1), depth - 1))
            .otherwise(state["open"])
            .alias("open"),
            F.when((state["frozen"] == 0) & nested, depth + 1)
            .when(closes & (state["frozen"] == depth), F.lit(0))
            .otherwise(state["frozen"])
            .alias("frozen"),
        )

    return F.reduce(_tokens(json), start, step, lambda state: state["out"])


def _strip_item(item: Column) -> Column:
    json = F.to_json(item)
    return (
        F.when(~F.startswith(json, F.lit("{")) | ~F.contains(json, F.lit('"$')), json)
        .when(json.rlike(r"[\[,]\["), _strip_reachable_keys(json))
        .otherwise(_strip_all_keys(json))
    )


def array_text(json: Column) -> Column:
    """JSON text of an array: ``$`` stripped from keys, keys sorted, numbers normalised.

    Most arrays need none of this and pass through. When there are arrays inside arrays,
    items are stripped one by one, since their inner arrays keep their keys.
    """
    one_by_one = F.concat(
        F.lit("["),
        F.array_join(F.transform(as_array(F.try_parse_json(json)), _strip_item), ","),
        F.lit("]"),
    )
    nested = json.rlike(r"[\[,]\[")
    stripped = F.when(nested, one_by_one).otherwise(_strip_all_keys(json))
    in_order = F.when(
        F.contains(json, F.lit('"$')), F.to_json(F.try_parse_json(stripped))
    ).otherwise(json)
    normal = F.array_join(
        F.transform(
            _tokens(in_order),
            lambda t: F.when(t.rlike(r"\A-?[0-9]"), json_number(t)).otherwise(t),
        ),
        "",
    )
    text = F.when(in_order.rlike(r"[0-9]E|\.0[,\]}]|0\.000000"), normal).otherwise(in_order)
    escaped = text
    for char, escape in ESCAPES.items():
        escaped = F.replace(escaped, F.lit(char), F.lit(escape))
    unusual = json.rlike('"\\$|[0-9]E|\\.0[,\\]}]|0\\.000000|[&<>\u2028\u2029]')
    return F.when(unusual, escaped).otherwise(json)


def value_kind(json: Column) -> Column:
    """Kind of a JSON value, told from its canonical text."""
    first = F.left(json, F.lit(1))
    return (
        F.when(first == '"', "string")
        .when(json.rlike(r"\A-?[0-9]+(\.0)?\z"), "int")
        .when(json.rlike(r"\A-?[0-9.]+\z"), "float")
        .when(first == "[", "array")
        .when(json.isin("true", "false"), "bool")
        .when(json == "null", "null")
        .when(first == "{", "object")
        .when(plain_number(json).rlike(r"\A-?[0-9]+\z"), "int")
        .otherwise("float")
    )


def value_text(json: Column, kind: Column) -> Column:
    """Text of a JSON value: empty for null, numbers plain, arrays as JSON."""
    unescaped = F.when(
        F.contains(json, F.lit("\\")), F.try_parse_json(json).cast("string")
    ).otherwise(F.substring(json, F.lit(2), F.length(json) - 2))
    return (
        F.when(kind == "string", unescaped)
        .when(kind.isin("int", "float"), F.when(json.rlike(r"E|\.0\z"), plain_number(json)).otherwise(json))
        .when(kind == "array", array_text(json))
        .when(kind == "null", "")
        .otherwise(json)
    )


def pairs(json: Column) -> Column:
    """(key, json) of all members that are no objects, found in the text of an object."""
    zipped = F.arrays_zip(
        F.regexp_extract_all(json, F.lit(PAIR), F.lit(1)).alias("key"),
        F.regexp_extract_all(json, F.lit(PAIR), F.lit(2)).alias("json"),
    )
    return F.filter(zipped, lambda p: p["json"] != "{")


def is_plain(pairs: Column) -> Column:
    """Whether the pairs are exact: no escaped keys, no deep arrays, no key twice."""
    keys = pairs["key"]
    return (
        (F.size(F.array_distinct(keys)) == F.size(keys))
        & ~F.contains(F.array_join(keys, ""), F.lit("\\"))
        & ~F.array_contains(pairs["json"], "[")
    )


def pair_leaves(pairs: Column) -> Column:
    """Pairs -> rows of (key, kind, text)."""
    with_kind = F.transform(
        pairs,
        lambda p: F.struct(
            p["key"].alias("key"), p["json"].alias("json"), value_kind(p["json"]).alias("kind")
        ),
    )
    return F.transform(
        with_kind,
        lambda p: F.struct(
            p["key"].alias("key"),
            p["kind"].alias("kind"),
            value_text(p["json"], p["kind"]).alias("text"),
        ),
    )


def _members(members: Column, depth: Column, path: Column | None) -> Column:
    def entry(e: Column) -> Column:
        return F.struct(
            strip_dollar(e["key"]).alias("key"),
            e["value"].alias("value"),
            F.to_json(e["value"]).alias("json"),
            depth.alias("depth"),
            F.startswith(e["key"], F.lit("$")).alias("dollar"),
            (e["key"] if path is None else F.concat(path, F.lit("."), e["key"])).alias("path"),
        )

    return F.transform(F.map_entries(members), entry)


def _is_object(entry: Column) -> Column:
    return F.startswith(entry["json"], F.lit("{"))


def flat_entries(value: Column) -> Column:
    """All non-object members at any depth, under their own names.

    Each round opens the objects left by the round before. Nesting cannot be deeper than
    the number of opening braces, so that many rounds always suffice; a round with nothing
    left to open passes its input on.
    """
    json = F.to_json(value)
    braces = F.length(json) - F.length(F.replace(json, F.lit("{"), F.lit("")))
    rounds = F.when(braces > 1, F.sequence(F.lit(2), braces)).otherwise(
        F.array().cast("array<int>")
    )

    def open_objects(entries: Column, _: Column) -> Column:
        opened = F.flatten(
            F.transform(
                entries,
                lambda e: F.when(
                    _is_object(e), _members(as_object(e["value"]), e["depth"] + 1, e["path"])
                ).otherwise(F.array(e)),
            )
        )
        return F.when(F.exists(entries, _is_object), opened).otherwise(entries)

    return F.reduce(rounds, _members(as_object(value), F.lit(0), None), open_objects)


def leaves(entries: Column) -> Column:
    """Entries -> sortable rows of (key, depth, dollar, path, kind, text)."""

    def kind(e: Column) -> Column:
        return F.struct(e.alias("entry"), value_kind(e["json"]).alias("kind"))

    def leaf(k: Column) -> Column:
        e = k["entry"]
        return F.struct(
            e["key"].alias("key"),
            e["depth"].alias("depth"),
            e["dollar"].alias("dollar"),
            e["path"].alias("path"),
            k["kind"].alias("kind"),
            value_text(e["json"], k["kind"]).alias("text"),
        )

    return F.transform(F.transform(entries, kind), leaf)
