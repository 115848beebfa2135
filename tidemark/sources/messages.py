"""Raw messages -> routed records with flat properties.

Input rows are ``(seq BIGINT, received_at TIMESTAMP, data_list STRING, data STRING)``. All
work on a message happens inside its own row, and most of it is computing: messages are dealt
to all cores first, for a small file of many messages would be read by few tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import plain_json, variant
from tidemark.functions.variant import once
from tidemark.session import configure

MAX_PAYLOAD_BYTES = 8 * 1024 * 1024

# Keys a profile record does not keep.
PROFILE_DROPS = ["type", "event"]

MISSING = "payload_missing"
TOO_LARGE = "payload_too_large"
UNDECODABLE = "undecodable"
BAD_SHAPE = "invalid_format"
BAD_NAME = "event_not_string"

_ITEM = "struct<method:string,leaves:array<struct<key:string,kind:string,text:string>>>"


def pick_payload(data_list: Column, data: Column) -> Column:
    return F.coalesce(F.nullif(data_list, F.lit("")), F.nullif(data, F.lit("")))


def get_text(value: Column, key: str) -> Column:
    """Text of one top-level member; NULL when it is absent or null."""
    member = F.element_at(variant.as_object(value), key)
    json = F.to_json(member)
    text = variant.value_text(json, variant.value_kind(json))
    return F.when(json != "null", text)


def message_type(value: Column) -> Column:
    """The top-level ``type``, for comparison with known names."""
    return F.try_variant_get(value, "$.type", "string")


def _route(size: Column, body: Column, items: Column, max_bytes: int) -> Column:
    """(route, reason) of a whole message; ``size`` is that of its payload in bytes."""

    def reject(reason: str) -> Column:
        return F.struct(F.lit("reject").alias("route"), F.lit(reason).alias("reason"))

    def accept(route: str) -> Column:
        return F.struct(F.lit(route).alias("route"), F.lit(None).cast("string").alias("reason"))

    all_objects = F.forall(
        items, lambda item: F.is_variant_null(item) | variant.as_object(item).isNotNull()
    )
    return (
        F.when(size.isNull(), reject(MISSING))
        .when(size > max_bytes, reject(TOO_LARGE))
        .when(body.isNull(), reject(UNDECODABLE))
        .when(items.isNotNull() & (F.size(items) > 0) & all_objects, accept("event"))
        .when(items.isNotNull(), reject(BAD_SHAPE))
        .when(F.is_variant_null(body), accept("nothing"))
        .when(variant.as_object(body).isNull(), reject(BAD_SHAPE))
        .when(message_type(body) == "track", accept("event"))
        .otherwise(accept("profile"))
    )


def _spread(messages: DataFrame, max_bytes: int) -> DataFrame:
    """(seq, received_at, size, payload), dealt to tasks; payloads beyond the limit stay behind."""
    payload = pick_payload(F.col("data_list"), F.col("data"))
    # Sized inside the array, so that a payload beyond the limit is not copied into a row.
    sized = F.transform(
        F.array(payload),
        lambda p: F.struct(F.octet_length(p).alias("size"), F.when(F.octet_length(p) <= max_bytes, p).alias("payload")),
    )
    # A number of its own: messages are small and dear, and tasks merged by size would be few.
    tasks = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return messages.select("seq", "received_at", F.inline(sized)).repartition(tasks, "seq", "received_at")


def decode(messages: DataFrame, max_bytes: int = MAX_PAYLOAD_BYTES, only: str | None = None) -> DataFrame:
    """One row per record: event elements, profiles, rejects, and accepted blanks.

    ``leaves`` holds ``(key, kind, text)`` per property, with ``$`` stripped and nested
    objects flattened. When several paths give the same key, the shallowest wins, then the
    one without ``$``, then the smaller path; ``collisions`` counts the losers.

    Given a route (``event`` or ``profile``), messages of any other have no rows, and their members
    are not looked at.
    """
    configure(messages.sparkSession)
    sent = _spread(messages, max_bytes)
    sent = sent.withColumn("plain", plain_json.settled(F.col("payload"), F.col("size"), only))
    is_plain = F.col("plain").isNotNull()
    parsed = once(sent, marked=variant.parse_marked(F.when(~is_plain, F.col("payload"))))
    parsed = once(parsed, body=variant.whole_value(F.col("marked")))
    parsed = once(parsed, items=variant.as_array(F.col("body")))
    routed = once(parsed, routed=_route(F.col("size"), F.col("body"), F.col("items"), max_bytes))
    if only:
        routed = routed.filter(F.coalesce("plain.route", "routed.route") == only)
    elements = (
        F.when(F.col("routed.route") == "event", F.coalesce("items", F.array("body")))
        .when(F.col("routed.route") == "profile", F.array("body"))
        .otherwise(F.array(F.lit(None).cast("variant")))
    )
    nothing = F.lit(None)
    settled = F.transform("plain.items", lambda item: F.struct(nothing.cast("variant").alias("element"), item.alias("settled")))
    walked = F.transform(elements, lambda item: F.struct(item.alias("element"), nothing.cast(_ITEM).alias("settled")))
    records = routed.select(
        "seq",
        "received_at",
        F.when(is_plain, F.col("plain.route")).otherwise(F.col("routed.route")).alias("route"),
        F.when(~is_plain, F.col("routed.reason")).alias("reason"),
        F.posexplode(F.when(is_plain, settled).otherwise(walked)).alias("pos", "item"),
    ).select("*", "item.*").drop("item")
    return _name_records(_with_leaves(records))


def _with_leaves(records: DataFrame) -> DataFrame:
    """Add ``leaves`` and ``collisions``; plain messages have their leaves already.

    One regular expression over the canonical text finds the members of most other records. Those
    it cannot settle, such as records with colliding keys, are walked level by level.
    """
    element = F.col("element")
    method = F.coalesce("settled.method", F.when(F.col("route") == "profile", message_type(element)))
    texts = once(records, json=F.to_json(element), method=method)
    paired = once(texts, pairs=variant.pairs(F.col("json")))
    walk = F.array_sort(variant.leaves(variant.flat_entries(element)))
    plain = F.col("pairs").isNull() | variant.is_plain(F.col("pairs"))
    walked = once(paired, found=F.when(~plain, walk))
    winners = F.filter(
        "found", lambda e, i: (i == 0) | (F.get(F.col("found"), i - 1)["key"] != e["key"])
    )
    slim = F.transform(
        winners,
        lambda e: F.struct(e["key"].alias("key"), e["kind"].alias("kind"), e["text"].alias("text")),
    )
    is_plain = F.col("found").isNull()
    leaves = F.coalesce("settled.leaves", F.when(is_plain, variant.pair_leaves(F.col("pairs"))).otherwise(slim))
    settled = once(walked, leaves=leaves)
    losers = F.when(is_plain, 0).otherwise(F.size("found") - F.size("leaves"))
    return settled.withColumn("collisions", losers).drop("element", "settled", "json", "pairs", "found")


def _name_records(flat: DataFrame) -> DataFrame:
    """Events without a name are dropped; a name that is no text rejects the record."""
    name = F.get(F.filter("leaves", lambda e: e["key"] == "event"), 0)
    is_event = F.col("route") == "event"
    unnamed = is_event & (F.col("name").isNull() | (F.col("name.kind") == "null"))
    bad = is_event & (F.col("name.kind") != "string")
    named = flat.withColumn("name", name)
    return named.select(
        "seq",
        "received_at",
        "pos",
        F.when(unnamed, "unnamed").when(bad, "reject").otherwise(F.col("route")).alias("route"),
        F.when(unnamed, None).when(bad, BAD_NAME).otherwise(F.col("reason")).alias("reason"),
        F.when(is_event & (F.col("name.kind") == "string"), F.col("name.text")).alias("event"),
        "method",
        "leaves",
        "collisions",
    )


def text_map(leaves: Column) -> Column:
    return F.map_from_entries(
        F.transform(leaves, lambda e: F.struct(e["key"].alias("key"), e["text"].alias("value")))
    )


def event_records(decoded: DataFrame) -> DataFrame:
    """(seq, pos, received_at, event, leaves, props) of the stored events."""
    events = decoded.filter(F.col("route") == "event")
    return once(
        events.select("seq", "pos", "received_at", "event", "leaves"),
        props=text_map(F.col("leaves")),
    )


def profile_records(decoded: DataFrame) -> DataFrame:
    """(seq, received_at, distinct_id, method, props) of the profile messages."""
    kept = F.filter("leaves", lambda e: ~e["key"].isin(PROFILE_DROPS))
    records = decoded.filter(F.col("route") == "profile")
    named = once(records, props=text_map(kept))
    return named.select(
        "seq",
        "received_at",
        "method",
        "props",
        F.coalesce(F.col("props")["distinct_id"], F.lit("")).alias("distinct_id"),
    )


def rejects(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("route") == "reject").select("seq", "pos", "received_at", "reason")


def rejects_by_reason(decoded: DataFrame) -> DataFrame:
    return rejects(decoded).groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))
