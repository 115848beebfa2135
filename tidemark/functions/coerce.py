"""Text -> typed column values, by the rules of the event table.

All functions take and return ``Column``; a text that does not parse never raises.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters a trim removes, as a regex class.
SPACE = r"[\s\x85\p{Z}]"

# Bounds of the unsigned and signed column types.
UINT64_MAX = 18446744073709551615
UINT16_MAX = 65535
INT16_MIN, INT16_MAX = -32768, 32767

# Epoch numbers below each bound are seconds, milliseconds, microseconds;
# anything larger is nanoseconds.
SECONDS_BELOW = 100_000_000_000
MILLIS_BELOW = 100_000_000_000_000
MICROS_BELOW = 100_000_000_000_000_000

# The last millisecond of year 9999, the end of Spark's timestamp range.
LAST_MILLI = 253_402_300_799_999

# Texts that mean true.
TRUE_TEXTS = ["1", "true", "yes", "y"]


def trim_space(raw: Column) -> Column:
    return F.regexp_replace(raw, f"^{SPACE}+|{SPACE}+$", "")


def strict_bigint(raw: Column) -> Column:
    """A 64-bit integer written as digits with an optional sign, else NULL."""
    return F.when(raw.rlike(r"\A[+-]?[0-9]+\z"), raw.try_cast("bigint"))


def epoch_millis(raw: Column) -> Column:
    """Epoch text -> milliseconds; NULL for anything not a positive integer.

    Small numbers are seconds. Numbers past year 9999 count as unparsable, since no
    timestamp column can hold them.
    """
    number = strict_bigint(trim_space(raw))
    millis = F.when(number < SECONDS_BELOW, number * 1000).otherwise(number)
    return F.when((number > 0) & (millis <= LAST_MILLI), millis)


def epoch_time(raw: Column) -> Column:
    return F.timestamp_millis(epoch_millis(raw))


def event_time(raw: Column, received_at: Column) -> Column:
    """The event's own time, else the receipt time, in whole milliseconds."""
    return F.coalesce(epoch_time(raw), F.date_trunc("millisecond", received_at))


def event_date(time: Column, tz: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(time, tz))


def _digits(raw: Column, sign: str) -> Column:
    """Significant digits of an integer text; empty when the text is not an integer."""
    return F.regexp_extract(raw, rf"\A{SPACE}*{sign}0*([0-9]+){SPACE}*\z", 1)


def uint64(raw: Column) -> Column:
    digits = F.coalesce(_digits(raw, ""), F.lit(""))
    limit = F.lit(str(UINT64_MAX)).cast("decimal(20,0)")
    value = F.least(digits.try_cast("decimal(38,0)"), limit)
    return (
        F.when(digits == "", F.lit(0))
        .when(F.length(digits) > 20, limit)
        .otherwise(value)
        .cast("decimal(20,0)")
    )


def uint16(raw: Column) -> Column:
    digits = F.coalesce(_digits(raw, ""), F.lit(""))
    return (
        F.when(digits == "", F.lit(0))
        .when(F.length(digits) > 5, F.lit(UINT16_MAX))
        .otherwise(F.least(digits.try_cast("int"), F.lit(UINT16_MAX)))
    )


def int16(raw: Column) -> Column:
    digits = F.coalesce(_digits(raw, "[+-]?"), F.lit(""))
    negative = raw.rlike(rf"\A{SPACE}*-")
    size = F.when(F.length(digits) > 5, F.lit(-INT16_MIN)).otherwise(digits.try_cast("int"))
    value = F.when(negative, F.greatest(-size, F.lit(INT16_MIN))).otherwise(
        F.least(size, F.lit(INT16_MAX))
    )
    return F.when(digits == "", F.lit(0)).otherwise(value).cast("smallint")


def true_text(raw: Column) -> Column:
    return F.coalesce(F.lower(trim_space(raw)).isin(TRUE_TEXTS), F.lit(False))


def int_or_zero(raw: Column) -> Column:
    """A 32-bit integer text, else 0."""
    return F.coalesce(int_or_null(raw), F.lit(0))


def int_or_null(raw: Column) -> Column:
    return F.when(raw.rlike(r"\A[+-]?[0-9]+\z"), raw.try_cast("int"))


def three_state_bool(raw: Column) -> Column:
    """``true``, ``false``, or NULL for every other text."""
    return F.when(raw == "true", F.lit(True)).when(raw == "false", F.lit(False))


def normalise_epoch(number: Column, now_millis: Column) -> Column:
    """An epoch number in any of four units -> milliseconds."""
    return (
        F.when(number.isNull() | (number <= 0), now_millis)
        .when(number < SECONDS_BELOW, number * 1000)
        .when(number < MILLIS_BELOW, number)
        .when(number < MICROS_BELOW, F.floor(number / F.lit(1000).cast("decimal(5,0)")))
        .otherwise(F.floor(number / F.lit(1_000_000).cast("decimal(8,0)")))
        .cast("bigint")
    )


# The three accepted date-time layouts, as patterns.
RFC3339 = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{1,2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"
SPACED = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?\z"
DAY = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def rfc3339_time(raw: Column) -> Column:
    return F.when(raw.rlike(RFC3339), F.replace(raw, F.lit(","), F.lit(".")).try_cast("timestamp"))


def layout_time(raw: Column) -> Column:
    """A date-time text in one of the accepted layouts, without a zone meaning UTC."""
    dotted = F.replace(raw, F.lit(","), F.lit("."))
    return (
        F.when(raw.rlike(RFC3339), dotted.try_cast("timestamp"))
        .when(raw.rlike(SPACED), F.concat(dotted, F.lit("Z")).try_cast("timestamp"))
        .when(raw.rlike(DAY), F.concat(raw, F.lit(" 00:00:00Z")).try_cast("timestamp"))
    )


def any_event_millis(kind: Column, text: Column, now_millis: Column) -> Column:
    """Event time of the typed path: number in any unit, or RFC 3339 text; whole seconds."""
    whole = F.when(kind == "int", text.try_cast("bigint")).otherwise(
        text.try_cast("double").try_cast("bigint")
    )
    millis = (
        F.when(kind.isin("int", "float"), normalise_epoch(whole, now_millis))
        .when(kind == "string", F.coalesce(F.unix_millis(rfc3339_time(text)), now_millis))
        .otherwise(now_millis)
    )
    return millis - F.pmod(millis, F.lit(1000))


def zone_time(raw: Column, pattern: str, tz: str) -> Column:
    """Wall-clock text of a time zone -> instant."""
    return F.to_utc_timestamp(F.try_to_timestamp(raw, F.lit(pattern)), tz)
