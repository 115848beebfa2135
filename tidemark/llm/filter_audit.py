"""Interaction of quality filters: removal games, their potential, and every order of filters.

A document's failures are one of 32 sets, so a part is 32 counts. The game of a coalition of
filters is what it removes: documents that fail any member. Hart and Mas-Colell's potential P of
a coalition is (its worth + the sum of P without each member) / its size; a filter's Shapley
value is P of all filters less P without it. Any order's steps are differences of coalitions.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, pick, stage, text_udf

FILTERS = "ABCDE"
_UPPER = UPPER.encode()
_SIGNS = b"#$%&*|"
_FACTS = pa.struct([("mask", pa.int32()), ("digest", pa.binary())])
#: Orders of five filters, a multiple of every denominator of a potential.
_ORDERS = 120
_SUMS = ("n", "good", "toxic")


def failures(text: str | None) -> dict:
    """Filters A to D that the text fails, as bits 0 to 3, and a digest of the text.

    A: under 200 words; B: distinct words under half the words; C: more than 2 % of the code
    points A-Z; D: a sign of ``#$%&*|``. Words are bounded by ASCII blanks. Null is empty.
    """
    text = text or ""
    data = text.encode(errors="surrogatepass")
    words = data.split()
    capitals = len(data) - len(data.translate(None, _UPPER))
    mask = len(words) < 200
    mask |= (100 * len(set(words)) < 50 * len(words)) << 1
    mask |= (100 * capitals > 2 * len(text)) << 2
    mask |= (len(data.translate(None, _SIGNS)) < len(data)) << 3
    return {"mask": int(mask), "digest": hashlib.blake2b(data, digest_size=16).digest()}


def _masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row ``part, mask, good, toxic``: all five failures and its labels.

    A text's first holders are those with its smallest id; they join on digest and id, so copies
    of one text, however many, are spread by their ids.
    """
    facts = text_udf(lambda texts: pa.array([failures(x) for x in texts], _FACTS), "struct<mask:int,digest:binary>")
    rows = pick(docs, "doc_id", "text", "source").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), facts("text").alias("f"))
    rows = stage(rows.select("doc_id", "part", "f.*"))
    marks = pick(labels, "doc_id", "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id")
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    known = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    known = known.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    bits = F.col("mask") + F.when(F.col("first"), 0).otherwise(16)
    one = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("good", "toxic")]
    nameless = rows.filter("doc_id IS NULL").select("part", "mask", F.lit(1).cast("long").alias("n"), *[F.lit(0).cast("long").alias(x) for x in ("good", "toxic")])
    return known.select("part", bits.alias("mask"), "n", *one).union(nameless)


def _filled(name: str) -> Column:
    """The named sums of all 32 failure sets, from a map of those that occur."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda m: F.coalesce(F.try_element_at("s", m)[name], F.lit(0)))


def _removed(sums: Column) -> Column:
    """Of 32 sums by failure set, what each of 32 coalitions removes."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda s: F.aggregate(
            F.sequence(F.lit(0), F.lit(31)),
            F.lit(0).cast("long"),
            lambda t, m: t + F.when(m.bitwiseAND(s) != 0, F.get(sums, m)).otherwise(0),
        ),
    )


def _potential(worth: Column) -> Column:
    """Potentials times 120 (whole numbers) of the coalitions; a coalition comes after its parts."""

    def one(done: Column, s: Column) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1), i)
        without = F.aggregate(
            F.sequence(F.lit(0), F.lit(4)),
            F.lit(0).cast("long"),
            lambda t, i: t + F.when(s.bitwiseAND(bit(i)) != 0, F.get(done, s - bit(i))).otherwise(0),
        )
        total = F.get(worth, s) * _ORDERS + without
        return F.concat(done, F.array(F.call_function("div", total, F.bit_count(s).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.array(F.lit(0).cast("long")), one)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step, what the step's filter does.

    ``docs(doc_id, text, source)``, ``labels(doc_id, quality, toxic)``; a part is a source, null
    the empty string. Columns ``part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley`` (the Shapley value times 120). Filter E fails
    where a smaller id has the same text; rows of one id and text all count and stand alike, a
    null id is neither smaller nor larger and has no labels. A document has a label if any of
    its label rows does. An empty table gives no rows; other columns are not read.
    """
    sums = _masked(docs, labels).groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col(x) * F.col("n")).alias(x) for x in ("good", "toxic")])
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*_SUMS))))
    parts = stage(sums.groupBy("part").agg(by_mask.alias("s")))
    total = F.aggregate(F.map_values("s"), F.lit(0).cast("long"), lambda t, v: t + v["n"]).alias("total")
    parts = stage(parts.select("part", total, *[_filled(x).alias(x) for x in _SUMS]))
    parts = stage(parts.select("part", "total", *[_removed(F.col(x)).alias(x) for x in _SUMS]))
    parts = stage(parts.withColumn("potential", _potential(F.col("n"))))
    orders = F.array(*[F.lit("".join(x)) for x in itertools.permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    letter = lambda j: F.ascii(F.substring("filter_order", j, 1)) - 65
    shifted = lambda j: F.call_function("shiftleft", F.lit(1), letter(j))
    own = shifted(F.col("step"))
    after = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda m, j: m.bitwiseOR(shifted(j)))
    steps = steps.withColumn("own", own).withColumn("after", after).withColumn("before", F.col("after") - F.col("own"))
    gain = {x: F.get(x, F.col("after")) - F.get(x, F.col("before")) for x in _SUMS}
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.get("n", F.col("after"))).alias("kept"),
        gain["n"].alias("removed"),
        (F.get("n", F.col("own")) - gain["n"]).alias("redundant"),
        (F.get("n", F.lit(31)) - F.get("n", F.lit(31) - F.col("own"))).alias("unique_fails"),
        gain["good"].alias("good_lost"),
        gain["toxic"].alias("toxic_lost"),
        (F.get("potential", F.lit(31)) - F.get("potential", F.lit(31) - F.col("own"))).alias("shapley"),
    )
