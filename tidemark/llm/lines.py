"""Substring deduplication by lines and paragraphs: normalised, hashed, grouped over all documents.

Only places and digests are shuffled, never text. Of units with one digest the earliest stays;
the others are removed, with their places in the source kept. A paragraph is a run of lines with
text, as one unit without its line ends, so it meets copies that are wrapped in other places.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, pick, place_of, stage, text_udf, unnamed

_FOLD = str.maketrans(UPPER, LOWER)
_BLANKS = re.compile(r"[ \t\r\f\v]+")
_UNITS = "array<struct<kind:string,unit:int,lines:int,start:int,end:int,place:int,words:array<int>,digest:binary>>"
#: A digest of at least this share of all units is joined apart; so there are at most as many.
HOT_SHARE = 1 / 4096


def normalised(line: str) -> str:
    """Lower case (A-Z) with single blanks."""
    return _BLANKS.sub(" ", line.translate(_FOLD)).strip(" ")


def _unit(kind: str, lines: list[tuple], plain: str) -> dict:
    """Lines that follow each other, each ``(unit, place, start, end, words)``, as one unit."""
    digest = hashlib.blake2b(plain.encode(errors="surrogatepass"), digest_size=16).digest()
    (unit, place, start, *_), last = lines[0], lines[-1]
    return {"kind": kind, "unit": unit, "lines": last[0] - unit + 1, "start": start, "end": last[3], "place": place, "words": [x[4] for x in lines], "digest": digest}


def units(text: str | None) -> list[dict]:
    """Every line with text, and every paragraph of two lines or more.

    ``unit`` is the first line's number, ``place`` its number among the lines with text, ``words``
    the words of each line.
    """
    out, start, place = [], 0, 0
    lines, plains = [], []

    def paragraph() -> None:
        if len(lines) > 1:
            out.append(_unit("paragraph", lines, " ".join(plains)))
        lines.clear()
        plains.clear()

    for i, line in enumerate((text or "").split("\n")):
        plain = normalised(line)
        if plain:
            lines.append((i, place, start, start + len(line), plain.count(" ") + 1))
            plains.append(plain)
            out.append(_unit("line", lines[-1:], plain))
            place += 1
        else:
            paragraph()
        start += len(line) + 1
    paragraph()
    return out


def _places(rows: DataFrame) -> DataFrame:
    """Of ``rows(row, doc_id, text)`` every unit, as a written table."""
    fields = [("kind", pa.string()), *[(x, pa.int32()) for x in ("unit", "lines", "start", "end", "place")], ("words", pa.list_(pa.int32())), ("digest", pa.binary())]
    found = text_udf(lambda texts: pa.array([units(x) for x in texts], pa.list_(pa.struct(fields))), _UNITS)
    return stage(rows.select("row", "doc_id", F.explode(found("text")).alias("u")).select("row", "doc_id", "u.*"))


def _repeats(places: DataFrame) -> DataFrame:
    """Every unit but the earliest of its digest, with the place of that one.

    Earliest is the smallest id (null ids last), then the row as written, then the place. Digests
    of a large share are few, so they are broadcast and their units stay where they are.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start")
    first = stage(places.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    least = max(2, int(places.count() * HOT_SHARE))
    hot, others = F.broadcast(first.filter(F.col("n") >= least)), first.filter(F.col("n") < least)
    rest = places.join(hot.select("digest"), "digest", "left_anti")
    both = places.join(hot, "digest").unionByName(rest.join(others, "digest"))
    later = (F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))
    return both.filter(later).select(*places.columns, F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))


def _with_stretches(gone: DataFrame) -> DataFrame:
    """Add the words of the unit, of the removed stretch it is in, and of its row's longest one.

    A stretch is a run of removed lines; lines without text between them don't end it.
    """
    lines = gone.select("row", "place", F.posexplode("words").alias("k", "w")).select("row", (F.col("place") + F.col("k")).alias("place"), "w").distinct()
    in_row = Window.partitionBy("row")
    runs = lines.withColumn("run", F.col("place") - F.row_number().over(in_row.orderBy("place")))
    runs = runs.withColumn("stretch_words", F.sum("w").over(Window.partitionBy("row", "run")))
    runs = runs.withColumn("longest_words", F.max("stretch_words").over(in_row)).select("row", "place", "stretch_words", "longest_words")
    total = F.aggregate("words", F.lit(0), lambda t, w: t + w).cast("bigint")
    return gone.join(runs, ["row", "place"]).withColumn("n_words", total)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """One row for each line or paragraph of ``docs(doc_id, text)`` that an earlier one repeats:

    ``doc_id, kind, unit, lines, start, end, kept_doc_id, kept_start, n_words, stretch_words,
    longest_words``: places in characters of the text, ``unit`` the first line's number from 0.
    Words are bounded by blanks; a stretch is a run of removed lines, so its words tell a long
    passage from a stock line, and ``longest_words`` does so for the document. Null and empty
    texts have no unit; a repeated row's units repeat the first one's. An empty table gives no
    rows.
    """
    rows = pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    gone = _with_stretches(stage(_repeats(_places(rows))))
    return gone.select("doc_id", "kind", "unit", "lines", "start", "end", "kept_doc_id", "kept_start", "n_words", "stretch_words", "longest_words")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines and paragraphs cut out of the text, other columns as they are."""
    text, doc_id = place_of(docs, "text"), place_of(docs, "doc_id")
    rows = stage(unnamed(docs).withColumn("row", F.monotonically_increasing_id()))
    gone = _repeats(_places(rows.select("row", F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    covered = F.explode(F.sequence("unit", F.col("unit") + F.col("lines") - 1)).alias("unit")
    gone = gone.select("row", covered).groupBy("row").agg(F.collect_set("unit").alias("units"))
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("units", i))
    cut = F.when(F.col("units").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return rows.join(gone, "row", "left").withColumn(text, cut).drop("row", "units").toDF(*docs.columns)
