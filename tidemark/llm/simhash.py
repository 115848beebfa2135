"""SimHash near-duplicates, their pairs thinned by tables of distances to pivot fingerprints.

Every distinct fingerprint has a row of Hamming distances to many reference fingerprints. By the
triangle inequality two fingerprints that differ in at most ``distance`` bits differ by at most
that in every coordinate of their rows, so pairs with a larger difference are discarded, and the
survivors are verified.

Distances to a fixed reference crowd around half the bits, so one coordinate discards only about
four in ten pairs, and the tables alone would have to look at all pairs. Bands bring pairs
together first: of ``distance + 2`` bands at least two are equal in any pair within
``distance``, so fingerprints meet under each pair of bands, never as all against all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, components, pick, place_of, stage, text_udf, unnamed

SEED = 42
BITS = 64
PIVOTS = 16
SMALL = 32
"""Up to this many fingerprints a unit is compared by shifted columns, beyond it by search."""
BLOCK = 8192
"""Fingerprints of one band pair beyond this are split into blocks that meet pairwise."""
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprints(texts: list[str | None], words: int) -> np.ndarray:
    """Fingerprint of each text from its shingles of that many words, repeats included."""
    hashes: list[int] = []
    counts = []
    for text in texts:
        found = (text or "").encode(errors="surrogatepass").translate(_FOLD).split()
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        n = max(len(found) - words + 1, min(len(found), 1))
        spans = zip(begins[:n].tolist(), ends[-n:].tolist() if n else [], strict=True)
        hashes.extend([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans])
        counts.append(n)
    out = np.zeros(len(texts), np.uint64)
    counts = np.array(counts)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        over = (2 * ones > counts[full, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint(words: int) -> Callable[[Column], Column]:
    """The fingerprint of a text column, its 64 bits as a signed long."""
    return text_udf(lambda texts: pa.array(fingerprints(texts, words).view(np.int64)), "long", limit=1 << 20)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers, so every task has the same ones."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(count)], np.uint64)


def distance_table(values: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values[:, None] ^ references[None, :])


def _near(one: np.ndarray, many: np.ndarray, tables: tuple[np.ndarray, np.ndarray], distance: int) -> np.ndarray:
    """Of paired rows, places within the distance: the tables discard, the bits decide."""
    left, right = tables
    places = np.arange(len(many))
    for k in range(left.shape[1]):
        gap = np.abs(left[places, k].astype(np.int8) - right[places, k].astype(np.int8))
        places = places[gap <= distance]
    return places[np.bitwise_count(one[places] ^ many[places]) <= distance]


def _search(values: np.ndarray, table: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that connect what is connected in one unit: each place is reached once."""
    rest = np.arange(len(values))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            keep = (np.abs(table[rest].astype(np.int8) - table[x].astype(np.int8)) <= distance).all(axis=1)
            keep &= np.bitwise_count(values[rest] ^ values[x]) <= distance
            for y in rest[keep]:
                yield x, y
                front.append(y)
            rest = rest[~keep]


def _links(unit: np.ndarray, values: np.ndarray, distance: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the values of each unit; rows of a unit are neighbours."""
    begins = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    sizes = np.diff(np.append(begins, len(unit)))
    size = np.repeat(sizes, sizes)
    table = distance_table(values, references)
    left, right = [], []
    small = size <= SMALL
    for shift in range(1, min(SMALL, int(sizes.max(initial=1)))):
        a = np.flatnonzero(small[:-shift] & (unit[:-shift] == unit[shift:]))
        hits = a[_near(values[a], values[a + shift], (table[a], table[a + shift]), distance)]
        left.append(values[hits])
        right.append(values[hits + shift])
    for at, n in zip(begins[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        own = values[at : at + n]
        pairs = np.array(list(_search(own, table[at : at + n], distance)), np.int64).reshape(-1, 2)
        left.append(own[pairs[:, 0]])
        right.append(own[pairs[:, 1]])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def near_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links ``a, b`` among distinct fingerprints ``fp`` that connect all within the distance.

    A unit is a band pair's value. A unit over ``BLOCK`` rows is cut into blocks by hash, and
    every two of its blocks form a unit of their own, so no task holds more than two blocks.
    Small units give every link; large ones a tree of links for each connected part, which is
    all that components need.
    """
    n = distance + 2
    cuts = [BITS * i // n for i in range(n + 1)]
    bands = [(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [x | y for x, y in combinations(bands, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("t", "m")).withColumn("key", F.col("fp").bitwiseAND(F.col("m")))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp", "t"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    met = keyed.join(sizes, ["t", "key"]).select("fp", "t", "key", mine.alias("mine"), other)
    unit = F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other"))
    units = met.select("fp", unit.alias("unit")).repartition("unit").sortWithinPartitions("unit", "fp")

    def run(batches):
        references = pivots()
        unit, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(unit, values):
            a, b = _links(unit, values, distance, references)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        for batch in batches:
            unit = np.concatenate((unit, batch.column("unit").to_numpy()))
            values = np.concatenate((values, batch.column("fp").to_numpy().view(np.uint64)))
            last = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0  # it may go on
            if last >= 1 << 16:
                yield links(unit[:last], values[:last])
                unit, values = unit[last:], values[last:]
        if len(unit):
            yield links(unit, values)

    return units.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, distance: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs(doc_id, text)``.

    Rows are linked when their fingerprints differ in at most ``distance`` bits;
    ``component_id`` is the smallest id that links reach (null ids are passed over unless a
    component has no other). Null, empty and blank texts have fingerprint zero, which links like
    any other. Rows that repeat an id or a text stay as they are, each with its component. An
    empty table gives no rows.
    """
    prints = stage(pick(docs, "doc_id", "text").select("doc_id", fingerprint(words)("text").alias("fp")))
    return prints.join(components_of(prints, distance), "fp").select("doc_id", "fp", "component_id")


def components_of(prints: DataFrame, distance: int) -> DataFrame:
    """``fp, root, component_id`` for each distinct fingerprint of ``prints(doc_id, fp)``."""
    own = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(own.select("fp"), distance))
    # Fingerprints without a link, nearly all, are their own component.
    placed = own.join(roots, own.fp == roots.v, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(lowest, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, distance: int = 4) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all its columns.

    The row with the smallest id stays, of rows that share it the first as written.
    """
    named = unnamed(docs).withColumn("fp", fingerprint(words)(F.col(place_of(docs, "text"))))
    rows = stage(named.withColumn("row", F.monotonically_increasing_id()))
    prints = rows.select(F.col(place_of(docs, "doc_id")).alias("doc_id"), "fp", "row")
    placed = prints.join(components_of(prints, distance).select("fp", "root"), "fp")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = placed.groupBy("root").agg(F.min(rank).alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").drop("row", "fp").toDF(*docs.columns)
