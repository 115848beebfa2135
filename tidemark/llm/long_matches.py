"""Byte strings that a corpus holds more than once, found with run-length indexes and removed.

A string of ``LENGTH`` bytes holds ``WINDOW`` grams of ``GRAM`` bytes each. The one with the
smallest hash is its anchor, wherever the string stands; so two equal strings have equal anchors
at equal places in them, and only the surroundings of equal anchors have to be compared.

1. Every document gives its anchors with a digest of their surroundings: all bytes that a string
   with this anchor can reach, and where in them it stands. Anchors that occur once are dropped.
2. Surroundings that are equal as a whole are repeated as a whole, and count once from here on.
3. The different surroundings of each anchor meet in a shard, with many other anchors. A
   run-compressed Burrows-Wheeler transform is built of them, sampled at the ends of its runs. From
   the samples, matching statistics stream over the text; places with a long enough match are
   kept if another surrounding of the same anchor has the same string at the same offset.
4. Repeated strings go back to all documents that hold them and are cut out.

Anchors with very many different surroundings would make a shard too large. Their strings are
counted by digest instead, which adds up before any shuffle and needs no group in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, stage
from tidemark.llm.run_index import repeated_starts

LENGTH = 400
GRAM = 100
WINDOW = LENGTH - GRAM + 1
MOST_PERIOD = GRAM // 2
SHARD_BYTES = 1 << 20
CROWDED = 1_000
"""Different surroundings of an anchor from which they are counted by digest."""
BLOCK = 30
"""Starts of strings whose common core is counted first."""

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPLIT = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(29)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on, from hashes of 8, 16, ... 128 bytes."""
    n = len(data) - 7
    value = np.empty(n, np.uint64)
    for i in range(min(8, n)):
        count = (len(data) - i) // 8
        value[i::8] = data[i : i + 8 * count].view("<u8")
    size = 8
    while size * 2 <= GRAM:
        value = _joined(value, size)
        size *= 2
    return _joined(value, GRAM - size)


def _joined(value: np.ndarray, step: int) -> np.ndarray:
    out = value[:-step] * _MIX
    out ^= out >> _LOW
    out += value[step:]
    out *= _SPLIT
    out ^= out >> _LOW
    return out


def _sliding(value: np.ndarray, window: int, least: bool) -> np.ndarray:
    """Smallest or largest of every ``window`` neighbours."""
    best = np.minimum if least else np.maximum
    n = len(value)
    pad = -n % window
    fill = np.full(pad, np.iinfo(np.uint64).max if least else 0, np.uint64)
    blocks = np.concatenate((value, fill)).reshape(-1, window)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - window + 1], ahead[window - 1 : n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in some window of ``WINDOW`` grams."""
    value = gram_hashes(data)
    lowest = _sliding(value, WINDOW, True)
    # A gram is an anchor if it is the smallest of a window that it is in.
    pad = np.zeros(WINDOW - 1, np.uint64)
    highest = _sliding(np.concatenate((pad, lowest, pad)), WINDOW, False)
    places = np.flatnonzero(value == highest)
    return places, value[places]


def without_inner(places: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Leaves out anchors within periodic stretches, which are repeated as a whole.

    Equal anchors at equal short distances stand in a stretch with that period. If it is longer
    than a string and a period, each of its strings occurs twice in it. Strings that leave it
    hold its first or last anchor; of equal strings in another stretch, one in each holds one of
    the first two. So the first and last two stay, and the stretch is given as repeated.
    """
    gap = np.diff(places)
    same = (value[1:] == value[:-1]) & (gap <= MOST_PERIOD)
    keep, stretches, i = np.ones(len(places), bool), [], 0
    for i, j in _even_runs(same, gap):
        begin, end, period = int(places[i]), int(places[j]) + GRAM, int(gap[i])
        if j - i >= 4 and end - begin >= LENGTH + period:
            stretches.append((begin, end))
            keep[i + 2 : j - 1] = False
    return places[keep], value[keep], stretches


def _even_runs(same: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of runs of at least four equal gaps between equal anchors."""
    number = np.where(same, gap, -np.arange(1, len(gap) + 1))  # no two gaps that don't count are equal
    if len(number):
        begins = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        ends = np.append(begins[1:], len(number))
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if b - a >= 4:
                yield a, b


def _around(place: int, size: int) -> tuple[int, int]:
    """The bytes that a string with an anchor at the place can reach."""
    return max(0, place + GRAM - LENGTH), min(size, place + LENGTH)


def _all_anchors(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, anchor, around, place``; a row without anchor has a stretch in the last two."""

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            row, anchor, around, place = [], [], [], []
            for i, text in enumerate(batch.column("data")):
                raw = text.as_buffer()
                size = raw.size if raw else 0
                if size < LENGTH:
                    continue
                data = np.frombuffer(raw, np.uint8)
                places, value, stretches = without_inner(*anchors(data))
                whole = memoryview(raw)
                spans = [_around(p, size) for p in places.tolist()]
                around += [xxhash.xxh3_64_intdigest(whole[a:b], p - a) for p, (a, b) in zip(places.tolist(), spans, strict=True)]
                anchor += value.tolist()
                place += places.tolist()
                for a, b in stretches:
                    anchor.append(None)
                    around.append(b)
                    place.append(a)
                row += [i] * (len(spans) + len(stretches))
            signed = np.array(around, np.uint64).view(np.int64)
            wanted = pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in anchor], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in row], pa.int64()), pa.array([hashes[i] for i in row], pa.int64()), wanted, pa.array(signed), pa.array(place, pa.int64())], ["doc_id", "text_hash", "anchor", "around", "place"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, anchor long, around long, place long")


# Shards.


def _shard_marks(anchor: np.ndarray, around: np.ndarray, place: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, around, start, end`` of what is repeated in each surrounding."""
    sizes = np.array([len(x) + 1 for x in texts])
    begins = np.cumsum(sizes) - sizes
    seq = np.zeros(int(sizes.sum()), np.int64)
    for at, x in zip(begins.tolist(), texts, strict=True):
        seq[at : at + len(x)] = np.frombuffer(x, np.uint8).astype(np.int64) + 1
    places, kind = repeated_starts(seq, LENGTH)
    own = np.searchsorted(begins, places, side="right") - 1
    start = places - begins[own]
    offset = start - np.minimum(place[own], LENGTH - GRAM)  # from the anchor
    _, group = np.unique(anchor, return_inverse=True)
    order = np.lexsort((offset, group[own], kind))
    key = np.stack((kind[order], group[own][order], offset[order]))
    new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))) if len(order) else np.zeros(0, bool)
    twice = ~new
    twice[:-1] |= ~new[1:]
    hit = np.sort(order[twice])
    return _merged_starts(anchor[own[hit]], around[own[hit]], own[hit], start[hit])


def _merged_starts(anchor, around, own, start):
    """Starts of repeated strings, in order, as spans where they overlap or touch."""
    if not len(start):
        return anchor, around, start, start
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (start[1:] - start[:-1] > LENGTH)))
    last = np.append(np.flatnonzero(new)[1:], len(start)) - 1
    return anchor[new], around[new], start[new], start[last] + LENGTH


_MARKS = "anchor long, around long, start long, end long"


def _indexed(windows: DataFrame) -> DataFrame:
    """Marks of surroundings whose anchors have few; an anchor's are in one shard."""
    sorted_ = windows.repartition("anchor").sortWithinPartitions("anchor")

    def run(batches):
        held: list[tuple[int, int, int, bytes]] = []
        known: set[tuple[int, int]] = set()  # a repeated row of a document gives its windows again
        size = 0

        def given():
            columns = list(zip(*held, strict=True))
            marks = _shard_marks(np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), list(columns[3]))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in marks], ["anchor", "around", "start", "end"])

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("anchor", "around", "place", "data")), strict=True):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield given()
                    held, size = [], 0
                    known.clear()
                if row[:2] not in known:
                    known.add(row[:2])
                    held.append(row)
                    size += len(row[3])
        if held:
            yield given()

    return sorted_.mapInArrow(run, _MARKS)


def _blocks(place: int, size: int) -> Iterator[tuple[int, range]]:
    """Blocks of starts in a surrounding, counted back from the anchor; the starts of each."""
    left = min(place, LENGTH - GRAM)
    for block in range((LENGTH - GRAM) // BLOCK + 1):
        first, last = left - BLOCK * block - BLOCK + 1, left - BLOCK * block
        starts = range(max(0, first), min(last, size - LENGTH) + 1)
        if starts:
            yield block, starts


def _counted(windows: DataFrame) -> DataFrame:
    """Marks of surroundings whose anchors have many, by counts of digests; no group meets.

    All strings that start in a block have a core of bytes in common, so only cores that occur
    in two surroundings are looked into; of those, all strings are counted one by one.
    """

    def cores(batches):
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(x).to_pylist() for x in ("anchor", "around", "place", "data")), strict=True):
                left = min(row[2], LENGTH - GRAM)
                for block, _ in _blocks(row[2], len(row[3])):
                    core = row[3][left - BLOCK * block : left - BLOCK * (block + 1) + 1 + LENGTH]
                    rows.append((row[0], row[1], block, xxhash.xxh3_128_digest(core)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["anchor", "around", "block", "core"])

    def strings(batches):
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(x).to_pylist() for x in ("anchor", "around", "place", "data", "blocks")), strict=True):
                left, wanted = min(row[2], LENGTH - GRAM), set(row[4])
                for block, starts in _blocks(row[2], len(row[3])):
                    if block in wanted:
                        rows += [(row[0], row[1], s, xxhash.xxh3_128_digest(row[3][s : s + LENGTH] + (s - left).to_bytes(4, "little", signed=True))) for s in starts]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["anchor", "around", "start", "digest"])

    def several(rows: DataFrame, *keys: str) -> DataFrame:
        """Rows whose keys occur in more than one surrounding."""
        ends = rows.groupBy(*keys).agg(F.min("around").alias("a"), F.max("around").alias("b")).filter("a <> b")
        return rows.join(ends.select(*keys), list(keys), "left_semi")

    found = stage(windows.mapInArrow(cores, "anchor long, around long, block int, core binary"))
    wanted = several(found, "anchor", "block", "core").groupBy("anchor", "around").agg(F.collect_set("block").alias("blocks"))
    some = windows.join(wanted, ["anchor", "around"]).select("anchor", "around", "place", "data", "blocks")
    digests = stage(some.mapInArrow(strings, "anchor long, around long, start long, digest binary"))
    hits = several(digests, "anchor", "digest").dropDuplicates(["anchor", "around", "start"])
    return hits.select("anchor", "around", "start", (F.col("start") + LENGTH).alias("end"))


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around each wanted anchor: ``anchor, around, place, n, crowded, data``."""
    by_text = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "around", "place", "crowded")).alias("wanted"))
    same = docs.doc_id.eqNullSafe(by_text.doc_id) & (docs.text_hash == by_text.text_hash)
    both = docs.join(by_text, same).select("wanted", "data")

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = batch.column("data")[i].as_py()
                for x in batch.column("wanted")[i].as_py():
                    a, b = _around(x["place"], len(raw))
                    out.append((x["anchor"], x["around"], x["place"], x["crowded"], raw[a:b]))
                    if len(out) == 4096:
                        yield _window_rows(out)
                        out = []
            if out:
                yield _window_rows(out)

    kind = "anchor long, around long, place long, crowded boolean, data binary"
    return both.mapInArrow(run, kind)


def _window_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["anchor", "around", "place", "crowded", "data"])


def _spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, start, end``: repeated bytes of each text, possibly overlapping."""
    found = stage(_all_anchors(docs))
    stretches = found.filter("anchor is null").select("doc_id", "text_hash", F.col("place").alias("start"), F.col("around").alias("end"))

    # Most anchors occur once; counts alone are shuffled to tell which.
    often = found.filter("anchor is not null").groupBy("anchor").agg(F.count("*").alias("all")).filter("all > 1")
    found = stage(found.join(often.select("anchor"), "anchor", "left_semi"))
    first = F.min(F.struct("doc_id", "text_hash", "place")).alias("first")
    different = stage(found.groupBy("anchor", "around").agg(F.count("*").alias("n"), first))
    kinds = different.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = stage(different.join(kinds, "anchor").select("anchor", "around", "first.*", (F.col("kinds") > CROWDED).alias("crowded")))
    windows = stage(_surroundings(docs, mixed))
    some = _indexed(windows.filter("not crowded")).union(_counted(windows.filter("crowded")))

    # Surroundings that occur once have their place beside them; the others are repeated whole.
    once = some.join(different.filter("n = 1"), ["anchor", "around"]).select("first.*", "start", "end")
    left = F.greatest(F.col("place") + GRAM - LENGTH, F.lit(0))
    once = once.select("doc_id", "text_hash", (left + F.col("start")).alias("start"), (left + F.col("end")).alias("end"))
    whole = found.join(different.filter("n > 1").select("anchor", "around"), ["anchor", "around"])
    whole = whole.select("doc_id", "text_hash", left.alias("start"), (F.col("place") + LENGTH).alias("end"))
    return once.union(whole).union(stretches)


def _merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for each row of ``docs(doc_id, text)``.

    ``spans`` are the maximal byte ranges of the UTF-8 text that strings of ``LENGTH`` bytes cover
    which start at another place of any document too, the same one included; overlaps count, and
    matches don't cross documents. ``kept`` are the other bytes. Null is empty; shorter texts
    have no such string. Of repeated rows each is the other's match. An empty table gives no
    rows.
    """
    texts = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    spans = _spans(texts).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    same = texts.doc_id.eqNullSafe(spans.doc_id) & (texts.text_hash == spans.text_hash)
    both = texts.join(spans, same, "left").select(texts.doc_id, "data", "spans")

    def run(batches):
        for batch in batches:
            rows = []
            for doc, raw, found in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "data", "spans")), strict=True):
                gone = _merged([(x["start"], x["end"]) for x in found or ()], len(raw))
                edges = [0, *(x for span in gone for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc, len(raw), [{"start": a, "end": b} for a, b in gone], kept))
            pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pairs, pa.binary()), strict=True)], ["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
