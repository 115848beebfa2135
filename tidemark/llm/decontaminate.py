"""Benchmark decontamination with an FM-index of each training shard.

A shard is a run of documents of one partition. Its words become numbers over the vocabulary of
the test phrases, and an FM-index is built over them. Every phrase window is searched backwards
through the ranks of a wavelet tree, its occurrences are located by sampled suffix positions,
and overlapping occurrences merge into removal spans.

A word that no phrase has cannot lie in an occurrence, and neither can a run of phrase words that
is shorter than every window. Both are left out of the index, with a separator in their place; so
the index grows with the text that could match.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, place_of, stage, text_udf, unnamed
from tidemark.llm.fm_index import FMIndex

WINDOW = 13
SHARD_BYTES = 16 << 20
PHRASE_BYTES = 1 << 20
"""Text of the phrases that one pass over the documents may look for; more take more passes."""
LOCATED = 1 << 20
"""Occurrences that are located at once."""

# ASCII letters are lower-cased; any other ASCII character but a digit parts words.
_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x > 127 else 32 for x in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="surrogatepass").translate(_WORDS).split()


class Phrases:
    """Windows of test phrases as rows of word numbers (0 ends, 1 separates, words from 2)."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.place: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            row = [self.place.setdefault(x, len(self.place) + 2) for x in words(text)]
            for i in range(max(1, len(row) - window + 1) if row else 0):
                owners[tuple(row[i : i + window])].add(item)
        self.owners = list(owners.values())
        self.lengths = np.array([len(x) for x in owners], np.int64)
        self.rows = np.zeros((len(owners), window), np.int64)
        for i, x in enumerate(owners):
            self.rows[i, : len(x)] = x
        self.shortest = int(self.lengths.min(initial=window))
        self.symbols = len(self.place) + 2


def _runs(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Runs of words that phrases have, at least as long as the shortest window."""
    known = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
    step = np.diff(known)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - begin >= shortest
    return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))


def shard_hits(texts: list[str | None], phrases: Phrases) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: number of words, spans of words within occurrences, items that occur."""
    counts, parts, origin, owner, size = [], [], [], [], 0
    get = phrases.place.get
    for doc, text in enumerate(texts):
        found = words(text)
        counts.append(len(found))
        ids = np.fromiter([get(x, 0) for x in found], np.int64, len(found))
        for a, b in _runs(ids, phrases.shortest):
            parts += [ids[a:b], [1]]
            origin.append((size, doc, a))
            size += b - a + 1
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[int]] = defaultdict(set)
    if parts and len(phrases.lengths):
        index = FMIndex(np.concatenate(parts), phrases.symbols)
        low, high = index.search(phrases.rows, phrases.lengths)
        begins = np.array([x[0] for x in origin])
        for at in _located(low, high):
            window = np.repeat(np.arange(len(low))[at], (high - low)[at])
            rows = np.arange(len(window)) - np.repeat(np.cumsum((high - low)[at]) - (high - low)[at], (high - low)[at]) + low[window]
            places = index.locate(rows)
            run = np.searchsorted(begins, places, side="right") - 1
            for w, r, p in zip(window.tolist(), run.tolist(), places.tolist(), strict=True):
                begin, doc, first = origin[r]
                spans[doc].append((first + p - begin, first + p - begin + int(phrases.lengths[w])))
                items[doc] |= phrases.owners[w]
    for doc, n in enumerate(counts):
        yield n, merged(spans.get(doc, [])), sorted(items.get(doc, ()))


def _located(low: np.ndarray, high: np.ndarray) -> Iterator[slice]:
    """Neighbouring windows whose occurrences together stay near ``LOCATED``."""
    group = np.cumsum(high - low) // LOCATED
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(low)]
    return (slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def character_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of characters of the text."""
    if not spans:
        return []
    lowered = text.translate({x: x + 32 for x in range(65, 91)})
    places = [m.span() for m in _WORD.finditer(lowered)]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Phrases]:
    """The phrases, in turn, as many at once as ``PHRASE_BYTES`` allows."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text or "")
        if size >= PHRASE_BYTES:
            yield Phrases(block, window)
            block, size = [], 0
    if block:
        yield Phrases(block, window)


_PAIRS = "array<struct<start:int,end:int>>"


def _search(shared: Broadcast, id_type: pa.DataType) -> Callable[[Column], Column]:
    """What the phrases' windows cover in a text column; each piece of a batch is a shard."""
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kind = pa.struct([("n_words", pa.int64()), ("spans", pairs), ("items", pa.list_(id_type))])

    def run(texts):
        rows = []
        for n, spans, items in shard_hits(texts, shared.value):
            rows.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": items})
        return pa.array(rows, kind)

    return text_udf(run, f"struct<n_words:long,spans:{_PAIRS},items:array<{'string' if pa.types.is_string(id_type) else 'long'}>>", SHARD_BYTES)


def _characters(text: Column, spans: Column) -> Column:
    """Spans of words as spans of characters; only texts with a span are handed over."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([[{"start": a, "end": b} for a, b in character_spans(t or "", [(x["start"], x["end"]) for x in s])] for t, s in rows], pairs)

    return F.arrow_udf(run, _PAIRS)(F.when(F.size(spans) > 0, text), spans)


def _union_of(spans: Column) -> Column:
    """Spans of several searches in order, merged where they overlap or touch."""

    def add(done, x):
        last = F.element_at(done, -1)
        grown = F.struct(last.start.alias("start"), F.greatest(last.end, x.end).alias("end"))
        joins = (F.size(done) > 0) & (x.start <= F.try_element_at(done, F.lit(-1)).end)
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def _in_turn(docs: DataFrame, blocks: Iterator[Phrases], id_type: pa.DataType) -> DataFrame:
    """``docs`` with ``found``, of several blocks of phrases: one pass over the texts for each.

    Only one block is with the driver and the executors at a time; what it found is written.
    """
    context = docs.sparkSession.sparkContext
    text = F.col(place_of(docs, "text"))
    rows = stage(unnamed(docs).withColumn("row", F.monotonically_increasing_id()))
    counts, hits = None, None
    for phrases in blocks:
        shared = context.broadcast(phrases)
        found = rows.select("row", _search(shared, id_type)(text).alias("found"))
        own = stage(found.select("row", "found.*").filter((F.size("spans") > 0) | F.lit(counts is None)))
        shared.destroy()
        counts = own.select("row", "n_words") if counts is None else counts
        own = own.select("row", "spans", "items").filter(F.size("spans") > 0)
        hits = own if hits is None else hits.union(own)
    spans, items = F.flatten(F.collect_list("spans")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    hits = hits.groupBy("row").agg(_union_of(spans).alias("spans"), items.alias("items"))
    both = rows.join(counts, "row").join(hits, "row", "left")
    empty = [F.coalesce(x, F.array().cast(both.schema[x].dataType)).alias(x) for x in ("spans", "items")]
    return both.withColumn("found", F.struct("n_words", *empty)).drop("row", "n_words", "spans", "items")


def _found(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``docs`` with columns by number, and ``n_words, spans, items, n_hit, contaminated``."""
    phrases = pick(benchmark, "item_id", "text").filter("item_id is not null")
    text_ids = phrases.schema["item_id"].dataType.typeName() == "string"
    id_type = pa.string() if text_ids else pa.int64()
    blocks = _blocks(phrases, window)
    first, second = next(blocks, Phrases([], window)), next(blocks, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)
        found = unnamed(docs).withColumn("found", _search(shared, id_type)(F.col(place_of(docs, "text"))))
    else:
        found = _in_turn(docs, itertools.chain([first, second], blocks), id_type)
    found = found.withColumns({x: F.col(f"found.{x}") for x in ("n_words", "spans", "items")}).drop("found")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)
    found = found.withColumn("n_hit", hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans, characters, contaminated`` per row of ``docs``.

    ``spans`` are the word ranges that windows of ``benchmark(item_id, text)`` cover, ``n_hit``
    the words in them, and ``characters`` the same ranges in characters of the text; ``items``
    are the ids of items with an occurrence. A document is contaminated from a twentieth of its
    words on. An item of fewer words than a window is a window itself; a null or empty text or a
    null id gives none. Null and empty documents have no words. Repeated documents get a row
    each; repeated items count once. Phrases beyond ``PHRASE_BYTES`` are searched for in turn.
    """
    doc_id, text = F.col(place_of(docs, "doc_id")).alias("doc_id"), F.col(place_of(docs, "text"))
    found = _found(docs, benchmark, window)
    return found.select(doc_id, "n_words", "n_hit", "items", "spans", _characters(text, F.col("spans")).alias("characters"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    n = len(docs.columns)
    return _found(docs, benchmark, window).filter("not contaminated").select([f"c{i}" for i in range(n)]).toDF(*docs.columns)
