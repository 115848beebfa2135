"""Packing: concatenate all documents' tokens and cut at fixed windows.

Two passes. The first turns every document into token ids and writes them, with the partition
and the tokens before the document in it. The second adds up the partitions' totals, which gives
every partition its global offset, and cuts each document where its tokens cross a window's end.
No document moves between partitions and none has to fit into a window.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, small, stage

WINDOW = 2048
END = 1
"""The id that ends each document."""
CACHED_WORDS = 800_000
"""Words that a worker keeps between batches, about 150 MB."""
CUTS = 4096
"""Pieces per batch that a task gives back."""


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer splits at white space and drops it, so a text's ids are those of its words in
    turn. Words are looked up in a bounded table and only new ones are tokenized. Texts are cut
    at blanks and line ends alone; any other white space stays inside a word and is left to the
    tokenizer. Two rules keep the table small where they cannot change an id: texts of Latin-1
    characters, which the tokenizer lower-cases one by one, are lower-cased here, and a comma or
    full stop behind letters is a word of its own, as the tokenizer has it.
    """

    def __init__(self, path: str):
        self.path = path
        vocabulary = _tokenizer(path).get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.begins = array("q", [0])
        self.flat = array("I")

    def _add(self, word: str, ids) -> None:
        self.place[word] = len(self.place)
        self.flat.extend(ids)
        self.begins.append(len(self.flat))

    def _ids(self, word: str):
        at = self.place[word]
        return self.flat[self.begins[at] : self.begins[at + 1]]

    def learn(self, words: set[str]) -> None:
        stopped = {x for x in words if x[-1:] in (",", ".") and _plain(x[:-1])}
        stems = {x[:-1] for x in stopped} | {x[-1] for x in stopped} | (words - stopped)
        stems.difference_update(self.place)
        plain = [x for x in stems if _plain(x)]
        if plain:  # all in one call: their last tokens say where each ends
            ids = np.array(_tokenizer(self.path).encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.ends[ids]) + 1
            for word, a, b in zip(plain, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                self._add(word, ids[a:b].tolist())
        others = [x for x in stems if not _plain(x)]
        for word, found in zip(others, _tokenizer(self.path).encode_batch_fast(others, add_special_tokens=False), strict=True):
            self._add(word, found.ids)
        for word in stopped:
            self._add(word, self._ids(word[:-1]) + self._ids(word[-1]))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, ``END`` behind each, and each text's number of ids.

        A batch's words are told apart once; only distinct ones are looked up.
        """
        folded = pc.replace_substring(pa.array([_folded(x or "") for x in texts], pa.string()), "\n", " ")
        split = pc.split_pattern(folded, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.place) + len(words) > CACHED_WORDS:
            self.clear()
        known = list(map(self.place.get, words))
        if None in known:
            self.learn({x for x, at in zip(words, known, strict=True) if at is None})
            known = list(map(self.place.__getitem__, words))
        places = np.array(known, np.int64)
        rows = places[coded.indices.to_numpy(zero_copy_only=False)]
        begins = np.frombuffer(self.begins, np.int64)
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        sizes = begins[rows + 1] - begins[rows]
        ends = np.cumsum(sizes)
        take = np.arange(int(ends[-1])) + np.repeat(begins[rows] - (ends - sizes), sizes)
        last = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)) - 1
        ids = np.insert(flat[take], ends[last], np.uint32(END))
        del begins, flat  # arrays in use as buffers cannot grow
        return ids, np.diff(ends[last], prepend=0) + 1


def _plain(word: str) -> bool:
    """Whether the word is letters of Latin-1 alone."""
    return word.isalpha() and (word.isascii() or max(word) <= "\xff")


def _folded(text: str) -> str:
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """One table for each Python worker, which serves many tasks."""
    return WordIds(path)


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, part, before, n, ids``: ids as little-endian 32-bit numbers.

    ``before`` counts the tokens of the partition's earlier documents.
    """

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        encode = _word_ids(tokenizer)
        for batch in small(batches, limit=2 << 20):
            ids, sizes = encode(batch.column("text").to_numpy(zero_copy_only=False).tolist())
            ends = np.cumsum(sizes)
            bounds = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32))
            held = pa.Array.from_buffers(pa.binary(), len(sizes), [None, bounds, pa.py_buffer(ids.astype("<u4"))])
            arrays = [batch.column("doc_id"), pa.array(np.full(len(sizes), part)), pa.array(before + ends - sizes), pa.array(sizes), held]
            before += int(ends[-1])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "before", "n", "ids"])

    return docs.mapInArrow(run, "doc_id long, part long, before long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece of a document in ``docs(doc_id, text)``:

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids``, the piece's
    ids as little-endian 32-bit numbers. ``start`` counts the document's ids before the piece,
    ``offset`` the sequence's. All sequences but the last are full, so only it needs padding.

    Null and empty texts have the end id alone. Repeated rows are packed each. An empty table
    gives no rows.
    """
    tokens = stage(tokenize(pick(docs, "doc_id", "text"), tokenizer))
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each partition of the first pass: a single task adds them up.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids")

    def cut(batches):
        rows: list[tuple] = []

        def given():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for doc, at, ids in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "at", "ids")), strict=True):
                n = len(ids) // 4
                cuts = [0, *range(window - at % window, n, window), n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    own = ids[4 * a : 4 * b]
                    rows.append((doc, a, b - a, zlib.crc32(own), n, (at + a) // window, (at + a) % window, own))
                    if len(rows) == CUTS:
                        yield given()
                        rows.clear()
        if rows:
            yield given()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [*[pa.int64()] * 7, pa.binary()]
    return placed.mapInArrow(cut, ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in names))
