"""Removal of lines that many documents share, by a sharded minimal perfect hash.

Lines are hashed in their documents. Digests found in enough documents are dealt to shards;
each shard holds a minimal perfect hash of its digests and, by the digest's number, arrays of
64-bit fingerprints, counts and last documents. Documents probe these arrays, not lines: a batch
of texts asks every shard once for each digest it holds, and gets back those to be dropped. So a
line that a third of all rows hold is one question a batch, and every shard and every batch has
a bounded size at any size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, small, stage

_BLANK = " \t\n\x0b\x0c\r"
#: Digests of an index shard, and questions that a shard is asked, on average.
SHARD_KEYS, SHARD_ASKED = 1 << 17, 1 << 20

_KEYS = "array<struct<line:int,hi:bigint,lo:bigint,first_in_row:boolean,first_in_batch:boolean>>"
_KEYED = f"batch bigint, doc_id bigint, text string, n_lines bigint, keys {_KEYS}"
_SHARD = "shard bigint, sizes binary, words binary, prints binary, counts binary, last binary"
_ANSWER = "batch bigint, hi bigint, lo bigint, n_docs bigint, last bigint"
_RESULT = "doc_id bigint, n_lines bigint, n_dropped bigint, kept string"


def _first(codes: np.ndarray) -> np.ndarray:
    """Whether each value stands at its first place."""
    out = np.zeros(len(codes), bool)
    out[np.unique(codes, return_index=True)[1]] = True
    return out


def _keys(texts: pa.Array, fewest_chars: int) -> tuple[pa.Array, pa.Array]:
    """Of each text the number of lines, and the digests of the lines with long keys."""
    lines = pc.split_pattern(texts, "\n")
    every = lines.flatten()
    key = pc.ascii_lower(pc.utf8_trim(every, characters=_BLANK))
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(key), fewest_chars).to_numpy(zero_copy_only=False))
    counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    row = np.searchsorted(begin, at, "right") - 1
    coded = key.take(pa.array(at)).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    digests = b"".join(xxhash.xxh3_128_digest(x.as_buffer()) for x in coded.dictionary)
    halves = np.frombuffer(digests, "<i8").reshape(-1, 2)[code]
    fields = {
        "line": pa.array((at - begin[row]).astype(np.int32)),
        "hi": pa.array(halves[:, 0]),
        "lo": pa.array(halves[:, 1]),
        "first_in_row": pa.array(_first(row * (len(coded.dictionary) + 1) + code)),
        "first_in_batch": pa.array(_first(code)),
    }
    bounds = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    keys = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.array(counts), pa.ListArray.from_arrays(pa.array(bounds), keys)


def _keyed(docs: DataFrame, fewest_chars: int) -> DataFrame:
    """The documents in numbered batches, with their digests; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in small(batches):
            texts = pc.fill_null(batch.column("text"), "")
            counts, keys = _keys(texts, fewest_chars)
            columns = [pa.array(np.full(len(texts), number)), batch.column("doc_id"), texts, counts, keys]
            yield pa.RecordBatch.from_arrays(columns, names=["batch", "doc_id", "text", "n_lines", "keys"])
            number += 1

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return stage(rows.mapInArrow(run, _KEYED))


def _build(shard: pa.Table) -> pa.Table:
    """One shard of digests as its arrays, in the order of the perfect hash."""
    from tidemark.llm.perfect_hash import PerfectHash

    halves = [shard.column(x).to_numpy().view(np.uint64) for x in ("hi", "lo")]
    built = PerfectHash.build(*halves)
    order = np.argsort(built.numbers(*halves))
    arrays = [built.sizes, built.words, halves[1][order], shard.column("n_docs").to_numpy()[order], shard.column("last").to_numpy()[order]]
    row = {"shard": shard.column("shard")[0], "sizes": arrays[0], "words": arrays[1], "prints": arrays[2], "counts": arrays[3], "last": arrays[4]}
    return pa.table({k: [v if k == "shard" else v.tobytes()] for k, v in row.items()}, pa.schema([("shard", pa.int64()), *[(k, pa.binary()) for k in list(row)[1:]]]))


def _probe(asked: pa.Table, index: pa.Table) -> pa.Table:
    """The asked digests that the shard holds, with their counts and last documents."""
    from tidemark.llm.perfect_hash import PerfectHash

    if not len(index):
        return asked.select(["batch", "hi", "lo", "hi", "lo"]).slice(0, 0).rename_columns(["batch", "hi", "lo", "n_docs", "last"])
    array = {k: np.frombuffer(index.column(k)[0].as_buffer(), "<i8") for k in ("sizes", "words", "prints", "counts", "last")}
    hi, lo = (asked.column(x).to_numpy().view(np.uint64) for x in ("hi", "lo"))
    number = PerfectHash(array["sizes"], array["words"].view(np.uint64)).numbers(hi, lo)
    held = np.flatnonzero((number >= 0) & (array["prints"].view(np.uint64)[number] == lo))
    found = number[held]
    return asked.select(["batch", "hi", "lo"]).take(pa.array(held)).append_column("n_docs", pa.array(array["counts"][found])).append_column("last", pa.array(array["last"][found]))


def _cut(batch: pa.Table, answers: pa.Table) -> pa.Table:
    """The batch's texts without the lines answered for."""
    last = {(h, low): doc for h, low, doc in zip(*(answers.column(x).to_pylist() for x in ("hi", "lo", "last")), strict=True)}
    texts, kept, dropped = batch.column("text"), [], []
    keys = batch.column("keys").combine_chunks()
    bounds, fields = keys.offsets.to_pylist(), [keys.values.field(x).to_numpy(zero_copy_only=False) for x in ("line", "hi", "lo")]
    asked = {h for h, _ in last}
    near = np.isin(fields[1], np.fromiter(asked, np.int64, len(asked))) if asked else np.zeros(len(fields[1]), bool)
    for i, doc in enumerate(batch.column("doc_id").to_pylist()):
        a, b = bounds[i], bounds[i + 1]
        gone = set()
        for k in (np.flatnonzero(near[a:b]) + a).tolist():
            owner = last.get((int(fields[1][k]), int(fields[2][k])))
            if owner is not None and owner != doc:
                gone.add(int(fields[0][k]))
        text = texts[i].as_py()
        kept.append("\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone) if gone else text)
        dropped.append(len(gone))
    columns = [batch.column("doc_id"), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
    return pa.table(columns, names=["doc_id", "n_lines", "n_dropped", "kept"])


def line_index(keyed: DataFrame, fewest_docs: int, shards_for: int) -> tuple[DataFrame, int]:
    """The shards of the digests found in enough documents, as a written table, and their number.

    A digest counts once a row. The last document is the largest id; digests without any id are
    left out, since all their documents are alike the last.
    """
    key = F.explode(F.filter("keys", lambda k: k.first_in_row)).alias("k")
    seen = keyed.select("doc_id", key).groupBy(F.col("k.hi").alias("hi"), F.col("k.lo").alias("lo"))
    counted = seen.agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
    often = stage(counted.filter((F.col("n_docs") >= fewest_docs) & F.col("last").isNotNull()))
    shards = max(1, -(-often.count() // SHARD_KEYS), shards_for)
    dealt = often.withColumn("shard", F.pmod("hi", F.lit(shards)))
    return stage(dealt.groupBy("shard").applyInArrow(_build, _SHARD)), shards


def without_frequent_lines(docs: DataFrame, fewest_chars: int = 40, fewest_docs: int = 5) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of each row of ``docs(doc_id, text)``.

    Texts are split at line feeds; a null or empty text is one empty line. A line's key is the
    line without ASCII blanks at its ends, A-Z in lower case. Keys of at least ``fewest_chars``
    code points in at least ``fewest_docs`` rows lose all their lines but those of the largest
    ``doc_id`` that holds the key. Rows count as documents, so repeated rows count each, and
    rows that share the largest id all keep their lines. A null id is smaller than any other;
    where all ids are null nothing goes. An empty table gives no rows; other columns are not read.
    """
    keyed = _keyed(docs, fewest_chars)
    asks = F.filter("keys", lambda k: k.first_in_batch)
    total = keyed.agg(F.coalesce(F.sum(F.size(asks)), F.lit(0)).alias("n")).first()["n"]
    index, shards = line_index(keyed, fewest_docs, -(-total // SHARD_ASKED))
    asked = keyed.select("batch", F.explode(asks).alias("k")).select("batch", "k.hi", "k.lo", F.pmod("k.hi", F.lit(shards)).alias("shard"))
    answers = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, _ANSWER)
    return keyed.groupBy("batch").cogroup(stage(answers).groupBy("batch")).applyInArrow(_cut, _RESULT)
