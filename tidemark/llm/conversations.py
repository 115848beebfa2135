"""Repair of conversation structure: faults, cheapest edits, repaired turns.

Rows are sorted by conversation and turn over evenly cut ranges, so a conversation of any length
is spread; each range is cut into blocks of bounded rows and bytes. A block that holds a whole
conversation is repaired by its signature alone: distinct signatures of all conversations, in
the order of their reversed text, run through one automaton that shares their suffixes, and the
edits found go back to every block with that signature. Conversations of several blocks take two
narrow passes over signatures: costs to go from the last block back, states from the first on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, small, stage
from tidemark.llm.dawg import Automaton, continued, replay

_BLANK = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
#: Most rows and characters of a block (a longer text has a block of its own), and most nodes
#: an automaton keeps before it starts anew.
BLOCK_ROWS, BLOCK_CHARS, MOST_NODES = 1 << 12, 1 << 20, 1 << 20

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_AREA = ["conv_id", "part", "seq"]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, ``conv_id, turn, role, text, n``: n copies, dropped rows with none.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties the text, 2 takes its ``.!?``
    away, 3 repeats the row, 4 makes the role user. Nulls are one blank, but a null id or turn
    stays null in its column.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    blank = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(blank("role"))
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("n"))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Equal rows folded, with ``later``: an earlier turn has the same role and text.

    Only texts that stand at several turns of a conversation are looked up.
    """
    narrow = rows.filter("n > 0").select("conv_id", "role", _digest("text").alias("digest"), "turn")
    spans = narrow.groupBy("conv_id", "role", "digest").agg(
        F.max(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("low"), F.max("turn").alias("high")
    )
    twice = stage(spans.filter("low < high OR (untimed AND high IS NOT NULL)").drop("high")).alias("t")
    folded = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).alias("r")
    same = F.expr("r.conv_id <=> t.conv_id AND r.role = t.role") & (_digest("r.text") == F.col("t.digest"))
    later = F.expr("coalesce(r.turn > t.low OR (t.untimed AND r.turn IS NOT NULL), false)")
    return stage(folded.join(twice, same, "left").select("r.*", later.alias("later")))


class _Block:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: Any, seq: int) -> None:
        self.conv, self.seq = conv, seq
        self.symbols: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.chars = 0
        self.count = dict.fromkeys(_COUNTS, 0)
        self.head = self.tail = self.low = self.high = None

    def full(self, most_rows: int) -> bool:
        return len(self.symbols) >= most_rows or self.chars >= BLOCK_CHARS

    def add(self, turn: int | None, role: str, text: str, later: bool) -> None:
        initial, core = role[:1], text.strip(_BLANK)
        if self.tail is None:
            self.head = initial
        else:
            self.count["illegal"] += self.tail + initial not in _LEGAL
        self.tail = initial
        if turn is not None:
            self.count["turns"] += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if not core or later:
            self.symbols.append("X")
            self.count["blank" if not core else "duplicate"] += 1
            return
        cut = core[-1] not in ".!?"
        self.count["truncated"] += cut
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append(symbol.upper() if cut else symbol)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)


def _block_schema(rows: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    texts = pa.list_(pa.string())
    return pa.schema(
        [
            ("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)),
            *[("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), ("signature", pa.string())],
            *[("roles", texts), ("texts", texts), ("head", pa.string()), ("tail", pa.string())],
            *[("low", pa.int64()), ("high", pa.int64())],
            *[(x, pa.int64()) for x in _COUNTS],
        ]
    )


def _blocks(rows: DataFrame, most_rows: int) -> DataFrame:
    """The sorted rows in blocks; a written table. ``whole`` blocks hold all of a conversation."""
    schema, names = _block_schema(rows), rows.columns

    def out(block: _Block, whole: bool) -> dict:
        own = {"conv_id": block.conv, "part": TaskContext.get().partitionId(), "seq": block.seq, "whole": whole}
        own |= {"signature": "".join(block.symbols), **{x: getattr(block, x) for x in ("roles", "texts", "head", "tail", "low", "high")}}
        return own | block.count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, done = None, True, []
        for batch in small(batches):
            for conv, turn, role, text, n, later in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if block is None or conv != block.conv:
                    if block is not None:
                        done.append(out(block, block.seq == 0 and not first))
                        first = False
                    block = _Block(conv, 0)
                for copy in range(n):
                    if block.full(most_rows):
                        done.append(out(block, False))
                        block = _Block(conv, block.seq + 1)
                        if len(done) > 4:
                            yield pa.RecordBatch.from_pylist(done, schema)
                            done = []
                    block.add(turn, role, text, later or copy > 0)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if block is not None:
            yield pa.RecordBatch.from_pylist([out(block, False)], schema)

    order = ["conv_id", "turn", "role", "text"]
    cut = rows.repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    from pyspark.sql.pandas.types import from_arrow_schema

    return stage(cut.mapInArrow(run, from_arrow_schema(schema)))


def _solved(blocks: DataFrame) -> DataFrame:
    """Edits of every distinct signature of whole conversations, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            signatures = batch.column("signature").to_pylist()
            edits = []
            for signature in signatures:
                if len(automaton.best) > MOST_NODES:
                    automaton = Automaton()
                edits.append(automaton.audit(automaton.add(signature), 0)[0])
            yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.string()), pa.array(edits, pa.string())], names=["signature", "edits"])

    distinct = blocks.filter("whole").select("signature").distinct().withColumn("ending", F.reverse("signature"))
    return stage(distinct.repartitionByRange("ending").sortWithinPartitions("ending").mapInArrow(run, "signature string, edits string"))


def _ways(blocks: DataFrame) -> DataFrame:
    """Of each block of a longer conversation its edits from every state, costs to go taken from the last block back."""
    conv = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, costs = object(), None
        for batch in batches:
            ways = []
            for own, signature in zip(batch.column("conv_id").to_pylist(), batch.column("signature").to_pylist(), strict=True):
                automaton = Automaton() if own != conv else Automaton(continued(costs))
                node = automaton.add(signature)
                conv, costs = own, automaton.costs(node)
                ways.append([dict(zip(("edits", "after"), automaton.audit(node, q), strict=True)) for q in range(4)])
            kind = pa.list_(pa.struct([("edits", pa.string()), ("after", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in _AREA), pa.array(ways, kind)], names=[*_AREA, "ways"])

    narrow = blocks.filter("NOT whole").select(*_AREA, "signature").repartition("conv_id")
    sorted_back = narrow.sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    return sorted_back.mapInArrow(run, f"{conv}, part int, seq bigint, ways array<struct<edits:string,after:int>>")


def _chosen(blocks: DataFrame) -> DataFrame:
    """Of each block of a longer conversation the state it starts in and its edits."""
    conv = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), 0
        for batch in batches:
            states, edits = [], []
            for own, ways in zip(batch.column("conv_id").to_pylist(), batch.column("ways").to_pylist(), strict=True):
                state = state if own == conv else 0
                conv = own
                states.append(state)
                edits.append(ways[state]["edits"])
                state = ways[state]["after"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in _AREA), pa.array(states, pa.int32()), pa.array(edits, pa.string())], names=[*_AREA, "state", "edits"])

    return stage(_ways(blocks).sortWithinPartitions(*_AREA).mapInArrow(run, f"{conv}, part int, seq bigint, state int, edits string"))


def repaired_blocks(conversations: DataFrame, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the damaged conversations with their cheapest edits, two written tables in one.

    ``conversations(conv_id, turn, role, text)``; other columns are not read. Rows follow by turn
    (null turns first), then role, then text. A conversation without rows has one empty block; an
    empty table gives none.
    """
    blocks = _blocks(_with_repeats(damaged(conversations)), most_rows)
    single = blocks.filter("whole").join(_solved(blocks), "signature").withColumn("state", F.lit(0))
    chosen = _chosen(blocks).withColumnsRenamed({x: f"of_{x}" for x in _AREA})
    same = F.expr("conv_id <=> of_conv_id AND part = of_part AND seq = of_seq")
    several = blocks.filter("NOT whole").join(chosen, same).drop(*[f"of_{x}" for x in _AREA])
    return single.select(*blocks.columns, "state", "edits").union(several.select(*blocks.columns, "state", "edits"))


def repaired_turns(blocks: DataFrame) -> DataFrame:
    """The repaired rows of ``repaired_blocks``: ``conv_id, part, seq, place, role, text``, in order of these numbers."""
    conv = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}"
    made = "array<struct<role:string,text:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (batch.column(x).to_pylist() for x in ("signature", "edits", "state", "roles", "texts"))
            turns = [[{"role": r, "text": t} for r, t in replay(*row)[1]] for row in zip(*rows, strict=True)]
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in _AREA), pa.array(turns, kind)], names=[*_AREA, "turns"])

    done = blocks.mapInArrow(run, f"{conv}, part int, seq bigint, turns {made}")
    return done.select(*_AREA, F.posexplode("turns").alias("place", "turn")).select(*_AREA, "place", "turn.role", "turn.text")


class _Report:
    """Figures of one conversation, block by block."""

    def __init__(self, conv: Any) -> None:
        self.row = {"conv_id": conv, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
        self.hash, self.edits, self.any = hashlib.sha256(), [], False
        self.turns, self.low, self.high, self.tail = 0, None, None, None

    def add(self, block: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.row[name] += block[name]
        if self.tail is not None and block["head"] is not None:
            self.row["illegal"] += self.tail + block["head"] not in _LEGAL
        self.tail = block["tail"] if block["tail"] is not None else self.tail
        if block["low"] is not None:
            self.turns += block["turns"] - (block["low"] == self.high)
            self.low = block["low"] if self.low is None else self.low
            self.high = block["high"]
        cost, turns = replay(*(block[x] for x in ("signature", "edits", "state", "roles", "texts")))
        self.row["cost"] += cost
        self.edits.append(block["edits"])
        for role, text in turns:
            self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode(errors="surrogatepass"))
            self.any = True

    def result(self) -> dict:
        if self.low is not None:
            self.row["gaps"] = self.high - self.low + 1 - self.turns
        return self.row | {"audit": "".join(self.edits), "repaired_sha256": self.hash.hexdigest()}


def report(blocks: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired_blocks``.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` (of the
    repaired ``role:text`` joined by line feeds). A null id is a conversation of its own. Blocks
    of longer conversations stream through a task in order; nothing but the running hash and the
    edits of one conversation is held.
    """
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    conv = blocks.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, {', '.join(f'{x} bigint' for x in longs)}, audit string, repaired_sha256 string"
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [("conv_id", to_arrow_type(blocks.schema["conv_id"].dataType)), *[(x, pa.int64()) for x in longs]]
    arrow = pa.schema([*kinds, ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            for block in batch.to_pylist():
                if current is None or block["conv_id"] != current.row["conv_id"]:
                    if current is not None:
                        done.append(current.result())
                    current = _Report(block["conv_id"])
                current.add(block)
            yield pa.RecordBatch.from_pylist(done, arrow)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.result()], arrow)

    single = blocks.filter("whole").mapInArrow(run, schema)
    several = blocks.filter("NOT whole").repartition("conv_id").sortWithinPartitions(*_AREA)
    return single.union(several.mapInArrow(run, schema))
