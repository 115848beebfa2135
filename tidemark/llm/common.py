"""Helpers that several corpus operators share: columns, staged tables, batches, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by exact spelling, else by spelling without case.

    Of several columns with one spelling the first counts; other columns are not read, so extra
    columns cannot clash with those an operator adds.
    """
    return unnamed(df).select([F.col(place_of(df, x)).alias(x) for x in names])


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors must share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read again.

    Cuts lineage: lost executors don't repeat what came before, and what a task numbered
    (partitions, rows) stays as it was written.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def pieces(texts: pa.Array, limit: int = 4 << 20) -> Iterator[pa.Array]:
    """The array cut so that each piece has about ``limit`` bytes, or is a single text."""
    if len(texts):
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(texts)], strict=True):
            yield texts.slice(a, b - a)


def small(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``limit`` bytes of ``text``, or is a single row."""
    for batch in batches:
        at = 0
        for piece in pieces(batch.column("text"), limit):
            yield batch.slice(at, len(piece))
            at += len(piece)


def text_udf(run: Callable[[list[str | None]], pa.Array], kind: str, limit: int = 1 << 20) -> Callable[[Column], Column]:
    """A column function that gives ``run`` lists of texts of about ``limit`` bytes."""

    def whole(texts: pa.Array) -> pa.Array:
        done = [run(x.to_pylist()) for x in pieces(texts, limit)]
        return pa.concat_arrays(done) if done else run([])

    return F.arrow_udf(whole, kind)


def unnamed(df: DataFrame) -> DataFrame:
    """``df`` with columns by number, so that added columns clash with none; undone by ``toDF``."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> str:
    """The column of ``unnamed(df)`` that ``pick`` would take."""
    have = df.columns
    return f"c{have.index(name) if name in have else [x.lower() for x in have].index(name.lower())}"


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(v, root)``, root the smallest member.

    Alternates large-star and small-star steps until every component is a star around its
    smallest member. Each step takes minima by key, which combine before the shuffle, and joins
    them back to the edges; hot vertices are left to the skew join. Every round is a written
    table. Vertices without an edge to another vertex have no row.
    """
    current = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(lowest, both.a == lowest.u).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large.a == low.u).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        current = stage(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("a").alias("v"), F.col("b").alias("root")).union(current.select("b", "b").distinct())
        seen = state
