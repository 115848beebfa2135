"""What Parquet footers say of the stored files, read in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BOUNDS = "file string, low string, high string, known boolean"


def open_file(path: str):
    """A file of any file system that pyarrow knows, by the path Spark has for it."""
    from pyarrow import fs

    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    system, place = fs.FileSystem.from_uri(uri)
    return system.open_input_file(place)


def _group_bounds(footer, column: str) -> list[tuple[str, str, bool]]:
    """(smallest, largest, known) text of the column in each row group that has rows."""
    found = []
    for group in map(footer.row_group, range(footer.num_row_groups)):
        chunks = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        chunk = chunks.get(column)
        stats = chunk.statistics if chunk is not None else None
        if not group.num_rows:
            continue
        if chunk is None or (stats is not None and stats.null_count == group.num_rows):
            found.append(("", "", True))  # an absent value may read as empty text
        elif stats is None or not stats.has_min_max or not isinstance(stats.min, str):
            found.append(("", "", False))
        else:
            found.append((stats.min if stats.null_count == 0 else "", stats.max, True))
    return found


def _bounds_of(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def bounds(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch.column("file").to_pylist():
                try:
                    with open_file(path) as source:
                        groups = _group_bounds(pq.ParquetFile(source).metadata, column)
                except (pa.ArrowException, OSError, ValueError):  # a file system pyarrow lacks
                    groups = [("", "", False)]
                rows += [(path, *group) for group in groups]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = {"file": pa.string(), "low": pa.string(), "high": pa.string(), "known": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds.values(), strict=True)], [*kinds])

    return bounds


def text_bounds(spark: SparkSession, files: list[str], column: str, files_per_task: int = 256) -> DataFrame:
    """``file, low, high, known`` for each row group: the range of a text column.

    Not ``known`` are row groups without statistics and files that pyarrow cannot open.
    """
    tasks = max(1, -(-len(files) // files_per_task))
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks)
    return listed.mapInArrow(_bounds_of(column), BOUNDS)
