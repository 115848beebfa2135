"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on. They are runtime settings, so they can also be put on a
# session that somebody else has built.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects that repeat a key keep the last value instead of failing to parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings for speed. The JVM compiles no method over 8,000 bytes, and wide projections generate
# larger ones; beyond this limit Spark leaves them out of whole stages and cuts them up.
SPEED_CONF = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in {**REQUIRED_CONF, **SPEED_CONF}.items():
        spark.conf.set(key, value)
    return spark


def get_session(app_name: str = "tidemark", **extra: str) -> SparkSession:
    """Build a session; cluster sizing stays with spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give a session that names no ``spark.checkpoint.dir`` one of its own.

    For the driver contract and tests only: a cluster names a folder that its machines share.
    """
    if not checkpoint_dir(spark):
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/tidemark")


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver found it; once per application."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for path in sorted(package.rglob("*.py")):
            target.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tidemark_shipped = True


def checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables, under the session's checkpoint folder."""
    base = checkpoint_dir(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this package's own making."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """As ``stage``, for jobs that end here: the table goes when the block ends."""
    path = scratch_dir(df.sparkSession, label)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove(df.sparkSession, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table that several jobs read, and read it back.

    Unlike a cache it survives lost executors and cuts the lineage.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
