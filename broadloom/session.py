"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kept as plain settings so that a cluster profile can override each of them.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Per-feature aggregates emit one partial row per feature and task: fewer,
    # larger scan tasks give a smaller shuffle on very wide tables.
    "spark.sql.files.maxPartitionBytes": "512m",
    # Rows of a wide matrix are large; this is also the encode batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "256m",
}


def get_session(app: str = "broadloom", **overrides: str) -> SparkSession:
    """Build or reuse a session with the recommended settings."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**RECOMMENDED, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application.

    Workers import it wherever they run; the driver may have found it on a path that
    they do not share.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="broadloom-"), "broadloom.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = os.path.join(tempfile.gettempdir(), "broadloom-shared")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/broadloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder as Parquet.

    The result has a known size, so Catalyst decides by itself whether a later
    join may broadcast it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the stored table behind a result of ``materialize``.

    Only for tables that no later job reads, such as the last state of an iteration once the next
    one is stored: a lost executor may make Spark read any table of an open plan again.
    """
    context = df.sparkSession.sparkContext
    plain = lambda path: re.sub(r"^\w+:/*", "/", path)
    own = plain(f"{shared_dir(df.sparkSession)}/broadloom/")
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if plain(path).startswith(own):
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, system = _file(spark, path)
    return system.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table by its path, if it is there."""
    target, system = _file(spark, path)
    system.delete(target, True)


def rename_path(spark: SparkSession, old: str, new: str) -> bool:
    """Give a file another name in one step; false if another one has it already."""
    target, system = _file(spark, new)
    return not system.exists(target) and system.rename(_file(spark, old)[0], target)


def list_files(spark: SparkSession, path: str, ending: str) -> list[str]:
    """The files of a folder whose names end so, in order."""
    target, system = _file(spark, path)
    return sorted(
        name for s in system.listStatus(target) if (name := s.getPath().toString()).endswith(ending)
    )


# Rows of parameters or interval bounds (about 100 MB) that may go to every executor.
BROADCAST_ROWS = 2_000_000


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A join side of ``rows`` counted rows: broadcast up to ``limit``, else shuffled.

    The row width must be bounded. The hint spares the large side a shuffle that the
    optimizer would plan for a side whose size it can only guess.
    """
    return F.broadcast(df) if rows <= limit else df
