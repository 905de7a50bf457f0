"""Session helpers: the package on executors, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch where the session has Spark's default.
ARROW_ROWS = 2000
#: Bytes of rows, as they are in memory and before sorting, that ``dealt`` gives to one task.
TASK_BYTES = 128 << 20
#: Spark's setting by which a command deletes its shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: dict[str, bool] = {}


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once for each application.

    Spark distributes the archive itself, so executors need no shared folder for it.
    Arrow batches get ``ARROW_ROWS`` rows, unless the session has a number of its own:
    rows are whole texts here, and a task holds some copies of a batch.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if _shipped.get(sc.applicationId):
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        archive = Path(folder) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        kept = Path(tempfile.mkdtemp()) / archive.name
        kept.write_bytes(archive.read_bytes())
    sc.addPyFile(str(kept))
    _shipped[sc.applicationId] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset in a local
    session (as in tests) a folder of our own is set.  A cluster without it is refused.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Commands meanwhile delete their shuffle files as they end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts lineage: writes a table to the shared folder and reads it back; what was shuffled for it is deleted."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_deleted(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dealt(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """Rows of about ``size`` bytes in memory dealt by keys over as many tasks as that takes, ``spark.sql.shuffle.partitions`` at least.

    With a fixed number a task would grow with the table, and where Spark chooses it goes by
    the bytes shuffled, which may be a twentieth of those in memory.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-size // TASK_BYTES)), *keys)


def forget(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for a table that is read no more; others are left alone."""
    path = getattr(df, "_written_to", None)
    if path:
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
