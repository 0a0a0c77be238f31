"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Rows of one task where a plan sets its own number of tasks.
ROWS_PER_TASK = 250_000


def build_session(app: str = "tidebook", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every plan relies on.

    Shuffle sizing is left to AQE: start with many small partitions and let it
    coalesce, split skewed joins and pick broadcast sides at run time.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once per application.

    Workers then import it wherever the driver was started from; Spark's own
    file server hands the archive to the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_tidebook_shipped", False):
        return
    package = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-ship-", dir="/tmp"), "tidebook.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._tidebook_shipped = True


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Number of tasks for a shuffle that Spark must not merge or leave at the
    session's fixed count: a task's rows, and so its memory, then stay the same
    however large the input is. Every task slot gets one at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master gets one folder per session (as in tests);
    elsewhere an executor could not read it, so that is an error.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can read")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_CONF, root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives executor loss."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
