"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


# Split the heavy side of a join at run time even if that costs a later aggregate one more shuffle:
# otherwise all rows of a hot household would follow the join into one task.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set what the row-level joins rely on; all of it may change while a session runs."""
    for name, value in SKEW_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(app: str = "umbral", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and the benchmark; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("UMBRAL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return apply_settings(session)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    fallback = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(fallback)
    return spark.sparkContext.getCheckpointDir()


_SCRATCH: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it is deleted when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        folder = f"{shared_folder(spark).rstrip('/')}/scratch-{app}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _SCRATCH[app] = folder
    return _SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet in the application's scratch folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, name: str) -> None:
    """Delete a table of the scratch folder that no later job reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> SparkSession:
    """Let the files of a shuffle go when its query ends; else they lie on disk until the driver happens to collect garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs restart from files, not from lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """Deal rows out when there are fewer tasks than cores (few or unsplittable files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if tasks >= cores else df.repartition(cores)


def write_through(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a columnar table in the shared folder: a job boundary readers can prune."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    return spread(back, back.rdd.getNumPartitions())


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Rows an iterative fit reads many times, held in memory or on disk while it runs.

    Lost blocks are computed again from the plan.
    """
    first = df.persist(StorageLevel.MEMORY_AND_DISK)
    rows = spread(first, first.rdd.getNumPartitions())
    if rows is not first:  # one copy is enough
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        rows.count()
        first.unpersist()
    try:
        yield rows
    finally:
        rows.unpersist()
        first.unpersist()
