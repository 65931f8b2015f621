"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.codegen.cache.maxEntries": "2000",  # feature plans hold more than 100 generated classes
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # call-site capture costs more than small plans
}

_RECORDERS: list[list[str]] = []


def get_session(app: str = "barframe", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with UTC time, AQE and skew handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the tasks of ``spark`` (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_barframe_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="barframe-ship-")) / "barframe.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._barframe_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a fresh temporary folder. On a cluster a
    machine-local folder would not survive a lost executor, so the setting is required there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="barframe-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/barframe/{label}-{uuid.uuid4().hex[:12]}"
    for paths in _RECORDERS:
        paths.append(path)
    return path


@contextmanager
def recorded_scratch(paths: list[str]) -> Iterator[list[str]]:
    """Collects the scratch paths handed out in the block, so that their owner can ``remove`` them when done."""
    _RECORDERS.append(paths)
    try:
        yield paths
    finally:
        _RECORDERS[:] = [p for p in _RECORDERS if p is not paths]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored stage on its file system."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings for the plans run in the block; keys have ``__`` in place of dots and no ``spark.sql`` in front."""
    keys = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def freed_shuffles(spark: SparkSession):
    """Shuffle files of the plans run in the block go when their plan ends, rather than when the driver next collects garbage."""
    return settings(spark, classic__shuffleDependency__fileCleanup__enabled="true")


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the stored table.

    Used where the same expensive plan would otherwise be evaluated by several branches
    (block totals plus rows, driver-side fitting loops). The table outlives lost executors, so the
    shuffles that made it are freed at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with freed_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on the file system that Spark itself resolves it on."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)
