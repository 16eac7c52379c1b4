"""Session helpers: a test session, durable intermediate tables, code shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SPOOLED: dict[str, SparkSession] = {}
#: Spark removes the shuffle files of a finished execution; what it wrote no longer needs them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session as tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shutterlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def is_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Give the executors this package unless they import it already by the PYTHONPATH that they have."""
    sc = spark.sparkContext
    theirs = os.environ.get("PYTHONPATH", "") if is_one_machine(spark) else sc.getConf().get("spark.executorEnv.PYTHONPATH", "")
    if _ROOT in theirs.split(os.pathsep) or getattr(sc, "_shutterlake", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "shutterlake_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "shutterlake")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(target)
    sc._shutterlake = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's; on one machine, else, one of our own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not is_one_machine(spark):
            raise RuntimeError("a cluster needs a shared folder for intermediate tables: set spark.checkpoint.dir")
        folder = getattr(sc, "_shutterlake_dir", None)
        if not folder:
            folder = sc._shutterlake_dir = "file://" + tempfile.mkdtemp(prefix="shutterlake-")
    return folder.rstrip("/")


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def spool(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    Unlike cached blocks the files outlive an executor. The shuffles that made
    them go at once; they go when `discard` is called, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spool-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    if not _SPOOLED:
        atexit.register(_clear)
    _SPOOLED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove spooled tables that nothing will read again; other tables are left alone."""
    for t in tables:
        path = getattr(t, "_spooled", None)
        if path is not None and path in _SPOOLED:
            _remove(_SPOOLED.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    for path, spark in _SPOOLED.items():
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
