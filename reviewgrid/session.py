"""Spark session and shared-folder helpers.

Library code never builds its own session for a query: every operator
takes the caller's ``SparkSession``. ``get_spark`` exists for tests,
``bench.py`` and ad-hoc use.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "reviewgrid",
              shuffle_partitions: int | None = None) -> SparkSession:
    master = master or os.environ.get("SPARK_MASTER", "local[*]")
    cpus = os.cpu_count() or 8
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is. Unset, a local session gets a temporary folder; on a cluster it
    is an error, as executors could not read each other's files there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="reviewgrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for one job's tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/reviewgrid/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def removes_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes, and actions on frames made herein, remove their shuffle files when they end, where Spark would keep
    them until the driver happens to collect its garbage. (If a plan were run again, its stages would be, too.)"""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def kept(table: DataFrame, path: str) -> DataFrame:
    """``table``, read from ``path``, for ``discard``."""
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` or the corpus operators' ``spill`` returned, once everything that reads them has been written. Other frames are left alone."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from the table,
    and a lost executor costs only the tasks that were reading it."""
    path = work_path(df.sparkSession, name)
    with removes_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return kept(df.sparkSession.read.schema(df.schema).parquet(path), path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``reviewgrid`` importable in Python workers (``addPyFile``).

    Needed before any ``mapInPandas`` / pandas UDF whose function lives in
    this package: executors unpickle it by module name. Done once per
    application, like ``--py-files`` at submit time.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="reviewgrid-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
