"""Session helpers: one place for the configuration every job relies on.

The library never invents machine-local folders on a cluster.  Lineage cuts and
intermediate tables go under the shared folder named by ``spark.checkpoint.dir``;
only when that setting is absent (unit tests, a laptop) do we fall back to a
fresh folder under the system temp directory.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Settings a session needs for this library; applied only when not already set,
# so a cluster's own configuration wins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # let AQE coalesce the partitions of persisted plans (the vote plan persists
    # its grouped candidates) instead of keeping spark.sql.shuffle.partitions
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches handed to Python (example scan, generation) are bounded by
    # rows and by bytes, since a row may carry a whole document
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.ui.enabled": "false",
    "spark.scheduler.mode": "FAIR",
}


_SHIPPED: set = set()  # applications whose executors have the package


def get_session(master: str | None = None, app: str = "sqltally",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    given = SparkContext._active_spark_context.getConf() if SparkContext._active_spark_context else SparkConf()
    conf = {k: v for k, v in conf.items() if not given.contains(k)} | (extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship_package(spark)
    checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Gives executors this package, where they don't have it on their path.

    Python functions of the operators are pickled by reference, so a worker
    must be able to import the package."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="sqltally-package-")  # the driver serves it to the executors
    path = os.path.join(folder, "sqltally.zip")
    write_package(path)
    sc.addPyFile(path)


def write_package(path: str) -> None:
    """A zip file of this package's modules."""
    root = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("sqltally", os.path.relpath(full, root)))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from the session (``spark.checkpoint.dir``); set our own only when it
    is unset, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir is None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="sqltally-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if current is None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique location under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return f"{base}/sqltally/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so plain Python can look at local paths."""
    return path[5:] if path.startswith("file:") else path


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
