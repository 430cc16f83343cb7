"""Spark session helpers.

Cluster settings always win: a default is only set where the session, the submit command and
spark-defaults leave the key unset.  The checkpoint directory is read from ``spark.checkpoint.dir``;
only a ``local[*]`` master may fall back to a scratch folder, any other master raises.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Runtime defaults, set where unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Launch settings of a session that this process starts on one machine (tests, bench).
_LOCAL = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "kgrec", driver_memory: str | None = None) -> SparkSession:
    """The running session, or a new one; arguments given here are explicit settings, the rest are defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local["):
            for k, v in _LOCAL.items():
                builder = builder.config(k, v)
    driver_memory = driver_memory or os.environ.get("KGREC_DRIVER_MEMORY")
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for k, v in _DEFAULTS.items():
        if not given.contains(k):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch one only where none is configured on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="kgrec-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that functions find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_kgrec_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="kgrec-package-")  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "kgrec_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "kgrec")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    sc._kgrec_shipped = True
