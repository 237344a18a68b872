"""Session helpers.

Library code never creates a session: every operator takes DataFrames.  These
helpers are for tests, the bench and small scripts; on a cluster the platform
hands you a session and only :func:`checkpoint_dir` is consulted.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this library relies on (safe at any scale).
_REQUIRED = {
    # Runtime re-planning: converts joins whose side turns out small into
    # broadcast joins (a size check done on real statistics), coalesces tiny
    # shuffle partitions and splits skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "perkframe") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files of multi-pass operators are removed once unused
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in _REQUIRED.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it has to be set to a path that every machine sees; unset, it
    is an error there.  With a local master a scratch folder is made.  Spark
    gives each application a folder of its own in it, which is removed when the
    driver's process ends.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="perkframe-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    own = sc.getCheckpointDir() or path  # a folder of this application's in it
    if own not in _OWN_FOLDERS and own != path:
        _OWN_FOLDERS.add(own)
        atexit.register(_remove_at_exit, sc._jvm, own)
    return own


_OWN_FOLDERS: set[str] = set()


def _remove_at_exit(jvm, path: str) -> None:
    """Scratch tables and files of an application end with it."""
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def ensure_conf(spark: SparkSession) -> None:
    """Apply the settings this library relies on to an existing session."""
    for k, v in _REQUIRED.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    return os.path.join(checkpoint_dir(spark), name)
