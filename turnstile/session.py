"""Spark session defaults and the shared checkpoint location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings every job relies on: UTC time, AQE (coalescing, skew-join
# splitting, runtime broadcast switch behind the size threshold), Arrow
# transfer for the few pandas UDF paths, streaming state in RocksDB.  Set on
# the session only where the launcher has no value of its own.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Process settings for a session that no launcher has started.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    Master, shuffle partitions and driver memory are left to the launcher
    (``spark-submit``, ``spark-defaults.conf``) unless the caller passes
    them, and a default above is not applied where a running session or the
    launcher already has a value.
    """
    given = {k: str(v) for k, v in (extra or {}).items()}
    if shuffle_partitions is not None:
        given.setdefault("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if "TURNSTILE_DRIVER_MEMORY" in os.environ:
        given.setdefault("spark.driver.memory", os.environ["TURNSTILE_DRIVER_MEMORY"])
    running = SparkSession.getActiveSession()
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ  # spark-submit started this process
    builder = SparkSession.builder
    if master is not None:
        builder = builder.master(master)
    if app_name is not None or not (running or submitted):
        builder = builder.appName(app_name or "turnstile")
    for k, v in ({} if running or submitted else LOCAL_CONF).items():
        builder = builder.config(k, v)
    for k, v in given.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    launched = spark.sparkContext.getConf()
    for k, v in DEFAULT_CONF.items():
        if k not in given and not launched.contains(k):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, streaming state and written tables.

    The cluster names it in ``spark.checkpoint.dir``.  A temporary local
    folder is chosen only where the setting is absent *and* the master is
    local (tests, laptops); on a cluster a missing setting is an error,
    because executors cannot read each other's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="turnstile-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """What ``transformWithState`` needs, also in a session that ``get_spark``
    has not made: its own kinds of state, which Spark's default store cannot
    keep.  Streams that run, or go on from a checkpoint, keep their store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint root, on whatever file system
    that is; its writer creates it."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of the file system it belongs to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def writable(spark: SparkSession, path: str) -> bool:
    """Whether the nearest existing folder above ``path`` may be written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while not fs.exists(p) and p.getParent() is not None:
        p = p.getParent()
    try:
        fs.access(p, spark._jvm.org.apache.hadoop.fs.permission.FsAction.WRITE)
    except Py4JJavaError as e:
        if "AccessControlException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def committed_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching a glob in which a writer has finished (``_SUCCESS``),
    sorted by name; asked of the file system they belong to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching a glob, sorted by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found or [] if f.isDirectory())


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder and what is in it; one that is gone is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per context.

    Python functions of Spark jobs are pickled by reference, so executors
    need the package: installed, by ``--py-files``, or through this call,
    which hands Spark a zip of the sources to distribute.
    """
    sc = spark.sparkContext
    if getattr(sc, "_turnstile_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    spool = os.path.join(tempfile.mkdtemp(prefix="turnstile-py-"), "turnstile_src.zip")
    with zipfile.ZipFile(spool, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(spool)
    sc._turnstile_shipped = True


def reuse(df):
    """Materialise an intermediate that several branches of a plan consume.

    Spark does not share a sub-plan between branches whose column pruning
    differs, so each consumer would recompute it from the base tables.  A
    reliable ``checkpoint()`` writes it once to the shared checkpoint folder
    (survives executor loss, cuts lineage) and every branch reads that copy.
    Use only for intermediates much smaller than their inputs.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def save_bucketed(df, name: str, by, buckets: int, sort: bool = True):
    """Write ``df`` once as a catalog table bucketed (and sorted) by ``by``.

    Later aggregations and joins on those keys read it without a shuffle —
    e.g. the transactions view (lineitem ⋈ orders) bucketed by user for
    the per-user jobs, so the big join and its exchange run once instead of
    in every job.  Files go to the session's warehouse folder (shared
    storage on a cluster).  Returns the table as a DataFrame.
    """
    by = [by] if isinstance(by, str) else list(by)
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *by)
    if sort:
        w = w.sortBy(*by)
    w.saveAsTable(name)
    return df.sparkSession.table(name)
