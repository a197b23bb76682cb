"""SparkSession construction and the shared checkpoint folder.

Everything here is plain Spark configuration.  On a cluster the session is
normally created by the platform; ``get_session`` only fills in settings that
are still unset, so it never overrides what the cluster names (most notably
``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings we want on every session.  AQE re-plans joins at runtime from real
# sizes (broadcast only below the threshold, sort-merge above it), coalesces
# small shuffle partitions and splits skewed join partitions.
DEFAULT_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # A side is broadcast only when its (estimated or, under AQE, measured)
    # size is below this bound; otherwise the planner falls back to a
    # shuffled join.  This is the size check behind every dimension join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "parkops",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session or build one with ``DEFAULT_CONF``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    # what the cluster (spark-defaults, spark-submit) or a running session has set stays
    from pyspark import SparkConf
    active = SparkSession.getActiveSession()
    given = dict(active.sparkContext.getConf().getAll()) if active else dict(SparkConf().getAll())
    asked = {"spark.sql.shuffle.partitions", *(extra or {})}
    for k, v in conf.items():
        if k in asked or k not in given:
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``parkops`` importable in the Python workers.

    The grouped pandas functions (booking admission, stream state) live in
    this package and are pickled by reference, so every executor must be
    able to import it.  When the package is not installed on the cluster,
    it is zipped once per application and handed to ``addPyFile``, which
    ships it to every executor (the same as ``--py-files``)."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="parkops-pkg-"), "parkops.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for here, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(here, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (``DataFrame.checkpoint``).

    On a cluster ``spark.checkpoint.dir`` names a shared, fault-tolerant
    folder and is used as is (a cluster without it is an error, never a
    silent fall-back to local disk).  Only a local-mode session without it
    (local runs and tests) gets a scratch folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            # a machine-local folder is not visible to the other executors
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        conf_dir = tempfile.mkdtemp(prefix="parkops-ckpt-", dir=os.environ.get("PARKOPS_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (never machine-local
    on a cluster, because the parent comes from ``spark.checkpoint.dir``)."""
    base = ensure_checkpoint_dir(spark)
    import uuid
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def cleanup_scratch(spark: SparkSession) -> int:
    """Delete the intermediate folders this process wrote (call once the
    results built on them have been consumed).  Works on any Hadoop file
    system, so it also clears shared storage on a cluster."""
    sc = spark.sparkContext
    conf = sc._jsc.hadoopConfiguration()
    removed = 0
    while _SCRATCH:
        p = sc._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            removed += 1
    return removed
