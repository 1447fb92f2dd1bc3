"""Session helpers: one place for the knobs every job relies on.

Nothing here changes results; it only sets the execution environment
(AQE, UTC session time zone, Arrow) and resolves the shared checkpoint
folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Bytes above which a "small" side is not broadcast but shuffled instead.
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024


def get_spark(master: str | None = None, app: str = "geoseries",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests / local runs. On a cluster, reuse the active session."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    Read from ``spark.checkpoint.dir``.  Only a local-mode session without one
    (tests on one machine) gets a fresh scratch folder; on a cluster a missing
    setting is an error, because a machine-local folder is not shared.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir and sc is None:
        return conf_dir
    if not conf_dir:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not str(master).startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        conf_dir = tempfile.mkdtemp(prefix="geoseries-ckpt-")
        if sc is None:
            spark.conf.set("spark.checkpoint.dir", conf_dir)
            return conf_dir
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name) if "://" not in base else base.rstrip("/") + "/tables/" + name


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it
    back: the plan runs once, the lineage is cut, and the files survive executor
    loss (never ``localCheckpoint``).  For tables that several branches consume,
    small ones (aggregates, per-step forecast state) or, where a corpus is read
    in several passes, as large as the input.  The files go when the application
    ends, or earlier by :func:`drop_staged`."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    _delete_at_exit(spark, path)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out.staged_path = path
    return out


def _file_system(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf), where


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """A staged table lives as long as the application: the file system removes it
    when the driver's JVM ends (a plan that reads it may run until then)."""
    try:
        fs, where = _file_system(spark, path)
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        return
    fs.deleteOnExit(where)


def drop_staged(*tables: DataFrame) -> None:
    """Remove tables of :func:`cut_lineage` that no further plan reads."""
    for df in tables:
        path = getattr(df, "staged_path", None)
        if path:
            fs, where = _file_system(df.sparkSession, path)
            fs.delete(where, True)


def write_pointer(spark: SparkSession, path: str, text: str) -> None:
    """Put ``text`` into the small file ``path`` in one step: it is written beside
    it and renamed over it, so a reader sees the old text or the new one."""
    fs, where = _file_system(spark, path)
    sc = spark.sparkContext
    jvm = sc._jvm
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(beside), fs.makeQualified(where), how)


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """The text of a pointer file, None where there is none yet."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def remove_folders(spark: SparkSession, base: str, keep: set) -> None:
    """Remove the folders ``version=...`` of ``base`` but those in ``keep``."""
    fs, where = _file_system(spark, base)
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("version=") and name not in keep:
            fs.delete(status.getPath(), True)


def broadcast_if_small(df: DataFrame, est_bytes: int,
                       limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Broadcast hint only behind a size check made by the caller."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if est_bytes <= limit else df
