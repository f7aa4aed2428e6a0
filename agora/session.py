"""Session construction, the shared checkpoint folder and the owner of staged data."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on; each is set only where neither spark-submit nor
# the configuration files set it.  The session time zone does not change any result (all day
# arithmetic is zone-free), it only keeps printed timestamps stable.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Fixed once the JVM runs, so only for a local session that this process starts.
LOCAL_DEFAULTS = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}


def _local_heap() -> str:
    """Half of the machine's memory for the one JVM of local mode."""
    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    return f"{max(1024, total // 2 >> 20)}m"


def build_session(master: str | None = None, app_name: str = "agora",
                  shuffle_partitions: int | None = None,
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or fetch) a session; package defaults never replace a setting made elsewhere."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    explicit = dict(extra_conf or {})
    if shuffle_partitions:
        explicit["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if (master or "").startswith("local") and "PYSPARK_GATEWAY_PORT" not in os.environ:
        submit = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
        for key, value in {**LOCAL_DEFAULTS, "spark.driver.memory": _local_heap()}.items():
            if key not in explicit and key not in submit and not (key.endswith("memory") and "--driver-memory" in submit):
                builder = builder.config(key, value)
    for key, value in explicit.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in SQL_DEFAULTS.items():
        if not given.contains(key) and key not in explicit:
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder, setting one if unset.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder (HDFS, S3,
    ...); it is read from the session and never replaced.  Only a local-mode
    session without the setting (unit tests) gets a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="agora-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    """A path and the file system it names, whatever that is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file."""
    target, system = _file_system(spark, path)
    return system.delete(target, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    target, system = _file_system(spark, path)
    return system.exists(target)


def move_folder(spark: SparkSession, source: str, path: str) -> None:
    """Put a folder in the place of another one, which is deleted."""
    target, system = _file_system(spark, path)
    system.delete(target, True)
    if not system.rename(spark._jvm.org.apache.hadoop.fs.Path(source), target):
        raise OSError(f"{source} cannot be moved to {path}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file."""
    target, system = _file_system(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


class Scratch:
    """Owner of the Parquet tables staged by one unit of work.

    They live in one folder below the shared checkpoint folder, which :meth:`close` deletes;
    DataFrames that read them are of no use afterwards.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/agora-{uuid.uuid4().hex}"
        self.used = False

    def new_path(self, name: str = "stage") -> str:
        self.used = True
        return f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame) -> DataFrame:
        path = self.new_path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        if self.used:
            delete_folder(self.spark, self.folder)
            self.used = False


# The scratch folder of each running application, for plans that no workspace owns.
_SCRATCH: dict[str, Scratch] = {}


def application_scratch(spark: SparkSession) -> Scratch:
    key = spark.sparkContext.applicationId
    if key not in _SCRATCH:
        _SCRATCH[key] = Scratch(spark)
    return _SCRATCH[key]


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    return a scan of it.

    This cuts the lineage like a reliable ``checkpoint()`` (the data survives
    executor loss and later reads never recompute the plan) but stores
    columnar files, which are faster to write and to read back and keep
    column pruning for the readers.  The table belongs to the application's
    scratch folder: :func:`release_staged` deletes it, at the latest when the
    Python process ends.
    """
    return application_scratch(df.sparkSession).stage(df)


def release_staged(spark: SparkSession) -> None:
    """Delete everything that :func:`stage` has written in this application."""
    scratch = _SCRATCH.pop(spark.sparkContext.applicationId, None)
    if scratch is not None:
        scratch.close()


@atexit.register
def _release_at_exit() -> None:
    for key, scratch in list(_SCRATCH.items()):
        try:
            if scratch.spark.sparkContext._jsc is not None and scratch.spark.sparkContext.applicationId == key:
                scratch.close()
        except Exception:  # the session is gone; its folder stays for the operator to delete
            pass
