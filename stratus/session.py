"""Session helpers: the only place that builds a SparkSession."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC wall clock (event times and calendar
# features must not depend on the machine's zone), ANSI on, AQE on so that
# shuffle partition counts, broadcast choices and skewed joins are re-planned
# from runtime statistics.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of unreachable DataFrames are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "stratus",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with :data:`BASE_CONF` applied.

    On a cluster ``master`` stays ``None`` and the submitter's settings win;
    tests and the bench pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(k, conf[k])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediates that every executor and the driver can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode
    session that leaves it unset (tests, the bench) gets a folder of its own;
    on a cluster a missing setting is an error, never a machine-local path.
    """
    current = (spark.conf.get("spark.checkpoint.dir", None)
               or spark.sparkContext.getCheckpointDir())
    if current:
        return current
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder all executors share")
    folder = tempfile.mkdtemp(prefix="stratus-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A fresh path under :func:`shared_folder`, removed when the application
    ends."""
    path = f"{shared_folder(spark).rstrip('/')}/stratus-{label}-{uuid.uuid4().hex}"
    target, files = _file_system(spark, path)
    files.deleteOnExit(target)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that :func:`scratch_path` named, once nothing reads it."""
    target, files = _file_system(spark, path)
    files.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder inside the shared store."""
    old, files = _file_system(spark, source)
    new, _ = _file_system(spark, target)
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Data files below ``path`` (names that begin with _ or . are not)."""
    root, files = _file_system(spark, path)
    found, each = [], files.listFiles(root, True)
    while each.hasNext():
        item = each.next().getPath()
        if item.getName()[0] not in "_.":
            found.append(item.toString())
    return sorted(found)


def set_file_time(spark: SparkSession, path: str, millis: int) -> bool:
    """Set a file's modification time; False where the store does not keep it."""
    target, files = _file_system(spark, path)
    files.setTimes(target, millis, -1)
    return files.getFileStatus(target).getModificationTime() // 1000 == millis // 1000


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write an intermediate that several branches of a plan read as Parquet
    into the shared folder, once, and read it back.

    The lineage ends at the written table: every branch, and every task
    retried after an executor loss, reads the files instead of recomputing
    the upstream scan, and each branch reads only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
