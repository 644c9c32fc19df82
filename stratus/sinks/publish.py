"""Several result tables published together or not at all.

Every publication writes its tables into a folder of its own, then one small
manifest that names the folder is renamed over the last one. A reader opens the
manifest first, so it sees the tables of one publication, never a mix: a failure
between two writes leaves the last pair in place, and the folder without a
manifest is removed by the next publication that succeeds.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from stratus.session import _file_system, delete_path, path_exists

MANIFEST = "CURRENT"


def publish(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], keep: int = 2) -> str:
    """Write ``tables`` under ``path`` and make them the current publication.

    The last ``keep`` publications stay, for readers that have opened one. Returns the
    publication's name."""
    name = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for table, df in tables.items():
        df.write.parquet(f"{path}/{name}/{table}")
    _swap(spark, path, name)
    for old in _publications(spark, path, upto=name)[:-keep]:
        delete_path(spark, f"{path}/{old}")
    return name


def current(spark: SparkSession, path: str) -> str | None:
    """Name of the publication that readers get; None before the first."""
    manifest = f"{path}/{MANIFEST}"
    if not path_exists(spark, manifest):
        return None
    return spark.read.text(manifest).first()[0]


def read_published(spark: SparkSession, path: str, *tables: str) -> list[DataFrame]:
    """``tables`` of the current publication, all of the same one."""
    name = current(spark, path)
    if name is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    return [spark.read.parquet(f"{path}/{name}/{t}") for t in tables]


def _swap(spark: SparkSession, path: str, name: str) -> None:
    jvm = spark.sparkContext._jvm
    fresh, files = _file_system(spark, f"{path}/{MANIFEST}-{uuid.uuid4().hex}")
    target, _ = _file_system(spark, f"{path}/{MANIFEST}")
    out = files.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    ways = spark.sparkContext._gateway.new_array(rename, 1)
    ways[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(fresh), files.makeQualified(target), ways)


def _publications(spark: SparkSession, path: str, upto: str) -> list[str]:
    """Folders of publications, the oldest first, no later than ``upto``."""
    root, files = _file_system(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
    return sorted(n for n in names if n.startswith("v") and n <= upto)
