"""Intermediate tables that cut lineage between passes of one job."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; only a local session may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="failwatch-")
    return _local_folders[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """Unused path in the folder of this application, which can go when it has ended."""
    folder = f"{shared_folder(spark)}/failwatch-{spark.sparkContext.applicationId}"
    inner = "".join(f"{scope}/" for scope in getattr(_scopes, "names", []))
    return f"{folder}/{inner}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of this thread go when the block ends; gives their folder."""
    folder = new_path(spark, "scratch")
    outer = getattr(_scopes, "names", [])
    _scopes.names = [*outer, folder.rsplit("/", 1)[1]]
    try:
        yield folder
    finally:
        _scopes.names = outer
        delete(spark, folder)


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    files, jvm_path = _file_system(spark, path)
    return files.exists(jvm_path)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none when there is no such folder."""
    files, jvm_path = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(jvm_path)) if files.exists(jvm_path) else []


def delete(spark: SparkSession, path: str) -> None:
    files, jvm_path = _file_system(spark, path)
    files.delete(jvm_path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back.

    Unlike a cache the result survives the loss of executors, and unlike
    ``checkpoint()`` it is columnar, so later passes still prune columns. The files also
    tell the planner the size, so a join broadcasts the table only when it is small.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            delete(df.sparkSession, file.rsplit("/", 1)[0])
