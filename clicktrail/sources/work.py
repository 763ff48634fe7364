"""Working tables in the folder that the cluster names in ``spark.checkpoint.dir``.

A stage that several later steps read is written there once as Parquet and
read back: the lineage is cut, and the files outlive lost executors. All paths
go through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clicktrail.session import ensure_checkpoint_dir

_MADE: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new, unused folder name under the shared checkpoint folder; ``sweep`` removes it."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return folder


def sweep(spark: SparkSession) -> None:
    """Deletes the working tables made so far: call it when no result that reads them is needed any more."""
    while _MADE:
        drop(spark, _MADE.pop())


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in ``path``; none if it does not exist."""
    p, fs = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file or folder to a name that is not taken, making the folders above it."""
    p, fs = _file_system(spark, path)
    target, _ = _file_system(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"could not rename {path} to {to}")


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a working table that this library has written."""
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def stored(df: DataFrame, path: str, *partition: str) -> DataFrame:
    """Writes ``df`` as Parquet (replacing an interrupted earlier try) and reads it back."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(*partition)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
