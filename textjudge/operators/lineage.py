"""Reliable materialisation of intermediate results that are used more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    A session on one machine without that setting (a test, a bench) gets a temporary
    folder; on a cluster a missing setting is an error, as a local folder would be lost.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder; the files outlive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``; then the shuffle files that only it needed can leave the disk.

    Spark deletes them when the driver's collector finds them unused, which a driver with
    little to do may not look for until the end. Every shuffle costs some small files for
    each task, so jobs of many rounds fill the disk even where few rows are left.
    """
    out = materialize(df)
    machine = df.sparkSession.sparkContext._jvm
    del df
    machine.System.gc()
    return out


def write_step(df: DataFrame, path: str) -> None:
    """Add ``df`` to the Parquet files of a step that later ones read.

    Smaller than a checkpoint, which keeps rows as they are in memory. The shuffle files
    of ``df`` leave the disk as with ``stored``.
    """
    machine = df.sparkSession.sparkContext._jvm
    df.write.mode("append").option("compression", "zstd").parquet(path)
    del df
    machine.System.gc()


def drop_step(spark: SparkSession, path: str) -> None:
    """Delete the files of a step that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
