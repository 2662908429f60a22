"""Session helpers shared by every operator: tables, lineage cuts, shared scratch space."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session without that setting (tests, a laptop) gets a folder of its own, which is
    then also the setting that later calls see.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if named is None and current.isDefined():
        named = current.get()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="docquarry-")
    if not current.isDefined():
        context.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame, free: bool = True) -> DataFrame:
    """Cuts the lineage of ``df`` into the shared folder, so a lost executor costs nothing.

    With ``free`` the shuffle files that led to it are let go at once; small results do without.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    if free:
        free_shuffles(spark)
    return out


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges, whatever its size seems to be.

    Spark takes 2 KB for a VARIANT, so all other columns of a stored collection seem to be next to nothing, and
    the identifiers of millions of documents would be collected by the driver and broadcast.
    """
    return df.hint("merge")


def written(df: DataFrame) -> DataFrame:
    """As :func:`checkpoint`, but as a Parquet table, which is smaller and stays until :func:`discard`."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    del df
    free_shuffles(spark)
    out = spark.read.parquet(at)
    out.written_at = at
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of :func:`written` that no plan will read any more."""
    remove(df.sparkSession, df.written_at)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no live plan needs; it does so when the driver collects its garbage.

    Events that are still on their way to listeners hold on to a plan, hence the second round.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if not spark.sparkContext.master.startswith("local["):
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
