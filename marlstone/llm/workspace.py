"""Shared tables that cut lineage, in the folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a folder beside the warehouse's
    tables, or on a single machine (master ``local``) a temporary one; the session stays as it is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.applicationId not in _OWN:
            alone = context.master.split("[")[0] == "local"
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="marlstone-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_marlstone"
        found = _OWN[context.applicationId]
    return found.rstrip("/")


def unused(columns: list[str], name: str) -> str:
    """``name``, or with a number where a column is called so already, in any case of letters."""
    taken = {c.lower() for c in columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(1, len(columns) + 2))) if n.lower() not in taken)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: later stages start from it,
    so an executor that is lost costs no more than its own tasks."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df.stored_at)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table of this module once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
