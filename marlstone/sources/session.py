"""Sessions: the package's own code on every executor."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Have Spark serve this package to Python workers, which may not share the driver's path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="marlstone-code-"), "marlstone.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("marlstone", os.path.relpath(path, root)))
    context.addPyFile(out)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def allow_checkpoints(spark: SparkSession) -> None:
    """Have ``checkpoint()`` write to the folder that ``spark.checkpoint.dir`` names. Where that is unset, and
    no folder was given to the context, it is one beside the warehouse's tables, on a single machine a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        alone = context.master.split("[")[0] == "local"
        own = "file://" + tempfile.mkdtemp(prefix="marlstone-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_marlstone"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)


def give_back() -> None:
    """In a Python worker, which lives on into later stages: give back memory that isn't used any more."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim is not None:
        trim(0)
