"""Tables written between jobs, in the folder all executors share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "8m"
PLAN_CHARS = "20000"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset on one machine, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seaflow-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def package_on_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it, installed or not."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def small_batches(spark: SparkSession) -> None:
    """Has rows with whole texts go to Python in batches of ``BATCH_BYTES``, so that a worker holds little at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def short_plans(spark: SparkSession) -> None:
    """Has the driver keep plans as texts of ``PLAN_CHARS`` at most: it keeps some hundreds of them."""
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_CHARS)


def release() -> None:
    """Gives memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/seaflow-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet: what follows doesn't compute them again, whoever is lost.

    The files stay until the owner of the shared folder clears it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
