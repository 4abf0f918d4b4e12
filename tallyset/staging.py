"""Intermediate tables that outlive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
#: Whether the shuffle files of a query go with its end.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs in one process, as in
    tests, a temporary one that goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tallyset-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/tallyset/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, outlives lost executors, runs once. The shuffle
    files of the write go with its end; else they stay until the driver happens to collect its garbage."""
    path, conf = new_path(df.sparkSession), df.sparkSession.conf
    before = conf.get(_FREE, None)
    conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_FREE)
        else:
            conf.set(_FREE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
