"""Scratch tables that all executors share and that go when the application ends."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_marked: set[str] = set()


def base_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: a temporary folder if driver and executors are one process, else the
    warehouse, unless that is a folder of one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="figquarry-"))
    base = spark.conf.get("spark.sql.warehouse.dir")
    if re.match(r"file:|/", base):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The path of a new scratch table; all of an application's are deleted when it ends."""
    own = f"{base_dir(spark)}/figquarry/{spark.sparkContext.applicationId}"
    if own not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _marked.add(own)
    return f"{own}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a scratch table: its lineage is cut, and a lost executor can't change its rows."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
