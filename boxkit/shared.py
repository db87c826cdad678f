"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where nothing is set and driver and executors are one process.
ALONE = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; an error where it is unset and executors are processes of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = ALONE
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def released(spark: SparkSession):
    """Queries that are made and run inside leave no shuffle files behind; Spark keeps them until the driver collects garbage otherwise."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage; what was shuffled for it goes."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with released(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes what stored() wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
