"""The folder that driver and executors share, and tables stored there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a session within one
    process gets a temporary one; where executors are other processes that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='mensura-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, kind: str, name: str) -> str:
    """The name of a fresh folder in the shared one."""
    return f"{shared_folder(spark)}/{kind}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: worked out once, for several
    readers, and cut from its lineage."""
    path = new_folder(df.sparkSession, "tables", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_place(spark: SparkSession, path: str) -> bool:
    """Makes a folder in whatever store its path names; whether it wasn't there before."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return not store.exists(where) and store.mkdirs(where)
