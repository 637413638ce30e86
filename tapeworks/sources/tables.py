"""Intermediate tables: what several parts of a result read is written once, in a folder that all machines see.

A written table outlives executors, holds no memory, cuts the plan, and lets Spark see its size.
"""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; a local session without either takes one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and (found := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = found.get()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table and read back."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of ``kept`` that nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
