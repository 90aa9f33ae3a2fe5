"""Shared-folder staging: cut lineage with a written table every executor can read.

The folder is the session's ``spark.checkpoint.dir``.  Only on one machine, as in tests,
it may be unset; then a folder of this process is made, and the setting filled in.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: what follows doesn't depend on the executors that made it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    df.sparkSession._jvm.System.gc()  # lets Spark delete the shuffle files of finished jobs
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    spark = tables[0].sparkSession
    for x in tables:
        p = spark._jvm.org.apache.hadoop.fs.Path(x._staged)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folds(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; ids that are null count as 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5
