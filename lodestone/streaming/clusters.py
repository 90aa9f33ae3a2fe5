"""SM-2: clusters of documents as they arrive, in micro-batches over a store of representatives.

The store is a folder: ``representatives`` and ``members``, one partition a batch.  A batch looks only
at representatives of earlier batches and writes its own partitions anew, so a batch that is run
again after a failure, at any point, leaves the rows it would have left at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import arrivals

AT = "struct<batch:bigint,arrival:bigint,id:bigint>"
REPRESENTATIVES = f"at {AT}, id bigint, chars int, title_set array<string>, simhash bigint, batch bigint"
MEMBERS = f"at {AT}, id bigint, cluster_id string, representative bigint, confidence double, method string, batch bigint"


def _read(like: DataFrame, store: str, name: str, schema: str) -> DataFrame:
    spark = like.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/{name}")


def members(like: DataFrame, store: str) -> DataFrame:
    """All assignments so far."""
    return _read(like, store, "members", MEMBERS)


def assign_batch(batch: DataFrame, number: int, store: str) -> None:
    """Cluster a batch of (arrival, id, text, title) against what earlier batches left."""
    known = _read(batch, store, "representatives", REPRESENTATIVES).where(F.col("batch") < number).select("at", "id", "chars", "title_set", "simhash")
    docs = batch.select(F.struct(F.lit(number).cast("long").alias("batch"), F.col("arrival").cast("long").alias("arrival"), F.col("id").cast("long").alias("id")).alias("at"), F.col("id").cast("long").alias("id"), "text", "title")
    out, new = arrivals.best_fit(arrivals.fingerprinted(docs), known)
    new.select("at", "id", "chars", "title_set", "simhash").write.mode("overwrite").parquet(f"{store}/representatives/batch={number}")
    out.write.mode("overwrite").parquet(f"{store}/members/batch={number}")


def clustering(docs: DataFrame, store: str, checkpoint: str) -> DataStreamWriter:
    """The stream of documents into the store; start it with a trigger of choice."""
    return docs.writeStream.foreachBatch(lambda batch, number: assign_batch(batch, number, store)).option("checkpointLocation", checkpoint)
