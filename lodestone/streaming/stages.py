"""AD-7, SM-3, SNK-6: resources that pass stages one after another, and can be taken up after a kill anywhere.

The store is a folder with a table a stage, one partition a batch, and a log that is only ever added to.  A stage that
has finished for a batch is read, not run again; one that was cut off is written anew.  So whatever the number of
restarts, the tables and the log hold what one run leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text

#: A stage makes, of the rows that came through the stage before, its own rows; resources without any stop there.
Stage = tuple[str, Callable[[DataFrame], DataFrame]]
LOG = "resource long, position int, stage string, result string, batch long"


def _finished(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def advance(batch: DataFrame, number: int, store: str, stages: list[Stage]) -> DataFrame:
    """Take a batch of rows with a ``resource`` through all stages; the rows of the last."""
    spark, rows, entered = batch.sparkSession, batch, batch.select("resource").distinct()
    for position, (name, stage) in enumerate(stages):
        out, log = f"{store}/{name}/batch={number}", f"{store}/log/batch={number}/stage={name}"
        if not _finished(spark, out):
            stage(rows).write.mode("overwrite").parquet(out)
        rows = spark.read.parquet(out)
        through = rows.select("resource").distinct().withColumn("through", F.lit(True))
        if not _finished(spark, log):
            result = F.when(F.col("through"), "PASS").otherwise("STOP")
            entered.join(through, "resource", "left").select("resource", F.lit(position).alias("position"), result.alias("result")).write.mode("overwrite").parquet(log)
        entered = through.select("resource")
    return rows


def log(spark: SparkSession, store: str) -> DataFrame:
    """resource, position, stage, result, batch of all that happened."""
    return spark.read.schema(LOG).parquet(f"{store}/log")


def staging(resources: DataFrame, store: str, checkpoint: str, stages: list[Stage]) -> DataStreamWriter:
    """A stream of resources through the stages, batch by batch."""
    return resources.writeStream.foreachBatch(lambda batch, number: advance(batch, number, store, stages) and None).option("checkpointLocation", checkpoint)


def knowledge_stages(verdicts: DataFrame) -> list[Stage]:
    """PENDING resources (resource, text) to claims: the resource's verdict (resource, role), chunks that are no garbage, a quote of each
    chunk, and its binding.  A missing verdict rejects."""
    def gated(rows: DataFrame) -> DataFrame:
        return rows.join(verdicts.where("role IN ('CORE', 'CONTEXT')").select("resource", "role"), "resource")

    def chunk_gated(rows: DataFrame) -> DataFrame:
        parts = rows.select("resource", "role", F.posexplode(text.chunks(F.col("text"))).alias("part", "chunk"))
        return parts.where((F.length("chunk") >= 60) & (F.regexp_count("chunk", F.lit(text.SENTENCE_ENDS)) / F.length("chunk") >= 0.005))

    def extracted(rows: DataFrame) -> DataFrame:
        return rows.select("resource", "role", "part", "chunk", F.get(text.sentences(F.col("chunk"), 20), F.lit(0)).alias("quote")).where("quote IS NOT NULL")

    def done(rows: DataFrame) -> DataFrame:
        return rows.select("resource", "role", "part", "quote", text.bind(F.col("quote"), F.col("chunk")).alias("match"))

    return [("GATED", gated), ("CHUNK_GATED", chunk_gated), ("EXTRACTED", extracted), ("DONE", done)]
