"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import folds, staged

#: Labelled rows to fit on at most; those with the least hash of their id.
LABELLED = 20_000


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int = LABELLED) -> DataFrame:
    """text, y of labelled documents outside the held-out fold, as a written table.

    Rows without an id or label are none; of several labels of an id the greatest
    counts, and of rows that share an id one is taken.
    """
    docs = docs.select("doc_id", "text")  # other columns may bear any name
    y = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (folds(F.col("doc_id")) != 0))
    y = y.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(column).cast("int")).alias("y"))
    y = staged(y.orderBy(F.xxhash64("_id"), "_id").limit(most), "labels")
    return staged(docs.join(F.broadcast(y), docs.doc_id == y["_id"]).select("_id", "text", "y").dropDuplicates(["_id"]), "labelled")
