"""Documents dealt into buckets that follow the order of doc_id, without a single-task sort.

Cut points come from approximate quantiles of doc_id, so buckets are nearly equal in rows
whatever the ids' gaps are. Rows of one bucket are one stretch of the order; equal ids stay
together and are ordered by text. Null ids come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, cut_points, partitions


def bucketed(df: DataFrame, per_partition: int = 2) -> tuple[DataFrame, list[int]]:
    """Add ``bucket``; buckets ascend with doc_id."""
    cuts = cut_points(df, "doc_id", per_partition * partitions(df.sparkSession))
    return df.withColumn("bucket", bucket_of(F.col("doc_id"), cuts)), cuts


def dealt(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Each bucket whole in one task and in order; a task may hold several buckets."""
    return df.repartition(n, "bucket").sortWithinPartitions("bucket", *order)


def with_heads(df: DataFrame) -> DataFrame:
    """Add ``guest``: a copy of the row that follows each bucket, which closes that bucket.

    Only one row of each bucket is copied: its first by (doc_id, text). The last bucket is
    closed by the first row of all.
    """
    from pyspark.sql import Window

    first = df.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("h"))
    order = Window.orderBy("bucket")  # one row for each bucket, as many as tasks
    ring = first.select(F.col("bucket").alias("b"), F.lead("bucket").over(order).alias("nb"), F.min("bucket").over(Window.partitionBy()).alias("b0"))
    ring = ring.select("b", F.coalesce("nb", "b0").alias("from_b"))
    heads = ring.join(first, ring["from_b"] == first["bucket"]).select(F.col("b").alias("bucket"), F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text"), F.lit(1).alias("guest"))
    return df.select("bucket", "doc_id", "text", F.lit(0).alias("guest")).unionByName(heads)
