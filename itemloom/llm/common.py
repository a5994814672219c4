"""Helpers the operators share: clash-free columns, ordered buckets, frozen copies."""

from __future__ import annotations

from bisect import bisect_right

import gc
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.session import materialise, shared_folder

__all__ = ["documents", "materialise", "shared_folder", "partitions", "cut_points", "bucket_of", "settled", "sha256", "read_table", "spread"]

WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


def documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns an operator reads, under fixed names; a null text is an empty one.

    Columns of the caller with other or clashing names never enter an operator's plan.
    """
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                     *[F.col(c) for c in more])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), *by)


def cut_points(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` values that cut the column into nearly equal stretches."""
    if buckets < 2:
        return []
    found = df.select(F.col(column).cast("long").alias("v")).na.drop().approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    return sorted({int(v) for v in found})


def bucket_of(column: Column, cuts: list[int]) -> Column:
    """Number of the stretch a value falls in; nulls fall in the first."""
    if not cuts:
        return F.lit(0)
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    return F.when(column.isNull(), F.lit(0)).otherwise(F.size(F.filter(edges, lambda c: c <= column))).cast("int")


def settled(df: DataFrame) -> DataFrame:
    """``materialise``, then let the finished job go, so that Spark's cleaner removes its shuffle files."""
    out = materialise(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


class Cover:
    """Union of the spans (kind, start, end), to ask whether it holds a stretch of text whole."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(s[1:3] for s in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def holds(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a) - 1
        return i >= 0 and b <= self.ends[i]
