"""Folder trees, tag counts, selections and ordinal columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, parent_path


def tag_counts(items: DataFrame) -> DataFrame:
    """Uses per tag; a tag repeated in one item counts each time."""
    return items.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("uses"))


def folder_counts(items: DataFrame) -> DataFrame:
    """Items per folder including everything below it.

    Counts per folder come first, so only one row per folder is spread to its ancestors.
    """
    own = items.groupBy("folder").agg(F.count("*").alias("n"))
    return (own.select(F.explode(ancestors(F.col("folder"))).alias("folder"), "n")
            .groupBy("folder").agg(F.sum("n").alias("items")))


def folder_tree(folders: DataFrame) -> DataFrame:
    """Every folder with parent, name, depth and whether it has sub-folders."""
    nodes = folders.select("folder").distinct().select(
        F.explode(ancestors(F.col("folder"))).alias("folder")).distinct()
    nodes = nodes.select("folder", parent_path(F.col("folder")).alias("parent"),
                         F.element_at(F.split("folder", "/"), -1).alias("name"),
                         (F.size(F.split("folder", "/")) - 1).alias("depth"))
    parents = nodes.select(F.col("parent").alias("folder")).distinct().withColumn("has_children", F.lit(True))
    return (nodes.join(parents, "folder", "left")
            .withColumn("has_children", F.coalesce("has_children", F.lit(False))))


def children_of(tree: DataFrame, parent: str) -> DataFrame:
    return tree.filter(F.col("parent") == parent).select("folder", "name", "has_children")


def rename_tag(tags: Column, old: str, new: str) -> Column:
    """Replace a tag and drop repeats, first place wins; other rows keep their repeats."""
    merged = F.array_distinct(F.transform(tags, lambda t: F.when(t == old, new).otherwise(t)))
    return F.when(F.array_contains(tags, old), merged).otherwise(tags)


def add_tags(tags: Column, extra: list[str]) -> Column:
    clean = [t.strip() for t in extra if t.strip()]
    if not clean:
        return tags
    return F.array_distinct(F.concat(tags, F.array(*[F.lit(t) for t in clean])))


def toggle(selection: DataFrame, change: DataFrame, key: str = "id") -> DataFrame:
    """Rows in exactly one of the two sets."""
    both = selection.select(key).distinct().unionByName(change.select(key).distinct())
    return both.groupBy(key).agg(F.count("*").alias("_n")).filter("_n = 1").select(key)


def select_all(selection: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    return selection.select(key).unionByName(more.select(key)).distinct()


def unselect(selection: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return selection.join(gone, key, "left_anti").select(key)


def next_order(items: DataFrame) -> DataFrame:
    """Order value the next item of a folder gets."""
    return items.groupBy("folder").agg((F.max("order") + 1.0).alias("next_order"))


def next_order_of(items: DataFrame, folder: str) -> DataFrame:
    """The same for one folder, which may still be empty."""
    one = items.filter(F.col("folder") == folder)
    return one.agg(F.coalesce(F.max("order") + 1.0, F.lit(1.0)).alias("next_order"))


TEMP_TITLE = r"^临时卡([0-9]+)(?:_[0-9]+)?$"  # fixed value


def next_temporary_index(items: DataFrame) -> DataFrame:
    """Per folder, one more than the highest temporary card number in use."""
    n = F.regexp_extract("title", TEMP_TITLE, 1).try_cast("long")
    return items.groupBy("folder").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_index"))
