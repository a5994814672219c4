"""Sort orders of the item list, page slices and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key, natural_path_key
from ..scale import global_rank

PAGE_ROWS = 30  # fixed value
RESULT_PAGE_DEFAULT, RESULT_PAGE_MAX = 20, 50  # fixed values


def tie_break() -> list[Column]:
    return [F.col("number").asc_nulls_last(), F.coalesce(F.col("created"), F.lit("")).asc(),
            F.coalesce(F.col("path"), F.lit("")).asc()]


def sort_keys(mode: str = "custom") -> list[Column]:
    """Sort columns of a mode; all end in ``path``, which is unique, except newest first,
    whose ties the item list leaves open and ``id`` settles here."""
    if mode == "created_desc":
        return [F.col("created").desc(), F.col("id").asc()]
    if mode == "created_asc":
        return [F.col("created").asc(), *tie_break()]
    if mode == "difficulty":
        level = F.coalesce(F.col("difficulty"), F.lit(""))
        return [F.when(level == "", "0").otherwise(level).asc(), *tie_break()]
    if mode == "type":
        return [F.col("type").asc(), *tie_break()]
    if mode == "starred":
        return [F.col("starred").desc(), F.col("order").asc(), *tie_break()]
    if mode == "source":
        source = F.trim(F.coalesce(F.col("source"), F.lit("")))
        return [F.when(source == "", 1).otherwise(0).asc(), natural_key(source).asc(),
                natural_path_key(F.col("folder")).asc(), F.col("order").asc_nulls_last(), *tie_break()]
    return [F.col("order").asc(), *tie_break()]


def page(df: DataFrame, order: list[Column], number: int, rows: int = PAGE_ROWS) -> DataFrame:
    """Page ``number`` (from 1); sorted and cut by the engine's own top-k."""
    cut = df.orderBy(*order).offset((number - 1) * rows).limit(rows)
    place = F.row_number().over(Window.orderBy(*order))  # at most ``rows`` rows
    return cut.withColumn("place", place)


def clamp_page_rows(rows: int | None) -> int:
    return RESULT_PAGE_DEFAULT if not rows else max(1, min(RESULT_PAGE_MAX, int(rows)))


def snapshot(df: DataFrame, order: list[Column]) -> DataFrame:
    """All rows with their position, so that any later page is a range filter."""
    return global_rank(df, order, "place")


def snapshot_page(snap: DataFrame, number: int, rows: int = PAGE_ROWS) -> DataFrame:
    return snap.filter(F.col("place").between((number - 1) * rows + 1, number * rows))
