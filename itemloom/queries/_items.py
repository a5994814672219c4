"""The item table as derived from ``documents``, in Spark and in SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def items(t) -> DataFrame:
    d = t.documents
    kind = F.col("n_chars") % 5
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc"), F.col("doc_id")).alias("title"),
        F.concat_ws("/", "lang", "source").alias("folder"),
        F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc"), F.col("doc_id"), F.lit(".md")).alias("path"),
        F.col("text").alias("body"),
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("solution"),
        F.when(kind == 0, F.concat(F.lit("see "), F.col("source"))).otherwise("").alias("note"),
        F.col("source"),
        F.when(kind == 1, "单选题").when(kind == 2, "多选题").when(kind == 3, "填空题").otherwise("解答题").alias("type"),
        F.when(F.col("n_chars") % 6 == 0, "").otherwise((F.col("n_chars") % 6).cast("string")).alias("difficulty"),
        F.when(kind == 0, F.array("lang", "lang", "source")).otherwise(F.array("lang", "source")).alias("tags"),
        (F.col("n_chars") % 3 == 0).alias("starred"),
        (F.col("n_chars") % 97).cast("double").alias("order"),
        F.when(F.col("n_chars") % 4 == 0, None).otherwise((F.col("n_chars") % 23 + 1).cast("int")).alias("number"),
        F.date_format(F.date_add(F.lit("2024-01-01"), (F.col("n_chars") % 300).cast("int")), "yyyy-MM-dd'T'00:00:00").alias("created"),
    )


ITEMS = """items AS (SELECT doc_id AS id, 'doc' || doc_id AS title, lang || '/' || source AS folder,
 lang || '/' || source || '/doc' || doc_id || '.md' AS path, text AS body, split_part(text, chr(10), 2) AS solution,
 CASE WHEN n_chars % 5 = 0 THEN 'see ' || source ELSE '' END AS note, source,
 CASE n_chars % 5 WHEN 1 THEN '单选题' WHEN 2 THEN '多选题' WHEN 3 THEN '填空题' ELSE '解答题' END AS type,
 CASE WHEN n_chars % 6 = 0 THEN '' ELSE CAST(n_chars % 6 AS VARCHAR) END AS difficulty,
 CASE WHEN n_chars % 5 = 0 THEN [lang, lang, source] ELSE [lang, source] END AS tags,
 n_chars % 3 = 0 AS starred, CAST(n_chars % 97 AS DOUBLE) AS "order",
 CASE WHEN n_chars % 4 = 0 THEN NULL ELSE CAST(n_chars % 23 + 1 AS INTEGER) END AS number,
 strftime(DATE '2024-01-01' + CAST(n_chars % 300 AS INTEGER), '%Y-%m-%dT00:00:00') AS created
 FROM documents)"""

NATKEY = ("list_transform(regexp_extract_all(lower({x}), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') "
          "THEN {{'k': 0, 'w': length(ltrim(p, '0')), 't': ltrim(p, '0')}} ELSE {{'k': 1, 'w': 0, 't': p}} END)")


def natkey(x: str) -> str:
    return NATKEY.format(x=x)
