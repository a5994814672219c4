"""Repair plan for items whose body a heading swallowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Heading and source note spellings.
NUMBER_HEAD = r"(?U)^(?:\$\\displaystyle\s*)?(\d{1,3}(?:\.\d{1,3})?)\$?\s*[.．、\s]"
LEAD_HEADINGS = r"\A(?:[ \t]*#{1,6}[ \t]+[^\n]*\n*)+"
SOURCE_NOTE = r"【([^】]*)】"


def _plain(text):
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\$\\displaystyle\s*([^$]*?)\$", "$1"), r"(?U)\s+", " "))


def strip_lead_headings(text):
    """Content after all headings it starts with."""
    return F.regexp_replace(text, LEAD_HEADINGS, "")


def classify_empty(items: DataFrame) -> DataFrame:
    """``fix`` when one numbered heading holds the whole body, ``review`` when unsure, else ``skip``."""
    s = F.col("extra_sections")
    first = F.get(s, 0)
    action = (F.when(F.trim(F.coalesce("body", F.lit(""))) != "", "skip").when(F.coalesce(F.size(s), F.lit(0)) <= 0, "skip")
              .when(F.size(s) != 1, "review").when(first["heading"] == "解析", "review")
              .when(~_plain(first["heading"]).rlike(NUMBER_HEAD), "review")
              .when(F.trim(strip_lead_headings(first["content"])) == "", "review").otherwise("fix"))
    return items.withColumn("action", action)


def plan_empty(items: DataFrame) -> DataFrame:
    """New body and source of the items that can be fixed."""
    rows = classify_empty(items).filter("action = 'fix'")
    first = F.get("extra_sections", 0)
    note = F.nullif(_plain(F.regexp_extract(first["heading"], SOURCE_NOTE, 1)), F.lit(""))
    return rows.select("id", strip_lead_headings(first["content"]).alias("new_body"), F.coalesce(note, F.col("source")).alias("new_source"))
