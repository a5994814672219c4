"""Tables inside texts as rows, and answer keys as one row per number."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import marks as M

TABLE, ROW = r"(?is)<table\b[^>]*>(.*?)</table>", r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL = r"(?is)<t[dh]\b([^>]*)>(.*?)</t[dh]>"
SPAN = r"(?i)colspan\s*=\s*[\"']?(\d+)"
HEAD_WORDS, VALUE_WORDS = ("题号", "题目", "题次"), ("答案", "参考答案")  # fixed values


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x and "&" in x else x)


def cell_text(raw: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(raw, r"(?i)<br\s*/?>", " "), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(_unescape(s), r"(?U)\s+", " "))


def html_cells(pages: DataFrame, id: str, html_column: str) -> DataFrame:
    """(id, tbl, row, col, text, colspan) of every cell of every table."""
    tables = pages.select(id, F.posexplode(F.regexp_extract_all(html_column, F.lit(TABLE), F.lit(1))).alias("tbl", "inner"))
    rows = tables.select(id, "tbl", F.posexplode(F.regexp_extract_all("inner", F.lit(ROW), F.lit(1))).alias("row", "inner"))
    cells = F.arrays_zip(F.regexp_extract_all("inner", F.lit(CELL), F.lit(1)).alias("a"), F.regexp_extract_all("inner", F.lit(CELL), F.lit(2)).alias("t"))
    flat = rows.select(id, "tbl", "row", F.posexplode(cells).alias("col", "cell"))
    span = F.greatest(F.lit(1), F.coalesce(F.regexp_extract("cell.a", SPAN, 1).try_cast("int"), F.lit(1)))
    return flat.select(id, "tbl", "row", "col", cell_text(F.col("cell.t")).alias("text"), span.alias("colspan"))


def pipe_cells(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Cells of Markdown pipe rows; separator rows are dropped."""
    t = F.trim(text)
    inner = F.regexp_replace(t, r"^\||\|$", "")
    rows = lines.filter(t.startswith("|") & ~t.rlike(r"^\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?$"))
    return rows.select(*keys, F.posexplode(F.split(inner, r"\|")).alias("col", "raw")).select(*keys, "col", cell_text(F.col("raw")).alias("text"))


def answer_key(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per number from two-row answer tables and from one-line lists of three or more.

    Numbers must rise, and no answer may be empty; other lines yield nothing.
    """
    rows = F.regexp_extract_all(text, F.lit(ROW), F.lit(1))
    bare = lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(2)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", "")))
    two = lines.filter(F.size(rows) == 2).select(*keys, bare(F.get(rows, 0)).alias("h"), bare(F.get(rows, 1)).alias("v"))
    named = F.get("h", 0).isin(*HEAD_WORDS) & F.get("v", 0).isin(*VALUE_WORDS)
    cut = lambda c: F.when(named, F.slice(c, 2, F.size(c))).otherwise(F.col(c))
    two = two.filter("size(h) > 1 AND size(v) > 1").select(*keys, cut("h").alias("h"), cut("v").alias("v"))
    table = two.filter("size(h) = size(v)").select(*keys, "h", "v", F.transform("h", lambda x: F.when(x.rlike(r"^\d{1,3}$"), x.cast("int"))).alias("n"))
    mark = r"(?:^|(?<=\s))(\d{1,3})\s*[.．、]\s+"
    flat = lines.filter(F.size(rows) == 0).select(*keys, F.trim(text).alias("t"))
    flat = flat.filter(F.col("t").rlike("^" + r"\d{1,3}\s*[.．、]\s+") & (F.regexp_count("t", F.lit(mark)) >= 3))
    listed = flat.select(*keys, F.regexp_extract_all("t", F.lit(mark), F.lit(1)).alias("h"),
                         F.transform(F.slice(F.split("t", mark), F.lit(2), F.size(F.split("t", mark))), lambda x: F.trim(x)).alias("v"))
    listed = listed.select(*keys, "h", "v", F.transform("h", lambda x: x.cast("int")).alias("n")).filter(
        F.col("n") == F.sequence(F.get("n", 0), F.get("n", 0) + F.size("n") - 1))
    both = table.unionByName(listed)
    rising = F.forall(F.sequence(F.lit(0), F.greatest(F.size("n") - 2, F.lit(0))), lambda i: (F.size("n") < 2) | (F.get("n", i) < F.get("n", i + 1)))
    good = both.filter(F.forall("n", lambda x: x.isNotNull() & (x > 0)) & F.forall("v", lambda x: x != "") & (F.size("n") == F.size("v"))).filter(rising)
    return good.select(*keys, F.explode(F.arrays_zip("n", "v")).alias("p")).select(*keys, F.col("p.n").alias("number"), F.col("p.v").alias("answer"))


# The line marks of the reply protocol.
KIND, TYPE = r"(?im)^@@KIND\s+(question|solution|both)\s*$", r"(?m)^@@TYPE\s+(单选|多选|填空|解答)\s*$"
BODY, SOL = r"(?m)^@@BODY[ \t]*$", r"(?m)^@@SOL[ \t]*$"


def reply_columns(text: Column) -> Column:
    """(kind, type, body, solution) of a reply in the line-mark protocol; either section may come first."""
    b, s = F.regexp_instr(text, F.lit(BODY)), F.regexp_instr(text, F.lit(SOL))
    after_b = b + F.length(F.regexp_substr(text, F.lit(BODY)))
    after_s = s + F.length(F.regexp_substr(text, F.lit(SOL)))
    none = F.lit("")
    body = (F.when((b > 0) & (s > b), F.substr(text, after_b, s - after_b)).when(b > 0, F.substr(text, after_b)).otherwise(none))
    sol = (F.when((s > 0) & (b > s), F.substr(text, after_s, b - after_s)).when(s > 0, F.substr(text, after_s)).otherwise(none))
    clean = lambda c: M.strip(F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.startswith("@@")), "\n"))
    return F.struct(F.lower(F.nullif(F.regexp_extract(text, KIND, 1), none)).alias("kind"), F.nullif(F.regexp_extract(text, TYPE, 1), none).alias("type"),
                    clean(body).alias("body"), clean(sol).alias("solution"))


def handout_blocks(lines: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, warnings) of texts with ``<!-- mark:question id -->``, ``:solution id``, ``:end id`` lines.

    A block runs from an open line to the end line of its id before the next open line.
    """
    pattern = r"^\s*<!--\s*" + mark + r":(question|solution|end)\s+([A-Za-z0-9_-]{6,80})\s*-->\s*$"
    tagged = lines.withColumn("kind", F.regexp_extract("text", pattern, 1)).withColumn("block_id", F.regexp_extract("text", pattern, 2))
    from ..scale import dense_chunk, lead, scan
    marks_ = tagged.filter("kind <> ''").select("doc", "line_no", "kind", "block_id")
    opens = scan(marks_.filter("kind = 'question'"), ["doc"], ["line_no"], dense_chunk("line_no"), {"next_open": lead(F.col("line_no"))})
    o = opens.select("doc", "block_id", F.col("line_no").alias("start"), "next_open")
    inner = o.join(marks_.filter("kind <> 'question'"), ["doc", "block_id"]).filter(
        (F.col("line_no") > F.col("start")) & (F.col("next_open").isNull() | (F.col("line_no") < F.col("next_open"))))
    span = inner.groupBy("doc", "block_id", "start").agg(F.min(F.when(F.col("kind") == "end", F.col("line_no"))).alias("stop"),
                                                       F.min(F.when(F.col("kind") == "solution", F.col("line_no"))).alias("sol"))
    full = o.join(span, ["doc", "block_id", "start"], "left")
    blocks = full.filter("stop IS NOT NULL").select("doc", "block_id", "start", "stop", F.when(F.col("sol") < F.col("stop"), F.col("sol")).alias("solution_at"))
    open_ended = full.filter("stop IS NULL").select("doc", F.lit("missing_end").alias("warning"), "block_id")
    twice = blocks.groupBy("doc", "block_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc", F.lit("duplicate_id").alias("warning"), "block_id")
    return blocks, open_ended.unionByName(twice)
