"""Papers composed from items, as tables: sections, numbers, slots, spaces, points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import rank_in_key

# Section order, default points, answer space limits.
BUCKETS = ("单选题", "多选题", "填空题")
SECTION_MARKS = ("一", "二", "三", "四")
POINTS = {"单选题": 5, "多选题": 6, "填空题": 5}
SUB_LINE = r"(?m)^[ \t　]*（\s*(?:[0-9０-９]+|[ivxIVX]+|[Ⅰ-ⅿ]+)\s*）"
SUB_TOP = r"(?m)^[ \t　]*（\s*[0-9０-９]+\s*）"
METHOD_LINE = r"(?m)^[ \t　]*(?:方法|解法|证法|解答|做法)\s*(?:[0-9０-９]+|[一二三四五六七八九十]+)\s*[:：.．、]?\s*"
STD_BASE, STD_STEP, STD_MAX = 2.0, 0.5, 4.0
PRACTICE_BASE, PRACTICE_LEVEL, PRACTICE_SUB, PRACTICE_MAX = 3.0, 1.0, 1.5, 12.0


def bucket(type: Column) -> Column:
    out = None
    for i, name in enumerate(BUCKETS):
        out = F.when(type == name, i) if out is None else out.when(type == name, i)
    return out.otherwise(3)


def numbered_by_type(items: DataFrame, paper: str, order: list[Column]) -> DataFrame:
    """Items with continuous ``num`` after sorting into type sections, and the section's ordinal.

    Order inside a section is kept; empty sections take no ordinal.
    """
    b = items.withColumn("bucket", bucket(F.col("type")))
    ranked = rank_in_key(b, [paper], [F.col("bucket").asc(), *order], "num")
    kinds = b.select(paper, "bucket").distinct()
    ordinal = F.dense_rank().over(Window.partitionBy(paper).orderBy("bucket"))  # at most four rows per paper
    return ranked.join(kinds.withColumn("section", ordinal), [paper, "bucket"])


def numbered_in_order(items: DataFrame, paper: str, order: list[Column], mode: str, pinned: Column | None = None) -> DataFrame:
    """Items numbered as given, with their page slot: quarter, half or full."""
    ranked = rank_in_key(items, [paper], order, "num")
    small = bucket(F.col("type")) < 3
    slot = {"two": F.when(small, "slot_quarter").otherwise("slot_half"), "lecture": F.when(small, "slot_half").otherwise("full"),
            "slides": F.lit("slide")}[mode]
    return ranked.withColumn("slot", F.when(pinned, "full").otherwise(slot) if pinned is not None else slot)


def solution_appendix(numbered: DataFrame) -> DataFrame:
    return numbered.filter("solution IS NOT NULL AND solution <> ''").select("paper", "num", "solution")


def section_scores(items: DataFrame, paper: str, points: dict[str, int] | None = None) -> DataFrame:
    """Count, points each and total per section; sections without points have no total."""
    rate = {**POINTS, **(points or {})}
    per = items.withColumn("bucket", bucket(F.col("type"))).groupBy(paper, "bucket").agg(F.count("*").alias("items"))
    each = F.lit(None).cast("int")
    for i, name in enumerate((*BUCKETS, "解答题")):
        if rate.get(name):
            each = F.when(F.col("bucket") == i, rate[name]).otherwise(each)
    return per.withColumn("points", each).withColumn("total", F.col("points") * F.col("items"))


def answer_space(body: Column) -> Column:
    n = F.greatest(F.regexp_count(body, F.lit(SUB_LINE)), F.lit(1))
    return F.least(STD_BASE + STD_STEP * (n - 1), F.lit(STD_MAX))


def practice_space(body: Column, difficulty: Column) -> Column:
    level = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(5), difficulty.try_cast("int"))), F.lit(3))
    n = F.greatest(F.regexp_count(body, F.lit(SUB_TOP)), F.lit(1))
    return F.least(PRACTICE_BASE + PRACTICE_LEVEL * (level - 1) + PRACTICE_SUB * (n - 1), F.lit(PRACTICE_MAX))


def parts(items: DataFrame, text: str = "body", solution: bool = False) -> DataFrame:
    """One row per sub-question part: a part opens at each sub-question (or method) line."""
    t = F.regexp_replace(F.col(text), SUB_LINE.replace("(?m)^", "(?m)(?<=\n)"), "\u0001$0")
    if solution:
        t = F.regexp_replace(t, METHOD_LINE.replace("(?m)^", "(?m)(?<=\n)"), "\u0001$0")
    cut = F.filter(F.transform(F.split(t, "\u0001"), lambda p: F.trim(F.regexp_replace(p, r"^[\s　]+|\s+$", ""))), lambda p: p != "")
    return items.select("id", F.posexplode(cut).alias("part_no", "text"))


def image_defaults(type: Column, images: Column, subject: str) -> Column:
    """(mode, flow, stack, align) an imported item's images start with."""
    choice, phys = type.isin("单选题", "多选题"), subject == "physics"
    mode = (F.when(images == 0, F.lit(None).cast("string")).when(choice, F.when(images > 1, "between").otherwise("opts"))
            .when(type == "填空题", "between" if phys else "full").when(type == "解答题", "after" if phys else "sub"))
    row = (choice & (images > 1)) | (F.lit(phys) & type.isin("填空题", "解答题"))
    flow = F.when((images > 0) & row, "row").otherwise("column")
    return F.struct(mode.alias("mode"), flow.alias("flow"), ((images > 1) & (flow == "column")).alias("stack"),
                    F.when((images > 0) & F.lit(phys) & (type == "解答题"), "center").alias("align"))


def figure_groups(items: DataFrame, id: str = "id", body: str = "body") -> DataFrame:
    """Neighbouring figures of a body, two to a group; any text between opens a new group."""
    image = r"!\[\[[^\]]+\]\]|!\[[^\]]*\]\([^)]*\)"
    marked = F.regexp_replace(F.col(body), "(" + image + ")", "\u0001$1\u0002")
    pieces = F.filter(F.split(marked, "[\u0001\u0002]"), lambda p: p.rlike(r"\S"))
    rows = items.select(id, F.posexplode(pieces).alias("p", "piece")).withColumn("figure", F.col("piece").rlike("^(?:" + image + ")$"))
    w = Window.partitionBy(id).orderBy("p")  # pieces of one body
    run = rows.withColumn("run", F.sum((~F.col("figure")).cast("int")).over(w)).filter("figure")
    k = F.row_number().over(Window.partitionBy(id, "run").orderBy("p")) - 1
    i = F.row_number().over(Window.partitionBy(id).orderBy("p")) - 1
    return run.select(id, i.alias("i"), "run", F.floor(k / 2).cast("int").alias("pair"), F.col("piece").alias("figure"))
