"""Structural checks of segmented documents; each reports, none repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import marks as M
from ..functions.choices import empty_options, has_fill_mark, has_subquestions, with_choices
from ..functions.text import content_units, dense_noise, visible_length
from ..scale import dense_chunk, join_counted, row_number, scan
from ..session import materialise
from .pairing import orphan_solutions, pair_by_coordinate
from .sequence import number_gaps, runs

# Limits of the checks.
LONG_RATIO, LONG_MIN_BLOCKS = 4.0, 6
LOST_MIN, LOST_RATIO, LOST_LARGE, LOST_LARGE_RATIO = 80, 0.20, 300, 0.10
COVER_SLACK = 0.001

IMAGE = r"!\[[^\]]*\]\([^)]*\)"
ALNUM = r"[\p{L}\p{N}]"

stems_of = lambda blocks: blocks.filter("zone = 'stem'")


def empty_recognition(text: Column, signs: str = ALNUM) -> Column:
    """No letter or digit outside image references; ``signs`` names what counts as one."""
    return ~F.regexp_replace(text, IMAGE, "").rlike(signs)


def declared_mismatch(blocks: DataFrame) -> DataFrame:
    """Sections whose heading declares another item count than the section has."""
    per = stems_of(blocks).groupBy("doc", F.coalesce("section", F.lit("")).alias("section")).agg(F.count("*").alias("found"))
    return per.withColumn("declared", M.declared_count(F.col("section"))).filter("declared <> found")


def long_blocks(blocks: DataFrame) -> DataFrame:
    """Unmarked stems longer than four times the median of their section."""
    rows = materialise(stems_of(blocks).filter(~F.col("text").rlike(M.SOLUTION_MARK)).select(
        "doc", "idx", "number", F.coalesce("section", F.lit("")).alias("section"), visible_length(F.col("text")).alias("size")))
    sizes = rows.groupBy("doc", "section", "size").agg(F.count("*").alias("k"))
    medians = sizes.groupBy("doc", "section").agg(F.sum("k").alias("n"), F.percentile("size", F.lit(0.5), F.col("k")).alias("median"))
    near = medians.filter((F.col("n") >= LONG_MIN_BLOCKS) & (F.col("median") > 0))
    return join_counted(rows, near, ["doc", "section"], "idx").filter(F.col("size") > F.col("median") * LONG_RATIO).drop("n")


def lost_content(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents whose unpaired solutions hold a large share of the content."""
    units = content_units(F.col("text"))
    whole = blocks.groupBy("doc").agg(
        F.sum(units).alias("whole"), F.count_if(F.col("zone") == "stem").alias("stems"),
        F.count_if((F.col("zone") == "stem") & F.col("number").isNull()).alias("bare"))
    lost = orphan_solutions(blocks, pairs).groupBy("doc").agg(F.sum(units).alias("lost"), F.count("*").alias("orphans"))
    ratio = F.col("lost") / F.col("whole")
    big = (((F.col("lost") >= LOST_MIN) & (ratio >= LOST_RATIO)) | ((F.col("lost") >= LOST_LARGE) & (ratio >= LOST_LARGE_RATIO)))
    return (whole.join(lost, "doc").filter("stems > 0 AND bare * 2 <= stems AND whole > 0").filter(big)
            .select("doc", "orphans", "lost", "whole"))


def late_solution_marks(blocks: DataFrame) -> DataFrame:
    """Documents whose marked stems are exactly the last few stems."""
    stems = scan(stems_of(blocks).select("doc", "idx", "text"), ["doc"], ["idx"], dense_chunk("idx"), {"k": row_number()})
    marked = F.col("text").rlike(M.SOLUTION_MARK)
    per = stems.groupBy("doc").agg(F.count("*").alias("stems"), F.count_if(marked).alias("marked"),
                                   F.min(F.when(marked, F.col("k"))).alias("first"))
    return per.filter("marked > 0 AND marked * 2 < stems AND first = stems - marked + 1").select("doc", "stems", "marked")


def option_anomalies(blocks: DataFrame) -> DataFrame:
    """Choice items with one to three option labels, or with bare formulas only."""
    s = F.coalesce("section", F.lit(""))
    rows = with_choices(stems_of(blocks).filter(s.rlike(M.CHOICE_SECTION)))
    exact = s.rlike("单选|多选|不定项")
    open_ = ~F.col("c.complete_known") & (exact | F.col("c.blank") | F.col("c.looks_like"))
    few = F.length("c.labels").between(1, 3)
    bare = ((F.col("c.labels") == "") & exact & F.col("c.blank") & F.col("c.formulas").between(2, 4) & (F.col("c.pictures") < 4))
    return rows.filter(open_ & (few | bare)).select("doc", "idx", "number", F.col("c.labels").alias("labels"))


def noise_blocks(blocks: DataFrame) -> DataFrame:
    return stems_of(blocks).filter(dense_noise(F.col("text"))).select("doc", "idx", "number")


def report(blocks: DataFrame, lines: DataFrame | None = None, check_numbering: bool = True) -> DataFrame:
    """All findings as (doc, rank, check, findings); lower rank is more certain."""
    blocks = materialise(blocks)
    pairs = pair_by_coordinate(blocks)
    grouped = stems_of(blocks).withColumn("_g", F.coalesce("group", F.lit("-")))
    parts = [("unpaired_content", 2, lost_content(blocks, pairs)), ("dense_noise", 4, noise_blocks(blocks)),
             ("long_block", 5, long_blocks(blocks)), ("option_count", 6, option_anomalies(blocks)),
             ("solution_in_stem", 7, late_solution_marks(blocks))]
    if check_numbering:
        parts += [("number_gap", 1, number_gaps(grouped, ["doc", "_g"]).select("doc", "missing").distinct()),
                  ("declared_count", 3, declared_mismatch(blocks))]
    if lines is not None:
        parts.append(("empty_option", 8, empty_options(lines)))
    out = None
    for name, rank, found in parts:
        one = found.groupBy("doc").agg(F.count("*").alias("findings")).select(
            "doc", F.lit(rank).alias("rank"), F.lit(name).alias("check"), "findings")
        out = one if out is None else out.unionByName(one)
    return out


def segmentation_metrics(blocks: DataFrame, lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per document: blocks, stems, numbered stems, coverage, gaps, orphans, conflicts."""
    tight = F.length(F.regexp_replace("text", r"(?U)\s+", ""))
    per = blocks.groupBy("doc").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("zone") == "stem").alias("stems"),
        F.count_if((F.col("zone") == "stem") & F.col("number").isNotNull()).alias("numbered"), F.sum(tight).alias("covered"))
    whole = lines.groupBy("doc").agg(F.sum(tight).alias("whole"))
    grouped = stems_of(blocks).withColumn("_g", F.coalesce("group", F.lit("-")))
    gaps = number_gaps(grouped, ["doc", "_g"]).select("doc", "missing").distinct().groupBy("doc").agg(F.count("*").alias("gaps"))
    lost = orphan_solutions(blocks, pairs).groupBy("doc").agg(F.count("*").alias("orphans"))
    out = whole.join(per, "doc", "left").join(gaps, "doc", "left").join(lost, "doc", "left").fillna(0)
    bare = F.when(F.col("stems") > F.col("numbered"), 1).otherwise(0)
    gap = F.when(F.col("gaps") > 0, 1).otherwise(0)
    return out.select("doc", "blocks", "stems", "numbered", F.bround(F.col("covered") / F.col("whole"), 4).alias("cover"),
                      "gaps", "orphans", (F.col("orphans") + bare + gap).alias("conflicts"))


def image_only(lines: DataFrame) -> DataFrame:
    """Documents that hold nothing but images and the fixed answer heading."""
    t = M.strip(F.col("text"))
    plain = (t == "") | (t == "# 参考答案与解析") | (t.startswith("![") & t.endswith(")"))
    return lines.groupBy("doc").agg(F.bool_and(plain).alias("only")).filter("only").select("doc")


def coverage_summary(metrics: DataFrame) -> DataFrame:
    """Lowest and upper-median coverage; coverage has four decimals, so few distinct values."""
    each = metrics.groupBy("cover").agg(F.count("*").alias("k"))
    run = each.withColumn("upto", F.sum("k").over(Window.orderBy("cover")))  # at most 10,001 rows for shares in 0..1
    n = each.select(F.sum("k")).scalar()
    return run.agg(F.min("cover").alias("lowest"), F.min(F.when(F.col("upto") >= F.floor(n / 2) + 1, F.col("cover"))).alias("upper_median"))


def regressions(now: DataFrame, before: DataFrame) -> DataFrame:
    """Documents that lost coverage or newly fail, against a saved run.

    Both sides carry ``doc, cover, error, skipped``.
    """
    old = before.select("doc", F.col("cover").alias("old_cover"), F.col("error").alias("old_error"), F.col("skipped").alias("old_skipped"))
    broke = F.col("error").isNotNull() & F.col("old_error").isNull()
    lower = ~F.col("skipped") & ~F.col("old_skipped") & (F.coalesce("cover", F.lit(0.0)) < F.coalesce("old_cover", F.lit(0.0)) - COVER_SLACK)
    return (now.join(old, "doc").withColumn("reason", F.when(broke, "new_error").when(F.col("error").isNull() & lower, "coverage"))
            .filter("reason IS NOT NULL").select("doc", "reason", "old_cover", "cover"))


RECOVERED = {"choice": "单选题（由整段 A-D 选项恢复）", "fill": "填空题（由整段无选项答题空恢复）",
             "generic": "单选题（由整段选择题多数证据恢复）", "tail_fill": "填空题（由选择题段后的连续填空恢复）",
             "solution": "解答题（由连续小问题面恢复）", "fill_prefix": "填空题（由解答题段开头连续答题空恢复）"}  # fixed values


def _stage(blocks: DataFrame, per_run, decide) -> DataFrame:
    """One repair: aggregate each run of neighbouring stems of one section, then rewrite rows."""
    placed = runs(blocks, ["doc"], F.col("zone") == "stem", F.col("section"), others=True)
    stats = per_run(placed.filter("run IS NOT NULL"))
    new = placed.join(stats, ["doc", "run"], "left").withColumn("section", F.coalesce(decide(), "section"))
    return materialise(new.select(*blocks.columns))


def repair_sections(blocks: DataFrame) -> DataFrame:
    """Move items whose section heading drifted, by majority evidence inside each run."""
    rows = with_choices(blocks, name="_c")
    known = F.col("_c.complete_known")
    pics = F.regexp_count("text", F.lit(r"!\[[^\]]*\]\([^)]*\)")) >= 3
    # texts stay behind; the stages carry positions, headings and flags
    rows = materialise(rows.select(
        "doc", "idx", "number", "zone", "group", "section", (known | (F.col("_c.blank") & pics)).alias("s_choice"), (known | F.col("_c.blank")).alias("s_any"),
        has_fill_mark(F.col("text")).alias("s_fill"), has_subquestions(F.col("text")).alias("s_sub"), known.alias("s_known"),
        F.contains(F.col("text"), F.lit("___")).alias("s_line")))
    fill, generic, exact = F.col("section").rlike("(?:填空|实验)题"), F.col("section").rlike("选择题"), F.col("section").rlike("单选|多选|不定项|单项|多项")

    def base(df, *more):
        return df.groupBy("doc", "run").agg(F.count("*").alias("n"), F.min("section").alias("sec"), *more)

    rows = _stage(rows, lambda d: base(d, F.count_if("s_choice").alias("k")).filter("n >= 4 AND k * 2 >= n").select("doc", "run", F.lit(True).alias("hit")),
                  lambda: F.when(F.col("hit") & fill, RECOVERED["choice"]))
    rows = _stage(rows, lambda d: base(d, F.count_if("s_any").alias("c"), F.count_if("s_fill").alias("k"))
                  .filter("n >= 4 AND c = 0 AND k * 2 >= n").select("doc", "run", F.lit(True).alias("hit")),
                  lambda: F.when(F.col("hit") & generic & ~exact, RECOVERED["fill"]))

    def choice_range(d):
        span = base(d, F.count_if("s_any").alias("k"), F.min(F.when(F.col("s_any"), F.col("idx"))).alias("lo"),
                    F.max(F.when(F.col("s_any"), F.col("idx"))).alias("hi")).filter("n >= 4 AND k * 2 >= n AND k > 0")
        tail = (d.join(span.select("doc", "run", "hi"), ["doc", "run"]).filter("idx > hi").groupBy("doc", "run")
                .agg(F.count("*").alias("tn"), F.count_if("s_fill").alias("tf"), F.count_if("s_any").alias("tc")))
        return span.join(tail, ["doc", "run"], "left").select("doc", "run", "lo", "hi", "tn", "tf", "tc")

    rows = _stage(rows, choice_range, lambda: F.when(generic & ~exact & F.col("idx").between(F.col("lo"), F.col("hi")), RECOVERED["generic"])
                  .when(generic & ~exact & (F.col("idx") > F.col("hi")) & (F.col("tn") >= 3) & (F.col("tf") * 2 >= F.col("tn")) & (F.col("tc") == 0), RECOVERED["tail_fill"]))
    rows = _solution_runs(rows, fill)
    rows = _stage(rows, _fill_prefix, lambda: F.when(F.col("section").contains("解答") & (F.col("idx") < F.col("stop")), RECOVERED["fill_prefix"]))
    told = rows.select("doc", "idx", F.struct("section").alias("_s"))
    full = blocks.join(told, ["doc", "idx"], "left").withColumn("section", F.when(F.col("_s").isNotNull(), F.col("_s.section")).otherwise(F.col("section")))
    return full.select(*blocks.columns)


def _fill_prefix(placed: DataFrame) -> DataFrame:
    """End of the leading fill-in items of a run, where sub-questions follow at once."""
    is_fill = ~F.col("s_known") & F.col("s_fill")
    per = placed.groupBy("doc", "run").agg(
        F.count("*").alias("n"), F.min("idx").alias("first"), F.min(F.when(~is_fill, F.col("idx"))).alias("stop"),
        F.min_by("s_sub", F.when(~is_fill, F.col("idx"))).alias("sub"))
    return per.filter("n >= 4 AND stop - first >= 3 AND sub").select("doc", "run", "stop")


def _solution_runs(rows: DataFrame, fill: Column) -> DataFrame:
    cand = (F.col("zone") == "stem") & F.col("number").isNotNull() & fill & ~F.col("s_line") & F.col("s_sub")
    marked = runs(rows, ["doc"], F.coalesce(cand, F.lit(False)), F.lit(""), others=True)
    per = marked.filter("run IS NOT NULL").groupBy("doc", "run").agg(
        F.count("*").alias("n"), F.min(F.col("number") - F.col("idx")).alias("a"), F.max(F.col("number") - F.col("idx")).alias("b"),
        F.min(F.coalesce("group", F.lit("-"))).alias("g"), F.max(F.coalesce("group", F.lit("-"))).alias("h"))
    good = per.filter("n >= 3 AND a = b AND g = h").select("doc", "run", F.lit(True).alias("_hit"))
    out = marked.join(good, ["doc", "run"], "left").withColumn("section", F.when(F.col("_hit"), RECOVERED["solution"]).otherwise(F.col("section")))
    return materialise(out.select(*rows.columns))
