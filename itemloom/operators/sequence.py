"""Number sequences inside documents: gaps, runs, restarts, context, cuts.

Rows carry a dense position ``idx`` (from 0) inside ``doc``; every running value goes
through ``scale.scan``, so a document of any length is worked on in chunks. A scan reads
its input twice, so where one scan feeds another the first result is written out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..scale import chunks_of, dense_chunk, lag, last_seen, lead, row_number, running_count, running_max, running_sum, scan

MAX_GAP = 10  # fixed value: longer gaps are taken for misread numbers
RESTART_SEEN, RESTART_TAIL = 5, 3  # fixed values


def with_index(df: DataFrame, keys: list[str], order: list[str], chunk, name: str = "idx") -> DataFrame:
    """Dense position from 0 along ``order``."""
    out = scan(df, keys, order, chunk, {name: row_number()})
    return out.withColumn(name, F.col(name) - 1)


def number_gaps(df: DataFrame, keys: list[str], number: str = "number", pos: str = "idx") -> DataFrame:
    """Numbers skipped inside rising runs: one row per skipped number.

    A key whose numbers form a full range without repeats has none, in any order.
    """
    known = df.filter(F.col(number).isNotNull()).select(*keys, pos, number)
    step = scan(known, keys, [pos], dense_chunk(pos), {"before": lag(F.col(number))})
    width = F.col(number) - F.col("before")
    holes = step.filter((width > 1) & (width <= MAX_GAP + 1)).select(
        *keys, F.explode(F.sequence(F.col("before") + 1, F.col(number) - 1)).alias("missing"))
    full = continuity(known, keys, number).filter("contiguous").select(*keys)
    return holes.join(full, keys, "left_anti")


def continuity(df: DataFrame, keys: list[str], number: str = "number") -> DataFrame:
    """Per key: count, range, and whether the numbers are a full range / exactly 1..N."""
    one = df.filter(F.col(number).isNotNull()).groupBy(*keys, number).agg(F.count("*").alias("_n"))
    agg = one.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.count("*").alias("distinct_numbers"),
        F.min(number).alias("low"), F.max(number).alias("high"))
    whole = (F.col("rows") == F.col("distinct_numbers")) & (F.col("high") - F.col("low") + 1 == F.col("rows"))
    return agg.withColumn("contiguous", whole).withColumn("from_one", whole & (F.col("low") == 1))


def missing_in_range(df: DataFrame, keys: list[str], number: str = "number") -> DataFrame:
    """Every number between a key's lowest and highest that does not occur."""
    seen = df.filter(F.col(number).isNotNull()).select(*keys, number).distinct()
    step = scan(seen, keys, [number], dense_chunk(number), {"before": lag(F.col(number))})
    return step.filter(F.col(number) - F.col("before") > 1).select(
        *keys, F.explode(F.sequence(F.col("before") + 1, F.col(number) - 1)).alias("missing"))


def missing_requested(requested: DataFrame, found: DataFrame, keys: list[str], number: str = "number") -> DataFrame:
    on = [*keys, number]
    return requested.select(*on).distinct().join(found.select(*on).distinct(), on, "left_anti")


def restart_points(df: DataFrame, keys: list[str], number: str = "number", pos: str = "idx",
                   section: str | None = None, group: str | None = None) -> DataFrame:
    """First position per key where numbering falls back to 1 after at least 5 were seen.

    With ``section`` the highest number seen is forgotten when the section changes, and
    rows of a ``group`` do not take part; rows that do not take part still count as tail.
    """
    chunked = df.withColumn("_c", dense_chunk(pos))
    taking = chunked.filter(F.col(number).isNotNull())
    if group:
        taking = taking.filter(F.col(group).isNull())
    part = list(keys)
    if section:
        marked = materialise(scan(taking, keys, [pos], "_c", {"_last": lag(F.col(section))}))
        first = F.col("_last").isNull() & F.col(section).isNotNull()
        moved = first | (F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col(section)))
        taking = materialise(scan(marked, keys, [pos], "_c", {"_run": running_count(moved)}))
        part.append("_run")
    seen = scan(taking, part, [pos], "_c", {"_seen": running_max(F.col(number), inclusive=False)})
    hits = seen.filter((F.col(number) == 1) & (F.col("_seen") >= RESTART_SEEN)).select(*keys, pos)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    return (hits.join(sizes, keys).filter(F.col("_size") - F.col(pos) >= RESTART_TAIL)
            .groupBy(*keys).agg(F.min(pos).alias("restart_at")))


def fill_context(df: DataFrame, keys: list[str], columns: list[str], pos: str = "idx") -> DataFrame:
    """Carry the latest non-null value of each column to the rows after it."""
    made = {f"{c}_ctx": last_seen(F.col(c)) for c in columns}
    return scan(df, keys, [pos], dense_chunk(pos), made)


def form_blocks(lines: DataFrame, keys: list[str], boundary: Column, pos: str = "line_no",
                text: str = "text") -> DataFrame:
    """Join lines into blocks; a boundary line opens a block, earlier lines form block 0.

    A block holds lines of one source row only, so its text is never larger than it.
    """
    marked = scan(lines, keys, [pos], dense_chunk(pos), {"block": running_count(boundary)})
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return marked.groupBy(*keys, "block").agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"),
        F.min(pos).alias("first_line"), F.count("*").alias("lines"))


def runs(df: DataFrame, keys: list[str], member: Column, value: Column, pos: str = "idx", others: bool = False) -> DataFrame:
    """Number the stretches of neighbouring member rows with one value.

    Other rows are dropped, or kept with a null run if ``others``.
    """
    chunk = chunks_of(df, pos)
    keep = materialise if chunk is not None else lambda rows: rows  # windows over one key follow on each other without files
    base = df.withColumn("_in", F.coalesce(member, F.lit(False))).withColumn("_val", F.coalesce(value, F.lit("")))
    step = keep(scan(base, keys, [pos], chunk, {"_pin": lag(F.col("_in")), "_pval": lag(F.col("_val"))}))
    opens = F.col("_in") & (~F.coalesce("_pin", F.lit(False)) | (F.col("_pval") != F.col("_val")))
    numbered = scan(step, keys, [pos], chunk, {"run": running_count(opens)})
    told = numbered.withColumn("run", F.when(F.col("_in"), F.col("run"))) if others else numbered.filter("_in")
    return told.drop("_in", "_val", "_pin", "_pval")


def best_cut(df: DataFrame, keys: list[str], is_solution: Column, pos: str = "idx") -> DataFrame:
    """Where the solutions start: the first cut with most stems before and solutions after.

    No cut when the tail is empty, less than half solution, or would be the whole document.
    """
    flag = F.when(is_solution, 1).otherwise(0).cast("long")
    run = scan(df.withColumn("_f", flag), keys, [pos], dense_chunk(pos), {"_before": running_sum(F.col("_f"), inclusive=False)})
    balance = F.col(pos) - 2 * F.col("_before")
    place = F.struct(balance.alias("s"), (-F.col(pos)).alias("c"))
    agg = run.groupBy(*keys).agg(
        F.max(place).alias("_best"), F.count("*").alias("rows"), F.sum("_f").alias("solutions"),
        F.max_by("_before", place).alias("_sol_before"))
    at_end = F.col("rows") - 2 * F.col("solutions") > F.col("_best.s")
    cut = F.when(at_end, F.col("rows")).otherwise(-F.col("_best.c"))
    tail = F.col("rows") - F.col("cut")
    in_tail = F.col("solutions") - F.col("_sol_before")
    valid = (F.col("solutions") > 0) & (F.col("cut") > 0) & (tail > 0) & (2 * in_tail >= tail)
    return (agg.withColumn("cut", cut)
            .select(*keys, "rows", "solutions", F.when(valid, F.col("cut")).alias("cut")))


def zones(df: DataFrame, keys: list[str], is_solution: Column, after_heading: Column,
          number: str = "number", pos: str = "idx", section: str = "section", group: str = "group", restarts: bool = True) -> DataFrame:
    """Zone per row: by answer heading where a document has one, else by best cut, else
    (no solution mark at all) by numbering restart; never a document of solutions only.
    Without ``restarts`` a document with no solution mark is all stems."""
    flags = df.groupBy(*keys).agg(F.max(F.coalesce(after_heading, F.lit(False))).alias("_head"),
                                  F.min(F.coalesce(after_heading, F.lit(False))).alias("_all"))
    cuts = best_cut(df, keys, is_solution, pos)
    info = flags.join(cuts.select(*keys, "cut", "solutions"), keys, "left")
    if restarts:
        info = info.join(restart_points(df, keys, number, pos, section, group), keys, "left")
    else:
        info = info.withColumn("restart_at", F.lit(None).cast("long"))
    joined = df.withColumn("_ans", F.coalesce(after_heading, F.lit(False))).join(info, keys, "left")
    tail = F.when(F.col("_head"), F.col("_ans") & ~F.col("_all")).when(
        F.col("solutions") > 0, F.col(pos) >= F.col("cut")).otherwise(F.col(pos) >= F.col("restart_at"))
    return (joined.withColumn("zone", F.when(tail, "solution").otherwise("stem"))
            .drop("_head", "_all", "_ans", "cut", "solutions", "restart_at"))


def scheme_vote(lines: DataFrame, keys: list[str], is_section: Column, has_keyword: Column,
                number: str = "number", pos: str = "line_no") -> DataFrame:
    """Whether Arabic or Chinese numbers count the items of a document."""
    tagged = lines.withColumn("_sec", F.coalesce(is_section, F.lit(False)))
    nums = tagged.filter(~F.col("_sec") & F.col(number).isNotNull()).select(*keys, pos, number)
    step = scan(nums, keys, [pos], dense_chunk(pos), {"_prev": lag(F.col(number))})
    restarts = step.groupBy(*keys).agg(F.count_if(F.col(number) <= F.col("_prev")).alias("restarts"),
                                       F.count("*").alias("numbers"))
    heads = tagged.groupBy(*keys).agg(F.count_if(F.col("_sec")).alias("sections"),
                                      F.count_if(F.col("_sec") & has_keyword).alias("with_keyword"))
    both = heads.join(restarts, keys, "left").fillna(0, ["restarts", "numbers"])
    chinese = ((F.col("sections") > 0) & (F.col("with_keyword") * 2 < F.col("sections")) & (F.col("numbers") > 0)
               & (F.col("restarts") >= F.greatest(F.lit(2), F.floor(F.col("sections") / 2))))
    return both.withColumn("scheme", F.when(chinese, "chinese").otherwise("arabic"))


def gaps_of_one(df: DataFrame, keys: list[str], number: str = "number", pos: str = "idx") -> DataFrame:
    """Neighbouring rows n and n+2 (one lost number), and n, n+2, n+2, n+3 shifts."""
    step = scan(df, keys, [pos], dense_chunk(pos), {"_n1": lead(F.col(number)), "_p1": lag(F.col(number))})
    return step.withColumn("lost_after", F.coalesce(F.col("_n1") == F.col(number) + 2, F.lit(False))).drop("_n1", "_p1")


def repair_shifted_duplicate(df: DataFrame, keys: list[str], context: list[str], number: str = "number",
                             pos: str = "idx") -> DataFrame:
    """Rewrite neighbouring n, n+2, n+2, n+3 of one context to n, n+1, n+2, n+3.

    Only where n+1 occurs nowhere in that context; of several such places the first counts.
    """
    ctx = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in context])
    base = df.withColumn("_c", dense_chunk(pos)).withColumn("_x", ctx)
    here = F.struct(F.col(number).alias("n"), F.col("_x").alias("x"))
    one = materialise(scan(base, keys, [pos], "_c", {"_p": lag(here), "_n": lead(here)}))
    two = scan(one, keys, [pos], "_c", {"_nn": lead(F.col("_n"))})
    n, x = F.col(number), F.col("_x")
    wrong = ((F.col("_p.n") == n - 2) & (F.col("_n.n") == n) & (F.col("_nn.n") == n + 1)
             & (F.col("_p.x") == x) & (F.col("_n.x") == x) & (F.col("_nn.x") == x))
    found = two.filter(wrong).select(*keys, "_x", (n - 1).alias("_m"), pos)
    taken = base.select(*keys, "_x", n.alias("_m")).distinct()
    fixes = (found.join(taken, [*keys, "_x", "_m"], "left_anti")
             .groupBy(*keys, "_x", "_m").agg(F.min(pos).alias(pos)).select(*keys, pos, "_m"))
    return (df.join(fixes, [*keys, pos], "left").withColumn("repaired", F.col("_m").isNotNull())
            .withColumn(number, F.coalesce(F.col("_m"), F.col(number))).drop("_m"))
