"""Splitting collections into papers and pairing exam parts with answer parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.passes import nfkc, topic_core, topic_key
from ..scale import chunks_of, dense_chunk, fold, lag, lead, running_count, scan
from ..session import materialise

# Title words and limits.
GENERIC = ("物理", "数学", "化学", "生物", "语文", "英语", "物理试题", "数学试题", "化学试题", "生物试题", "语文试题", "英语试题",
           "试题", "试卷", "答案", "解析", "参考答案", "答案解析", "详细解析")
PAPER_WORDS = (r"(?:中学|学校|附中|一中|届|学年|高一|高二|高三|初一|初二|初三|高考|中考|月考|联考|模考|一模|二模|三模|期中|期末|测试|考试|竞赛|试卷|试题)")
SCHOOL_WORDS = ("中学", "学校", "附中", "一中", "届", "学年", "月考", "联考", "模考", "一模", "二模", "期中", "期末", "高考", "中考", "参考答案")
SOLUTION_SUFFIX = r"(?U)(?:参考答案|答案解析|详细解析|解析|答案|详解|解答)+\s*$"
SUBJECT_SUFFIX = r"(?U)(?:物理|数学|化学|生物|语文|英语)(?:试题|试卷)?\s*$"
FILE_SUFFIX = r"(参考答案|答案解析|详细解析|解析|答案|详解|解答)[\s\-_()（）\d]*$"
MIN_NUMBERS, MIN_COVERAGE, MIN_OVERLAP = 5, 0.85, 0.80
RECOVERY_COVERAGE = 0.60


def is_paper_title(title: Column) -> Column:
    t = F.regexp_replace(nfkc(F.coalesce(title, F.lit(""))), r"(?U)\s+", "")
    return (t != "") & ~t.isin(*GENERIC) & ~t.rlike(r"^[一二三四五六七八九十]+[、.．]") & t.rlike(PAPER_WORDS)


def discover_parts(outline: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, rejected documents) from outline rows (doc, seq, depth, page, title).

    The shallowest depth with two titled pages is cut; a titled page of another depth behind
    the first start makes the document ambiguous.
    """
    rows = materialise(outline.withColumn("paper", is_paper_title(F.col("title"))))
    titled = rows.filter("paper")
    depth = (titled.groupBy("doc", "depth").agg(F.count_distinct("page").alias("n")).filter("n >= 2")
             .groupBy("doc").agg(F.min("depth").alias("depth")))
    compact = F.regexp_replace("title", r"(?U)\s+", "")
    signals = sum((F.contains(compact, F.lit(w)).cast("int") for w in SCHOOL_WORDS), F.lit(0))
    starts = titled.join(depth, ["doc", "depth"]).groupBy("doc", "page").agg(
        F.max_by("title", F.struct(signals, F.length(compact), -F.col("seq"))).alias("title"))
    first = starts.groupBy("doc").agg(F.min("page").alias("first"))
    other = (titled.join(depth.withColumnRenamed("depth", "_d"), "doc").filter("depth <> _d").join(first, "doc").filter("page >= first")
             .join(starts.select("doc", "page"), ["doc", "page"], "left_anti").select("doc").distinct())
    nxt = scan(starts.withColumn("_c", F.floor(F.col("page") / 4096)), ["doc"], ["page"], "_c", {"next_page": lead(F.col("page"))})
    parts = nxt.join(pages, "doc").select("doc", "title", F.col("page").alias("start"), F.coalesce("next_page", "page_count").alias("stop"))
    none = rows.select("doc").distinct().join(depth, "doc", "left_anti").select("doc", F.lit("no_paper_level").alias("reason"))
    rejected = none.unionByName(other.select("doc", F.lit("mixed_levels").alias("reason")))
    return parts.join(rejected, "doc", "left_anti"), rejected


def pairing_key(title: Column) -> Column:
    t = F.trim(nfkc(F.coalesce(title, F.lit(""))))
    t = F.trim(F.regexp_replace(t, SOLUTION_SUFFIX, ""))
    t = F.trim(F.regexp_replace(t, SUBJECT_SUFFIX, ""))
    return F.regexp_replace(F.lower(t), r"[^0-9a-z一-鿿]+", "")


def pair_parts(exams: DataFrame, solutions: DataFrame) -> DataFrame:
    """Exam and answer parts of a collection by title key, with ``state``: ok, missing, extra, duplicate."""
    def side(df, p):
        return df.withColumn("key", pairing_key(F.col("title"))).groupBy("collection", "key").agg(
            F.count("*").alias(f"{p}_n"), F.min("title").alias(f"{p}_title"))
    j = side(exams, "exam").join(side(solutions, "solution"), ["collection", "key"], "full_outer")
    state = (F.when((F.coalesce("exam_n", F.lit(0)) > 1) | (F.coalesce("solution_n", F.lit(0)) > 1) | (F.col("key") == ""), "duplicate")
             .when(F.col("solution_n").isNull(), "missing").when(F.col("exam_n").isNull(), "extra").otherwise("ok"))
    return j.select("collection", "key", "exam_title", "solution_title", state.alias("state"))


def pair_uploads(files: DataFrame) -> DataFrame:
    """Upload groups: documents by core name, images by folder; counts of both sides."""
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    solution = stem.rlike(FILE_SUFFIX)
    core = F.regexp_replace(F.regexp_replace(stem, FILE_SUFFIX, ""), r"[\s\-_()（）]+$", "")
    image = F.lower("name").rlike(r"\.(?:png|jpg|jpeg|webp|bmp)$")
    keyed = files.withColumn("group", F.when(image, F.concat(F.lit("dir:"), "folder")).otherwise(F.concat(F.lit("doc:"), "folder", F.lit("/"), core)))
    return keyed.groupBy("group").agg(F.count_if(~solution).alias("exams"), F.count_if(solution).alias("solutions"))


def topic_matches(exams: DataFrame, solutions: DataFrame) -> DataFrame:
    """Compatible (collection, exam pos, solution pos): equal cores, or one core is the other
    plus a tail that already occurs in it. The tail rule meets by equality on prefixes."""
    def side(df, p):
        key = topic_key(F.col("topic"))
        rows = materialise(df.withColumn("_k", key).filter("_k <> ''").select("collection", F.col("pos").alias(p), topic_core(F.col("_k")).alias("core")))
        cuts = F.filter(F.sequence(F.lit(1), F.length("core")), lambda n: (n == F.length("core")) | F.contains(
            F.substr("core", F.lit(1), n), F.substr("core", n + 1)))
        forms = rows.select("collection", p, F.explode(F.transform(cuts, lambda n: F.substr("core", F.lit(1), n))).alias("form"))
        return rows, forms
    (e, ef), (s, sf) = side(exams, "exam_pos"), side(solutions, "solution_pos")
    on = ["collection", "form"]
    a = ef.join(s.withColumnRenamed("core", "form"), on)
    b = e.withColumnRenamed("core", "form").join(sf, on)
    return a.select("collection", "exam_pos", "solution_pos").unionByName(b.select("collection", "exam_pos", "solution_pos")).distinct()


def pair_units(exams: DataFrame, solutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejected collections) of units zipped by position.

    Rejected: unequal unit counts; incompatible topics; a topic with several candidates whose
    ordinals do not single it out; restarted units whose numbers overlap below 80 %.
    """
    n = (exams.groupBy("collection").agg(F.count("*").alias("a")).join(
        solutions.groupBy("collection").agg(F.count("*").alias("b")), "collection", "full_outer")
        .filter("a IS NULL OR b IS NULL OR a <> b").select("collection", F.lit("unit_count").alias("reason")))
    m = materialise(topic_matches(exams, solutions))
    per_exam = m.groupBy("collection", F.col("exam_pos").alias("pos")).agg(F.count("*").alias("options"))
    per_sol = m.groupBy("collection", F.col("solution_pos").alias("pos")).agg(F.count("*").alias("rivals"))
    same = m.filter("exam_pos = solution_pos").select("collection", F.col("exam_pos").alias("pos"), F.lit(True).alias("fits"))
    s = solutions.select("collection", "pos", F.col("title").alias("s_title"), F.col("ordinal").alias("s_ordinal"),
                         F.col("question_numbers").alias("s_numbers"), F.col("generated_title").alias("s_generated"))
    z = (exams.join(s, ["collection", "pos"]).join(per_exam, ["collection", "pos"], "left").join(per_sol, ["collection", "pos"], "left")
         .join(same, ["collection", "pos"], "left"))
    by_ordinal = (m.join(exams.select("collection", F.col("pos").alias("exam_pos"), "ordinal"), ["collection", "exam_pos"])
                  .join(solutions.select("collection", F.col("pos").alias("solution_pos"), F.col("ordinal").alias("so")), ["collection", "solution_pos"])
                  .filter("ordinal = so").groupBy("collection", F.col("exam_pos").alias("pos")).agg(F.count("*").alias("k")))
    z = z.join(by_ordinal, ["collection", "pos"], "left")
    overlap = F.size(F.array_intersect("question_numbers", "s_numbers")) / F.greatest(F.lit(1), F.size(F.array_distinct("question_numbers")), F.size(F.array_distinct("s_numbers")))
    fits = F.coalesce("fits", F.lit(False))
    unclear = ((F.col("options") > 1) | (F.col("rivals") > 1)) & ~F.coalesce((F.col("ordinal") == F.col("s_ordinal")) & (F.col("k") == 1), F.lit(False))
    why = (F.when(F.col("number_reset"), F.when(overlap < MIN_OVERLAP, "overlap").when(~F.col("generated_title") & ~F.col("s_generated") & ~fits, "titles"))
           .when(~fits, "topic").when(unclear, "ambiguous"))
    judged = z.withColumn("reason", why)
    rejected = n.unionByName(judged.filter("reason IS NOT NULL").groupBy("collection").agg(F.min("reason").alias("reason")))
    return judged.join(rejected, "collection", "left_anti").select("collection", "pos", "title", "s_title"), rejected


def restart_groups(numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, rejected documents) by complete restarts of the numbering.

    ``numbers(doc, line_no, number, titled)``; ``titled`` says an ordinary paper title stands
    right before the line, an optional ``section`` that only a section heading does. Every 1
    that does not follow a 1 opens a group. A document is rejected as a whole when a group has
    under five numbers or covers under 85 % of its range, when neighbours without a title
    between them overlap below 80 %, or when a group opens at a section heading. A group
    keeps its distinct numbers only, at most 300 by their range.
    """
    hits = numbers.filter(F.col("number").between(1, 300))
    chunk = chunks_of(hits, "line_no")
    if "section" not in hits.columns:
        hits = hits.withColumn("section", F.lit(False))
    marked = scan(hits, ["doc"], ["line_no"], chunk, {"_before": lag(F.col("number"))})
    opens = (F.col("number") == 1) & (F.col("_before") != 1)
    runs = scan(marked.withColumn("_opens", F.coalesce(opens, F.lit(False))), ["doc"], ["line_no"], chunk, {"_run": running_count(F.col("_opens"))})
    at = F.min_by(F.struct("line_no", "number", "titled", "section"), "line_no")
    groups = materialise(runs.groupBy("doc", (F.col("_run") + 1).cast("int").alias("grp")).agg(
        at.alias("_at"), F.sort_array(F.collect_set("number")).alias("question_numbers"))
        .select("doc", "grp", F.col("_at.line_no").alias("start_line"), F.col("_at.titled").alias("titled"), "question_numbers",
                F.col("_at.number").alias("first"), F.col("_at.section").alias("section")))
    nx = scan(groups, ["doc"], ["grp"], dense_chunk("grp"), {"nx": lead(F.struct("question_numbers", "titled"))})
    q, last = F.col("question_numbers"), F.col("nx").isNull()
    thin = (F.col("first") != 1) | (F.size(q) < MIN_NUMBERS) | (F.size(q) / F.array_max(q) < MIN_COVERAGE)
    apart = ~last & ~F.col("nx.titled") & (
        F.size(F.array_intersect(q, F.col("nx.question_numbers"))) / F.greatest(F.size(q), F.size("nx.question_numbers")) < MIN_OVERLAP)
    per = nx.groupBy("doc").agg(F.count("*").alias("n"), F.max(~last & (F.size(q) < MIN_NUMBERS)).alias("unsure"), F.max(thin).alias("thin"),
                                F.max(apart).alias("apart"), F.max((F.col("grp") > 1) & F.col("section")).alias("section"))
    reason = (F.when(F.col("section"), "section").when(F.col("unsure") | (F.col("n") < 2), "no_clear_restart")
              .when(F.col("thin"), "coverage").when(F.col("apart"), "overlap"))
    rejected = per.withColumn("reason", reason).filter("reason IS NOT NULL").select("doc", "reason")
    return groups.join(rejected, "doc", "left_anti").drop("first", "section"), rejected


def titles_before(lines: DataFrame, is_heading: Column, is_reset: Column) -> DataFrame:
    """Headings that stand directly before a reset line, joined; plain text in between cuts the chain."""
    base = lines.withColumn("_h", is_heading).withColumn("_r", is_reset).filter(F.trim("text") != "")
    plain = ~F.col("_h")
    run = scan(base, ["doc"], ["line_no"], dense_chunk("line_no"), {"chain": running_count(plain, inclusive=False)})
    heads = run.filter("_h").groupBy("doc", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("title"),
                                                        F.min("line_no").alias("title_line"))
    return run.filter("_r AND NOT _h").select("doc", "line_no", "chain").join(heads, ["doc", "chain"]).drop("chain")


def rising_starts(numbers: DataFrame) -> DataFrame:
    """Lines that start items: the longest of five greedy chains in which a number may skip two.

    Numbers have three digits, so a chain has at most 999 lines.
    """
    def step(state, part):
        for line, n in zip(part["line_no"], part["number"]):
            line, n = int(line), int(n)
            for chain in state:
                if chain["expect"] <= n <= chain["expect"] + 2:
                    chain["lines"].append(line)
                    chain["expect"] = n + 1
            if len(state) < 5:
                state.append({"lines": [line], "expect": n + 1})

    def finish(state):
        best = max(state, key=lambda c: len(c["lines"])) if state else {"lines": []}
        return [(x,) for x in best["lines"]]

    return fold(numbers, ["doc"], ["line_no"], list, step, finish, f"doc {dict(numbers.dtypes)['doc']}, line_no long")


def titled_units(lines: DataFrame, min_coverage: float = 0.80, recovery: bool = False) -> tuple[DataFrame, DataFrame]:
    """(units, rejected documents) of a collection cut at confirmed titles.

    ``lines(doc, line_no, is_title, key, number)``. Neighbouring titles with one key are one
    run, of which the last title counts that is followed by numbers from 1 covering at least
    80 % of their range. A document needs two confirmed runs, and no unconfirmed run after
    the first confirmed one. With ``recovery`` five numbers from 1 covering 60 % confirm too.
    """
    titles = lines.filter("is_title").select("doc", "line_no", "key")
    marked = materialise(scan(titles, ["doc"], ["line_no"], dense_chunk("line_no"), {"_k": lag(F.col("key"))}))
    opens = marked.select("doc", "line_no", "key", (F.col("_k").isNull() | (F.col("_k") != F.col("key"))).alias("opens"))
    rows = (lines.filter("NOT is_title AND number BETWEEN 1 AND 300").select("doc", "line_no", "number", F.lit(None).cast("string").alias("key"), F.lit(False).alias("opens"), F.lit(False).alias("title"))
            .unionByName(opens.select("doc", "line_no", F.lit(None).cast("int").alias("number"), "key", "opens", F.lit(True).alias("title"))))
    placed = materialise(scan(rows, ["doc"], ["line_no"], dense_chunk("line_no"), {"run": running_count(F.col("opens")), "cand": running_count(F.col("title"))}))
    numbers = placed.filter("NOT title AND run > 0").groupBy("doc", "run", "number").agg(F.max("cand").alias("seen_in"))
    heads = placed.filter("title").select("doc", "run", "cand", "line_no", F.col("key").alias("title_key"))
    # at most 300 numbers meet each title of their run
    proof = (heads.join(numbers, ["doc", "run"], "left").groupBy("doc", "run", "cand", "line_no", "title_key")
             .agg(F.min(F.when(F.col("seen_in") >= F.col("cand"), F.col("number"))).alias("low"), F.max(F.when(F.col("seen_in") >= F.col("cand"), F.col("number"))).alias("high"),
                  F.count_if(F.col("seen_in") >= F.col("cand")).alias("k")))
    valid = (F.col("k") >= 2) & (F.col("low") == 1) & (F.col("k") >= F.col("high") * min_coverage)
    if recovery:
        valid = valid | ((F.col("k") >= MIN_NUMBERS) & (F.col("low") == 1) & (F.col("k") >= F.col("high") * RECOVERY_COVERAGE))
    runs_ = materialise(proof.groupBy("doc", "run").agg(F.max(F.when(valid, F.struct("cand", "line_no", "title_key", "k"))).alias("best")))
    per = runs_.groupBy("doc").agg(F.count("best").alias("confirmed"), F.min(F.when(F.col("best").isNotNull(), F.col("run"))).alias("first"),
                                   F.max(F.when(F.col("best").isNull(), F.col("run"))).alias("open_run"))
    reason = F.when(F.col("confirmed") < 2, "too_few_titles").when(F.col("open_run") > F.col("first"), "unconfirmed_title")
    rejected = per.withColumn("reason", reason).filter("reason IS NOT NULL").select("doc", "reason")
    units = runs_.filter("best IS NOT NULL").join(rejected, "doc", "left_anti").select(
        "doc", "run", F.col("best.line_no").alias("start_line"), F.col("best.title_key").alias("title_key"), F.col("best.k").alias("numbers"))
    return units, rejected


def provisional_units(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, rejected documents) with a second try at 60 % for documents that ``titled_units`` rejects.

    ``lines`` also has ``strong`` and ``ordinal`` on its titles. The second try needs strong
    titles throughout, ordinals that rise by one from unit to unit, and five numbers in each.
    Its units are ``provisional``: they tell where to look for lost numbers and must pass
    ``titled_units`` afterwards, so they are not for pairing or loading.
    """
    strict, failed = titled_units(lines)
    failed = materialise(failed)
    weak = lines.filter("is_title AND NOT coalesce(strong, false)").select("doc").distinct()
    again = lines.join(failed.select("doc"), "doc", "left_semi").join(weak, "doc", "left_anti")
    loose = titled_units(again, recovery=True)[0]
    titles = again.filter("is_title").select("doc", F.col("line_no").alias("start_line"), "ordinal")
    placed = materialise(loose.join(titles, ["doc", "start_line"]))
    steps = scan(placed, ["doc"], ["run"], dense_chunk("run"), {"_before": lag(F.struct("ordinal"))})
    jump = F.col("_before").isNotNull() & ~F.coalesce(F.col("ordinal") == F.col("_before.ordinal") + 1, F.lit(False))
    bad = steps.filter(jump | F.col("ordinal").isNull() | (F.col("numbers") < MIN_NUMBERS)).select("doc").distinct()
    found = placed.drop("ordinal").join(bad, "doc", "left_anti").withColumn("provisional", F.lit(True))
    units = strict.withColumn("provisional", F.lit(False)).unionByName(found)
    return units, failed.join(found.select("doc").distinct(), "doc", "left_anti")
