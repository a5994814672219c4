"""Collections whose numbering starts anew: titles before a restart, papers nested in a unit,
and the answer side cut to fit the units of the exam side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.marks import arabic, chinese_number, strip
from ..functions.passes import nfkc, topic_core, topic_key
from ..scale import Carry, chunks_of, dense_chunk, fold, lag, last_seen, lead, running_count, running_max, scan
from ..session import materialise
from .collections import MIN_COVERAGE, MIN_NUMBERS, MIN_OVERLAP

# Line patterns and limits.
HEADING = r"^\s{0,3}#{1,6}\s+\S"
BOLD = r"(?U)^\s*(?:\*\*[^*]+\*\*|__[^_]+__)\s*$"
IMAGE = r"^!\[[^]]*]\([^)]*\)$"
FENCE = r"(?U)^\s*(?:```|~~~)"
LEADING_MARKS = r"(?U)^\s*(?:#{1,6}\s*)?(?:>\s*)?(?:\*\*|__)?\s*(?:[★☆]+\s*)?"
TRAILING_MARKS = r"(?U)\s*(?:\*\*|__)?\s*$"
ANSWER_TAIL = r"(?U)(?:[>》]\s*(?:参考)?(?:答案|解析|详解|解答)(?:与解析)?|参考答案|\s+(?:答案解析|解析|详解|解答|答案))\s*$"
SECTION = (r"(?U)(?:单项|多项|不定项|单选|多选|选择|填空|实验|判断|计算|解答|简答|非选择|作图|证明|答案|解析)题?(?:部分)?"
           r"(?:\s*[（(][^）)\n]{0,120}[）)])?\s*$")
COVER = r"(?U)^(?:[（(]?(?:考察|考试)范围|[（(]?自测(?:时间|限时)|学校|姓名|班级|总分|自评总分)\s*[:：]"
NUMERALS = "[〇零一二三四五六七八九十百两壹贰叁肆伍陆柒捌玖拾佰]+"
NUMBERS = (r"(?U)^(\d{1,3})\s*(?:[．、]|\.(?!\d))", r"(?U)^第\s*(\d{1,3})\s*[题題]")
NUMBER_CN = r"(?U)^第\s*(" + NUMERALS + r")\s*[题題]"
ANSWER_TITLE = r"(?U)^[㐀-鿿A-Za-z]{1,24}?(" + NUMERALS + r")\s*(?:参考)?(?:答案|解析|详解|解答)(?:与解析)?\s*[:：]?$"
ANSWER_TOPICS = ("答案", "参考答案", "解析", "答案解析", "参考答案解析", "详解", "解答")
TITLE_CHARS, COVER_LINES = 120, 20
SPARSE_OVERLAP, SPARSE_MISSING = 0.75, 3


def _title(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, LEADING_MARKS, ""), TRAILING_MARKS, "")
    return strip(F.regexp_replace(plain, ANSWER_TAIL, ""))


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds ``number``, the item number that opens a line, heading and emphasis marks aside; each step is a column of its own."""
    plain = F.col("_plain")
    found = [F.when(plain.rlike(p), arabic(F.regexp_extract(plain, p, 1))) for p in NUMBERS]
    told = (lines.withColumn("_plain", F.regexp_replace("text", LEADING_MARKS, "")).withColumn("_arabic", F.coalesce(*found))
            .withColumn("_numeral", F.when(plain.rlike(NUMBER_CN), F.regexp_extract(plain, NUMBER_CN, 1))))
    number = F.when(~F.ltrim("text").startswith("|"), F.coalesce("_arabic", chinese_number(F.col("_numeral"))))
    return told.withColumn("number", number).drop("_arabic", "_numeral", "_plain")


def number_hits(lines: DataFrame) -> DataFrame:
    """(doc, line_no, number, title, title_line, section) of the numbered lines of ``lines(doc, line_no, text)``.

    The title is the ordinary heading before a number, past blank lines and section headings;
    within 20 lines also past cover fields and images, never past other text. ``section``
    says that a section heading is all that stands there. Lines in fences and table rows
    carry no number. A null text is an empty line.
    """
    text, number, title = F.col("text"), F.col("number"), F.col("title")
    clean = lines.select("doc", "line_no", F.coalesce("text", F.lit("")).alias("text")).filter(strip(text) != "")
    told = _numbered(clean).withColumn("title", _title(text)).withColumn("_head", text.rlike(HEADING) | text.rlike(BOLD))
    kind = (F.when(F.col("_head"), F.when(number.isNotNull(), "other").when(title == "", "cover").when(title.rlike(SECTION), "section").otherwise("title"))
            .when(title.rlike(COVER) | F.trim(text).rlike(IMAGE), "cover").otherwise("other"))
    slim = told.withColumn("kind", kind).select("doc", "line_no", "number", "kind", text.rlike(FENCE).alias("fence"),
                                                F.when(F.col("kind") == "title", title).alias("title"))
    chunk = chunks_of(lines, "line_no")
    fenced = scan(slim, ["doc"], ["line_no"], chunk, {"fences": running_count(F.col("fence"))})
    inside = F.col("fence") | (F.col("fences") % 2 == 1)
    clear = fenced.select("doc", "line_no", "title", F.when(~inside, F.col("number")).alias("number"), F.when(inside, "other").otherwise(F.col("kind")).alias("kind"))
    seen = F.struct("kind", "line_no", "title")
    looked = scan(clear, ["doc"], ["line_no"], chunk, {
        "near": last_seen(F.when(F.col("kind") != "section", seen), False),
        "far": last_seen(F.when(~F.col("kind").isin("section", "cover"), seen), False), "before": lag(F.col("kind"))})
    near = (F.col("near.kind") == "title") & (F.length("near.title") <= TITLE_CHARS)
    far = (F.col("far.kind") == "title") & (F.col("line_no") - F.col("far.line_no") <= COVER_LINES)
    found = F.when(near, F.col("near")).when(far, F.col("far"))
    return looked.filter(F.col("number").between(1, 300)).select(
        "doc", "line_no", "number", found["title"].alias("title"), found["line_no"].alias("title_line"),
        (F.coalesce(F.col("before") == "section", F.lit(False)) & ~F.coalesce(near, F.lit(False))).alias("section"))


def nested_units(units: DataFrame, hits: DataFrame, min_coverage: float = MIN_COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(parts, rejected documents): units in which whole papers with their own title follow are cut there.

    ``units(doc, unit, start_line, title, ordinal)``, ``hits`` as of ``number_hits``. Inside a
    unit a 1 opens a part if a title stands before it, no 1 does, and the open part has five
    numbers; else the part goes on. A unit with one part, or that does not begin at 1, stays
    as it is. Where a unit is cut, each part needs five numbers and ``min_coverage`` of its
    range, or the whole document is rejected. The first part keeps title and ordinal of its unit.
    """
    rows = (units.select("doc", F.col("start_line").alias("line_no"), F.lit(0).alias("_is_hit"), F.struct("unit", "start_line").alias("_unit"),
                         *[F.lit(None).cast(t).alias(c) for c, t in (("number", "int"), ("title", "string"), ("title_line", "long"))])
            .unionByName(hits.select("doc", "line_no", F.lit(1).alias("_is_hit"), F.lit(None).cast(units.select(F.struct("unit", "start_line")).schema[0].dataType).alias("_unit"),
                                     F.col("number").cast("int").alias("number"), "title", F.col("title_line").cast("long").alias("title_line"))))
    chunk = chunks_of(rows, "line_no")
    placed = scan(rows, ["doc"], ["line_no", "_is_hit"], chunk, {"_unit": last_seen(F.col("_unit"))})
    own = placed.filter("_is_hit = 1 AND _unit IS NOT NULL").select(
        "doc", F.col("_unit.unit").alias("unit"), "line_no", "number",
        F.when(F.col("title_line") >= F.col("_unit.start_line"), F.struct("title", "title_line")).alias("head"))
    marked = scan(own, ["doc", "unit"], ["line_no"], chunk, {"before": lag(F.col("number"))})
    opens = F.coalesce((F.col("number") == 1) & (F.col("before") != 1) & F.col("head").isNotNull(), F.lit(False))
    runs = materialise(scan(marked.withColumn("_opens", opens), ["doc", "unit"], ["line_no"], chunk, {"run": running_count(F.col("_opens"))}).drop("_opens"))

    def step(state, part):
        out = []
        for run, numbers in zip(part["run"], part["numbers"]):
            if len(state["seen"]) >= MIN_NUMBERS:
                state["seen"], state["part"] = set(), state["part"] + 1
            state["seen"].update(int(n) for n in numbers)
            out.append((int(run), state["part"]))
        return out

    kinds = dict(runs.dtypes)
    parts = fold(runs.groupBy("doc", "unit", "run").agg(F.collect_set("number").alias("numbers")), ["doc", "unit"], ["run"],
                 lambda: {"seen": set(), "part": 1}, step, lambda state: [], f"doc {kinds['doc']}, unit {kinds['unit']}, run long, part int")
    same = (F.col("r.doc").eqNullSafe(F.col("p.doc")) & F.col("r.unit").eqNullSafe(F.col("p.unit")) & (F.col("r.run") == F.col("p.run")))
    at = F.min_by(F.struct("line_no", "number", "head"), "line_no")
    cut = materialise(runs.alias("r").join(parts.alias("p"), same).groupBy("r.doc", "r.unit", "p.part").agg(
        at.alias("at"), F.sort_array(F.collect_set("number")).alias("question_numbers")))
    shape = (cut.groupBy("doc", "unit").agg(F.max("part").alias("n"), F.min_by("at.number", "part").alias("first"))
             .join(runs.groupBy("doc", "unit").agg(F.sort_array(F.collect_set("number")).alias("all_numbers")), ["doc", "unit"]))
    whole = F.coalesce((F.col("n") < 2) | (F.col("first") != 1), F.lit(True))
    u = units.select("doc", "unit", "start_line", F.col("title").alias("unit_title"), "ordinal")
    judged = u.join(shape, ["doc", "unit"], "left").withColumn("whole", whole)
    kept = judged.filter("whole").select("doc", "unit", F.lit(1).alias("part"), "start_line", F.col("unit_title").alias("title"), "ordinal",
                                         F.coalesce("all_numbers", F.array().cast("array<int>")).alias("question_numbers"), F.lit(False).alias("number_reset"))
    first = F.col("part") == 1
    split = judged.filter("NOT whole").select("doc", "unit", "unit_title", "ordinal").join(cut, ["doc", "unit"])
    q = F.col("question_numbers")
    rejected = split.filter((F.size(q) < MIN_NUMBERS) | (F.size(q) / F.array_max(q) < min_coverage)).select("doc", F.lit("coverage").alias("reason")).distinct()
    fresh = split.select("doc", "unit", "part", F.coalesce("at.head.title_line", "at.line_no").alias("start_line"),
                         F.when(first, F.col("unit_title")).otherwise(F.col("at.head.title")).alias("title"), F.when(first, F.col("ordinal")).alias("ordinal"),
                         "question_numbers", F.lit(True).alias("number_reset"))
    return kept.unionByName(fresh).join(rejected, "doc", "left_anti"), rejected


def with_topics_compatible(rows: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """Adds ``name``: equal topics, equal cores, or one core with a tail that already occurs in it; each step is a column of its own."""
    keyed = rows.withColumn("_ka", topic_key(a)).withColumn("_kb", topic_key(b))
    cored = keyed.withColumn("_ca", topic_core(F.col("_ka"))).withColumn("_cb", topic_core(F.col("_kb")))

    def repeated(longer, shorter):
        tail = F.substr(longer, F.length(shorter) + 1)
        return F.startswith(longer, shorter) & (tail != "") & F.contains(shorter, tail)
    ka, kb, ca, cb = (F.col(c) for c in ("_ka", "_kb", "_ca", "_cb"))
    fits = (ka != "") & (kb != "") & ((ka == kb) | (ca == cb) | repeated(ca, cb) | repeated(cb, ca))
    return cored.withColumn(name, fits).drop("_ka", "_kb", "_ca", "_cb")


def _with_answers_by_ordinal(rows: DataFrame, title: Column, topic: Column, ordinal: Column, wanted: Column, name: str) -> DataFrame:
    """Adds ``name``: a title that is an ordinal and an answer word only, with the ordinal of the exam unit."""
    told = (rows.withColumn("_t", nfkc(title)).withColumn("_generic", F.col("_t").rlike(ANSWER_TITLE))
            .withColumn("_numeral", F.when(F.col("_generic"), F.regexp_extract("_t", ANSWER_TITLE, 1))))
    number = F.coalesce(ordinal, chinese_number(F.col("_numeral")))
    return told.withColumn(name, F.coalesce((number == wanted) & (F.col("_generic") | topic_key(topic).isin(*ANSWER_TOPICS)), F.lit(False))).drop("_t", "_generic", "_numeral")


def solution_units(exams: DataFrame, hits: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, rejected collections): answers cut where their numbers restart, each group proved by its exam unit.

    ``exams(collection, pos, title, topic, ordinal, question_numbers, generated_title)`` with
    pos from 1; ``hits(collection, line_no, number, title, title_line)`` of the answer side;
    ``titles(collection, line_no, title, topic, ordinal, strong)`` its structure titles. A 1
    opens a group once the open one has two numbers. Rejected: another number of groups than
    of exam units; a group that lacks 1, or overlaps its unit below 80 %; a title that fits
    neither topic nor ordinal. 75 % do when a strong title with the same ordinal and topic
    stands there, only up to three inner numbers lack, numbers rise, and neighbours are regular.
    """
    head = F.struct("line_no", "title", "topic", F.col("ordinal").cast("int").alias("ordinal"), "strong")
    kind = titles.select(head.alias("t")).schema[0].dataType
    rows = (titles.select("collection", "line_no", F.lit(0).alias("_is_hit"), F.lit(None).cast("int").alias("number"),
                          F.lit(None).cast("string").alias("plain"), F.lit(None).cast("long").alias("plain_line"), head.alias("cand"))
            .unionByName(hits.filter(F.col("number").between(1, 300)).select(
                "collection", "line_no", F.lit(1).alias("_is_hit"), F.col("number").cast("int").alias("number"), F.col("title").alias("plain"),
                F.col("title_line").cast("long").alias("plain_line"), F.lit(None).cast(kind).alias("cand"))))
    keys, order = ["collection"], ["line_no", "_is_hit"]
    number = F.col("number")
    chunk = chunks_of(rows, "line_no")
    seen = scan(rows, keys, order, chunk, {
        "cand": last_seen(F.col("cand")), "before": last_seen(number, False), "before_line": last_seen(F.when(number.isNotNull(), F.col("line_no")), False),
        "high": running_max(number, False), "low": Carry("min", number, False)}).filter("_is_hit = 1")
    two = seen.withColumn("_two", F.coalesce((number == 1) & (F.col("low") != F.col("high")), F.lit(False)))
    once = scan(two, keys, order, chunk, {"_earlier": running_count(F.col("_two"), False)})
    opened = once.withColumn("_opens", F.col("_two") & ((F.col("before") != 1) | (F.col("_earlier") == 0)))
    placed = scan(opened, keys, order, chunk, {"_run": running_count(F.col("_opens"))})
    free = F.col("before_line").isNull()
    strong = F.when(free | (F.col("cand.line_no") > F.col("before_line")), F.col("cand"))
    plain = F.when(F.col("plain").isNotNull() & (free | (F.col("plain_line") > F.col("before_line"))), F.struct(
        F.col("plain_line").cast(kind["line_no"].dataType).alias("line_no"), F.col("plain").alias("title"), F.col("plain").alias("topic"),
        F.lit(None).cast("int").alias("ordinal"), F.lit(False).alias("strong")))
    at = F.min_by(F.struct("line_no", F.coalesce(strong, plain).cast(kind).alias("head")), "line_no")
    groups = placed.groupBy("collection", (F.col("_run") + 1).cast("int").alias("pos")).agg(
        at.alias("at"), F.sort_array(F.collect_set("number")).alias("s"), F.max(F.coalesce(~F.col("_opens") & (number < F.col("before")), F.lit(False))).alias("falls"))
    e = exams.select("collection", F.col("pos").cast("int").alias("pos"), F.col("title").alias("e_title"), F.col("topic").alias("e_topic"), F.col("ordinal").alias("e_ordinal"),
                     F.array_distinct("question_numbers").cast("array<int>").alias("e"), "generated_title")
    both = materialise(e.join(groups, ["collection", "pos"], "full_outer"))
    s, x, cand = F.col("s"), F.col("e"), F.col("at.head")
    overlap = F.size(F.array_intersect(s, x)) / F.greatest(F.lit(1), F.size(s), F.size(x))
    near = scan(both.withColumn("overlap", overlap), keys, ["pos"], dense_chunk("pos"), {"left": lag(F.col("overlap")), "right": lead(F.col("overlap"))})
    near = materialise(with_topics_compatible(near, F.col("e_topic"), cand["topic"], "fits"))
    near = _with_answers_by_ordinal(near, cand["title"], cand["topic"], cand["ordinal"], F.col("e_ordinal"), "by_ordinal")
    fits = F.col("fits")
    regular = (F.coalesce("left", F.lit(1.0)) >= MIN_OVERLAP) & (F.coalesce("right", F.lit(1.0)) >= MIN_OVERLAP)
    sparse = ((F.col("overlap") >= SPARSE_OVERLAP) & cand["strong"] & (cand["ordinal"] == F.col("e_ordinal")) & fits & (F.size(s) >= MIN_NUMBERS)
              & (F.size(F.array_except(s, x)) == 0) & F.size(F.array_except(x, s)).between(1, SPARSE_MISSING)
              & (F.array_max(s) == F.array_max(x)) & ~F.col("falls") & regular)
    thin = (F.size(s) < 2) | (F.array_min(s) != 1) | ((F.col("overlap") < MIN_OVERLAP) & ~F.coalesce(sparse, F.lit(False)))
    stray = cand.isNotNull() & ~F.col("generated_title") & ~fits & ~F.col("by_ordinal")
    reason = F.when(s.isNull() | x.isNull(), "unit_count").when(thin, "overlap").when(stray, "title")
    judged = near.withColumn("reason", reason)
    rejected = (judged.filter("reason IS NOT NULL").groupBy("collection")
                .agg(F.min_by("reason", F.struct(F.col("reason") != "unit_count", "pos")).alias("reason")))
    none = cand.isNull()
    units = judged.join(rejected, "collection", "left_anti").select(
        "collection", "pos", F.when(none, F.col("e_title")).otherwise(cand["title"]).alias("title"), F.when(none, F.col("e_topic")).otherwise(cand["topic"]).alias("topic"),
        F.when(none, F.col("e_ordinal")).otherwise(cand["ordinal"]).alias("ordinal"), F.coalesce(cand["line_no"], F.col("at.line_no")).alias("start_line"),
        s.alias("question_numbers"), none.alias("generated_title"))
    return units, rejected
