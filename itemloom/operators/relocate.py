"""Bodies of choice items rewritten so that each option carries its own figure.

The assignment of figures to letters comes from ``layout.assign_options``; here a body follows
it. All moves of a body are one expression over its pieces: the figures leave the question, the
rest keeps its order, and each figure returns at its place. The solution part is never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.choices import ANSWER_BLANK_TEXT, bound

# Figures, labels, where a solution begins, captions of stem figures.
FIGURE = r"!\[[^\]]*\]\(\s*images/[^\s)]+\s*\)"
FIGURE_PATH = r"!\[[^\]]*\]\(\s*images/([^\s)]+)\s*\)"
STRONG = {c: rf"(?<![A-Za-z])[{c}{w}]\s*[.．、)]" for c, w in zip("ABCD", "ＡＢＣＤ")}
WEAK = r"[（(]\s*\$\s*(?:\\displaystyle\s*)?([A-DＡ-Ｄ])\s*\$\s*[)）]"
SOLUTION = r"(?m)^\s*(?:#{1,6}\s*)?(?:【\s*(?:参考)?(?:答案|解析)[^】]*】|(?:参考)?答案\s*[:：]|解析\s*[:：]|解答\s*[:：])"
STEM_CAPTION = "正视图|主视图|俯视图|题干图"
WINDOW = r"(?s)(?=(" + ".*?".join(STRONG.values()) + "))"
INSIDE = r"(?s)^(" + STRONG["A"] + ")(.*?)(" + STRONG["B"] + ")(.*?)(" + STRONG["C"] + ")(.*?)(" + STRONG["D"] + ")$"


def _end(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def _begin(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def _option(letter: str, figures: Column) -> Column:
    return F.concat(F.lit(f"![选项{letter}](images/"), figures[letter], F.lit(")"))


def _listed(head: Column, figures: Column) -> Column:
    """A head and the four options below it, each a label and its figure."""
    return F.concat(head, *[x for c in "ABCD" for x in (F.lit(f"\n\n({c})\n\n"), _option(c, figures))])


def _question(question: Column, figures: Column) -> Column:
    """The rewritten question, or null where nothing proves the move."""
    refs = F.regexp_extract_all(question, F.lit(FIGURE), F.lit(0))
    paths = F.regexp_extract_all(question, F.lit(FIGURE_PATH), F.lit(1))
    windows = F.regexp_extract_all(question, F.lit(WINDOW), F.lit(1))
    weak = F.translate(F.array_join(F.regexp_extract_all(question, F.lit(WEAK), F.lit(1)), ""), "ＡＢＣＤ", "ABCD")
    facts = F.struct(question.alias("q"), figures.alias("f"), refs.alias("refs"), F.size(windows).alias("strong"), weak.alias("weak"), question.rlike("(?U)" + ANSWER_BLANK_TEXT).alias("blank"),
                     F.filter(F.arrays_zip(refs.alias("r"), paths.alias("p")), lambda x: ~F.array_contains(F.array(*[figures[c] for c in "ABCD"]), x["p"])).alias("stem"),
                     F.forall(F.array(*[figures[c] for c in "ABCD"]), lambda p: F.array_contains(paths, p)).alias("present"))
    return bound(facts, _rewritten)


def _rewritten(s: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(s["q"], FIGURE, ""), r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")
    stem = F.array_join(F.transform(s["stem"], lambda x: F.regexp_replace(x["r"], r"^!\[[^\]]*\]", "![题干图]")), "\n\n")

    def inserted(clean: Column) -> Column:
        return bound(F.regexp_extract_all(clean, F.lit(WINDOW), F.lit(1)), lambda found: F.when(F.size(found) > 0, bound(
            F.array_min(F.transform(found, lambda w: F.struct(F.length(w).alias("n"), F.instr(clean, w).alias("at"), w.alias("w")))), lambda w: placed(clean, w))))

    def placed(clean: Column, w: Column) -> Column:
        group = lambda k: F.regexp_extract(w["w"], INSIDE, k)
        parts = [x for k, c in zip((1, 3, 5, 7), "ABCD") for x in (group(k), F.lit("\n\n"), _option(c, s["f"]), *([group(k + 1)] if k < 7 else []))]
        head, tail = F.substr(clean, F.lit(1), w["at"] - 1), F.substr(clean, w["at"] + w["n"])
        front = F.when(F.size(s["stem"]) > 0, F.concat(_end(head), F.lit("\n\n"), stem, F.lit("\n\n"))).otherwise(head)
        return _end(F.concat(front, *parts, tail))

    first = F.least(F.regexp_instr(s["q"], F.lit(FIGURE)), F.regexp_instr(s["q"], F.lit(WEAK)))
    flat = _listed(_end(F.substr(s["q"], F.lit(1), first - 1)), s["f"])
    unlabelled = _listed(F.concat(_end(bare), F.when(F.size(s["stem"]) > 0, F.concat(F.lit("\n\n"), stem)).otherwise("")), s["f"])
    n = F.size(s["refs"])
    lost = s["blank"] & ~(s["q"].rlike(STEM_CAPTION) & (n < 5))
    return (F.when((n < 4) | ~s["present"], F.lit(None)).when(s["strong"] > 0, bound(bare, inserted))
            .when((s["weak"] == "ABCD") & (n == 4), F.when(s["blank"], flat)).when(lost, unlabelled))


def relocate_figures(items: DataFrame, assigned: DataFrame) -> DataFrame:
    """Items (doc, item, text) with every option's figure at its label, and ``moved``.

    ``assigned`` holds doc, item, label, figure; an item needs all four letters, once each.
    Labels of the body keep their figures; four flat figures with weak labels, or figures of a
    body without labels, become a list. Other bodies stay.
    """
    four = (assigned.filter(F.col("label").isin(*"ABCD")).groupBy("doc", "item")
            .agg(F.count("*").alias("_n"), *[F.min(F.when(F.col("label") == c, F.col("figure"))).alias(c) for c in "ABCD"])
            .filter("_n = 4 AND A IS NOT NULL AND B IS NOT NULL AND C IS NOT NULL AND D IS NOT NULL").select("doc", "item", F.struct(*"ABCD").alias("_f")))
    j = items.join(four, ["doc", "item"], "left")
    at = F.regexp_instr("text", F.lit(SOLUTION))
    cut = F.when(at > 0, at).otherwise(F.length("text") + 1)
    new = bound(F.struct(F.substr("text", F.lit(1), cut - 1).alias("q"), F.substr("text", cut).alias("tail"), F.col("_f").alias("f")), lambda s: bound(
        F.struct(_question(s["q"], s["f"]).alias("new"), s["tail"].alias("tail")),
        lambda d: F.when(d["new"].isNotNull(), F.concat(_end(d["new"]), F.when(d["tail"] != "", F.concat(F.lit("\n\n"), _begin(d["tail"]))).otherwise("")))))
    j = j.withColumn("_new", F.explode(F.array(F.when(F.col("_f").isNotNull(), new))))
    return j.withColumn("moved", F.col("_new").isNotNull()).withColumn("text", F.coalesce("_new", "text")).drop("_new", "_f")
