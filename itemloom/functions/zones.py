"""Rules for the plain zones of a text: symbols and numbers into formulas, option labels.

A line is read as zones: formulas, images and links, tags, code, commands and file names are
kept, the rest is plain. A rule first marks its targets in the whole line, where all their neighbours
can be seen; then the line is cut at its zones, and marks in kept zones are taken back.
Everything is column expressions, so a text never leaves the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .choices import ANSWER_BLANK_TEXT, bound
from .passes import by_parts

# Zones, neighbours, counting words and labels that decide what is wrapped.
KEPT = (r"\$\$(?:[^$]|\$(?!\$))*+\$\$|(?<!\$)\$(?!\$)(?:[^$\\]|\\.)*+\$(?!\$)|!?\[[^\]]*+\]\([^)]*+\)|<[^>]++>|`[^`]*+`")
KEPT_WIDE = KEPT + r"|\\[A-Za-z]+|[^\s（）()]*\.(?i:png|jpe?g|gif|svg|bmp|webp)"
RAW_TEX = r"\\[A-Za-z]+|[{}^]|(?<!_)_(?!_)"
LETTER_UNITS = "组班级类型层档步项种区卷册款届站"
NUMBER_UNITS = "分年个名位种条张次步项组题问班级类型层档区卷册款届人天月日时秒边角面倍成"
NUMBER_LEADS = "(?<![第图表式组问]\\s{0,99})(?<!(?:方法|解法|证法|解答|做法)\\s{0,99})"
PREFIX_MOST, PAYLOAD_MOST = 80, 64

_NEAR = r"(?<![_^{}\\]\s{0,99})(?<!\$)"
_ROMAN = r"(?!(?<=[（(]\s{0,99})[iI]\s*[）)])"
LETTER = rf"(?<![0-9A-Za-z\u0002]){_NEAR}{_ROMAN}([A-Za-z])(?![0-9A-Za-z])(?!\s*[_^{{}}\\])(?!\$)(?![ \t　]*[{LETTER_UNITS}])"
LABEL = LETTER.replace("([A-Za-z])", "([A-D])") + r"([.．])"
_DIGITS = r"\d++(?:[.．]\d++(?![0-9A-Za-z]))?+"
_HEADS = rf"(?!(?<=^\s{{0,99}})[-−±+]?{_DIGITS}[.、．)）])(?!(?<=[（(]\s{{0,99}})[-−±+]?{_DIGITS}\s*[）)])"
_BEHIND = rf"(?![0-9A-Za-z])(?![_^{{}}\\$])(?!\s*[%％])(?![ \t　]*[{NUMBER_UNITS}])"
SIGNED = rf"(?<![0-9A-Za-z.．])(?<![0-9)\]}}）]\s{{0,99}}){_NEAR}{NUMBER_LEADS}{_HEADS}([-−±+]{_DIGITS}){_BEHIND}"
NUMBER = rf"(?<![0-9A-Za-z.．\u0002])(?<!\u0002[-−±+]){_NEAR}{NUMBER_LEADS}{_HEADS}({_DIGITS}){_BEHIND}"
STRONG_LABEL = r"(?<![0-9A-Za-z\\])([A-D])[.．](?=\s)"
PICTURE_LINE = r"^\s*!\[[^\]]*\]\([^)]*\)\s*$"
READABLE = r"[0-9A-Za-z㐀-鿿]"


def _wrapped(text: Column, marks: list[tuple[str, str]]) -> Column:
    """Marked targets of every line into formulas, but in lines with commands outside formulas."""
    keep = lambda p: F.translate(p, "\u0002\u0003", "")
    wrap = lambda p: F.replace(F.replace(p, F.lit("\u0002"), F.lit("$\\displaystyle ")), F.lit("\u0003"), F.lit("$"))

    def line(x: Column) -> Column:
        marked = F.translate(x, "\u0001\u0002\u0003", "")
        for pattern, new in marks:
            marked = F.regexp_replace(marked, pattern, new)
        return F.when(F.regexp_replace(x, KEPT, " ").rlike(RAW_TEX), x).otherwise(by_parts(marked, wrap, keep, KEPT_WIDE))

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def wrap_letters(text: Column) -> Column:
    """Single Latin letters in plain text as formulas; a letter A to D takes its dot along.

    Labels of parts such as (i), letters before a counting word and fragments of broken formulas stay.
    """
    return _wrapped(text, [(LABEL, "\u0002$1$2\u0003"), (LETTER, "\u0002$1\u0003")])


def wrap_numbers(text: Column) -> Column:
    """Numbers in plain text as formulas, with their sign unless it joins two terms.

    Item numbers, part numbers such as (1), ordinals, counts, marks, years and per cent stay.
    """
    return _wrapped(text, [(SIGNED, "\u0002$1\u0003"), (NUMBER, "\u0002$1\u0003")])


def strip_option_parens(text: Column) -> Column:
    """Brackets around an option label go, whether outside or inside its formula."""
    t = F.regexp_replace(text, r"[（(](\$\\displaystyle\s*[A-D][.．]?\$)[）)]", "$1")
    return F.regexp_replace(t, r"(\$\\displaystyle\s*)[（(]([A-D])([.．]?)[）)]", "$1$2$3")


def free_embedded_labels(text: Column) -> Column:
    """Labels B to D that were read into the end of the formula before them."""
    for letter in "BCD":
        text = F.regexp_replace(text, rf"(?i)\(\s*\\mathrm\s*\{{\s*{letter}\s*\}}\s*\)\s*\$\s*\$\s*", rf"\$ ({letter}) \$")
        text = F.regexp_replace(text, rf"(?i)\\mathrm\s*\{{\s*{letter}\s*\}}\s*\$\s*[.．]\s*(?=\$)", rf"\$ {letter}. ")
    return text


def add_first_label(text: Column) -> Column:
    """A line under a picture that holds labels B, C and D in order and text before them gets its A.

    Only in a text with an empty answer bracket.
    """

    def line(lines: Column, x: Column, i: Column) -> Column:
        before = F.regexp_extract(x, rf"^(.*?){STRONG_LABEL}", 1)
        prefix = F.regexp_replace(before, r"(?U)^\s+|\s+$", "")
        above = F.element_at(F.filter(F.slice(lines, F.lit(1), i), lambda y: y.rlike(r"(?U)\S")), -1)
        fits = (F.length(prefix) <= PREFIX_MOST) & prefix.rlike(READABLE)
        labels = F.array_join(F.regexp_extract_all(x, F.lit(STRONG_LABEL), F.lit(1)), "")
        hit = F.when(labels == "BCD", F.when(fits, F.when(i > 0, F.when(F.exists(F.slice(lines, F.lit(1), i), lambda y: y.rlike(r"(?U)\S")), above.rlike(PICTURE_LINE)))))
        return F.when(F.coalesce(hit, F.lit(False)), F.concat(F.lit("A. "), F.regexp_replace(x, r"(?U)^\s+", ""))).otherwise(x)

    done = bound(F.split(text, "\n"), lambda lines: F.array_join(F.transform(lines, lambda x, i: line(lines, x, i)), "\n"))
    return F.when(text.rlike("(?U)" + ANSWER_BLANK_TEXT), done).otherwise(text)


def split_compact_labels(text: Column) -> Column:
    """A run such as A.3.5JB.3.1JC.xD.y behind the last empty bracket, one option on a line.

    The labels outside formulas must be A to D once each, their bodies short, readable and without blanks.
    """
    body = r"((?:\$[^$\s]*+\$|(?![A-D][.．])\S)++)"
    shape = rf"(?s)^(\s*)A[.．]{body}B[.．]{body}C[.．]{body}D[.．](\S+)(.*)$"
    last = r"(?Us)^(.*" + ANSWER_BLANK_TEXT.replace("(?:\\\\", "(?:\\\\") + r")"

    def cut(head: Column) -> Column:
        rest = F.substr(text, F.length(head) + 1)
        return bound(F.struct(head.alias("head"), F.regexp_extract(rest, r"^([^\n]*)", 1).alias("line"), F.regexp_extract(rest, r"(?s)^[^\n]*(.*)$", 1).alias("rest")), join)

    def join(s: Column) -> Column:
        outside = F.regexp_replace(s["line"], KEPT, "\u0001")
        labels = F.array_join(F.regexp_extract_all(outside, F.lit(r"([A-D])[.．]"), F.lit(1)), "")
        group = lambda k: F.regexp_extract(s["line"], shape, k)
        good = s["line"].rlike(shape)
        for k in (2, 3, 4, 5):
            good = good & group(k).rlike(READABLE) & ((F.length(group(k)) <= PAYLOAD_MOST) if k < 5 else F.lit(True))
        apart = F.regexp_replace(s["line"], shape, "$1A.$2\nB.$3\nC.$4\nD.$5$6")
        return F.when((labels == "ABCD") & good, F.concat(s["head"], apart, s["rest"])).otherwise(text)

    return bound(F.regexp_extract(text, last, 1), lambda head: F.when(head != "", cut(head)).otherwise(text))
