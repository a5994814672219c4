"""Line and block marks of exam papers as Catalyst expressions.

The patterns are fixed values: they decide which lines count as numbers, headings and
solution marks. ``(?U)`` makes digits and blanks Unicode-aware.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = r"(?U)^\s*#{1,6}\s*"
STARS = r"(?U)^[★☆]+\s*"
CN_DIGITS = "零一二三四五六七八九"
CN_VARIANTS = ("两〇壹贰叁肆伍陆柒捌玖拾佰", "二零一二三四五六七八九十百")  # fixed values
CN_CLASS = "[一二三四五六七八九十百零]+"
SECTION_LINE = r"(?U)^(?:第\s*)?([一二三四五六七八九十]+)\s*[、．.]\s*(.*)$"
SECTION_WORDS = r"(选择题|多选|单选|填空题|实验题|解答题|计算题|证明题|应用题|本题共|本大题|部分)"
PRACTICE_LINE = (r"(?U)^(?:核心题型(?:\s|$|[①②③④⑤⑥⑦⑧⑨⑩])|刷(?:基础|提分|易错|素养|提升|能力|高分|综合)(?:\s|$|[▶▷])|易错点\s*[▶▷])")
GROUP_LINE = r"(?U)^([A-DＡ-Ｄa-d]|[一二三四五六七八九十]+)\s*组\s*$"
ANSWER_LINE = (r"(?U)^(?:(?:[《〈].{1,100}[》〉]|数学(?:试卷|试题)?|试题|[^。！？!?：:]{1,100}数学)\s*)?"
               r"(?:参考答案(?:(?:与|及)(?:试题)?解析|(?:与|及)评分标准)?|答案(?:(?:与|及)解析|(?:与|及)(?:评分标准|评分细则))?"
               r"|参考解答|答案解析|解析)\s*[:：]?\s*$")
TOC_LINE = r"(?U)[.．·。](?:\s*[.．·。]){11,}\s*$"
MARK_LINE = r"(?U)^§\s*[\d.]+\s*$"
PREAMBLE_WORDS = r"(答题卡|准考证号|考试结束|铅笔|涂黑|橡皮(?!泥|筋)|交回|本试卷共|考试时间|草稿纸|非选择题)"
SOLUTION_HEAD = r"(?U)^(?:\d{1,3}\s*[.．、]\s*)?(【答案】|【解析】|答案[:：]|解析[:：])"
SOLUTION_MARK = r"【答案】|【解析】|【详解】"
CHAIN_TAIL = r"(?U)^\d{1,3}\s*[.．、]"
FIGURE_CAPTION = r"(?U)^(?:示意)?图(?:\s*[（(][A-Za-z0-9一二三四五六七八九十]+[)）])?$"
FENCE = r"^\s*(?:```|~~~)"
CHOICE_SECTION = r"单选|多选|选择题|不定项"
BOILERPLATE_MAX = 120
PREAMBLE_LINES = 40
IMAGE_ONLY_LINE = r"(?U)^\s*(?:!\[[^\]]*\]\([^)]*\)\s*)*$"


@dataclass(frozen=True)
class Style:
    """One way to write item numbers; ``guard`` rejects chains such as 1.1.5."""

    name: str
    strict: str
    loose: str
    guard: bool = True
    weight: float = 1.0
    chinese: bool = False
    prefixed: str | None = None


# The three numbering styles, in tie order.
DOT = Style("arabic-dot", r"(?U)^(?:[A-DＡ-Ｄ]{1,4}\s+)?(\d{1,3})\s*[.．、]\s*(.*)$",
            r"(?U)^(?:[A-DＡ-Ｄ]{1,4}\s+)?[(（]?\s*第?\s*(\d{1,3})\s*[.．、)）]\s*[题]?\s*(.*)$")
TI = Style("cn-di-ti", r"(?U)^(?:§\s*[\d.]+\s*)?第\s*(\d{1,3})\s*[题題]\s*[.．、:：]?\s*(.*)$",
           r"(?U)^(?:§\s*[\d.]+\s*)?第\s*(\d{1,3})\s*[题題]\s*[.．、:：]?\s*(.*)$", False, 3.0, False,
           r"(?U)^[^。．.！!？?；;：:，,、（）()【】]{0,20}?第\s*(\d{1,3})\s*[题題]\s*[.．、:：]?\s*()$")
TI_CN = Style("cn-di-ti-cn", r"(?U)^(?:§\s*[\d.]+\s*)?第\s*(" + CN_CLASS + r")\s*[题題]\s*[.．、:：]?\s*(.*)$",
              r"(?U)^(?:§\s*[\d.]+\s*)?第\s*(" + CN_CLASS + r")\s*[题題]\s*[.．、:：]?\s*(.*)$", False, 3.0, True)
STYLES = (DOT, TI, TI_CN)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def line_body(line: Column) -> Column:
    """Line without heading marks and difficulty stars."""
    return F.regexp_replace(strip(F.regexp_replace(line, HEAD, "")), STARS, "")


def arabic(digits: Column) -> Column:
    """Integer of a digit text, full-width digits included."""
    return F.translate(digits, "０１２３４５６７８９", "0123456789").try_cast("int")


def chinese_number(text: Column) -> Column:
    """Integer of a Chinese numeral from 1 to 999 (units, or digits in a row), or of a plain digit string."""
    digit = F.translate(F.translate(text, CN_VARIANTS[0], CN_VARIANTS[1]), CN_DIGITS, "0123456789")
    hundreds = F.when(F.contains(digit, F.lit("百")), F.coalesce(F.regexp_extract(digit, "([1-9])百", 1).try_cast("int"), F.lit(1))).otherwise(0)
    tens = F.when(F.contains(digit, F.lit("十")), F.coalesce(F.regexp_extract(digit, "([1-9])十", 1).try_cast("int"), F.lit(1))).otherwise(0)
    ones = F.coalesce(F.regexp_extract(digit, "([0-9])$", 1).try_cast("int"), F.lit(0))
    units = digit.rlike("^[0-9]?百?0?[0-9]?十?[0-9]?$") & digit.rlike("[百十]")
    return F.when(units, hundreds * 100 + tens * 10 + ones).when(digit.rlike("^[0-9]+$"), digit.try_cast("int"))


def number_of(body: Column, style: Style = DOT, loose: bool = False) -> Column:
    """(n, rest) of a numbered line, nulls otherwise."""
    pattern = style.loose if loose else style.strict
    to_int = chinese_number if style.chinese else arabic

    def read(p):
        return F.struct(to_int(F.regexp_extract(body, p, 1)).alias("n"), strip(F.regexp_extract(body, p, 2)).alias("rest"))

    got = F.when(body.rlike(pattern), read(pattern))
    if style.prefixed:
        got = got.when(body.rlike(style.prefixed), read(style.prefixed))
    bad = got["n"].isNull() | (got["n"] == 0)
    if style.guard:
        bad = bad | got["rest"].rlike(CHAIN_TAIL)
    else:
        bad = bad | got["rest"].rlike(FIGURE_CAPTION)
    return F.when(~bad, got)


def first_line(text: Column) -> Column:
    return F.get(F.split(strip(text), "\n"), 0)


def block_kind(text: Column) -> Column:
    """``solution`` when the block opens with a solution mark."""
    return F.when(line_body(first_line(text)).rlike(SOLUTION_HEAD), "solution").otherwise("unknown")


def is_boilerplate(text: Column) -> Column:
    body = strip(text)
    return (F.length(body) < BOILERPLATE_MAX) & body.rlike(PREAMBLE_WORDS)


def is_toc(line: Column) -> Column:
    return line.rlike(TOC_LINE)


def first_style_number(body: Column, patterns: list[str]) -> Column:
    """Number caught by the first of several boundary patterns (group 1) that matches."""
    return F.coalesce(*[F.when(body.rlike(p), arabic(F.regexp_extract(body, p, 1))) for p in patterns])


# Whitelist boundaries: any of these opens a block.
WHITELIST = (r"(?U)^(?:[A-DＡ-Ｄ]{1,4}\s+)?\s*(\d{1,3})\s*[.．]\s*(.*)$",
             r"(?U)^(?:[A-DＡ-Ｄ]{1,4}\s+)?\s*第\s*(\d{1,3})\s*题\s*(.*)$",
             r"(?U)^(?:[A-DＡ-Ｄ]{1,4}\s+)?\s*第\s*(" + CN_CLASS + r")\s*题\s*(.*)$")

# Number of a finished block, and what may be cut off its front.
BLOCK_NUMBER = r"(?U)^(?:\D{0,4}?|[^$]{0,6}?\$\\displaystyle\s*)(\d{1,3})\s*\$?\s*[.．、,，)）题]"
BLOCK_NUMBER_CN = r"(?U)^[^一-鿿]{0,4}?第?\s*(" + CN_CLASS + r")\s*[题、．.，,)）]"
TYPE_TAG = r"(?U)^\s*[\[【]\s*(单选|多选|填空|解答)\s*[\]】]\s*"
LEAD_NUMBER = r"(?U)^(?:#{1,6}\s*)?(?:\*\*|__|\*)?\s*(?:\$\\displaystyle\s*)?第?\s*(\d{1,3})\s*\$?\s*(?:[.．、]|题)"
LEAD_NUMBER_CN = r"(?U)^(?:#{1,6}\s*)?(?:\*\*|__|\*)?\s*(?:第\s*" + CN_CLASS + r"\s*[题、．.]|" + CN_CLASS + r"\s*、)"
LEAD_EMPHASIS = r"(?U)^(?:#{1,6}\s*)?(\*\*|__|\*)"
SCORE_LEAD = r"(?U)^[（(]\s*(?:共|每题|每小题|本题|本小题|满分){0,2}\s*\d{1,3}(?:\.\d+)?\s*分\s*[)）]\s*"
TAG_TYPES = {"单选": "单选题", "多选": "多选题", "填空": "填空题", "解答": "解答题"}


def block_number(block: Column) -> Column:
    """Number written at the start of a block, Arabic or Chinese."""
    head = F.regexp_replace(F.regexp_replace(block, r"(?U)^\s+", ""), r"^- ", "")
    line = strip(F.regexp_replace(strip(F.get(F.split(head, "\n"), 0)), TYPE_TAG, ""))
    return (F.when(line.rlike(BLOCK_NUMBER), arabic(F.regexp_extract(line, BLOCK_NUMBER, 1)))
            .when(line.rlike(BLOCK_NUMBER_CN), chinese_number(F.regexp_extract(line, BLOCK_NUMBER_CN, 1))))


def _close_emphasis(text: Column, opener: Column) -> Column:
    """Drop the closing emphasis that belongs to a number whose opening was cut."""
    star = (opener == "*") & text.startswith("**")
    hit = (opener != "") & text.startswith(opener) & ~star
    return F.when(hit, F.ltrim(F.substr(text, F.length(opener) + 1))).otherwise(text)


def strip_leading_number(stem: Column) -> Column:
    """Stem without its number and the score note right after it."""
    text = F.regexp_replace(stem, r"(?U)^\s+", "")
    rest = F.regexp_replace(text, LEAD_NUMBER, "")
    digits = F.regexp_extract(text, LEAD_NUMBER, 1)
    ok = text.rlike(LEAD_NUMBER) & (arabic(digits) != 0) & ~rest.rlike(r"(?U)^\d")
    cn = ~text.rlike(LEAD_NUMBER) & text.rlike(LEAD_NUMBER_CN)
    opener = F.when(text.rlike(LEAD_NUMBER) | cn, F.regexp_extract(text, LEAD_EMPHASIS, 1)).otherwise("")

    def left(c):
        return F.regexp_replace(c, r"(?U)^\s+", "")

    body = (F.when(ok, _close_emphasis(left(rest), opener))
            .when(cn, _close_emphasis(left(F.regexp_replace(text, LEAD_NUMBER_CN, "")), opener)).otherwise(text))
    scored = F.regexp_replace(left(body), SCORE_LEAD, "")
    return left(_close_emphasis(scored, opener))


# Where a solution starts inside a block.
SOLUTION_LINE = (r"(?U)^[\s>]*(?:#{1,6}\s*)?(?:\*\*|__|\*)?\s*(?:\d{1,3}\s*[.．、)）]\s*)?(?:\*\*|__)?\s*"
                 r"(?:【\s*(?:参考)?(?:答案|解析|解答|证明)\s*】|(?:参考)?答案\s*[:：]|解析\s*[:：]|解答\s*[:：]|解\s*[:：]|答\s*[:：]|证明\s*[:：])")
SOLUTION_INLINE = r"(?U)(?:【\s*(?:参考)?(?:答案|解析)\s*】|(?:参考)?答案\s*[:：]|解析\s*[:：])"


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def split_solution(block: Column, scan_marks: bool = True) -> Column:
    """(stem, solution): cut at the first solution mark, solution null without one.

    A mark at line start always cuts; inside a line it cuts only after some text, and a
    bare ``答案：`` right after ``的`` is an ordinary word.
    """
    lines = F.split(block, "\n")
    if not scan_marks:
        at = F.filter(F.transform(lines, lambda x, i: F.when(strip(x).startswith("【解析】"), i)), lambda v: v.isNotNull())
        k = F.get(at, 0)
        stem = strip(F.array_join(F.slice(lines, 1, k), "\n"))
        tail = strip(F.array_join(F.slice(lines, k + 1, F.size(lines)), "\n"))
        return F.when(F.size(at) > 0, F.struct(stem.alias("stem"), tail.alias("solution"))).otherwise(
            F.struct(strip(block).alias("stem"), F.lit(None).cast("string").alias("solution")))

    def place(x):
        def inside(inline):
            before = F.substr(x, F.lit(1), inline - 1)
            mark = F.regexp_substr(x, F.lit(SOLUTION_INLINE))
            word = mark.rlike(r"(?U)^(?:参考)?答案\s*[:：]$") & F.regexp_replace(before, r"(?U)\s+$", "").endswith("的")
            return F.when((inline > 0) & (strip(before) != "") & ~word, inline).otherwise(0)
        return F.when(x.rlike(SOLUTION_LINE), 1).otherwise(_once(F.regexp_instr(x, F.lit(SOLUTION_INLINE)), inside))

    def parted(ls, hit):
        line = F.get(ls, hit["i"])
        stem = F.array_join(F.concat(F.slice(ls, 1, hit["i"]), F.array(F.substr(line, F.lit(1), hit["at"] - 1))), "\n")
        tail = F.array_join(F.concat(F.array(F.substr(line, hit["at"])), F.slice(ls, hit["i"] + 2, F.size(ls))), "\n")
        cut = F.struct(strip(stem).alias("stem"), F.nullif(strip(tail), F.lit("")).alias("solution"))
        return F.when(hit.isNotNull(), cut).otherwise(
            F.struct(strip(block).alias("stem"), F.lit(None).cast("string").alias("solution")))

    def first(ls):
        return F.get(F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), place(x).alias("at"))), lambda s: s["at"] > 0), 0)

    return _once(lines, lambda ls: _once(first(ls), lambda hit: parted(ls, hit)))


def strip_repeated_stem(stem: Column, solution: Column) -> Column:
    """Solution without a stem copied to its front: at least 8 equal characters and half the stem."""
    limit = F.least(F.length(stem), F.length(solution))
    pairs = F.arrays_zip(F.split(F.substr(stem, F.lit(1), limit), "").alias("x"), F.split(F.substr(solution, F.lit(1), limit), "").alias("y"))
    differ = F.filter(F.transform(pairs, lambda p, i: F.when(p["x"] != p["y"], i)), lambda v: v.isNotNull())
    common = F.coalesce(F.get(differ, 0), limit)
    rest = F.regexp_replace(F.substr(solution, common + 1), r"^[ \t　,，.。:：;；]+", "")
    return F.when((common >= 8) & (common * 2 >= F.length(stem)) & (rest != ""), rest).otherwise(solution)


# Declared item count of a section heading.
COUNT_MARK, COUNT_MARK_CN = r"(?U)共\s*(\d{1,2})\s*小题", r"(?U)共\s*([一二三四五六七八九十]{1,3})\s*小题"


def declared_count(section: Column) -> Column:
    s = F.coalesce(section, F.lit(""))
    cn = F.regexp_extract(s, COUNT_MARK_CN, 1)
    small = cn.rlike("^(?:[一二三四五六七八九十]|十[一二])$")  # up to twelve
    return F.when(s.rlike(COUNT_MARK), arabic(F.regexp_extract(s, COUNT_MARK, 1))).when(small, chinese_number(cn))
