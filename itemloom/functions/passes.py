"""Text normalisation passes, math-aware, all as Catalyst expressions.

A text is cut at its inline formulas; rules then apply to formulas or to the rest only.
The order of the passes is fixed, since later ones read what earlier ones wrote.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .choices import bound, inspect_choices

MATH = r"(?<!\$)\$(?!\$)(?:[^$\\]++|\\.)++\$(?!\$)"
MATH_IN_LINE = r"(?<!\$)\$(?!\$)(?:[^$\\\n]++|\\[^\n])++\$(?!\$)"
ANY_MATH = r"(?s)\$\$.*?\$\$|" + MATH
CUT = "\u0001"

# Names, fonts, punctuation and tag spellings.
FUNCTIONS = ("arcsin|arccos|arctan|sinh|cosh|tanh|coth|sin|cos|tan|cot|sec|csc|log|ln|lg|exp|max|min|sup|inf|"
             "lim|det|gcd|deg|dim|ker|hom|arg")
FONTS = r"\\(?:mathbb|mathbf|mathrm|textbf|boldsymbol|mathcal)\s*\{\s*"
SET_BEFORE_C = r"((?:\\in|\\notin|\\subseteq|\\subsetneq|\\subset|\\cup|\\cap|∈)\s*)"
PUNCTUATION = {"，": ", ", "；": "; ", "：": ": ", "？": "? ", "！": "! "}
BLANK = r"(?:\\?_){3,}|＿{2,}"
HALF_SUBQUESTION = r"(?md)^([ \t　]*)\((\s*(?:[0-9]+|[ivxIVX]+)\s*)\)"
GREEK = "α-ωΑ-Ωξζηλμ"
ATOM = f"[0-9A-Za-z{GREEK}]+"
PAYLOAD = rf"({ATOM}(?:\s*[+\-−]\s*{ATOM})*|\\[A-Za-z]+(?:\s*\{{[^{{}}]+\}})?)"
OPEN, CLOSE = r"(?i:<{t}(?:\s[^>]*)?>)\s*\$?\s*", r"\s*\$?\s*([,.;:，。；：]?)\s*(?i:</{t}\s*>)"


def by_parts(text: Column, on_text=None, on_math=None, pattern: str = MATH) -> Column:
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{CUT}$1{CUT}"), CUT)
    same = lambda p: p
    done = F.transform(parts, lambda p, i: F.when(i % 2 == 1, (on_math or same)(p)).otherwise((on_text or same)(p)))
    return F.array_join(done, "")


def _chain(p: Column, rules) -> Column:
    for pattern, new in rules:
        p = F.regexp_replace(p, pattern, new)
    return p


def scripts(text: Column) -> Column:
    """HTML sub- and superscripts as formula scripts where base and script are certain; other tags go."""
    t = text
    for tag, mark in (("sub", "_"), ("sup", "^")):
        o, c = OPEN.format(t=tag), CLOSE.format(t=tag)
        esc = "\\" + mark
        again = r"(?<!\$)(\$(?!\$)(?:[^$\\]|\\.)+?" + esc + r"\s*\{?\s*(" + ATOM + r")\s*\}?\s*\$)(?!\$)[ \t　]*" + o + r"\2" + c
        t = F.regexp_replace(t, again, "$1$3")
        t = F.regexp_replace(t, r"(?<!\$)\$(?!\$)\s*((?:[^$\\]|\\.)+?)\s*\$(?!\$)[ \t　]*" + o + PAYLOAD + c, r"\$$1" + mark + r"{$2}\$$3")
        if tag == "sub":
            t = F.regexp_replace(t, r"√[ \t　]*" + o + PAYLOAD + c, r"\$\\\\sqrt{$1}\$$2".replace(r"\\\\", r"\\"))
            base = rf"(?<![0-9A-Za-z])([A-Z]{{1,4}}|[a-z]|[{GREEK}]|∁)"
        else:
            base = rf"(?<![0-9A-Za-z])([0-9A-Z]|[a-z]|[{GREEK}])"
        t = F.regexp_replace(t, base + o + PAYLOAD + c, r"\$$1" + mark + r"{$2}\$$3")
        t = F.regexp_replace(t, rf"(?i)</?{tag}(?:\s[^>]*)?>", "")
    return t


def math_rules(p: Column) -> Column:
    p = _chain(p, [(r"\\frac(?![a-zA-Z])", r"\\dfrac"), (rf"(?<![\\A-Za-z])({FUNCTIONS})(?![a-zA-Z])", r"\\$1"),
                   (FONTS + r"([NZQR])\s*\}", r"\\mathbb{$1}"), (SET_BEFORE_C + FONTS + r"C\s*\}", r"$1\\mathbb{C}")])
    inner = F.substr(p, F.lit(2), F.length(p) - 2)
    bare = F.trim(inner)
    return F.when((bare == "") | F.contains(inner, F.lit("\\displaystyle")), p).otherwise(
        F.concat(F.lit("$\\displaystyle "), bare, F.lit("$")))


def _text_punctuation(p: Column) -> Column:
    for a, b in PUNCTUATION.items():
        p = F.replace(p, F.lit(a), F.lit(b))
    return F.regexp_replace(p, r"([,;:?!]) +", "$1 ")


def _line_ends(t: Column) -> Column:
    return F.regexp_replace(t, r"(?md)[ \t]+$", "")


def drop_images(text: Column) -> Column:
    image = r"!\[[^\]]*\]\([^)]*\)"
    return F.regexp_replace(F.regexp_replace(text, rf"(?md)^[ \t]*{image}(?:[ \t]*{image})*[ \t]*(?:\n|\z)", ""), image, "")


def normalize_block(text: Column, keep_images: bool = True) -> Column:
    """The whole mechanical pass over one block."""
    t = text if keep_images else drop_images(text)
    t = by_parts(scripts(t), on_math=math_rules)
    t = by_parts(t, on_text=lambda p: F.replace(p, F.lit("。"), F.lit(". ")), pattern=MATH_IN_LINE)
    t = _line_ends(F.regexp_replace(_line_ends(t), r"(?md)(?<![0-9])\.$", ""))
    t = _line_ends(by_parts(t, on_text=_text_punctuation, pattern=MATH_IN_LINE))
    t = by_parts(t, on_text=lambda p: F.regexp_replace(p, BLANK, "___"))
    t = F.regexp_replace(t, HALF_SUBQUESTION, "$1（$2）")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def canonical_options(text: Column) -> Column:
    """A complete option set on lines of its own under canonical labels; other texts stay."""
    return bound(inspect_choices(text), lambda c: _relabelled(text, c))


def _relabelled(text: Column, c: Column) -> Column:
    lines = F.transform(c["options"], lambda o, i: F.concat(F.lit("$\\displaystyle "), F.char(i + 65), F.lit(".$ "), F.regexp_replace(o, r"(?U)^[)）]\s*", "")))
    head = F.regexp_replace(c["stem"], r"(?U)\s+$", "")
    built = F.concat(F.when(head != "", F.concat(head, F.lit("\n\n"))).otherwise(""), F.array_join(lines, "\n"))
    return F.when(c["options"].isNotNull(), built).otherwise(text)


def ensure_fill_blank(text: Column, type: Column) -> Column:
    """A fill-in item ends in a blank, before any images that close it."""
    t = F.regexp_replace(by_parts(text, on_text=lambda p: F.regexp_replace(p, BLANK, "___")), r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"=\s*\\_\s*\$", "=\\$ ___")
    has = F.contains(t, F.lit("___")) | t.rlike(r"\\(?:underline|underbar|hspace|rule)\s*\{|\\blank\b")
    split = r"(?s)\A(.*?)((?:\s*!\[\[[^\n]*)*)\z"
    blanked = F.concat(F.regexp_extract(t, split, 1), F.lit(" ___"), F.regexp_extract(t, split, 2))
    return F.when((type == "填空题") & ~has & (t != ""), blanked).otherwise(t)


UNICODE_TEXT = {"⩽": r" $\leqslant$ ", "⩾": r" $\geqslant$ ", "⋅": r" $\cdot$ ", "∩": r" $\cap$ ", "∪": r" $\cup$ ", "⊥": r" $\perp$ ",
                "∵": r" $\because$ ", "∴": r" $\therefore$ ", "λ": r" $\lambda$ ", "①": r" $\textcircled{1}$ ", "②": r" $\textcircled{2}$ ",
                "③": r" $\textcircled{3}$ ", "④": r" $\textcircled{4}$ ", "⑤": r" $\textcircled{5}$ ", "⑥": r" $\textcircled{6}$ "}  # fixed values


def publish_clean(text: Column) -> Column:
    """Publishing pass: control characters, symbols outside formulas, broken display shells,
    missing last arguments and stray backslashes."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\uf8f3]", "")
    t = F.regexp_replace(t, r"(?s)\$\$((?:(?!\$\$).)*?\$(?!\$)(?:(?!\$\$).)*?)\$\$(?!\$)", "$1")
    t = F.replace(t, F.lit(r"\scriptsize"), F.lit(""))
    t = F.regexp_replace(t, r"(\\[dt]?frac\s*\{(?:[^{}]|\{[^{}]*\})*\})(?=\s*\$)", "$1{}")
    t = F.regexp_replace(t, r"\\right(?=\s*\$)", r"\\right.")
    t = by_parts(t, on_text=lambda p: F.replace(p, F.lit("\\"), F.lit("\\\\")), pattern=ANY_MATH)

    def symbols(p):
        for a, b in UNICODE_TEXT.items():
            p = F.replace(p, F.lit(a), F.lit(b))
        return p
    return by_parts(t, on_text=symbols, pattern=ANY_MATH)


def swap_images(body: Column, i: int, j: int) -> Column:
    """Body with its i-th and j-th image references exchanged."""
    pattern = r"!\[\[[^\]]+\]\]|!\[[^\]]*\]\([^)]*\)"
    parts = F.split(F.regexp_replace(body, f"({pattern})", f"{CUT}$1{CUT}"), CUT)
    a, b = 2 * i + 1, 2 * j + 1
    out = F.transform(parts, lambda p, k: F.when(k == a, F.get(parts, b)).when(k == b, F.get(parts, a)).otherwise(p))
    return F.when(F.size(parts) > max(a, b), F.array_join(out, "")).otherwise(body)


def swap_layouts(layouts: Column, i: int, j: int) -> Column:
    """Layout entries with the two image numbers exchanged, in number order."""
    moved = F.transform(layouts, lambda x: x.withField("i", F.when(x["i"] == i, j).when(x["i"] == j, i).otherwise(x["i"])))
    return F.array_sort(moved, lambda x, y: x["i"] - y["i"])


@F.pandas_udf(T.StringType())
def repair_mojibake(texts: pd.Series) -> pd.Series:
    """Undo UTF-8 read as a one-byte code page, where the round trip is exact."""
    def fix(s):
        for page in ("cp1252", "latin-1"):
            try:
                back = s.encode(page).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if back != s:
                return back
        return s
    return texts.map(lambda s: fix(s) if s else s)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


DECORATION = (r"(?:基础理解与分析|核心理解与分析|超重失重及|含自由落体|最后强化|继续强化|基础|大全|各种|问题|强化|核心|理解|综合|应用|分析|信息|概念)")  # fixed value


def topic_key(title: Column) -> Column:
    t = F.lower(nfkc(F.coalesce(title, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(t, r"[★☆*]+(?:重要)?[★☆*]+", ""), r"[^0-9a-z㐀-鿿]+", "")


def topic_core(key: Column) -> Column:
    core = F.regexp_replace(key, DECORATION, "")
    return F.when(core == "", key).otherwise(core)


def split_glued_heads(text: Column, numbers: Column) -> Column:
    """A line break before each expected solution number that occurs once and is glued to the line before."""
    answer = r"(?:(?:[A-DＡ-Ｄ](?:[ \t,，、/]*[A-DＡ-Ｄ]){0,3})[ \t]*)?【(?:答案|详解|解析)】"
    part = r"[（(][ \t]*1[ \t]*[)）]"

    def step(acc, n):
        after = F.when(F.array_contains(numbers, n - 1), answer + "|" + part).otherwise(answer)
        head = F.concat(F.lit(r"(?<![\d.．])("), n.cast("string"), F.lit(r"[ \t]*[.．、][ \t]*(?:"), after, F.lit("))"))
        once = F.regexp_count(acc, head) == 1
        glued = F.regexp_count(acc, F.concat(F.lit(r"(?m)^[^\n]*\S[^\n]*?"), head)) == 1
        return F.when(once & glued, F.regexp_replace(acc, F.concat(F.lit(r"\s*"), head), F.lit("\n\n$1"))).otherwise(acc)

    return F.aggregate(numbers, text, step)


# Commands and the width they add.
COMMAND_WIDTH = {"vec": 0, "overrightarrow": 0, "overline": 0, "hat": 0, "bar": 0, "dot": 0, "tilde": 0, "widehat": 0, "widetilde": 0,
                 "boldsymbol": 0, "mathrm": 0, "mathbf": 0, "left": 0, "right": 0, "displaystyle": 0, "sqrt": 1, "cdot": 1, "times": 1, "div": 1, "pm": 1, "mp": 1}
SHORT_OPTION, MIDDLE_OPTION = 10, 28


def visible_width(option: Column) -> Column:
    """Estimated print width: a fraction counts its wider part, commands their fixed width, wide characters two."""
    t = F.regexp_replace(option, r"^\s*\$\\displaystyle\s*[A-D][.．]\s*\$", "")
    t = F.replace(F.regexp_replace(t, r"^\s*(?<![A-Za-z\\])[A-D][.．]", ""), F.lit("$"), F.lit(""))
    fraction = r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}"

    def plain(s):
        names = F.regexp_extract_all(s, F.lit(r"\\([a-zA-Z]+)"), F.lit(1))
        width = F.aggregate(names, F.lit(0), lambda acc, n: acc + F.coalesce(F.element_at(costs, n), F.lit(1)))
        rest = F.regexp_replace(F.regexp_replace(s, r"\\[a-zA-Z]+", ""), r"[{}\s]", "")
        return width + F.length(rest) + F.regexp_count(rest, F.lit(r"[^\x{0}-\x{2E7F}]"))

    costs = F.create_map(*[x for k, v in COMMAND_WIDTH.items() for x in (F.lit(k), F.lit(v))])
    nums = F.regexp_extract_all(t, F.lit(fraction), F.lit(1))
    dens = F.regexp_extract_all(t, F.lit(fraction), F.lit(2))
    stacked = F.aggregate(F.zip_with(nums, dens, lambda a, b: F.greatest(plain(a), plain(b), F.lit(1))), F.lit(0), lambda acc, w: acc + w)
    return plain(F.regexp_replace(t, fraction, "")) + stacked


def option_columns(options: Column) -> Column:
    """Columns the options of an item are set in: 4, 2 or 1, by the widest."""
    widest = F.coalesce(F.array_max(F.transform(options, visible_width)), F.lit(0))
    return F.when(widest <= SHORT_OPTION, 4).when(widest <= MIDDLE_OPTION, 2).otherwise(1)
