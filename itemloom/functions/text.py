"""Text columns built from Catalyst expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean the same formula command, applied in this order.
SAME_COMMANDS = [
    (r"\dfrac", r"\frac"),
    (r"\tfrac", r"\frac"),
    (r"\left", ""),
    (r"\right", ""),
    (r"\displaystyle", ""),
    (r"\,", ""), (r"\;", ""), (r"\:", ""), (r"\!", ""),
]
# Punctuation and blanks that carry no content.
SILENT = "，。、；：？！“”‘’（）()[]{}【】《》…—－-·,.;:?!\"'`~@#%^&*_+=|\\/<> \t\r\n　"

REVIEW_MARKER = "【必须人工校对】"  # fixed value
IMAGE_UNITS = 40  # fixed value: content units one image counts for
# Image reference and embed patterns.
MD_IMAGE = r"!\[[^\]]*\]\([^)]*\)"
EMBED_IMAGE = r"!\[\[[^\]]+\]\]"
ANY_IMAGE = MD_IMAGE + "|" + EMBED_IMAGE
SHOWN_IMAGE = r"!?\[\[[^\]]+\]\]|" + MD_IMAGE
# Noise command groups and their limits.
NOISE_MATH = r"\\(?:partial|xi|zeta|delta|Omega|dot|scriptsize)\b"
NOISE_LAYOUT = r"\\scriptsize\b"
NOISE_NESTED = r"\\scriptscriptstyle\b"
NOISE_MATH_MIN, NOISE_LAYOUT_MIN, NOISE_MIXED_MATH_MIN = 5, 2, 3
SPACE_CLASS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lf(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def fingerprint_text(body: Column) -> Column:
    """Body reduced to the characters that decide whether two items are the same."""
    s = F.coalesce(body, F.lit(""))
    for a, b in SAME_COMMANDS:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, r"\\[a-zA-Z]+", " ")
    s = F.translate(s, "$\\" + SILENT, "")
    return F.lower(s)


def fingerprint(body: Column) -> Column:
    return F.md5(fingerprint_text(body))


def natural_key(text: Column) -> Column:
    """Sort key that compares digit runs as whole numbers, before any letters.

    Digits compare by length without leading zeros, then by value, so runs of any
    length stay exact.
    """
    parts = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def part(t):
        digits = F.ltrim(t, F.lit("0"))
        is_num = t.rlike("^[0-9]")
        return F.struct(
            F.when(is_num, 0).otherwise(1).alias("kind"),
            F.when(is_num, F.length(digits)).otherwise(0).alias("width"),
            F.when(is_num, digits).otherwise(t).alias("text"),
        )

    return F.transform(parts, part)


def natural_path_key(path: Column) -> Column:
    """Natural key per path segment."""
    return F.transform(F.split(F.coalesce(path, F.lit("")), "/"), natural_key)


def visible_length(text: Column) -> Column:
    """Characters a reader sees: tags dropped, an image counts one, blanks dropped."""
    s = F.regexp_replace(text, r"<[^>]+>", "")
    s = F.regexp_replace(s, SHOWN_IMAGE, "图")
    return F.length(F.regexp_replace(s, SPACE_CLASS + "+", ""))


def content_units(text: Column) -> Column:
    """Visible characters plus a fixed number of units per image."""
    t = F.coalesce(text, F.lit(""))
    return visible_length(F.regexp_replace(t, ANY_IMAGE, "")) + F.regexp_count(t, F.lit(ANY_IMAGE)) * IMAGE_UNITS


def ancestors(path: Column) -> Column:
    """All prefixes of a ``/`` path, shortest first; empty path has none."""
    parts = F.split(path, "/")
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(made)


def parent_path(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*[/\\]", "")


def dense_noise(text: Column) -> Column:
    """True when rare formula commands pile up as they do in misread scans."""
    math = F.regexp_count(text, F.lit(NOISE_MATH))
    layout = F.regexp_count(text, F.lit(NOISE_LAYOUT))
    return ((math >= NOISE_MATH_MIN) | (layout >= NOISE_LAYOUT_MIN)
            | ((layout >= 1) & (math >= NOISE_MIXED_MATH_MIN)) | text.rlike(NOISE_NESTED))
