"""File and folder names from free text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .marks import strip

# Characters no name may hold, device names, longest title.
FORBIDDEN = '/\\:*?"<>|'
CONTROL = r'[<>:"/\\|?*\x00-\x1f]'
DEVICE = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\.|$)"
TITLE_CHARS = 180


def safe_folder(name: Column) -> Column:
    """One path segment without separators or parent steps; empty when nothing is left."""
    flat = F.replace(F.translate(strip(F.coalesce(name, F.lit(""))), FORBIDDEN, "_" * len(FORBIDDEN)), F.lit(".."), F.lit("_"))
    return strip(F.regexp_replace(strip(flat), r"^\.+|\.+$", ""))


def safe_title(title: Column) -> Column:
    """File name without extension: one line, no forbidden characters, no device name, at most 180 characters."""
    line = strip(F.regexp_replace(F.coalesce(title, F.lit("")), r"\r\n|\r|\n", " "))
    bare = F.regexp_replace(line, r"(?iU)\s*\.md$", "")
    flat = F.replace(F.regexp_replace(bare, CONTROL, "_"), F.lit(".."), F.lit("_"))
    tidy = F.regexp_replace(F.regexp_replace(flat, r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")
    return F.regexp_replace(F.substr(F.regexp_replace(tidy, DEVICE, "_$0"), F.lit(1), F.lit(TITLE_CHARS)), r"[ .]+$", "")


def default_title(source: Column, number: Column, sequence: Column, temporary: Column) -> Column:
    """Title of an untitled item: source and number, the number alone, or a temporary name; the item's own number goes first."""
    n, own = F.coalesce(number, sequence).cast("string"), number.cast("string")
    base = safe_title(source)
    loose = F.concat(F.lit("临时卡"), F.coalesce(n, F.lit("")))
    named = F.when(n.isNull(), base).otherwise(F.concat(base, F.lit("第"), n, F.lit("题")))
    return F.when(temporary, loose).when(base != "", safe_title(named)).otherwise(F.coalesce(F.concat(F.lit("第"), own, F.lit("题")), F.lit("")))
