"""From segmented papers to items: prepare, assemble, preview, gate, validate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import marks as M
from ..functions.choices import item_type, section_type, with_choices
from ..functions.passes import canonical_options, ensure_fill_blank, normalize_block
from ..functions.text import REVIEW_MARKER, content_units, fingerprint
from ..operators import dedup, pairing, predicates, quality
from ..operators.layout import HEAD_NUMBER, signature
from ..operators.sequence import missing_in_range
from ..session import materialise
from .segment import segment

MIN_VISIBLE, MIN_WITH_IMAGE, ANCHOR_PREFIX, ANCHOR_RATIO = 20, 8, 12, 0.72  # fixed values


def prepare(lines: DataFrame, only_numbers: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, report): cut, normalise, repair sections, report, then keep wanted numbers."""
    blocks, _ = segment(lines)
    clean = materialise(blocks.withColumn("text", normalize_block(F.col("text"))))
    fixed = materialise(quality.repair_sections(clean))
    found = quality.report(fixed, lines)
    if only_numbers:
        fixed = fixed.filter(predicates.only_numbers(F.col("number"), only_numbers))
    return fixed, found


def assemble(blocks: DataFrame, whitelist: bool = False) -> DataFrame:
    """Items of blocks: paired, ordered, typed, numbers and repeated stems stripped.

    Solutions of one stem come in their order, joined by blank lines.
    """
    pairs = materialise(pairing.pair_blocks(blocks, whitelist=whitelist))
    bare = lambda c: M.strip(M.strip_leading_number(c))
    rows = pairs.withColumn("_s", M.strip_repeated_stem(bare(F.col("text")), bare(F.col("solution"))))
    keep = [c for c in ("number", "section", "group", "text", "place") if c in rows.columns]
    joined = rows.groupBy("doc", "idx").agg(
        *[F.first(c).alias(c) for c in keep],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_s") != "", F.struct("solution_idx", "_s")))), lambda x: x["_s"]), "\n\n").alias("solution"))
    typed = materialise(with_choices(joined, name="_c"))
    short = section_type(F.col("text"), F.col("section"), F.col("number"), F.col("_c"))
    typed = typed.withColumn("type", F.concat(short, F.lit("题"))).withColumn("body", bare(F.col("text")))
    typed = materialise(typed.drop("_c", "text"))
    choice = F.col("type").isin("单选题", "多选题")
    body = F.when(choice, canonical_options(F.col("body"))).when(F.col("type") == "填空题", ensure_fill_blank(F.col("body"), F.col("type"))).otherwise(F.col("body"))
    return typed.withColumn("body", body)


def preview(items: DataFrame, bank: DataFrame) -> DataFrame:
    """Import rows: body and solution split, type, fingerprint, duplicate status."""
    s = M.split_solution(F.col("body"))
    rows = items.withColumn("_s", s)
    rows = (rows.withColumn("solution", F.when(F.coalesce("solution", F.lit("")) == "", F.coalesce("_s.solution", F.lit(""))).otherwise(F.col("solution")))
            .withColumn("body", F.col("_s.stem")).drop("_s"))
    if "type" not in rows.columns:
        rows = with_choices(rows, "body", "_c").withColumn("type", item_type(F.col("body"), F.col("_c"))).drop("_c")
    rows = materialise(rows.withColumn("fingerprint", fingerprint(F.col("body"))).withColumn("row", F.concat_ws("-", "doc", F.lpad(F.col("idx").cast("string"), 9, "0"))))
    return dedup.batch_status(rows, bank, "row")


def gate(items: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined documents): a review note, missing or repeated numbers, or an
    unnumbered item keeps a whole document out."""
    review = notes.filter(F.contains("note", F.lit(REVIEW_MARKER))).select("doc", F.lit("review_note").alias("reason"))
    gaps = missing_in_range(items, ["doc"]).select("doc", F.lit("missing_number").alias("reason"))
    twice = items.filter("number IS NOT NULL").groupBy("doc", "number").agg(F.count("*").alias("n")).filter("n > 1").select("doc", F.lit("repeated_number").alias("reason"))
    bare = items.filter("number IS NULL").select("doc", F.lit("no_number").alias("reason"))
    reasons = review.unionByName(gaps).unionByName(twice).unionByName(bare).groupBy("doc").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return items.join(reasons, "doc", "left_anti"), reasons


def recovered_blocks(expected: DataFrame, blocks: DataFrame, anchors: DataFrame | None = None, stem: bool = True) -> DataFrame:
    """Expected (doc, number) with ``state``: ok, or why the recovered block is refused."""
    one = blocks.groupBy("doc", "number").agg(F.count("*").alias("_n"), F.min("text").alias("text"))
    # the options of a block that does not stand alone decide nothing
    j = with_choices(expected.join(one, ["doc", "number"], "left"), F.when(F.col("_n") == 1, F.col("text")), "_c")
    images = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"!\[[^\]]*\]\([^)]*\)"))
    visible = content_units(F.col("text")) - 40 * images
    thin = (visible < MIN_VISIBLE) & ~((images > 0) & (visible >= MIN_WITH_IMAGE))
    state = (F.when(F.coalesce("_n", F.lit(0)) != 1, "not_once").when(thin, "too_short"))
    if stem:
        state = state.when((F.col("_c.looks_like") | (F.length("_c.labels") >= 3)) & ~F.col("_c.complete"), "options_incomplete")
    out = j.withColumn("state", state.otherwise("ok")).drop("_n", "_c")
    if anchors is None:
        return out
    a = anchors.select("doc", "number", F.left(signature(F.col("text")), F.lit(96)).alias("_o"))
    r = F.left(signature(F.col("text")), F.lit(96))
    k = out.join(a, ["doc", "number"], "left").withColumn("_r", r)
    close = F.startswith("_r", F.left("_o", F.lit(ANCHOR_PREFIX))) | (dedup._sequence_ratio("_o", "_r", F.lit(-2.0)) >= ANCHOR_RATIO)
    short = (F.length("_o") < ANCHOR_PREFIX) | (F.length("_r") < ANCHOR_PREFIX)
    return k.withColumn("state", F.when((F.col("state") == "ok") & F.col("_o").isNotNull() & short, "anchor_short")
                        .when((F.col("state") == "ok") & F.col("_o").isNotNull() & ~close, "anchor_differs").otherwise(F.col("state"))).drop("_o", "_r")


# Least visible characters, overlap, its place in the recovered text, boundary run, seeds, shares.
TAIL_KEY, TAIL_OVERLAP, TAIL_PLACE, TAIL_RUN, TAIL_SEED, TAIL_SHARE, TAIL_BEFORE = 80, 64, 64, 24, 48, 0.90, 32
TAIL_IMAGE = r"!\[[^\]]*\]\([^)]*\)|!\[\[[^\]\n]*\]\]|<img\b[^>]*>"
TAIL_MASKED = TAIL_IMAGE + r"|</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^>\n]*)?>|\\(?:left|right|displaystyle|textstyle|scriptstyle|scriptscriptstyle)\b"

KEY_BYTES = np.array([chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" for c in range(128)])
NOT_KEY = {c: None for c in range(128) if not KEY_BYTES[c]}
PLAIN_OVERLAP = 1 << 18  # longest product of two keys' lengths that is searched by plain substrings


def visible_key(text: str) -> tuple[str, list[int]]:
    """Digits, Latin letters and ideographs that a reader sees, in NFKC and lower case, and where each stands."""
    import re
    import unicodedata
    text = text or ""
    if "!" in text or "<" in text or "\\" in text:  # every mask begins with one of these
        text = re.sub(TAIL_MASKED, lambda m: " " * len(m.group(0)), text)
    if text.isascii():
        low = text.lower()
        seen = KEY_BYTES[np.frombuffer(low.encode(), np.uint8)]
        return low.translate(NOT_KEY), np.flatnonzero(seen).tolist()
    pairs = [(c, i) for i, raw in enumerate(text) for c in unicodedata.normalize("NFKC", raw).lower()
             if "0" <= c <= "9" or "a" <= c <= "z" or "\u3400" <= c <= "\u9fff"]
    return "".join(c for c, _ in pairs), [i for _, i in pairs]


def _prefixes(key: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the prefixes of a key, and what shifts a run's sum to its hash."""
    codes = np.frombuffer(key.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    base = 0x9E3779B97F4A7C15
    forth, back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), f, dtype=np.uint64)))) for f in (base, pow(base, -1, 1 << 64)))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * forth[:-1]))), back


def longest_overlap(a: str, b: str) -> tuple[int, int, int]:
    """Length and places of the longest run both keys hold: short keys by growing runs, long ones by halving over lengths of hashed runs."""
    if len(a) * len(b) <= PLAIN_OVERLAP:
        n = to = j = 0
        while j + n < len(b):
            if b[j:j + n + 1] in a:
                n, to = n + 1, j
            else:
                j += 1
        return (n, a.find(b[to:to + n]), to) if n else (0, 0, 0)
    (pa, ba), (pb, bb) = _prefixes(a), _prefixes(b)
    runs = lambda p, back, n: (p[n:] - p[:-n]) * back[:len(p) - n]
    low, high, best = 0, min(len(a), len(b)), (0, 0, 0)
    while low < high:
        n = (low + high + 1) // 2
        ha, hb = runs(pa, ba, n), runs(pb, bb, n)
        hit = np.isin(hb, ha)
        if hit.any():
            j = int(hit.argmax())
            low, best = n, (n, int((ha == hb[j]).argmax()), j)
        else:
            high = n - 1
    n, i, j = best
    return best if a[i:i + n] == b[j:j + n] else (0, 0, 0)


def covered(a: str, b: str, run: int = 8) -> int:
    """Characters of ``a`` explained by ``b`` in order: runs are extended, and met again behind a difference."""
    from bisect import bisect_left
    if a.startswith(b) or b.startswith(a):
        return min(len(a), len(b))
    spots = {}
    for j in range(len(b) - run + 1):
        spots.setdefault(b[j:j + run], []).append(j)
    i = j = total = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, total = i + 1, j + 1, total + 1
            continue
        while i <= len(a) - run:
            at = spots.get(a[i:i + run], [])
            k = bisect_left(at, j)
            if k < len(at):
                j = at[k]
                break
            i += 1
        else:
            break
    return total


def swallowed_from(anchor: str, recovered: str) -> int | None:
    """Where in ``anchor`` the recovered text of the next number begins, or None without proof of it.

    Needed: one long run both hold once, near the recovered start and behind the first part of
    the anchor; all that follows explained by the recovered text and the other way round; no
    image in it. A solution that only quotes the next head keeps its text.
    """
    import re
    a, places = visible_key(anchor)
    b, _ = visible_key(recovered)
    if min(len(a), len(b)) < TAIL_KEY:
        return None
    least = max(TAIL_BEFORE, len(a) // 5)
    for j in range(min(TAIL_PLACE, len(b) - TAIL_RUN) + 1):  # the cheapest proof first
        i = a.find(b[j:j + TAIL_RUN], least)
        if i >= 0:
            n = TAIL_RUN
            while n < TAIL_SEED and i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            break
    else:
        return None
    if a.count(b[j:j + n]) != 1 or b.count(b[j:j + n]) != 1:
        return None
    size, at, to = longest_overlap(a, b)
    if size < TAIL_OVERLAP or to > TAIL_PLACE:
        return None
    middle = to + (size - TAIL_OVERLAP) // 2
    if a.count(b[middle:middle + TAIL_OVERLAP]) != 1 or b.count(b[middle:middle + TAIL_OVERLAP]) != 1:
        return None
    tail, rest = a[i:], b[j:]
    same = covered(tail, rest)
    if same < TAIL_SHARE * len(tail) or 2 * same < TAIL_SHARE * (len(tail) + len(rest)) or re.search(TAIL_IMAGE, anchor[places[i]:]):
        return None
    return places[i]


def trim_swallowed_tail(solutions: DataFrame, recovered: DataFrame) -> DataFrame:
    """Cut a solution where the text of the next number was swallowed, if the recovered text proves it."""
    nxt = recovered.select("doc", (F.col("number") - 1).alias("number"), F.regexp_replace("text", HEAD_NUMBER, "").alias("_next"))
    one = nxt.groupBy("doc", "number").agg(F.count("*").alias("_n"), F.min("_next").alias("_next")).filter("_n = 1").drop("_n")

    @F.pandas_udf("int")
    def begins(text: pd.Series, following: pd.Series) -> pd.Series:
        return pd.Series([None if f is None or t is None else swallowed_from(t, f) for t, f in zip(text, following)], dtype="Int32")

    # only a pair whose keys can be long enough reaches Python
    may = (F.length("text") >= TAIL_KEY) & (F.length("_next") >= TAIL_KEY)
    j = solutions.join(one, ["doc", "number"], "left").withColumn("_at", F.explode(F.array(begins(F.when(may, F.col("text")), F.when(may, F.col("_next"))))))
    cut = F.regexp_replace(F.substr("text", F.lit(1), F.col("_at")), r"(?U)\s+$", "")
    return j.withColumn("trimmed", F.col("_at").isNotNull()).withColumn("text", F.when(F.col("_at").isNotNull(), cut).otherwise(F.col("text"))).drop("_next", "_at")


def trim_next_title(solutions: DataFrame, titles: DataFrame) -> DataFrame:
    """Drop the next unit's title (columns doc, number, title) from the end of a solution.

    It goes if one line alone equals it, as a heading or bold line, and only blank lines follow.
    """
    key = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    one = titles.groupBy("doc", "number").agg(F.min("title").alias("_title"), F.count_distinct("title").alias("_n")).filter("_n = 1").drop("_n")
    j = solutions.join(one, ["doc", "number"], "left")
    lines = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    j = j.withColumn("_lines", lines).withColumn("_want", F.when(key(F.col("_title")) != "", key(F.col("_title"))))
    strong = lambda x: x.rlike(r"(?U)^\s*(?:#{1,6}\s+\S|\*\*.+\*\*\s*$)")
    hits = F.filter(F.transform("_lines", lambda x, i: F.when(strong(x) & (key(x) == F.col("_want")), i)), lambda i: i.isNotNull())
    j = j.withColumn("_hits", hits)
    at = F.get("_hits", F.lit(0))
    rest = F.array_join(F.slice("_lines", at + 2, F.size("_lines")), "")
    gone = F.coalesce((F.size("_hits") == 1) & ~rest.rlike(r"(?U)\S"), F.lit(False))
    kept = F.regexp_replace(F.array_join(F.slice("_lines", F.lit(1), at), "\n"), r"(?U)\s+$", "")
    return j.withColumn("untitled", gone).withColumn("text", F.when(gone, kept).otherwise(F.col("text"))).drop("_title", "_lines", "_want", "_hits")
