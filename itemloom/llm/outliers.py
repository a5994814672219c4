"""Quality rules: base counts of a text and robust multivariate outliers. DataFrame functions only.

Every document gets counts, from them a vector of transformed statistics. For each language
and source a minimum-covariance-determinant estimate is found by concentration steps: from a
coordinatewise median start, take the ``SHARE`` of rows with the least Mahalanobis distances,
re-estimate mean and covariance on them, repeat. A document is rejected if its distance to the
final estimate is beyond the chi-square quantile ``TAIL``.

All rows take part in every estimate. Quantiles come from counts over fixed bins, so they are
exact up to the bin width, merge in any order and never hold a group's rows in one task.

Defined results: a null text is an empty one (all counts 0, base rules fail). A null language
or source is a group of its own. Groups with fewer than ``MIN_ROWS`` rows that pass the base
rules join the group of their language, and small languages join one rest group; if even that
has fewer than ``MIN_ROWS`` rows, nothing is rejected but by the base rules. Repeated rows
count as often as they occur. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, materialise

SHARE = 0.75  # rows that an estimate keeps
TAIL = 0.99999  # of the chi-square distribution
STEPS = 6
MIN_ROWS = 50
BINS = 64  # bins for each doubling of a squared distance
FLOORS = (0.25, 0.05, 0.04, 0.02, 0.08, 0.04)  # least standard deviation of each statistic
NAMES = ("length", "word", "symbol", "line", "repeat", "upper")
SYMBOLS = "#*$%&|<>"


def _cut(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper (long).

    A three-word window is told apart inside its text by a hash of 64 bits less those that
    number the text's words; hash and place share one long, so one sort of longs finds
    the repeats.
    """
    has_word = "[^\\x20\\x09-\\x0D]"
    out = df.withColumn("_words", F.array_remove(F.split(F.col(text), GAP, -1), ""))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_bits", F.length(F.bin(F.greatest("n_words", F.lit(1)))))
    w, n, bits = F.col("_words"), F.col("n_words").cast("int"), F.col("_bits")
    head = F.expr("shiftleft(-1L, _bits)")
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(head).bitwiseOR(i.cast("long")))
    out = out.withColumn("_runs", F.when(n >= 3, F.sort_array(packed)))
    r = F.col("_runs")
    met = F.filter(r, lambda x, j: (F.get(r, j - 1).bitwiseXOR(x).bitwiseAND(head) == 0) | (F.get(r, j + 1).bitwiseXOR(x).bitwiseAND(head) == 0))
    out = out.withColumn("_met", F.sort_array(F.transform(met, lambda x: x.bitwiseAND(F.bitwise_not(head)))))
    m = F.col("_met")
    covered = F.aggregate(F.transform(m, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(m, j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b)
    out = out.withColumn("_lines", F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(has_word)))
    return out.select(
        *[c for c in df.columns if c != text], "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_cut(F.col(text), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log(n.cast("double")), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.col("n_dup_lines") / n,
            F.col("n_repeat_words") / n, F.sqrt(F.col("n_upper") / chars)]


def chi_square(x: float, d: int) -> float:
    """Distribution function, by the series of the incomplete gamma function."""
    a, y = d / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= y / k
        total += term
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a)))


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, d) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, d) < p else (low, mid)
    return high


def consistency(d: int, share: float = SHARE) -> float:
    """Factor that makes the covariance of the kept share right for normal data."""
    return share / chi_square(chi_square_quantile(share, d), d + 2)


def binned_quantile(df: DataFrame, keys: list[str], bin_: Column, share: float) -> DataFrame:
    """For each key the least bin up to which at least ``share`` of its rows lie."""
    counted = df.groupBy(*keys, bin_.alias("_bin")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin")
    marked = counted.select(*keys, "_bin", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    return marked.filter(F.col("_upto") >= share * F.col("_all")).groupBy(*keys).agg(F.min("_bin").alias("_at"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    match = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        match = one if match is None else match & one
    return left.join(named, match, "left").drop(*[f"_r_{k}" for k in keys])


def pooled(df: DataFrame, used: Column, lang: str, source: str, least: int = MIN_ROWS) -> DataFrame:
    """Add the group of each row: its language and source, its language, or the rest."""
    per = df.groupBy(lang, source).agg(F.sum(F.when(used, 1).otherwise(0)).alias("_in"))
    small = F.col("_in") < least
    tongue = per.groupBy(lang).agg(F.sum(F.when(small, F.col("_in")).otherwise(0)).alias("_lang_in"))
    level = _joined(per, tongue, [lang]).select(
        lang, source, F.when(~small, 0).when(F.col("_lang_in") >= least, 1).otherwise(2).alias("_level"))
    out = _joined(df, level, [lang, source])
    return (out.withColumn("g_lang", F.when(F.col("_level") < 2, F.col(lang)))
            .withColumn("g_source", F.when(F.col("_level") < 1, F.col(source))).withColumnRenamed("_level", "g_level"))


KEYS = ["g_level", "g_lang", "g_source"]


def _with_distance(df: DataFrame, fit: DataFrame, d: int) -> DataFrame:
    """Add d2, by forward substitution of x - m in the lower triangle ``low``."""
    out = _joined(df, fit, KEYS)
    x, m, low = F.array(*[F.col(f"x{i}") for i in range(d)]), F.col("m"), F.col("low")
    out = out.withColumn("_off", F.zip_with(x, m, lambda a, b: a - b))
    off = F.col("_off")

    def solve(z, i):
        known = F.aggregate(F.zip_with(z, F.slice(low, i * d + 1, F.size(z)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.concat(z, F.array((F.get(off, i) - known) / F.get(low, i * d + i)))

    z = F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), F.expr("array_repeat(0.0D, 0)"), solve)
    out = out.withColumn("_z", F.when(m.isNotNull(), z))
    return out.withColumn("d2", F.aggregate(F.transform("_z", lambda v: v * v), F.lit(0.0), lambda a, b: a + b)).drop("m", "low", "_off", "_z")


def _estimate(df: DataFrame, d: int, floors: tuple[float, ...], factor: float) -> DataFrame:
    """Mean ``m`` and lower triangular root ``low`` (row by row) of each group's covariance."""
    sums = [F.avg(f"x{i}").alias(f"m{i}") for i in range(d)]
    sums += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)]
    fit = materialise(df.groupBy(*KEYS).agg(*sums))
    floor2 = F.array(*[F.lit(float(f) ** 2) for f in floors])
    cov = F.array(*[F.coalesce(F.col(f"c{i}_{j}"), F.lit(0.0)) * factor if j <= i else F.lit(0.0) for i in range(d) for j in range(d)])
    fit = fit.select(*KEYS, F.array(*[F.col(f"m{i}") for i in range(d)]).alias("m"), cov.alias("_c"), floor2.alias("_f"))
    c, f = F.col("_c"), F.col("_f")

    def step(low, at):
        i, j = F.floor(at / d).cast("int"), F.pmod(at, F.lit(d))
        dot = F.aggregate(F.zip_with(F.slice(low, i * d + 1, j), F.slice(low, j * d + 1, j), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        rest = F.get(c, at) - dot
        value = (F.when(j > i, F.lit(0.0)).when(i == j, F.sqrt(F.greatest(rest + F.get(f, i), F.get(f, i) / 4)))
                 .otherwise(rest / F.get(low, j * d + j)))
        return F.concat(low, F.array(value))

    low = F.aggregate(F.sequence(F.lit(0), F.lit(d * d - 1)), F.expr("array_repeat(0.0D, 0)"), step)
    return fit.select(*KEYS, "m", low.alias("low"))


def _start(df: DataFrame, d: int, floors: tuple[float, ...]) -> DataFrame:
    """Coordinatewise median and scaled median deviation, from bins of a fixed width."""
    width = 0.01
    tall = df.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"x{i}").alias("v")) for i in range(d)])).alias("e")).select(*KEYS, "e.dim", "e.v")
    middle = materialise(binned_quantile(tall, [*KEYS, "dim"], F.floor(F.col("v") / width), 0.5))
    off = _joined(tall, middle.withColumnRenamed("_at", "_mid"), [*KEYS, "dim"])
    off = off.withColumn("v", F.abs(F.col("v") - (F.col("_mid") + 0.5) * width)).drop("_mid")
    scale = binned_quantile(off, [*KEYS, "dim"], F.floor(F.col("v") / width), 0.5).withColumnRenamed("_at", "_dev")
    both = _joined(middle, scale, [*KEYS, "dim"])
    mid = [F.max(F.when(F.col("dim") == i, (F.col("_at") + 0.5) * width)) for i in range(d)]
    dev = [F.max(F.when(F.col("dim") == i, F.sqrt(F.pow(1.4826 * (F.col("_dev") + 0.5) * width, F.lit(2)) + floors[i] ** 2))) for i in range(d)]
    return both.groupBy(*KEYS).agg(F.array(*mid).alias("m"), F.array(*[dev[i] if i == j else F.lit(0.0) for i in range(d) for j in range(d)]).alias("low"))


def robust_distance(df: DataFrame, d: int, floors: tuple[float, ...] = FLOORS, used: str = "used", share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Add d2, the squared robust distance of x0..x{d-1} in the row's group (KEYS).

    Only rows with a true ``used`` shape the estimates. ``df`` must be a frozen table.
    """
    rows = df.filter(F.col(used)).select(*KEYS, *[f"x{i}" for i in range(d)])
    fit = materialise(_start(rows, d, floors))
    grade = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * BINS)
    for _ in range(steps):
        far = _with_distance(rows, fit, d).withColumn("_grade", grade)
        near = binned_quantile(far, KEYS, F.col("_grade"), share)
        kept = _joined(far, near, KEYS).filter(F.col("_grade") <= F.col("_at"))
        fit = materialise(_estimate(kept, d, floors, consistency(d, share)))
    return _with_distance(df, fit, d)


def quality(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
            tail: float = TAIL, least: int = MIN_ROWS) -> DataFrame:
    """Counts, base verdict, robust distance and the verdict ``kept`` of each document."""
    named = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                      F.col(lang).alias("lang"), F.col(source).alias("source"))
    d = len(NAMES)
    counted = counts(named).withColumn("base_failed", base_failed())
    counted = materialise(counted.select("*", *[v.alias(f"x{i}") for i, v in enumerate(vector())]))
    grouped = materialise(pooled(counted, ~F.col("base_failed"), "lang", "source", least).withColumn("used", ~F.col("base_failed")))
    sizes = grouped.filter("used").groupBy(*KEYS).agg(F.count("*").alias("_size"))
    far = _joined(robust_distance(grouped, d), sizes, KEYS)
    limit = chi_square_quantile(tail, d)
    # the rest group may be too small for an estimate; then only the base rules speak
    far_out = (F.col("d2") > limit) & (F.coalesce("_size", F.lit(0)) >= least)
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~F.coalesce(far_out, F.lit(False))).alias("kept"),
                      "lang", "source", F.col("d2").alias("distance2"))
