"""Reproducible stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import rank_in_key

# Strata and the order they are drawn in, by parity of the year.
NATIONAL, LOCAL, ARTS, SCIENCE, SPRING = "全国卷", "地方卷", "文科卷", "理科卷", "春季卷"
PRIORITY = {1: [NATIONAL, LOCAL, SCIENCE, ARTS, SPRING], 0: [NATIONAL, LOCAL, ARTS, SCIENCE, SPRING]}


def strata(name: Column) -> Column:
    has = lambda *w: F.lit(False) if not w else name.rlike("|".join(w))
    return F.array_compact(F.array(
        F.when(has("全国"), NATIONAL).otherwise(LOCAL), F.when(has("文卷", "文科"), ARTS),
        F.when(has("理卷", "理科"), SCIENCE), F.when(has("春季"), SPRING)))


def score(year: Column, name: Column) -> Column:
    return F.sha2(F.concat(year.cast("string"), F.lit("\0"), name), 256)


def choose(files: DataFrame, rate: float) -> DataFrame:
    """Sampled (year, name): one per stratum in priority order, then by hash up to the quota.

    A stratum's pick depends on at most four earlier picks, so five candidates per stratum
    decide it; everything else is ranked by hash without collecting a year.
    """
    scored = files.select("year", "name").withColumn("score", score(F.col("year"), F.col("name"))).withColumn("strata", strata(F.col("name")))
    sizes = scored.groupBy("year").agg(F.count("*").alias("n"))
    quota = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.col("n") * rate + 0.5).cast("long")))
    wide = scored.select("year", "name", "score", F.explode("strata").alias("stratum"))
    first = rank_in_key(wide, ["year", "stratum"], [F.col("score").asc(), F.col("name").asc()], "k").filter("k <= 5")

    def pick(pdf):
        year = int(pdf["year"].iloc[0])
        taken = []
        for s in PRIORITY[year % 2]:
            for name in pdf[pdf["stratum"] == s].sort_values("k")["name"]:
                if name not in taken:
                    taken.append(name)
                    break
        import pandas as pd
        return pd.DataFrame({"year": year, "name": taken, "turn": range(len(taken))})

    # at most 25 rows per year
    turns = first.groupBy("year").applyInPandas(pick, f"year {dict(files.dtypes)['year']}, name string, turn long")
    q = sizes.withColumn("quota", quota).select("year", "quota")
    picked = turns.join(q, "year").filter("turn < quota").select("year", "name")
    used = picked.groupBy("year").agg(F.count("*").alias("used"))
    rest = scored.join(picked, ["year", "name"], "left_anti")
    filled = (rank_in_key(rest.select("year", "name", "score"), ["year"], [F.col("score").asc(), F.col("name").asc()], "k")
              .join(q, "year").join(used, "year", "left").filter(F.col("k") <= F.col("quota") - F.coalesce("used", F.lit(0))))
    return picked.unionByName(filled.select("year", "name"))


def plan_totals(files: DataFrame, sample: DataFrame) -> DataFrame:
    a = files.groupBy("year").agg(F.count("*").alias("source_count"))
    b = sample.groupBy("year").agg(F.count("*").alias("sample_count"))
    per = a.join(b, "year", "left").fillna(0)
    return per.withColumn("actual_rate", F.col("sample_count") / F.col("source_count"))
