import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from itemloom import scale as S


def rows(seed=1, n=400):
    rnd = random.Random(seed)
    out = []
    for k, size in [("hot", n), ("a", 7), ("b", 1), ("c", 30)]:
        out += [(k, i, rnd.choice([None, rnd.randint(0, 9)])) for i in range(size)]
    rnd.shuffle(out)
    return out


def test_scan_over_many_chunks_equals_one_window(spark):
    df = spark.createDataFrame(rows(), "k string, pos long, v int")
    w = Window.partitionBy("k").orderBy("pos")
    full, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "k", "pos", F.row_number().over(w).alias("rn"), F.coalesce(F.sum("v").over(full), F.lit(0)).alias("s"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("sx"), F.max("v").over(before).alias("m"),
        F.last("v", True).over(full).alias("l"), F.lag("v").over(w).alias("lg"), F.lead("v").over(w).alias("ld"))
    for size in (1, 3, 50, 10_000):
        got = S.scan(df, ["k"], ["pos"], S.dense_chunk("pos", size), {
            "rn": S.row_number(), "s": S.running_sum(F.col("v")), "sx": S.running_sum(F.col("v"), inclusive=False),
            "m": S.running_max(F.col("v"), inclusive=False), "l": S.last_seen(F.col("v")), "lg": S.lag(F.col("v")), "ld": S.lead(F.col("v"))})
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), size


def test_scan_carries_over_chunks_of_a_null_key(spark):
    df = spark.createDataFrame([(None, i, 1) for i in range(6)] + [("a", i, 1) for i in range(3)], "k string, pos long, v int")
    got = S.scan(df, ["k"], ["pos"], S.dense_chunk("pos", 2), {"rn": S.row_number()}).orderBy("k", "pos").collect()
    assert [r.rn for r in got] == [1, 2, 3, 4, 5, 6, 1, 2, 3]


def test_heavy_keys_are_split_and_others_are_not(spark):
    df = spark.createDataFrame(rows(), "k string, pos long, v int")
    cut = S.heavy_chunk(df, ["k"], F.floor(F.col("pos") / 10), rows=100)
    per = {r.k: r.n for r in cut.groupBy("k").agg(F.count_distinct("_hc").alias("n")).collect()}
    assert per == {"hot": 40, "a": 1, "b": 1, "c": 1}


def test_ranks_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame(rows(), "k string, pos long, v int")
    for parts in (1, 5):
        d = df.repartition(parts)
        g = S.global_rank(d, [F.col("k").desc(), F.col("pos").asc()]).orderBy("rank").collect()
        assert [r["rank"] for r in g] == list(range(1, len(g) + 1))
        assert [(r.k, r.pos) for r in g] == sorted(((k, p) for k, p, _ in rows()), key=lambda x: (-ord(x[0][0]), x[1]))
        r = S.rank_in_key(d, ["k"], [F.col("pos").asc()]).collect()
        assert all(x["rank"] == x.pos + 1 for x in r)


def test_counted_join_with_slices_keeps_every_row_once(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, k string")
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    got = S.join_counted(df, counts, ["k"], "id", slice_rows=10)
    assert got.count() == 300 and got.select("id").distinct().count() == 300


def test_fold_sees_rows_in_order_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows(3), "k string, pos long, v int").select("k", "pos")
        got = S.fold(df, ["k"], ["pos"], list, lambda s, p: s.extend(p["pos"].tolist()), lambda s: [(s == sorted(s), len(s))], "k string, ok boolean, n long")
        assert {(r.k, r.ok, r.n) for r in got.collect()} == {("hot", True, 400), ("a", True, 7), ("b", True, 1), ("c", True, 30)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_of_one_chunk_cost_one_shuffle(spark):
    df = spark.createDataFrame(rows(), "k string, pos long, v int")
    got = S.scan(df, ["k"], ["pos"], S.chunks_of(df, "pos"), {"s": S.running_sum(F.col("v"))})
    again = S.scan(S.heavy_chunk(got, ["k"], F.col("pos")), ["k"], ["pos"], F.col("_hc"), {"ld": S.lead(F.col("v"))})
    ranked = S.rank_in_key(again, ["k"], [F.col("pos").asc()])
    plan = ranked._jdf.queryExecution().sparkPlan().toString() + ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and len(ranked.collect()) == 438
