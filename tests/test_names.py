from pyspark.sql import functions as F

from itemloom.functions import names as N


def test_safe_names(spark):
    cases = {"a/b:c": ("a_b_c", "a_b_c"), "../..": ("___", "___"), " 卷一.MD ": ("卷一", "卷一.MD"), "CON": ("_CON", "CON"), "lpt9.x": ("_lpt9.x", "lpt9.x"), "com0": ("com0", "com0"),
             "a\r\nb": ("a b", "a\r\nb"), "..": ("_", "_"), " . ": ("", ""), "x" * 200: ("x" * 180, "x" * 200), "a\tb": ("a_b", "a\tb"), "...": ("_", "_")}
    got = {r.s: (r.t, r.f) for r in spark.createDataFrame([(s,) for s in cases], "s string").select("s", N.safe_title(F.col("s")).alias("t"), N.safe_folder(F.col("s")).alias("f")).collect()}
    assert got == cases


def test_default_titles(spark):
    rows = [("书", 3, 9, False, "书第3题"), ("书", None, 9, False, "书第9题"), ("书", None, None, False, "书"), (None, 3, 9, False, "第3题"), ("", None, 9, False, ""),
            ("书", None, 4, True, "临时卡4"), (None, None, None, True, "临时卡")]
    df = spark.createDataFrame(rows, "s string, n int, q int, t boolean, want string")
    bad = df.withColumn("got", N.default_title(F.col("s"), F.col("n"), F.col("q"), F.col("t"))).filter("got <> want OR got IS NULL").collect()
    assert not bad
