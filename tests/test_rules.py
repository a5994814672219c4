import hashlib
import random

import pytest
from pyspark.sql import functions as F

from itemloom.functions import choices as C, marks as M, passes as P, text as X
from itemloom.operators import collections as CO, fusion as FU, layout as LA, loads as L, predicates as PR, sampling as SM, sequence as SQ
from itemloom.plans import importing as IM
import itemloom.queries  # noqa: F401
from itemloom.registry import QUERIES


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def gaps(spark, numbers):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(numbers)], "doc int, idx long, number int")
    return sorted(r.missing for r in SQ.number_gaps(df, ["doc"]).collect())


def test_number_gaps(spark):
    assert gaps(spark, [1, 2, 4, 5]) == [3]
    assert gaps(spark, [*range(1, 12), 14, 15, 12, 13]) == []
    assert gaps(spark, [1, 2, 3, 1, 2, 4]) == [3]
    assert gaps(spark, [3, 313]) == []
    assert gaps(spark, [None, 1, None, 3]) == [2]


def test_chinese_numbers_and_lines(spark):
    for word, n in [("十", 10), ("十二", 12), ("二十", 20), ("二十三", 23), ("九", 9), ("一〇", 10), ("百", 100), ("一百二十", 120), ("二百零三", 203), ("九百九十九", 999), ("两百一十", 210), ("十百", None), ("题", None)]:
        assert one(spark, M.chinese_number(F.col("s")), s=word) == n
    names, nought = "零一二三四五六七八九", {}
    for n in range(1, 1000):
        h, t, o = n // 100, n // 10 % 10, n % 10
        word = (names[h] + "百" if h else "") + (names[t] + "十" if t else "零" if h and o else "") + (names[o] if o else "")
        nought[word[1:] if word.startswith("一十") else word] = n
    words = spark.createDataFrame(list(nought.items()), "s string, n int")
    assert words.filter(~M.chinese_number(F.col("s")).eqNullSafe(F.col("n"))).count() == 0
    num = lambda s, **k: one(spark, M.number_of(M.line_body(F.col("s")), **k)["n"], s=s)
    assert num("## 12. 题") == 12 and num("★★3．题") == 3 and num("AD 9. 题") == 9
    assert num("1.1.5 函数") is None and num("0. 2 = 0. 5") is None and num("12) 题") is None
    assert num("12) 题", loose=True) == 12
    assert num("第 5 题 求", style=M.TI) == 5 and num("第1题 示意图", style=M.TI) is None
    assert num("2025 江苏预赛第 1 题", style=M.TI) == 1 and num("第十二题 求", style=M.TI_CN) == 12


def test_leading_numbers(spark):
    s = lambda t: one(spark, M.strip_leading_number(F.col("s")), s=t)
    assert s("12. 已知") == "已知" and s("**12.** 已知") == "已知" and s("第3题 求") == "求"
    assert s("1.5 千克的水") == "1.5 千克的水" and s("（1）求") == "（1）求" and s("2.（5 分）求") == "求"
    assert s("二，三班共有") == "二，三班共有" and s("第十二题 求") == "求"
    assert one(spark, M.block_number(F.col("s")), s="- [解答] 第4题 求") == 4


def test_split_solution(spark):
    f = lambda t: tuple(one(spark, M.split_solution(F.col("s")), s=t))
    assert f("题干\n【答案】B\n【解析】因为") == ("题干", "【答案】B\n【解析】因为")
    assert f("求值 答案：3") == ("求值", "答案：3")
    assert f("数学问题的答案：已知数列") == ("数学问题的答案：已知数列", None)
    assert f("解不等式：x>1") == ("解不等式：x>1", None)


def test_option_rules(spark):
    texts = {"题（ ）\nA. 1 B. 2 C. 3 D. 4": True, "集合 A. x（ ）A. 1 B. 2 C. 3": False, "A. 1 B. 2 C. D. 4": False, "（ ）(A) 1 (B) 2 (C) 3 (D) 4": True, "": False}
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", C.inspect_choices("t").alias("c")).collect()
    assert {r.t: r.c.complete for r in rows if r.t is not None} == texts
    assert [r.c.options for r in rows if r.t and r.t.startswith("题")] == [["1", "2", "3", "4"]]
    bare = "（ ）" + "".join(f"$\\displaystyle {c}$ {k} " for k, c in enumerate("ABCD"))
    plain = bare[3:]
    known = {r.t: (r.c.complete, r.c.complete_known) for r in spark.createDataFrame([(bare,), (plain,)], "t string").select("t", C.inspect_choices("t").alias("c")).collect()}
    assert known == {bare: (True, True), plain: (False, True)}
    lines = spark.createDataFrame([("A. B. -1013C． 3 D.",), ("若 C. 在 B. 之外 A. x",), ("A. 1 B. 2 C. 3",)], "text string")
    assert [(r.text, r.empty, r.total) for r in C.empty_options(lines).collect()] == [("A. B. -1013C． 3 D.", "AD", 4)]


def test_natural_order(spark):
    df = spark.createDataFrame([("卷10",), ("卷2",), ("3b",), ("A",), ("卷002x",)], "s string")
    assert [r.s for r in df.orderBy(X.natural_key(F.col("s"))).collect()] == ["3b", "A", "卷2", "卷002x", "卷10"]


def test_search_errors():
    with pytest.raises(PR.SearchError):
        PR.clause("starred", "maybe")
    with pytest.raises(PR.SearchError):
        PR.clause("tag", "")
    with pytest.raises(PR.SearchError):
        PR.clause("type", "x", types=["单选题"])


def test_text_passes(spark):
    n = lambda t: one(spark, P.normalize_block(F.col("s")), s=t)
    assert n("若 $\\frac{1}{2}$，则 $sin x$。") == "若 $\\displaystyle \\dfrac{1}{2}$, 则 $\\displaystyle \\sin x$"
    assert n("值为 0.\n结束。") == "值为 0.\n结束"
    assert n("x<sub>1</sub> 与 a<sup>2</sup>") == "$\\displaystyle x_{1}$ 与 $\\displaystyle a^{2}$"
    assert n("如<sub>图所示</sub>") == "如图所示"
    assert n("√<sub>3</sub>") == "$\\displaystyle \\sqrt{3}$"
    assert n("$x$<sub>n+1</sub>") == "$\\displaystyle x_{n+1}$"


def test_stable_id_and_conflict(spark):
    batch = spark.createDataFrame([("s", 0, "b", "", "", "", 1), ("s", 1, "c", "", "", "", 2)], "scope string, idx int, body string, solution string, type string, source string, number int")
    plan = L.plan_load(batch, batch.limit(0).select(F.lit("").alias("id"), F.col("scope").alias("import_scope"), F.col("idx").alias("import_index"), "body", "solution", "type", "source", "number"))
    ids = {r.idx: r.id for r in plan.collect()}
    assert ids[1] == hashlib.sha256(b"s\x001").hexdigest()[:12]
    bank = plan.select("id", F.col("scope").alias("import_scope"), F.col("idx").alias("import_index"), F.lit("other").alias("body"), "solution", "type", "source", "number")
    with pytest.raises(L.LoadRejected):
        L.rows_to_insert(batch, bank)


def test_sample_equals_direct_rule(spark):
    rnd = random.Random(5)
    files = [(y, f"{rnd.choice(['全国', '某地'])}{rnd.choice(['文科', '理科', ''])}{rnd.choice(['春季', '', ''])}{i}") for y in (2001, 2002, 2003) for i in range(rnd.randint(1, 40))]
    for rate in (0.05, 0.2, 1.0):
        got = {(r.year, r.name) for r in SM.choose(spark.createDataFrame(files, "year int, name string"), rate).collect()}
        want = set()
        for year in {y for y, _ in files}:
            names = sorted((n for y, n in files if y == year), key=lambda n: (hashlib.sha256(f"{year}\0{n}".encode()).hexdigest(), n))
            quota, picked = max(1, min(len(names), int(len(names) * rate + 0.5))), []
            for s in SM.PRIORITY[year % 2]:
                word = {"全国卷": lambda n: "全国" in n, "地方卷": lambda n: "全国" not in n, "文科卷": lambda n: "文科" in n, "理科卷": lambda n: "理科" in n, "春季卷": lambda n: "春季" in n}[s]
                hit = next((n for n in names if n not in picked and word(n)), None)
                if hit and len(picked) < quota:
                    picked.append(hit)
            picked += [n for n in names if n not in picked]
            want |= {(year, n) for n in picked[:quota]}
        assert got == want


def boxes(spark, rows):
    return spark.createDataFrame([("d", "i", f, 0, float(x), float(y), float(x + w), float(y + h)) for f, x, y, w, h in rows],
                                 "doc string, item string, figure string, page int, x0 double, y0 double, x1 double, y1 double")


def test_option_figures(spark):
    grid = [("c", 0, 300, 100, 80), ("a", 0, 0, 100, 80), ("d", 200, 302, 100, 80), ("b", 200, 3, 100, 80)]
    order = lambda df, a, m: "".join(r.figure for r in LA.assign_options(df, a, m).orderBy("label").collect())
    assert order(boxes(spark, grid), None, "reading") == "abcd"
    assert order(boxes(spark, grid + [("stem", 400, 600, 400, 300)]), None, "grid") == "abcd"
    assert order(boxes(spark, grid + [("e", 400, 0, 100, 80), ("f", 400, 300, 100, 80)]), None, "grid") == ""
    marks = spark.createDataFrame([("d", "i", c, 0, x, y) for c, x, y in [("A", 250.0, 90.0), ("B", 50.0, 90.0), ("C", 50.0, 390.0), ("D", 250.0, 390.0)]], "doc string, item string, label string, page int, x double, y double")
    assert order(boxes(spark, grid), marks, "cost") == "bacd"


def test_outline_parts(spark):
    rows = [("ok", 0, 0, 0, "合集"), ("ok", 1, 1, 2, "甲中学月考"), ("ok", 2, 1, 2, "物理试题"), ("ok", 3, 1, 9, "乙中学期末"), ("ok", 4, 2, 3, "一、选择题"),
            ("mix", 0, 0, 1, "甲中学月考"), ("mix", 1, 0, 5, "乙中学月考"), ("mix", 2, 1, 7, "丙中学月考"), ("none", 0, 0, 0, "目录")]
    df = spark.createDataFrame(rows, "doc string, seq int, depth int, page long, title string")
    pages = spark.createDataFrame([("ok", 20), ("mix", 20), ("none", 3)], "doc string, page_count long")
    parts, rejected = CO.discover_parts(df, pages)
    assert [(r.title, r.start, r.stop) for r in parts.orderBy("start").collect()] == [("甲中学月考", 2, 9), ("乙中学期末", 9, 20)]
    assert {(r.doc, r.reason) for r in rejected.collect()} == {("mix", "mixed_levels"), ("none", "no_paper_level")}


def test_restart_groups(spark):
    rows = [("two", i, n, False) for i, n in enumerate([*range(1, 20), *range(1, 19)])]
    rows += [("short", i, n, False) for i, n in enumerate([1, 2, 3, 1, 2, 3])]
    rows += [("apart", i, n, False) for i, n in enumerate([*range(1, 21), *range(1, 7)])]
    rows += [("titled", i, n, i == 20) for i, n in enumerate([*range(1, 21), *range(1, 7)])]
    groups, rejected = CO.restart_groups(spark.createDataFrame(rows, "doc string, line_no long, number int, titled boolean"))
    assert {(r.doc, r.grp, r.start_line) for r in groups.collect()} == {("two", 1, 0), ("two", 2, 19), ("titled", 1, 0), ("titled", 2, 20)}
    assert {r.doc: r.reason for r in rejected.collect()} == {"short": "no_clear_restart", "apart": "overlap"}


def test_rising_starts(spark):
    nums = [7, 1, 2, 1, 2, 4, 5, 3, 8, 20]
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(nums)], "doc string, line_no long, number int")
    assert sorted(r.line_no for r in CO.rising_starts(df).collect()) == [1, 2, 5, 6, 8]


def test_prepare_and_assemble(spark):
    text = "一、单选题\n1. 甲是（ ）\nA. 一 B. 二 C. 三 D. 四\n2. 乙是（ ）\nA. 五 B. 六 C. 七 D. 八\n二、填空题\n3. 丙为。\n参考答案\n1. A\n2. B\n3. 丙为。七"
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(text.split("\n"))], "doc string, line_no long, text string")
    blocks, found = IM.prepare(lines)
    items = IM.assemble(blocks).orderBy("idx").collect()
    assert [(r.number, r.type, r.solution) for r in items] == [(1, "单选题", "A"), (2, "单选题", "B"), (3, "填空题", "丙为. 七")]
    assert items[0].body.split("\n")[-1] == "$\\displaystyle D.$ 四" and items[2].body.endswith("___")
    assert found.count() == 0


def test_fusion_keeps_primary_without_proof(spark):
    body = "这是一道足够长的题目正文内容"
    p = spark.createDataFrame([("d", n, f"{n}. {body}") for n in (1, 2, 4, 7)], "doc string, number int, text string")
    a = spark.createDataFrame([("d", n, f"{n}. {body}") for n in (1, 2, 3, 4, 5, 7)], "doc string, number int, text string")
    got = {r.number: r.choice for r in FU.fuse_readings(p, a, ["doc"]).collect()}
    assert got == {1: "primary", 2: "primary", 3: "inserted", 4: "primary", 5: "left_out", 7: "primary"}


def test_whole_line_queries_read_every_line(spark, tmp_path):
    rows = [(1, "a\nb\nc\nd\ne", "en", "s", 9), (2, "a\nb\nc\nd\nd", "en", "s", 9), (3, "x\nq\nr\nss\nt", "en", "s", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: QUERIES[name].run(spark, str(tmp_path)).collect()
    assert {r.doc: r.aligned for r in run("whole_page_alignment")} == {1: True, 2: False, 3: True}  # the repeat stands in line 5
    assert sorted(r.idx for r in run("whole_block_spans") if r.doc == 2) == [0, 1, 2]
    assert {r.begin: r.end for r in run("whole_block_spans") if r.doc == 3} == {1: 2, 3: 4, 5: 6, 7: 9, 10: 11}
    assert {r.doc: r.digest for r in run("whole_rebuilt_units")}[2] == hashlib.md5("<new>\n<new>\n<new>\nd\nd".encode()).hexdigest()


def test_whole_order_queries_read_every_row(spark, tmp_path):
    rows = [(1, n, 10 + n, 5.0, "A" if n % 2 else "R") for n in range(1, 7)] + [(2, n, 20, 50.0, "A") for n in (1, 2, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {r.doc: r.lines_count for r in QUERIES["whole_audit_report"].run(spark, str(tmp_path)).collect()} == {1: 6, 2: 3}
    plan = QUERIES["option_verdicts"].run(spark, str(tmp_path))
    assert {r.letter: r.correct for r in plan.collect()} == {"A": True, "B": False, "C": True, "D": False}
    assert "l_linenumber" not in "".join(x for x in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x and "<= 4" in x)


def test_option_inspection_keeps_its_plan_small(spark):
    from itemloom.functions.choices import with_choices
    df = spark.createDataFrame([("1. 题 ( ) A. x B. y C. z D. w",), ("无",), (None,)], "text string")
    out = with_choices(df)
    both = out.filter("c.complete and c.blank").select("text", "c.options", "c.stem")
    assert len(both._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert [(r.options, r.stem) for r in both.collect()] == [(["x", "y", "z", "w"], "1. 题 ( )")]


def uses(df, word):
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_solution_marks_are_looked_up_once_for_a_line(spark):
    df = spark.createDataFrame([("1. x\n【答案】 y",), ("题 答案：3",), ("求x的答案：",), (None,), ("",)], "t string")
    out = df.select(M.split_solution(F.col("t")).alias("s"))
    assert uses(out, "regexp_instr(") == 1
    assert [tuple(r.s) if r.s else None for r in out.collect()] == [("1. x", "【答案】 y"), ("题", "答案：3"), ("求x的答案：", None), (None, None), ("", None)]


def test_empty_option_lines_are_cut_once(spark):
    df = spark.createDataFrame([(1, "3. A. B. x C. D. y"), (2, "A. 1 B. 2 C. 3 D. 4"), (3, "B. A. C. D."), (4, "A. B."), (5, None)], "k int, text string")
    out = C.empty_options(df)
    assert uses(out, "split(text") + uses(out, "split(concat(") == 1
    assert [tuple(r) for r in out.select("k", "empty", "total", "item_number").collect()] == [(1, "AC", 4, 3)]


def test_grid_lines_are_made_once(spark):
    at = {"a": (0, 0), "b": (300, 0), "c": (0, 250), "d": (300, 250), "e": (300, 600)}
    rows = [(1, "F", k, 0, x + 0.0, y + 0.0, x + 200.0, y + 150.0) for k, (x, y) in at.items() if k != "e"] + [(2, "F", "a", 0, 0.0, 0.0, 200.0, 150.0)]
    df = spark.createDataFrame(rows, "doc int, item string, figure string, page int, x0 double, y0 double, x1 double, y1 double")
    out = LA.assign_options(df, None, "grid")
    assert uses(LA._grids(LA._shaped(df)), "aggregate(") == 1
    assert sorted(tuple(r) for r in out.select("doc", "label", "figure").collect()) == [(1, "A", "a"), (1, "B", "b"), (1, "C", "c"), (1, "D", "d")]


def test_section_repair_writes_no_texts(spark, monkeypatch):
    from itemloom.operators import quality as Q, sequence as S
    written = []

    def noted(df):
        written.append(df.columns)
        return df
    monkeypatch.setattr(Q, "materialise", noted)
    monkeypatch.setattr(S, "materialise", noted)
    rows = [("d", i, i + 1, "stem", "一、选择题", None, f"{i + 1}. 求 x 的值 = ___") for i in range(4)] + [("d", 4, 1, "solution", "一、选择题", None, "1. A"), (None, 0, 1, "stem", "一、选择题", None, "1. 求 x")]
    blocks = spark.createDataFrame(rows, "doc string, idx long, number int, zone string, section string, group string, text string")
    got = {(r.doc, r.idx): (r.section, r.text) for r in Q.repair_sections(blocks).collect()}
    assert all(got["d", i] == (Q.RECOVERED["fill"], rows[i][6]) for i in range(4))
    assert got["d", 4] == ("一、选择题", "1. A") and got[None, 0] == ("一、选择题", "1. 求 x")
    assert written and not any("text" in columns for columns in written)


def test_options_are_read_only_where_they_count(spark):
    """No general change of case and no reading of blocks that nothing waits for (F29, F33)."""
    from itemloom.functions.choices import inspect_choices
    from itemloom.operators.fusion import graft_options
    plain, full = "1. 求 x 的值 = ___", "1. 题（ ）\nA. a B. b C. c D. d"
    rows = spark.createDataFrame([(1, plain), (2, full), (3, "a\u0003b")], "i int, t string").select("i", inspect_choices("t").alias("c"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan and "upper(" not in plan
    got = {r.i: (r.c.complete, r.c.blank, r.c.labels, r.c.stem, r.c.options) for r in rows.collect()}
    assert got == {1: (False, False, "", plain, None), 2: (True, True, "ABCD", "1. 题（ ）", ["a", "b", "c", "d"]), 3: (False, False, "", "ab", None)}
    blocks = spark.createDataFrame([("d", 1, "1. 题（ ）"), ("d", 2, "2. 题（ ）"), ("d", 3, full)], "doc string, number int, text string")
    whole = spark.createDataFrame([("d", 1, full), ("d", 3, full), ("d", 2, "A. a B. b")], "doc string, number int, text string")
    out = {r.number: (r.grafted, r.text) for r in graft_options(blocks, whole, ["doc", "number"]).collect()}
    assert out == {1: (True, "1. 题（ ）\nA. a\nB. b\nC. c\nD. d"), 2: (False, "2. 题（ ）"), 3: (False, full)}
