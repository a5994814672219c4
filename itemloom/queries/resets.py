"""Collections over orders: a customer is a collection, each order a paper whose items follow its count of lines."""

from pyspark.sql import functions as F

from ..operators import collections as C, resets as R
from ..registry import query
from ..scale import dense_chunk, rank_in_key, running_sum, scan
from ..session import materialise

NUMBERS = """CASE WHEN k = 11 THEN {three} WHEN k = 6 THEN {f}({seq}, {n} n <> 3) WHEN k = 9 THEN {f}({seq}, {n} n <> 3 AND n <> 4) ELSE {seq} END"""
HEADS = """CASE WHEN o_orderstatus = 'F' THEN {l}'# 月考卷' || o_orderkey, '', CASE WHEN k % 2 = 0 THEN '## 一、单选题' ELSE '学校：' END{r} WHEN o_orderstatus = 'P' AND k >= 12 THEN {l}'## 二、填空题'{r} ELSE {none} END"""

PAPERS = f"""WITH RECURSIVE c AS (SELECT l_orderkey, CAST(count(*) AS INT) AS k FROM lineitem GROUP BY 1),
 p AS (SELECT o_custkey AS doc, o_orderkey, o_orderpriority AS priority, o_orderstatus AS status, k, {NUMBERS.format(three='[1, 2, 3]', f='list_filter', n='lambda n:', seq='range(1, 9 + k // 4)')} AS numbers,
 {HEADS.format(l='[', r=']', none='[]')} AS heads FROM orders JOIN c ON l_orderkey = o_orderkey),
 placed AS (SELECT *, CAST(row_number() OVER w AS INT) AS pos, sum(len(heads) + len(numbers)) OVER w - len(heads) - len(numbers) AS base, lead(status) OVER w AS next_status, lead(numbers) OVER w AS next_numbers
 FROM p WINDOW w AS (PARTITION BY doc ORDER BY o_orderkey))"""


def papers(t):
    """doc, pos, base (first line), numbers, heads of each paper, with its order's columns."""
    k = t.lineitem.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("k"))
    seq = "sequence(1, 8 + k div 4)"
    rows = t.orders.join(k, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("doc"), "o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "k",
        F.expr(NUMBERS.format(three="array(1, 2, 3)", f="filter", n="n ->", seq=seq)).alias("numbers"),
        F.expr(HEADS.format(l="array(", r=")", none="cast(array() AS array<string>)")).alias("heads"))
    ranked = rank_in_key(rows, ["doc"], [F.col("o_orderkey").asc()], "pos").withColumn("pos", F.col("pos").cast("int"))
    size = F.size("heads") + F.size("numbers")
    ends = scan(ranked, ["doc"], ["pos"], dense_chunk("pos"), {"ends": running_sum(size)})
    return materialise(ends.withColumn("base", (F.col("ends") - size).cast("long")))


def hits(p):
    lines = p.select("doc", "base", F.posexplode(F.concat("heads", F.transform("numbers", lambda n: F.concat(n.cast("string"), F.lit(". 求值"))))).alias("j", "text"))
    return materialise(R.number_hits(lines.select("doc", (F.col("base") + F.col("j")).alias("line_no"), "text")))


def top_level(t):
    return C.restart_groups(hits(papers(t)).withColumn("titled", F.col("title").isNotNull()))


SHARE = "len(list_intersect(numbers, next_numbers)) / greatest(len(numbers), len(next_numbers))"
JUDGED = PAPERS + f""", why AS (SELECT doc, CASE WHEN bool_or(pos > 1 AND status = 'P' AND k >= 12) THEN 'section' WHEN bool_or(k = 11 AND next_numbers IS NOT NULL) OR count(*) < 2 THEN 'no_clear_restart'
 WHEN bool_or(k = 11 OR len(numbers) / list_max(numbers) < 0.85) THEN 'coverage' WHEN bool_or(next_status <> 'F' AND {SHARE} < 0.8) THEN 'overlap' END AS reason FROM placed GROUP BY doc)"""


@query("restart_groups", "W11", JUDGED + """ SELECT doc, pos AS grp, CAST(base + len(heads) AS BIGINT) AS start_line, CAST(len(numbers) AS INT) AS items FROM placed JOIN why USING (doc) WHERE reason IS NULL""")
def _(t):
    return top_level(t)[0].select("doc", "grp", "start_line", F.size("question_numbers").alias("items"))


@query("restart_rejections", "W11", JUDGED + " SELECT doc, reason FROM why WHERE reason IS NOT NULL")
def _(t):
    return top_level(t)[1]


# A unit opens at each urgent order. The runs of a unit open at titled papers.
NESTED = PAPERS + """, u AS (SELECT *, last_value(CASE WHEN priority = '1-URGENT' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos) AS unit FROM placed),
 r AS (SELECT *, sum(CASE WHEN status = 'F' AND pos <> unit THEN 1 ELSE 0 END) OVER (PARTITION BY doc, unit ORDER BY pos) AS run FROM u WHERE unit IS NOT NULL),
 runs AS (SELECT doc, unit, run, list_sort(list_distinct(flatten(list(numbers)))) AS s FROM r GROUP BY ALL),
 st AS (SELECT doc, unit, run, 1 AS part, s AS seen FROM runs WHERE run = 0 UNION ALL
 SELECT n.doc, n.unit, n.run, CASE WHEN len(seen) >= 5 THEN part + 1 ELSE part END, CASE WHEN len(seen) >= 5 THEN n.s ELSE list_distinct(list_concat(seen, n.s)) END
 FROM st JOIN runs n ON n.doc = st.doc AND n.unit = st.unit AND n.run = st.run + 1),
 parts AS (SELECT doc, unit, part, list_sort(list_distinct(flatten(list(numbers)))) AS q, min(pos) AS opener FROM r JOIN st USING (doc, unit, run) GROUP BY ALL),
 n AS (SELECT *, max(part) OVER (PARTITION BY doc, unit) AS parts FROM parts),
 bad AS (SELECT DISTINCT doc FROM n WHERE parts > 1 AND (len(q) < 5 OR len(q) / list_max(q) < 0.85))"""


def nested(t):
    p = papers(t)
    units = p.filter("priority = '1-URGENT'").select("doc", F.col("pos").alias("unit"), F.col("base").alias("start_line"),
                                                     F.concat(F.lit("专题"), F.col("o_orderkey").cast("string")).alias("title"), F.col("k").alias("ordinal"))
    return R.nested_units(units, hits(p))


@query("nested_units", "W11", NESTED + """ SELECT n.doc, unit, part, CAST(CASE WHEN parts = 1 OR o.status = 'F' THEN o.base ELSE o.base + len(o.heads) END AS BIGINT) AS start_line,
 CASE WHEN part = 1 THEN '专题' || h.o_orderkey ELSE '月考卷' || o.o_orderkey END AS title, CASE WHEN part = 1 THEN h.k END AS ordinal, CAST(len(q) AS INT) AS items, parts > 1 AS number_reset
 FROM n JOIN placed o ON o.doc = n.doc AND o.pos = opener JOIN placed h ON h.doc = n.doc AND h.pos = unit WHERE n.doc NOT IN (SELECT doc FROM bad)""")
def _(t):
    return nested(t)[0].select("doc", "unit", "part", "start_line", "title", "ordinal", F.size("question_numbers").alias("items"), "number_reset")


@query("nested_rejections", "W11", NESTED + " SELECT doc, 'coverage' AS reason FROM bad")
def _(t):
    return nested(t)[1]


# The answers of a paper: few lack items, some stand under another topic, some are missing.
ANSWERS = """CASE WHEN k = 9 THEN {f}(numbers, {n} n <> 5 AND n <> 6) WHEN k = 8 THEN {f}(numbers, {n} n < 10) WHEN k = 10 THEN {f}(numbers, {n} n < 7) ELSE numbers END"""
TITLED = "priority IN ('1-URGENT', '2-HIGH')"
SOLVED = PAPERS + f""", side AS (SELECT doc, pos, o_orderkey, k, {TITLED} AS titled, numbers, {ANSWERS.format(f='list_filter', n='lambda n:')} AS s FROM placed),
 laid AS (SELECT *, len(list_intersect(numbers, s)) / greatest(len(numbers), len(s)) AS share, row_number() OVER w AS answer_pos, sum(len(s) + 1) OVER w - len(s) - 1 AS base FROM side WHERE k <> 13 WINDOW w AS (PARTITION BY doc ORDER BY pos)),
 near AS (SELECT *, coalesce(lag(share) OVER w, 1) >= 0.8 AND coalesce(lead(share) OVER w, 1) >= 0.8 AS regular FROM laid WINDOW w AS (PARTITION BY doc ORDER BY pos)),
 why AS (SELECT doc, CASE WHEN max(CASE WHEN k = 13 THEN 1 ELSE 0 END) = 1 THEN 'unit_count' END AS reason FROM side GROUP BY doc),
 each AS (SELECT doc, pos, CASE WHEN share < 0.8 AND NOT (titled AND share >= 0.75 AND regular AND len(s) >= 5 AND list_max(s) = list_max(numbers)) THEN 'overlap' WHEN titled AND k = 12 THEN 'title' END AS reason FROM near),
 verdict AS (SELECT why.doc, coalesce(any_value(why.reason), arg_min(each.reason, each.pos) FILTER (each.reason IS NOT NULL)) AS reason FROM why LEFT JOIN each USING (doc) GROUP BY why.doc)"""


def solved(t):
    p = papers(t)
    title, titled = F.concat(F.lit("精练："), F.col("o_orderkey").cast("string"), F.lit("力学")), F.expr(TITLED)
    exams = p.select(F.col("doc").alias("collection"), "pos", title.alias("title"), F.concat(F.col("o_orderkey").cast("string"), F.lit("力学")).alias("topic"),
                     F.col("pos").alias("ordinal"), F.col("numbers").alias("question_numbers"), F.lit(False).alias("generated_title"))
    answers = p.filter("k <> 13").withColumn("s", F.expr(ANSWERS.format(f="filter", n="n ->")))
    ends = materialise(scan(answers, ["doc"], ["pos"], dense_chunk("pos"), {"stop": running_sum(F.size("s") + 1)}).withColumn("first", F.col("stop") - F.size("s") - 1))
    # answers repeat the topic at the end of the title, as readings of brackets do
    topic = F.when(F.col("k") == 12, F.lit("光学")).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("力学力学")))
    titles = ends.filter(titled).select(F.col("doc").alias("collection"), F.col("first").alias("line_no"), title.alias("title"), topic.alias("topic"),
                                        F.col("pos").alias("ordinal"), F.lit(True).alias("strong"))
    lines = ends.select(F.col("doc").alias("collection"), "first", F.posexplode("s").alias("j", "number")).select(
        "collection", (F.col("first") + 1 + F.col("j")).alias("line_no"), "number", F.lit(None).cast("string").alias("title"), F.lit(None).cast("long").alias("title_line"))
    return R.solution_units(exams, lines, titles)


@query("solution_resets", "W11", SOLVED + """ SELECT doc AS collection, CAST(pos AS INT) AS pos, CAST(CASE WHEN titled THEN base ELSE base + 1 END AS BIGINT) AS start_line, o_orderkey || CASE WHEN titled THEN '力学力学' ELSE '力学' END AS topic,
 CAST(len(s) AS INT) AS items, NOT titled AS generated_title FROM laid JOIN verdict USING (doc) WHERE reason IS NULL""")
def _(t):
    return solved(t)[0].select("collection", "pos", "start_line", "topic", F.size("question_numbers").alias("items"), "generated_title")


@query("solution_rejections", "W11", SOLVED + " SELECT doc AS collection, reason FROM verdict WHERE reason IS NOT NULL")
def _(t):
    return solved(t)[1]


# Papers of ten lines keep seven of ten items, of thirteen five of eleven.
LOSSY = "CASE WHEN k = 10 THEN {f}(numbers, {n} n <> 3 AND n <> 4 AND n <> 5) WHEN k = 13 THEN {f}(numbers, {n} n < 4 OR n > 9) ELSE numbers END"
STRONG, ORDINAL = "status <> 'P' OR k <> 8", "pos + CASE WHEN k = 12 THEN 1 ELSE 0 END"


@query("provisional_units", "W12", PAPERS + f""", v AS (SELECT doc, pos, o_orderkey, {STRONG} AS strong, {ORDINAL} AS ordinal, len(s) AS n, len(s) >= 2 AND len(s) / list_max(s) >= 0.8 AS ok, len(s) >= 5 AND len(s) / list_max(s) >= 0.6 AS loose
 FROM (SELECT *, {LOSSY.format(f='list_filter', n='lambda n:')} AS s FROM placed)),
 w AS (SELECT *, ok OR loose AS fits, coalesce(ordinal <> lag(CASE WHEN ok OR loose THEN ordinal END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos) + 1, false) AS jump FROM v),
 d AS (SELECT doc, count_if(ok) >= 2 AND coalesce(max(CASE WHEN NOT ok THEN pos END) < min(CASE WHEN ok THEN pos END), true) AS strict,
 bool_and(strong) AND count_if(fits) >= 2 AND coalesce(max(CASE WHEN NOT fits THEN pos END) < min(CASE WHEN fits THEN pos END), true) AND NOT bool_or(fits AND (jump OR n < 5)) AS again FROM w GROUP BY doc)
 SELECT doc, CAST(o_orderkey AS VARCHAR) AS title_key, CAST(n AS BIGINT) AS numbers, NOT strict AS provisional FROM w JOIN d USING (doc) WHERE (strict AND ok) OR (NOT strict AND again AND fits)""")
def _(t):
    p = papers(t).withColumn("s", F.expr(LOSSY.format(f="filter", n="n ->"))).withColumn("base", F.col("base") + F.col("pos"))
    titles = p.select("doc", F.col("base").alias("line_no"), F.lit(True).alias("is_title"), F.col("o_orderkey").cast("string").alias("key"), F.lit(None).cast("int").alias("number"),
                      F.expr(STRONG).alias("strong"), F.expr(ORDINAL).alias("ordinal"))
    items = p.select("doc", "base", F.posexplode("s").alias("j", "number")).select(
        "doc", (F.col("base") + 1 + F.col("j")).alias("line_no"), F.lit(False).alias("is_title"), F.lit(None).cast("string").alias("key"), "number",
        F.lit(None).cast("boolean").alias("strong"), F.lit(None).cast("int").alias("ordinal"))
    return C.provisional_units(materialise(titles.unionByName(items)))[0].select("doc", "title_key", F.col("numbers").cast("long").alias("numbers"), "provisional")
