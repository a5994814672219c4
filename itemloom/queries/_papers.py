"""Exam papers as lines and as blocks, derived from ``lineitem`` (one paper per order)."""

from pyspark.sql import functions as F

from ..scale import heavy_chunk, row_number, running_sum, scan
from ..session import materialise

ORDER = ["zone_rank", "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def _rows(t):
    n, p, s = F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    c = F.concat
    choice = F.array(c(n, F.lit(". 题"), p, F.lit("（  ）")), c(F.lit("A. a"), s, F.lit(" B. b"), s, F.lit(" C. c D. d")))
    part = F.array(c(n, F.lit(". 题"), p, F.lit("（  ）")), c(F.lit("A. a"), s, F.lit(" B. b"), s))
    fill = F.array(c(n, F.lit(". 求 "), p, F.lit(" 的值 = ___")), c(F.lit("![](images/p"), p, F.lit(".png)")))
    answer = F.array(c(n, F.lit(". 【答案】"), s), F.lit("解：由题意得"))
    stem = F.when(F.col("l_returnflag") == "A", choice).when(F.col("l_returnflag") == "R", part).otherwise(fill)
    return t.lineitem.withColumn("zone_rank", F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).select(
        "l_orderkey", *ORDER, "l_returnflag", F.when(F.col("l_linestatus") == "O", answer).otherwise(stem).alias("ls"))


def _placed(t):
    cut = heavy_chunk(_rows(t), ["l_orderkey"], F.col("zone_rank") * 100000 + F.datediff("l_shipdate", F.lit("1970-01-01")))
    return scan(cut, ["l_orderkey"], ORDER, F.col("_hc"), {"k": row_number(), "base": running_sum(F.size("ls"), inclusive=False)})


def paper_lines(t):
    """doc, line_no, text; the first two lines are title and section heading."""
    head = F.array(F.lit("# 试卷"), F.concat(F.lit("一、选择题：本题共 "), (F.col("l_orderkey") % 5 + 1).cast("string"), F.lit(" 小题")))
    lines = F.when(F.col("k") == 1, F.concat(head, F.col("ls"))).otherwise(F.col("ls"))
    base = F.when(F.col("k") == 1, 0).otherwise(F.col("base") + 2)
    out = _placed(t).select(F.col("l_orderkey").alias("doc"), base.alias("b"), F.posexplode(lines).alias("j", "text"))
    return materialise(out.select("doc", (F.col("b") + F.col("j")).cast("long").alias("line_no"), "text"))


def paper_blocks(t):
    """The same papers cut into blocks: doc, idx, number, section, group, zone, kind, text."""
    sol = F.col("zone_rank") == 1
    section = F.concat(F.lit("一、选择题：本题共 "), (F.col("l_orderkey") % 5 + 1).cast("string"), F.lit(" 小题"))
    return materialise(_placed(t).select(
        F.col("l_orderkey").alias("doc"), (F.col("k") - 1).alias("idx"), F.col("l_linenumber").alias("number"), section.alias("section"),
        F.lit(None).cast("string").alias("group"), F.when(sol, "solution").otherwise("stem").alias("zone"),
        F.when(sol, "solution").otherwise("unknown").alias("kind"), F.array_join("ls", "\n").alias("text")))


PAPER = """paper AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END, l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS idx,
 l_linenumber AS number, '一、选择题：本题共 ' || (l_orderkey % 5 + 1) || ' 小题' AS section, CASE WHEN l_linestatus = 'O' THEN 'solution' ELSE 'stem' END AS zone, l_returnflag AS flag,
 CASE WHEN l_linestatus = 'O' THEN l_linenumber || '. 【答案】' || l_suppkey || chr(10) || '解：由题意得'
 WHEN l_returnflag = 'A' THEN l_linenumber || '. 题' || l_partkey || '（  ）' || chr(10) || 'A. a' || l_suppkey || ' B. b' || l_suppkey || ' C. c D. d'
 WHEN l_returnflag = 'R' THEN l_linenumber || '. 题' || l_partkey || '（  ）' || chr(10) || 'A. a' || l_suppkey || ' B. b' || l_suppkey
 ELSE l_linenumber || '. 求 ' || l_partkey || ' 的值 = ___' || chr(10) || '![](images/p' || l_partkey || '.png)' END AS text FROM lineitem)"""

PAPER_PAIRS = """, k AS (SELECT *, row_number() OVER (PARTITION BY doc, number, zone ORDER BY idx) AS k FROM paper),
 pairs AS (SELECT s.doc, s.idx, s.number, a.idx AS solution_idx FROM (SELECT * FROM k WHERE zone = 'stem') s LEFT JOIN (SELECT * FROM k WHERE zone = 'solution') a USING (doc, number, k)),
 orphans AS (SELECT doc, idx, text FROM paper WHERE zone = 'solution' AND (doc, idx) NOT IN (SELECT (doc, solution_idx) FROM pairs WHERE solution_idx IS NOT NULL))"""
PAPER_GAPS = """, step AS (SELECT doc, number, lag(number) OVER (PARTITION BY doc ORDER BY idx) AS p FROM paper WHERE zone = 'stem'),
 whole_set AS (SELECT doc FROM paper WHERE zone = 'stem' GROUP BY doc HAVING count(*) = count(DISTINCT number) AND max(number) - min(number) + 1 = count(*)),
 gaps AS (SELECT DISTINCT doc, unnest(generate_series(p + 1, number - 1)) AS missing FROM step WHERE number - p BETWEEN 2 AND 11 AND doc NOT IN (SELECT doc FROM whole_set))"""
VIS = "length(regexp_replace(regexp_replace({t}, '!\\[[^\\]]*\\]\\([^)]*\\)', '图', 'g'), '\\s+', '', 'g'))"
UNITS = "(length(regexp_replace(regexp_replace({t}, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\s+', '', 'g')) + 40 * len(regexp_extract_all({t}, '!\\[[^\\]]*\\]\\([^)]*\\)')))"
TIGHT = "length(regexp_replace({t}, '\\s+', '', 'g'))"
