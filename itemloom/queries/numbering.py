"""Number repairs over the lines of orders; the lines of an order play the blocks of a paper."""

from pyspark.sql import functions as F

from ..operators import numbering as N
from ..registry import query
from ..session import materialise
from ._sequences import ORDERED, order_rows

W = "WITH RECURSIVE " + ORDERED
DIGIT = "CAST(right(text, 1) AS INT)"


def _told(t, by_digit):
    """The lines with a text by the last digit of their supplier."""
    return materialise(order_rows(t).withColumn("text", F.expr(by_digit)))


DECIMALS = f"CASE {DIGIT} % 4 WHEN 0 THEN concat(number, '.5 x') WHEN 1 THEN concat(number, '.5') WHEN 2 THEN concat(number, '.25 7.5') ELSE concat(number, '. t') END"


@query("merged_decimals", "W17", W + f""", b AS (SELECT doc, idx, number, zone, {DECIMALS} AS text, {DIGIT} % 4 AS k, lead(number) OVER (PARTITION BY doc ORDER BY idx) AS nx FROM seq),
 st AS (SELECT doc, idx, number AS kn, zone AS kz, idx AS own FROM b WHERE idx = 0 UNION ALL SELECT doc, idx, CASE WHEN j THEN kn ELSE number END, CASE WHEN j THEN kz ELSE zone END, CASE WHEN j THEN own ELSE idx END
 FROM (SELECT b.*, st.kn, st.kz, st.own, b.k < 3 AND b.zone = st.kz AND (b.number < st.kn OR b.k IN (1, 2)) AND coalesce(b.nx = st.kn + 1, false) AS j FROM st JOIN b ON b.doc = st.doc AND b.idx = st.idx + 1)),
 m AS (SELECT doc, own, string_agg(b.text, chr(10) || chr(10) ORDER BY idx) AS text FROM st JOIN b USING (doc, idx) GROUP BY doc, own)
 SELECT m.doc, row_number() OVER (PARTITION BY m.doc ORDER BY own) - 1 AS idx, b.number, m.text FROM m JOIN b ON b.doc = m.doc AND b.idx = m.own""")
def _(t):
    return N.merge_decimal_noise(_told(t, DECIMALS)).select("doc", "idx", "number", "text")


ANSWERS = f"CASE {DIGIT} % 4 WHEN 0 THEN concat(number, '. 【答案】A') WHEN 1 THEN concat(number, '. 解析：t') WHEN 2 THEN concat(number, '.(改编备用) t') ELSE concat(number, '. t') END"


@query("embedded_material", "W17", W + f""", b AS (SELECT doc, idx, number, zone, section, {ANSWERS} AS text, {DIGIT} % 4 AS k FROM seq),
 st AS (SELECT doc, idx, number AS kn, zone AS kz, section AS ks, k < 2 AS ka, idx AS own FROM b WHERE idx = 0 UNION ALL
 SELECT doc, idx, CASE WHEN j THEN kn ELSE number END, CASE WHEN j THEN kz ELSE zone END, CASE WHEN j THEN ks ELSE section END, CASE WHEN j THEN ka ELSE k < 2 END, CASE WHEN j THEN own ELSE idx END
 FROM (SELECT b.*, st.kn, st.kz, st.ks, st.ka, st.own, b.section = st.ks AND b.number <= st.kn AND st.ka AND b.zone = 'stem' AND st.kz = 'stem' AS j FROM st JOIN b ON b.doc = st.doc AND b.idx = st.idx + 1)),
 m AS (SELECT doc, own, string_agg(b.text, chr(10) || chr(10) ORDER BY idx) AS text FROM st JOIN b USING (doc, idx) WHERE idx = own OR k <> 2 GROUP BY doc, own)
 SELECT m.doc, row_number() OVER (PARTITION BY m.doc ORDER BY own) - 1 AS idx, b.number, m.text FROM m JOIN b ON b.doc = m.doc AND b.idx = m.own""")
def _(t):
    return N.merge_embedded_material(_told(t, ANSWERS)).select("doc", "idx", "number", "text")


def _both(rows, stem_number, solution_number, solution_text, solutions=None):
    """Stems of all lines, then solutions of some, one position after the other."""
    n = rows.groupBy("doc").agg(F.count("*").alias("n"))
    base = rows.join(n, "doc")
    stems = base.withColumn("zone", F.lit("stem")).withColumn("number", F.expr(stem_number).cast("int"))
    stems = stems.withColumn("text", F.expr("concat(coalesce(CAST(number AS STRING), '?'), '. ', text)"))
    answers = base.filter(solutions or "true").withColumn("zone", F.lit("solution")).withColumn("own", F.expr("n + idx")).withColumn("number", F.expr(solution_number).cast("int"))
    answers = answers.withColumn("text", F.expr(solution_text)).drop("idx").withColumnRenamed("own", "idx")
    keep = ["doc", "idx", "number", "zone", "section", "group", "text"]
    return materialise(stems.select(keep).unionByName(answers.select(keep)))


@query("shifted_tails", "W17", "WITH " + ORDERED + """, b AS (SELECT *, doc % 7 + 1 AS c, count(*) OVER (PARTITION BY doc) AS n FROM seq)
 SELECT doc, idx, CAST(idx + 1 AS INTEGER) AS number, (idx + 1) || '. ' || text AS text FROM b WHERE n >= 3 AND doc % 3 <> 0 AND c < n AND idx + 1 > c""")
def _(t):
    """One number is written twice and the rest follow on; every third order lacks the proof by its solutions."""
    blocks = _both(order_rows(t), "idx + 1 - CASE WHEN idx + 1 > doc % 7 + 1 THEN 1 ELSE 0 END", "CASE WHEN doc % 3 = 0 AND idx = 0 THEN 2 ELSE idx + 1 END", "concat(number, '. ', text)")
    return N.repair_shifted_tails(blocks).filter("repaired").select("doc", "idx", "number", "text")


@query("split_details", "W16", "WITH " + ORDERED + """, b AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM seq),
 a AS (SELECT *, idx + 1 < n AS two, idx + 1 < n AND NOT (doc % 3 = 0 AND idx = 0) AS cut, '【详解】' || text AS d FROM b WHERE idx % 2 = 0),
 x AS (SELECT doc, n + idx AS o, 0 AS p, idx + 1 AS number, (idx + 1) || '. A' || chr(10) || d || CASE WHEN cut THEN '' WHEN two THEN chr(10) || '【 解析 】' || text ELSE '' END AS text FROM a
 UNION ALL SELECT doc, n + idx, 1, idx + 2, (idx + 2) || '. 【 解析 】' || text FROM a WHERE cut
 UNION ALL SELECT doc, idx, 0, CASE WHEN doc % 3 = 0 AND idx = 1 THEN NULL ELSE idx + 1 END, CASE WHEN doc % 3 = 0 AND idx = 1 THEN '?' ELSE (idx + 1)::varchar END || '. ' || text FROM b)
 SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY o, p) - 1 AS idx, CAST(number AS INTEGER) AS number, text FROM x""")
def _(t):
    """Every second solution holds the worked answer of the next number too; in every third order the stems do not prove the first."""
    text = "concat(number, '. A\n【详解】', text, CASE WHEN idx + 1 < n THEN concat('\n【 解析 】', text) ELSE '' END)"
    blocks = _both(order_rows(t), "CASE WHEN doc % 3 = 0 AND idx = 1 THEN NULL ELSE idx + 1 END", "idx + 1", text, "idx % 2 = 0")
    return N.split_details(blocks).select("doc", "idx", "number", "text")
