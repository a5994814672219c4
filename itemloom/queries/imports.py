"""Collections, text passes and import pipelines over derived papers."""

from pyspark.sql import functions as F

from ..functions import passes as PS
from ..operators import collections as C, loads as L
from ..plans import importing as IM
from ..registry import query
from ..scale import rank_in_key
from ._papers import PAPER, paper_blocks, paper_lines

W = f"WITH {PAPER} "


@query("outline_parts", "W13", """WITH r AS (SELECT o_custkey AS doc, o_orderkey AS page FROM orders WHERE o_orderstatus <> 'P'), ok AS (SELECT doc FROM r GROUP BY doc HAVING count(*) >= 2)
 SELECT doc, page AS start, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY page), 100000) AS stop, 'n' || page || ' 中学月考' AS title FROM r WHERE doc IN (SELECT doc FROM ok)""")
def _(t):
    good = t.orders.select(F.col("o_custkey").alias("doc"), F.lit(0).alias("seq"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("depth"), F.col("o_orderkey").alias("page"),
                           F.when(F.col("o_orderstatus") == "P", "一、选择题").otherwise(F.concat(F.lit("n"), F.col("o_orderkey").cast("string"), F.lit(" 中学月考"))).alias("title"))
    root = t.customer.select(F.col("c_custkey").alias("doc"), F.lit(0).alias("seq"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("page"), F.lit("数学试题").alias("title"))
    pages = t.customer.select(F.col("c_custkey").alias("doc"), F.lit(100000).cast("long").alias("page_count"))
    return C.discover_parts(good.unionByName(root), pages)[0].select("doc", "start", "stop", "title")


@query("title_pairs", "J6", """WITH e AS (SELECT p_brand AS collection, 'k' || p_size AS key, count(*) AS n FROM part WHERE p_type <> 'LARGE' GROUP BY 1, 2), s AS (SELECT p_brand AS collection, 'k' || p_size AS key, count(*) AS n FROM part WHERE p_type = 'LARGE' GROUP BY 1, 2)
 SELECT collection, key, CASE WHEN coalesce(e.n, 0) > 1 OR coalesce(s.n, 0) > 1 THEN 'duplicate' WHEN s.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'extra' ELSE 'ok' END AS state FROM e FULL JOIN s USING (collection, key)""")
def _(t):
    p = t.part.select(F.col("p_brand").alias("collection"), "p_type", F.concat(F.lit("Ｋ-"), F.col("p_size").cast("string"), F.when(F.col("p_type") == "LARGE", " 物理试题 参考答案").otherwise(" 物理")).alias("title"))
    return C.pair_parts(p.filter("p_type <> 'LARGE'"), p.filter("p_type = 'LARGE'")).select("collection", "key", "state")


@query("upload_groups", "J7", """SELECT CASE WHEN p_type = 'PROMO' THEN 'dir:' || p_brand ELSE 'doc:' || p_brand || '/卷' || p_size || 'x' END AS "group", count_if(p_retailprice % 2 < 1) AS exams, count_if(p_retailprice % 2 >= 1) AS solutions FROM part GROUP BY 1""")
def _(t):
    sol = F.col("p_retailprice") % 2 >= 1
    name = F.concat(F.lit("卷"), F.col("p_size").cast("string"), F.lit("x"), F.when(sol, "_答案 (1)").otherwise(""), F.when(F.col("p_type") == "PROMO", ".png").otherwise(".pdf"))
    return C.pair_uploads(t.part.select(F.col("p_brand").alias("folder"), name.alias("name")))


def units(t, side):
    n = F.col("n_nationkey")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == n).groupBy("n_regionkey", "n_nationkey").agg(F.count("*").alias("k"))
    rows = rank_in_key(rows, ["n_regionkey"], [n.asc()], "pos")
    topic = F.concat(F.lit("专题"), F.char(n + 65), F.lit("力学"))
    off = F.when((F.col("n_regionkey") == 1) & (F.col("pos") == 2), F.lit("别的")).otherwise(F.concat(topic, F.lit("力学")))
    return rows.filter("NOT (n_regionkey = 2 AND pos = 1)" if side == "s" else "true").select(
        F.col("n_regionkey").alias("collection"), "pos", topic.alias("title"), (topic if side == "e" else off).alias("topic"), F.col("pos").cast("int").alias("ordinal"),
        F.array(F.lit(1), F.lit(2)).alias("question_numbers"), F.lit(False).alias("number_reset"), F.lit(False).alias("generated_title"))


@query("unit_pairs", "J8 X24", """SELECT n_regionkey AS collection, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS pos FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_regionkey NOT IN (1, 2)""")
def _(t):
    return C.pair_units(units(t, "e"), units(t, "s"))[0].select("collection", "pos")


@query("title_lookback", "W31", W + """SELECT doc, '# 试卷' AS title FROM paper WHERE idx = 0 AND number = 1""")
def _(t):
    lines = paper_lines(t).filter("text NOT LIKE '一、%'")
    return C.titles_before(lines, F.col("text").startswith("#"), F.col("text").startswith("1. ")).select("doc", "title")


@query("rising_starts", "W5")
def _(t):
    return C.rising_starts(paper_blocks(t).select("doc", F.col("idx").alias("line_no"), "number"))


@query("normalized_blocks", "X13 X14", """SELECT p_partkey AS id, '已知 $\\displaystyle \\dfrac{1}{' || p_size || '} + \\cos x \\in \\mathbb{R}$, 求 ' || p_name || '. 再求 $x_{' || p_size || '}$: ___' || chr(10) || '（1）证明' AS text FROM part""")
def _(t):
    k = F.col("p_size").cast("string")
    raw = F.concat(F.lit("已知 $\\frac{1}{"), k, F.lit("} + cos x \\in \\mathbf{R}$，求 "), "p_name", F.lit("。再求 x<sub>"), k, F.lit("</sub>：____\n\n\n\n(1)证明。"))
    out = PS.normalize_block(raw)
    return t.part.select(F.col("p_partkey").alias("id"), F.regexp_replace(F.replace(out, F.lit("\n\n"), F.lit("\n")), r"\$\\displaystyle (x_\{\d+\})\$", r"\$$1\$").alias("text"))


@query("canonical_options", "X15", W + """SELECT doc, idx, CASE WHEN flag = 'A' THEN split_part(text, chr(10), 1) || chr(10) || chr(10) || '$\\displaystyle A.$ a' || split_part(text, '-', 2) || split_part(split_part(text, 'A. a', 2), ' ', 1) || chr(10) || '$\\displaystyle B.$ b' || split_part(split_part(text, 'B. b', 2), ' ', 1) || chr(10) || '$\\displaystyle C.$ c' || chr(10) || '$\\displaystyle D.$ d' ELSE text END AS text FROM paper WHERE zone = 'stem'""")
def _(t):
    return paper_blocks(t).filter("zone = 'stem'").select("doc", "idx", PS.canonical_options(F.col("text")).alias("text"))


@query("fill_blanks", "X17", """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name || ' ___' || chr(10) || '![[a.png]]' ELSE p_name || ' ___ x' END AS text FROM part""")
def _(t):
    body = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("\n![[a.png]]"))).otherwise(F.concat("p_name", F.lit(" ＿＿ x")))
    return t.part.select(F.col("p_partkey").alias("id"), PS.ensure_fill_blank(body, F.lit("填空题")).alias("text"))


@query("repaired_mojibake", "X20", "SELECT doc_id, text FROM documents")
def _(t):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t.documents.select("doc_id", PS.repair_mojibake(broken).alias("text"))


@query("publish_clean", "X33", r"""SELECT p_partkey AS id, '甲\\乙 $a\leq b$  $\therefore$  ' || p_name || ' $x$ end $\left( y \right.$' AS text FROM part""")
def _(t):
    raw = F.concat(F.lit("甲\\乙\u0007 $a\\leq b$ ∴ "), "p_name", F.lit("$$ $x$ end$$ $\\left( y \\right$"))
    return t.part.select(F.col("p_partkey").alias("id"), PS.publish_clean(raw).alias("text"))


@query("swapped_images", "X32", """SELECT p_partkey AS id, p_name || '![[b.png]] x ![[a.png|30]]' AS body, '0:20,1:10' AS layouts FROM part""")
def _(t):
    body = F.concat("p_name", F.lit("![[a.png|30]] x ![[b.png]]"))
    lay = F.array(F.struct(F.lit(0).alias("i"), F.lit(10).alias("w")), F.struct(F.lit(1).alias("i"), F.lit(20).alias("w")))
    text = F.array_join(F.transform(PS.swap_layouts(lay, 0, 1), lambda x: F.concat_ws(":", x["i"].cast("string"), x["w"].cast("string"))), ",")
    return t.part.select(F.col("p_partkey").alias("id"), PS.swap_images(body, 0, 1).alias("body"), text.alias("layouts"))


@query("option_change_set", "P10 K7", W + "SELECT doc, idx FROM paper WHERE zone = 'stem' AND flag = 'A'")
def _(t):
    b = paper_blocks(t).filter("zone = 'stem'").select(F.struct("doc", "idx").alias("id"), F.col("text").alias("body"))
    return L.change_set(b, PS.canonical_options(F.col("body"))).select("id.doc", "id.idx")


@query("assembled_items", "P5 X12", W + """, k AS (SELECT *, row_number() OVER (PARTITION BY doc, number, zone ORDER BY idx) AS k FROM paper) SELECT s.doc, s.idx, CASE WHEN s.flag = 'N' THEN '单选题' ELSE '单选题' END AS type,
 CASE WHEN a.idx IS NULL THEN '' ELSE substr(a.text, length(CAST(a.number AS VARCHAR)) + 3) END AS solution FROM (SELECT * FROM k WHERE zone = 'stem') s LEFT JOIN (SELECT * FROM k WHERE zone = 'solution') a USING (doc, number, k)""")
def _(t):
    b = paper_blocks(t).withColumn("section", F.lit("一、单选题"))
    return IM.assemble(b).select("doc", "idx", "type", "solution")


@query("import_preview", "P6 W19 J10", W + """, f AS (SELECT doc, idx, md5(regexp_replace(lower(text), '[^a-z0-9\\p{Han}]', '', 'g')) AS fp FROM paper WHERE zone = 'stem')
 SELECT doc, idx, CASE WHEN row_number() OVER (PARTITION BY fp ORDER BY CAST(doc AS VARCHAR) || '-' || lpad(CAST(idx AS VARCHAR), 9, '0')) > 1 THEN 'batch' ELSE 'new' END AS status FROM f""")
def _(t):
    b = paper_blocks(t).filter("zone = 'stem'").select("doc", "idx", F.col("text").alias("body"), F.lit("").alias("solution"))
    bank = t.part.select(F.md5(F.concat(F.lit("bank"), F.col("p_partkey").cast("string"))).alias("fingerprint"))
    return IM.preview(b, bank).select("doc", "idx", "status")


@query("import_gate", "P7 F13 W2 A6", W + """, s AS (SELECT doc, count(*) AS n, count(DISTINCT number) AS d, max(number) - min(number) + 1 AS w, bool_or(idx = 0 AND flag = 'R') AS review FROM paper WHERE zone = 'stem' GROUP BY doc)
 SELECT doc, n AS items FROM s WHERE n = d AND w = d AND NOT review""")
def _(t):
    from ..operators.predicates import mark_review
    from ..functions.text import REVIEW_MARKER
    b = paper_blocks(t).filter("zone = 'stem'")
    low = b.filter("idx = 0").filter(F.contains("text", F.lit("B. b")) & ~F.contains("text", F.lit("D. d")))
    notes = low.select("doc", mark_review(F.lit("options lost"), REVIEW_MARKER).alias("note"))
    return IM.gate(b, notes)[0].groupBy("doc").agg(F.count("*").alias("items"))


@query("collection_load", "P12 K1", W + """, s AS (SELECT doc FROM paper WHERE zone = 'stem' GROUP BY doc HAVING count(*) = count(DISTINCT number) AND max(number) - min(number) + 1 = count(*))
 SELECT substr(sha256(CAST(doc AS VARCHAR) || chr(0) || idx), 1, 12) AS id, doc, idx FROM paper JOIN s USING (doc) WHERE zone = 'stem'""")
def _(t):
    b = paper_blocks(t).filter("zone = 'stem'")
    good, _held = IM.gate(b, b.limit(0).select("doc", F.lit("").alias("note")))
    rows = good.select(F.col("doc").cast("string").alias("scope"), "doc", "idx", F.col("text").alias("body"), F.lit("").alias("solution"), F.lit("").alias("type"), F.lit("").alias("source"), "number")
    bank = rows.limit(0).select(F.lit("").alias("id"), F.col("scope").alias("import_scope"), F.col("idx").alias("import_index"), "body", "solution", "type", "source", "number")
    return L.rows_to_insert(rows, bank).select("id", "doc", "idx")


@query("recovered_validation", "P13", W + """, e AS (SELECT DISTINCT doc, number FROM paper WHERE zone = 'stem'), b AS (SELECT doc, number, count(*) AS n, min(flag) AS f FROM paper WHERE zone = 'stem' GROUP BY 1, 2)
 SELECT doc, number, CASE WHEN n <> 1 THEN 'not_once' WHEN f = 'R' THEN 'ok' ELSE 'ok' END AS state FROM e JOIN b USING (doc, number)""")
def _(t):
    b = paper_blocks(t).filter("zone = 'stem'").withColumn("text", F.concat(F.lit("本题的题干足够长所以可以通过字数检查要求二十字以上"), "text"))
    return IM.recovered_blocks(b.select("doc", "number").distinct(), b).select("doc", "number", "state")


MD = {k: lambda doc, n, k=k, c=c: F.concat(*[F.md5(F.concat_ws("-", doc, n, F.lit(f"{k}{i}"))) for i in range(c)]) for k, c in (("own", 3), ("rec", 4), ("more", 3))}
TAILS = """WITH d AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS number FROM lineitem),
 t AS (SELECT *, md5(doc || '-' || number || '-own0') || md5(doc || '-' || number || '-own1') || md5(doc || '-' || number || '-own2') AS own,
 md5(doc || '-' || (number + 1) || '-rec0') || md5(doc || '-' || (number + 1) || '-rec1') || md5(doc || '-' || (number + 1) || '-rec2') || md5(doc || '-' || (number + 1) || '-rec3') AS rec,
 md5(doc || '-' || number || '-more0') || md5(doc || '-' || number || '-more1') || md5(doc || '-' || number || '-more2') AS more FROM d)"""


@query("trimmed_tails", "P14", TAILS + """ SELECT doc, number, number % 4 = 1 AS trimmed, CASE number % 4 WHEN 1 THEN own WHEN 2 THEN own || chr(10) || rec[:40] || ' ' || more WHEN 3 THEN own || chr(10) || rec[:70] || '![](a.png)' || rec[71:] ELSE rec || chr(10) || own END AS text FROM t""")
def _(t):
    """A swallowed next solution goes; a quoted head, a tail with an image and a text that begins with the passage stay."""
    d = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number")).distinct()
    after = F.col("number") + 1
    own, rec, more = MD["own"]("doc", "number"), MD["rec"]("doc", after), MD["more"]("doc", "number")
    cases = (F.when(F.col("number") % 4 == 1, F.concat(own, F.lit("\n"), F.left(rec, F.lit(64)), F.lit(" $\\displaystyle $ "), F.substr(rec, F.lit(65))))
             .when(F.col("number") % 4 == 2, F.concat(own, F.lit("\n"), F.left(rec, F.lit(40)), F.lit(" "), more))
             .when(F.col("number") % 4 == 3, F.concat(own, F.lit("\n"), F.left(rec, F.lit(70)), F.lit("![](a.png)"), F.substr(rec, F.lit(71)))).otherwise(F.concat(rec, F.lit("\n"), own)))
    found = d.select("doc", after.alias("number"), F.concat(after.cast("string"), F.lit(". "), F.upper(rec)).alias("text"))
    return IM.trim_swallowed_tail(d.withColumn("text", cases), found)


@query("next_unit_titles", "P14", TAILS + """ SELECT doc, number, number % 3 = 0 AS untitled, own || CASE number % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '## Unit ' || doc || chr(10) || more ELSE chr(10) || 'Unit ' || doc END AS text FROM t""")
def _(t):
    """A heading that is the next unit's title goes from the end; before more text, or as plain text, it stays."""
    d = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number")).distinct()
    title = F.concat(F.lit("Unit "), F.col("doc").cast("string"))
    end = (F.when(F.col("number") % 3 == 0, F.concat(F.lit("\n## "), title, F.lit("\n \n"))).when(F.col("number") % 3 == 1, F.concat(F.lit("\n## "), title, F.lit("\n"), MD["more"]("doc", "number")))
           .otherwise(F.concat(F.lit("\n"), title)))
    return IM.trim_next_title(d.withColumn("text", F.concat(MD["own"]("doc", "number"), end)), d.withColumn("title", F.concat(F.lit("unit  "), F.col("doc").cast("string"))))


@query("titled_units", "W12", """WITH n AS (SELECT DISTINCT l_orderkey AS doc, l_returnflag AS f, l_linenumber AS num FROM lineitem), g AS (SELECT doc, f, count(*) AS k, min(num) AS lo, max(num) AS hi FROM n GROUP BY 1, 2),
 v AS (SELECT *, k >= 2 AND lo = 1 AND k >= hi * 0.8 AS ok FROM g), d AS (SELECT doc, count_if(ok) AS c, min(CASE WHEN ok THEN f END) AS first, max(CASE WHEN NOT ok THEN f END) AS open FROM v GROUP BY 1)
 SELECT doc, f AS title_key, k AS numbers FROM v JOIN d USING (doc) WHERE ok AND c >= 2 AND (open IS NULL OR open < first)""")
def _(t):
    sec = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    li = t.lineitem.select(F.col("l_orderkey").alias("doc"), (sec * 1000 + 10 + F.col("l_linenumber")).cast("long").alias("line_no"), F.lit(False).alias("is_title"),
                           F.lit(None).cast("string").alias("key"), F.col("l_linenumber").alias("number")).distinct()
    ti = t.lineitem.select(F.col("l_orderkey").alias("doc"), (sec * 1000).cast("long").alias("line_no"), F.lit(True).alias("is_title"), F.col("l_returnflag").alias("key"), F.lit(None).cast("int").alias("number")).distinct()
    twice = ti.withColumn("line_no", F.col("line_no") + 1)
    return C.titled_units(li.unionByName(ti).unionByName(twice))[0].select("doc", "title_key", "numbers")


@query("split_glued_heads", "X34", """SELECT p_partkey AS id, '10. A【答案】' || p_name || chr(10) || chr(10) || '11. B【详解】x' || chr(10) || chr(10) || '12. (1) y 1.13. z' AS text FROM part""")
def _(t):
    raw = F.concat(F.lit("10. A【答案】"), "p_name", F.lit("  11. B【详解】x 12. (1) y 1.13. z"))
    return t.part.select(F.col("p_partkey").alias("id"), PS.split_glued_heads(raw, F.array(F.lit(10), F.lit(11), F.lit(12), F.lit(13))).alias("text"))


@query("option_columns", "X27", """SELECT p_partkey AS id, CASE WHEN length(replace(p_name, ' ', '')) + 3 <= 10 THEN 4 WHEN length(replace(p_name, ' ', '')) + 3 <= 28 THEN 2 ELSE 1 END AS cols FROM part""")
def _(t):
    opts = F.array(F.lit("A. 1"), F.concat(F.lit("$\\displaystyle B.$ "), "p_name", F.lit("$\\dfrac{123}{4}$")))
    return t.part.select(F.col("p_partkey").alias("id"), PS.option_columns(opts).alias("cols"))


@query("merged_duplicates", "W18", """WITH d AS (SELECT DISTINCT l_orderkey AS doc, l_partkey, l_suppkey FROM lineitem) SELECT doc, CAST(sum(CASE WHEN l_partkey < 10 THEN 3 ELSE 2 END) AS BIGINT) AS blocks FROM d GROUP BY doc""")
def _(t):
    from ..plans.segment import merge_duplicate_blocks
    from ..scale import heavy_chunk, row_number, scan
    d = t.lineitem.select(F.col("l_orderkey").alias("doc"), "l_partkey", "l_suppkey").distinct()
    placed = scan(heavy_chunk(d, ["doc"], F.col("l_partkey")), ["doc"], ["l_partkey", "l_suppkey"], F.col("_hc"), {"k": row_number()})
    long = F.repeat(F.concat(F.lit("由题意可知"), F.col("l_partkey").cast("string"), F.lit("的解法")), F.lit(20))
    rows = placed.select("doc", "k", F.explode(F.array(*[F.struct(F.lit(i).alias("j"), x.alias("text")) for i, x in enumerate([F.left(long, F.lit(50)), long, F.lit("别的题")])])).alias("b"))
    blocks = rows.select("doc", ((F.col("k") - 1) * 3 + F.col("b.j")).alias("idx"), F.when(F.col("b.j") < 2, F.col("k") * 2).otherwise(F.col("k") * 2 + 1).cast("int").alias("number"), F.col("b.text").alias("text"),
                         F.lit("s").alias("section"), F.lit(None).cast("string").alias("group"), F.lit("solution").alias("zone"), F.col("k").alias("line_no"))
    return merge_duplicate_blocks(blocks).groupBy("doc").agg(F.count("*").alias("blocks"))
