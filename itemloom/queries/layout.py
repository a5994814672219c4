"""Fusion and page layout rules over coordinates derived from the tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fusion as FU, layout as LA, relocate as RL
from ..registry import query
from ._papers import PAPER, paper_blocks

W = f"WITH {PAPER} "
HEADS = """h AS (SELECT l_orderkey AS doc, l_suppkey % 5 AS page, CAST(l_quantity AS DOUBLE) AS top, l_linenumber AS number, l_shipdate, l_partkey FROM lineitem WHERE l_linestatus = 'F'),
 f AS (SELECT l_orderkey AS doc, l_suppkey % 5 AS page, CAST(l_quantity AS DOUBLE) AS top, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS figure FROM lineitem WHERE l_linestatus = 'O')"""


def heads(t):
    return t.lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 5).alias("page"), F.col("l_quantity").alias("top"), F.col("l_linenumber").alias("number"))


def figs(t):
    return t.lineitem.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 5).alias("page"), F.col("l_quantity").alias("top"),
                                                         F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("figure"))


@query("figure_owners", "J16", f"""WITH {HEADS} SELECT DISTINCT doc, page, figure, owner FROM (SELECT f.doc, f.page, f.figure, f.top, (SELECT number FROM h WHERE h.doc = f.doc AND h.page = f.page AND h.top <= f.top ORDER BY h.top DESC, h.number DESC LIMIT 1) AS owner FROM f) WHERE owner IS NOT NULL""")
def _(t):
    return LA.figure_owners(heads(t), figs(t)).distinct()


RISING = """hd AS (SELECT l_orderkey AS doc, l_linenumber AS number, l_linenumber // 3 AS page, 100.0 * l_linenumber + 0.0 AS top FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
 fg AS (SELECT l_orderkey AS doc, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS figure, l_linenumber // 3 AS page, 100.0 * l_linenumber + l_quantity AS top, 100.0 * l_linenumber + 3 * l_quantity AS bottom FROM lineitem)"""


def rising(t):
    n = F.col("l_linenumber")
    page = F.floor(n / 3).cast("int")
    h = t.lineitem.select(F.col("l_orderkey").alias("doc"), n.alias("number"), page.alias("page"), (n * 100.0).alias("top")).distinct()
    f = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("figure"), page.alias("page"),
                          (n * 100.0 + F.col("l_quantity")).alias("top"), (n * 100.0 + 3 * F.col("l_quantity")).alias("bottom"))
    e = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.lit(2).alias("page"), F.lit(830.0).alias("top")).distinct()
    return h, f, e


@query("contained_owners", "J17", f"""WITH {RISING}, nx AS (SELECT *, lead((page, top)) OVER (PARTITION BY doc ORDER BY number) AS np FROM hd)
 SELECT f.doc, f.figure, n.number AS owner FROM fg f JOIN nx n ON n.doc = f.doc AND (n.page, n.top) <= (f.page, f.top) AND (np IS NULL OR np > (f.page, f.top)) WHERE (f.page, f.bottom) < coalesce(np, (2, 830.0))""")
def _(t):
    h, f, e = rising(t)
    return LA.contained_owner(h, f, e).select("doc", "figure", F.col("owner").cast("int").alias("owner"))


@query("figures_outside_crops", "J28", f"""WITH {RISING} SELECT doc, figure FROM fg f WHERE bottom <= 1000 AND top < bottom AND NOT EXISTS (SELECT 1 FROM hd h WHERE h.doc = f.doc AND h.page = f.page AND h.number % 2 = 0 AND f.bottom >= h.top AND f.top <= h.top + 40)""")
def _(t):
    h, f, _e = rising(t)
    crops = h.filter("number % 2 = 0").select("doc", "page", "top", (F.col("top") + 40).alias("bottom"))
    return LA.outside_crops(f, crops).select("doc", "figure")


@query("returned_figures", "J28 J17", f"""WITH {RISING}, nx AS (SELECT *, lead((page, top)) OVER (PARTITION BY doc ORDER BY number) AS np FROM hd),
 o AS (SELECT * FROM fg f WHERE bottom <= 1000 AND top < bottom AND NOT EXISTS (SELECT 1 FROM hd h WHERE h.doc = f.doc AND h.page = f.page AND h.number % 2 = 0 AND f.bottom >= h.top AND f.top <= h.top + 40))
 SELECT f.doc, f.figure, n.number AS owner FROM o f JOIN nx n ON n.doc = f.doc AND (n.page, n.top) <= (f.page, f.top) AND (np IS NULL OR np > (f.page, f.top)) WHERE (f.page, f.bottom) < coalesce(np, (2, 830.0)) AND n.number <> 3""")
def _(t):
    h, f, e = rising(t)
    crops = h.filter("number % 2 = 0").select("doc", "page", "top", (F.col("top") + 40).alias("bottom"))
    return LA.return_figures(f, crops, h, e, h.filter("number <> 3")).select("doc", "figure", F.col("owner").cast("int").alias("owner"))


@query("layout_boxes", "S7", """SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * CASE WHEN greatest(abs(embedding[1]), abs(embedding[2]), abs(embedding[3]), abs(embedding[4])) <= 1.5 THEN 1000 ELSE 1 END, 3) AS x0 FROM embeddings""")
def _(t):
    box = LA.normal_box(F.slice("embedding", 1, 4))
    return t.embeddings.select("vec_id", F.round(F.get(box, 0), 3).alias("x0"))


@query("anchor_matches", "J18", """WITH q AS (SELECT doc_id AS question, lang AS doc, n_chars % 50 AS number, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS sig FROM documents)
 SELECT doc, item, min(question) AS question FROM (SELECT i.doc, i.question AS item, q.question FROM q i JOIN q ON q.doc = i.doc AND q.number = i.number WHERE length(i.sig) >= 12 AND (starts_with(q.sig, left(i.sig, 64)) OR (starts_with(left(i.sig, 64), q.sig) AND length(q.sig) >= 12))
 UNION ALL SELECT i.doc, i.question, q.question FROM q i JOIN q ON q.doc = i.doc AND q.number = i.number WHERE length(i.sig) < 12) GROUP BY doc, item HAVING count(*) = 1""")
def _(t):
    d = t.documents.select(F.col("lang").alias("doc"), F.col("doc_id").alias("item"), (F.col("n_chars") % 50).alias("number"), "text")
    return LA.resolve_anchors(d, d.withColumnRenamed("item", "question"))


@query("passage_pages", "J19", """WITH p AS (SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS body FROM documents), b AS (SELECT item_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS sig FROM benchmark)
 SELECT item_id AS item, min(doc_id) AS page FROM b JOIN p ON contains(body, sig) WHERE length(sig) >= 24 GROUP BY 1 HAVING count(*) = 1""")
def _(t):
    return LA.locate_on_pages(t.benchmark.select(F.col("item_id").alias("item"), "text"), t.documents.select(F.col("doc_id").alias("page"), "text"))


@query("window_pages", "J19", """WITH p AS (SELECT doc_id AS page, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS body FROM documents),
 i AS (SELECT item_id * 3 + k AS item, lower(regexp_replace(CASE k WHEN 0 THEN text WHEN 1 THEN text[:9] || '#?' || text[11:] ELSE text[:24] END, '[^\\p{L}\\p{N}]', '', 'g'))[:192] AS key FROM benchmark, range(3) r(k)),
 w AS (SELECT DISTINCT item, key[s + 1:s + n] AS w FROM i, (SELECT unnest([64, 48, 40, 32]) AS n), (SELECT unnest(range(0, 97, 16)) AS s) WHERE length(key) >= 32 AND s + n <= length(key) UNION SELECT item, key FROM i WHERE length(key) BETWEEN 1 AND 31),
 h AS (SELECT w, min(page) AS page FROM (SELECT DISTINCT w FROM w) JOIN p ON contains(body, w) GROUP BY w HAVING count(*) = 1)
 SELECT item, min(page) AS page, count(*) AS votes FROM w JOIN h USING (w) GROUP BY item HAVING min(page) = max(page)""")
def _(t):
    """Each passage whole, with one misread character, and as a short head."""
    text = F.col("text")
    items = t.benchmark.select(F.explode(F.array(*[F.struct((F.col("item_id") * 3 + k).alias("item"), c.alias("text")) for k, c in enumerate(
        (text, F.concat(F.left(text, F.lit(9)), F.lit("#?"), F.substr(text, F.lit(11))), F.left(text, F.lit(24))))])).alias("i")).select("i.*")
    return LA.locate_by_windows(items, t.documents.select(F.col("doc_id").alias("page"), "text"))


@query("page_alignment", "J20", """WITH pg AS (SELECT doc_id, i AS page, string_split(text, chr(10))[i + 1] AS fb, text FROM documents, (SELECT unnest([0, 1, 2]) AS i) WHERE len(string_split(text, chr(10))) > i),
 s AS (SELECT doc_id, page, CASE WHEN fb <> '' AND length(text) - length(replace(text, fb, '')) = length(fb) THEN instr(text, fb) END AS pos FROM pg),
 l AS (SELECT *, lag(coalesce(pos, -1)) OVER (PARTITION BY doc_id ORDER BY page) AS p FROM s) SELECT doc_id AS doc, bool_and(pos IS NOT NULL AND (p IS NULL OR p < pos)) AS aligned FROM l GROUP BY 1""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("doc"), "text")
    pages = d.select("doc", F.posexplode(F.slice(F.split("text", "\n"), 1, 3)).alias("page", "first_block"))
    pages = pages.withColumn("first_block", F.nullif("first_block", F.lit("")))
    return LA.align_pages(pages, d).groupBy("doc").agg(F.min("aligned").alias("aligned"))


@query("whole_page_alignment", "J20", """WITH pg AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS fb, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
 s AS (SELECT doc_id, page, CASE WHEN fb <> '' AND length(text) - length(replace(text, fb, '')) = length(fb) THEN instr(text, fb) END AS pos FROM pg),
 l AS (SELECT *, lag(coalesce(pos, -1)) OVER (PARTITION BY doc_id ORDER BY page) AS p FROM s) SELECT doc_id AS doc, bool_and(pos IS NOT NULL AND (p IS NULL OR p < pos)) AS aligned FROM l GROUP BY 1""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("doc"), "text")
    pages = d.select("doc", F.posexplode(F.split("text", "\n")).alias("page", "first_block"))
    pages = pages.withColumn("first_block", F.nullif("first_block", F.lit("")))
    return LA.align_pages(pages, d).groupBy("doc").agg(F.min("aligned").alias("aligned"))


@query("best_layout_files", "J26", """WITH a AS (SELECT l_orderkey AS source, l_suppkey % 4 AS file, count_if(l_returnflag = 'A') AS hits, count_if(l_returnflag <> 'A') AS amb FROM lineitem GROUP BY 1, 2),
 f AS (SELECT o_orderkey AS source, unnest([0, 1, 2, 3]) AS file FROM orders) SELECT source, arg_max(file, (coalesce(hits, 0), -coalesce(amb, 0), -file, file)) AS file, max(coalesce(hits, 0)) AS hits FROM f LEFT JOIN a USING (source, file) WHERE file <> source % 4 GROUP BY source""")
def _(t):
    anchors = t.lineitem.select(F.col("l_orderkey").alias("source"), (F.col("l_suppkey") % 4).cast("int").alias("file"), (F.col("l_returnflag") == "A").alias("unique_hit"))
    files = t.orders.select(F.col("o_orderkey").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("file"))
    files = files.select("source", "file", F.when(F.col("file") == F.col("source") % 4, 2).otherwise(1).alias("pages"), F.lit(1).alias("source_pages"), F.col("file").alias("format_rank"))
    return LA.best_layout_file(anchors, files)


@query("gap_crops", "W29", """WITH b AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS n FROM lineitem), s AS (SELECT *, lag(n) OVER (PARTITION BY doc ORDER BY n) AS p FROM b),
 g AS (SELECT doc, p + 1 AS first, n - 1 AS last, p, n FROM s WHERE n - p > 1 AND n - p <= 5) SELECT doc, first, last, page, CAST(CASE WHEN page = p // 2 THEN 100 * p ELSE 0 END AS DOUBLE) AS top, CAST(CASE WHEN page = n // 2 THEN 100 * n ELSE 1000 END AS DOUBLE) AS bottom
 FROM (SELECT *, unnest(generate_series(p // 2, n // 2)) AS page FROM g WHERE n // 2 - p // 2 < 3)""")
def _(t):
    from ..operators.sequence import missing_in_range
    nums = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number"))
    anchors = nums.distinct().select("doc", "number", F.floor(F.col("number") / 2).alias("page"), (F.col("number") * 100.0).alias("top"))
    return LA.plan_crops(missing_in_range(nums, ["doc"]).withColumnRenamed("missing", "number"), anchors)


@query("right_column_figures", "W32", """SELECT l_orderkey AS doc, min(400 + 10.0 * l_quantity) / 1000 AS ratio FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_suppkey % 2) = 1 AND min(400 + 10.0 * l_quantity + 30) > 500""")
def _(t):
    x0 = 400 + 10.0 * F.col("l_quantity")
    return LA.right_column_figures(t.lineitem.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 2).alias("page"), x0.alias("x0"), (x0 + 60).alias("x1")))


READ = """, pr AS (SELECT doc, idx, number, flag, text FROM paper WHERE zone = 'stem')"""


@query("fused_readings", "J15", f"""WITH o AS (SELECT l_orderkey AS doc, l_linenumber AS number, max(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
 pr AS (SELECT * FROM o WHERE q >= 25), al AS (SELECT *, lag(number) OVER w AS b, lead(number) OVER w AS a FROM o WINDOW w AS (PARTITION BY doc ORDER BY number))
 SELECT doc, number, CASE WHEN (doc, number) IN (SELECT (doc, number) FROM pr) THEN CASE WHEN f = 'A' THEN 'replaced' ELSE 'primary' END
 WHEN (CASE WHEN b IS NULL THEN number = 1 AND a = 2 AND EXISTS (SELECT 1 FROM pr WHERE pr.doc = al.doc AND pr.number = 2) WHEN a IS NULL THEN b = number - 1 AND EXISTS (SELECT 1 FROM pr WHERE pr.doc = al.doc AND pr.number = b)
 ELSE b = number - 1 AND a = number + 1 AND EXISTS (SELECT 1 FROM pr WHERE pr.doc = al.doc AND pr.number = b) AND EXISTS (SELECT 1 FROM pr WHERE pr.doc = al.doc AND pr.number = a) END) THEN 'inserted' ELSE 'left_out' END AS choice FROM al""")
def _(t):
    o = t.lineitem.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number")).agg(F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    base = F.concat(F.col("number").cast("string"), F.lit(". sufficiently long body text"))
    p = o.filter("q >= 25").select("doc", "number", base.alias("text"))
    a = o.select("doc", "number", F.when(F.col("f") == "A", F.concat(base, F.lit(" with twenty more letters"))).otherwise(base).alias("text"))
    return FU.fuse_readings(p, a, ["doc"]).select("doc", "number", "choice")


@query("exact_block_spans", "J27", """SELECT doc_id AS doc, i AS idx, instr(text, fb) AS "begin", instr(text, fb) + length(fb) AS "end" FROM (SELECT doc_id, text, i, string_split(text, chr(10))[i + 1] AS fb FROM documents, (SELECT unnest([0, 1]) AS i) WHERE len(string_split(text, chr(10))) > i) WHERE fb <> '' AND length(text) - length(replace(text, fb, '')) = length(fb)""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("doc"), "text")
    b = d.select("doc", F.posexplode(F.slice(F.split("text", "\n"), 1, 2)).alias("idx", "text")).filter("text <> ''")
    return FU.exact_spans(d, b, ["doc"])


@query("rebuilt_units", "J27", """SELECT doc_id AS doc, CASE WHEN fb <> '' AND length(text) - length(replace(text, fb, '')) = length(fb) THEN md5(replace(text, fb, '<new>')) ELSE md5(text) END AS digest FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS fb FROM documents)""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("doc"), "text")
    b = d.select("doc", F.posexplode(F.slice(F.split("text", "\n"), 1, 1)).alias("idx", "text")).filter("text <> ''")
    return FU.rebuild_units(d, FU.exact_spans(d, b, ["doc"]), b.withColumn("text", F.lit("<new>")), ["doc"]).select("doc", F.md5("text").alias("digest"))


def line_blocks(d):
    return d.select("doc", F.posexplode(F.split("text", "\n")).alias("idx", "text")).filter("text <> ''")


@query("whole_block_spans", "J27", """SELECT doc_id AS doc, CAST(i - 1 AS INTEGER) AS idx, instr(text, fb) AS "begin", instr(text, fb) + length(fb) AS "end"
 FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS fb, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE fb <> '' AND length(text) - length(replace(text, fb, '')) = length(fb)""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("doc"), "text")
    return FU.exact_spans(d, line_blocks(d), ["doc"])


@query("whole_rebuilt_units", "J27", """SELECT doc_id AS doc, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x <> '' AND length(text) - length(replace(text, x, '')) = length(x) THEN '<new>' ELSE x END), chr(10))) AS digest FROM documents""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("doc"), "text")
    b = line_blocks(d)
    return FU.rebuild_units(d, FU.exact_spans(d, b, ["doc"]), b.withColumn("text", F.lit("<new>")), ["doc"]).select("doc", F.md5("text").alias("digest"))


@query("namespaced_images", "J29", """WITH i AS (SELECT 'exam' AS side, 'p' || l_partkey AS name FROM lineitem WHERE l_returnflag = 'A' UNION SELECT 'solution', 'p' || l_partkey FROM lineitem WHERE l_returnflag = 'R')
 SELECT side, name, CASE WHEN name IN (SELECT name FROM i GROUP BY name HAVING count(DISTINCT side) > 1) THEN side || '_' || name ELSE name END AS merged_name FROM i""")
def _(t):
    side = F.when(F.col("l_returnflag") == "A", "exam").when(F.col("l_returnflag") == "R", "solution")
    i = t.lineitem.select(side.alias("side"), F.concat(F.lit("p"), "l_partkey").alias("name")).filter("side IS NOT NULL").distinct()
    return FU.namespaced(i)


@query("namespaced_lookup", "J29", """SELECT 'exam_p' || p_partkey AS name, p_size AS box FROM part UNION ALL SELECT 'p' || p_partkey, p_size FROM part""")
def _(t):
    boxes = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.col("p_size").alias("box"))
    refs = boxes.select("name").unionByName(boxes.select(F.concat(F.lit("exam_"), "name").alias("name")))
    return FU.lookup_namespaced(refs, boxes)


@query("grafted_options", "J30", W + """, s AS (SELECT doc, idx, number, flag FROM paper WHERE zone = 'stem'), r AS (SELECT doc, number, count(*) AS n FROM s WHERE flag = 'A' GROUP BY 1, 2)
 SELECT doc, idx, flag <> 'A' AND coalesce(n, 0) = 1 AS grafted FROM s LEFT JOIN r USING (doc, number)""")
def _(t):
    b = paper_blocks(t).filter("zone = 'stem'")
    return FU.graft_options(b, b.select("doc", "number", "text"), ["doc", "number"]).select("doc", "idx", "grafted")


def option_boxes(t):
    """One cell of two columns for each line of an order, in the lines' order."""
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_linestatus").orderBy("l_linenumber", "l_partkey", "l_suppkey"))  # the lines of one order
    k = F.col("l_partkey") % 2
    placed = t.lineitem.withColumn("n", n)
    n = F.col("n")
    return placed.select(
        "n", F.col("l_orderkey").alias("doc"), F.col("l_linestatus").alias("item"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("figure"), F.lit(0).alias("page"),
        (((n - 1) % 2) * 300.0 + k * 4).alias("x0"), (F.floor((n - 1) / 2) * 250.0).alias("y0"), (((n - 1) % 2) * 300.0 + 200).alias("x1"), (F.floor((n - 1) / 2) * 250.0 + 150).alias("y1"))


BOXES = """b AS (SELECT doc, item, n, (n - 1) // 2 AS y, (n - 1) % 2 AS x, figure FROM (SELECT l_orderkey AS doc, l_linestatus AS item, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS figure,
  row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem))"""


@query("option_reading_order", "W26", f"""WITH {BOXES} SELECT doc, item, chr(CAST(64 + row_number() OVER (PARTITION BY doc, item ORDER BY y, x) AS INTEGER)) AS label, figure
 FROM b WHERE (doc, item) IN (SELECT (doc, item) FROM b GROUP BY doc, item HAVING count(*) = 4)""")
def _(t):
    return LA.assign_options(option_boxes(t), None, "reading")


# A grid is two full rows, or four figures of one column; only a lone grid counts.
@query("option_unique_grid", "W27 W26", f"""WITH {BOXES}, r AS (SELECT doc, item, y, count(*) AS c FROM b GROUP BY ALL), p AS (SELECT doc, item, count(*) FILTER (c = 2) AS full_rows FROM r GROUP BY ALL),
 l AS (SELECT doc, item, count(*) FILTER (x = 0) AS left_ones FROM b GROUP BY ALL),
 g AS (SELECT doc, item, full_rows, left_ones FROM p JOIN l USING (doc, item) WHERE full_rows * (full_rows - 1) // 2 + CASE WHEN left_ones = 4 THEN 1 ELSE 0 END = 1),
 m AS (SELECT b.* FROM b JOIN g USING (doc, item) JOIN r USING (doc, item, y) WHERE CASE WHEN full_rows = 2 THEN c = 2 ELSE x = 0 END)
 SELECT doc, item, chr(CAST(64 + row_number() OVER (PARTITION BY doc, item ORDER BY y, x) AS INTEGER)) AS label, figure FROM m""")
def _(t):
    return LA.assign_options(option_boxes(t), None, "grid")


@query("option_least_cost", "W28", f"""WITH {BOXES} SELECT doc, item, chr(CAST(64 + n AS INTEGER)) AS label, figure FROM b WHERE n <= 4 AND (doc, item) IN (SELECT (doc, item) FROM b WHERE n <= 4 GROUP BY doc, item HAVING count(*) = 4)""")
def _(t):
    n = F.col("n")
    marks = option_boxes(t).select("doc", "item", F.char(n + 64).alias("label"), F.lit(0).alias("page"),
        (((n - 1) % 2) * 300.0 + 100).alias("x"), (F.floor((n - 1) / 2) * 250.0 + 160).alias("y")).distinct()
    return LA.assign_options(option_boxes(t), marks, "cost")


RELOCATED = f"""WITH {BOXES}, g AS (SELECT doc, item, count(*) AS n, list('![](images/' || figure || ')' ORDER BY n DESC) AS refs, list(figure ORDER BY n) AS f FROM b GROUP BY doc, item),
 t AS (SELECT *, CASE doc % 4 WHEN 0 THEN '题 ( )' WHEN 1 THEN '题 ( )' WHEN 2 THEN '题' ELSE '题 （ ）' END || chr(10) || array_to_string(refs, ' ') || CASE doc % 4 WHEN 0 THEN chr(10) || 'A. 甲 B. 乙 C. 丙 D. 丁' || chr(10) || '【解析】 x' WHEN 3 THEN chr(10) || '($A$) ($B$) ($C$) ($D$)' ELSE '' END AS text FROM g),
 r AS (SELECT *, list_transform(range(1, 5), lambda i: '![选项' || chr(CAST(64 + i AS INTEGER)) || '](images/' || f[i] || ')') AS o FROM t)
 SELECT doc, item, n = 4 AND doc % 4 <> 2 AS moved, CASE WHEN n <> 4 OR doc % 4 = 2 THEN text
 WHEN doc % 4 = 0 THEN '题 ( )' || chr(10) || '   ' || chr(10) || 'A.' || chr(10) || chr(10) || o[1] || ' 甲 B.' || chr(10) || chr(10) || o[2] || ' 乙 C.' || chr(10) || chr(10) || o[3] || ' 丙 D.' || chr(10) || chr(10) || o[4] || ' 丁' || chr(10) || chr(10) || '【解析】 x'
 ELSE CASE doc % 4 WHEN 1 THEN '题 ( )' ELSE '题 （ ）' END || array_to_string(list_transform(range(1, 5), lambda i: chr(10) || chr(10) || '(' || chr(CAST(64 + i AS INTEGER)) || ')' || chr(10) || chr(10) || o[i]), '') END AS text FROM r"""


@query("relocated_figures", "P15 W26", RELOCATED)
def _(t):
    """Bodies whose figures stand in reverse before labels, weak labels, none, or without an answer bracket."""
    boxes, case = option_boxes(t), F.col("doc") % 4
    refs = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("n", "figure")))), lambda x: F.concat(F.lit("![](images/"), x["figure"], F.lit(")")))
    bodies = boxes.groupBy("doc", "item").agg(F.array_join(refs, " ").alias("_r")).select("doc", "item", F.concat(
        F.when(case == 2, "题").when(case == 3, "题 （ ）").otherwise("题 ( )"), F.lit("\n"), F.col("_r"),
        F.when(case == 0, "\nA. 甲 B. 乙 C. 丙 D. 丁\n【解析】 x").when(case == 3, "\n($A$) ($B$) ($C$) ($D$)").otherwise("")).alias("text"))
    return RL.relocate_figures(bodies, LA.assign_options(boxes, None, "reading"))
