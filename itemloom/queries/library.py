"""Assets, retention, sampling, composition and tables over the driver tables."""

from pyspark.sql import functions as F

from ..operators import assets as A, audit as AU, compose as C, sampling as SM, tables as TB
from ..registry import query
from ._items import ITEMS, items
from ._papers import PAPER, paper_blocks

WI = f"WITH {ITEMS} "
W = f"WITH {PAPER} "

REFS = r"""refs AS (SELECT page_id AS doc, lower(regexp_replace(h, '^.*/', '')) AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages)),
 assets AS (SELECT lower(split_part(text, ' ', 1)) AS name, min(n_chars) AS size, min(doc_id) AS k FROM documents GROUP BY 1),
 cls AS (SELECT name, size, k, CASE WHEN name IN (SELECT name FROM refs) THEN 'referenced' WHEN k % 7 = 0 THEN 'recent' ELSE 'orphan' END AS state FROM assets)"""


def _refs(t):
    hrefs = t.pages.select(F.col("page_id").alias("doc"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("h"))
    return hrefs.select("doc", F.lower(F.regexp_replace("h", "^.*/", "")).alias("name"))


def _assets(t):
    named = t.documents.groupBy(F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("name")).agg(F.min("n_chars").alias("size"), F.min("doc_id").alias("k"))
    return named.withColumn("mtime", F.timestamp_seconds(F.when(F.col("k") % 7 == 0, 999_900).otherwise(500_000)))




def _now():
    return F.timestamp_seconds(F.lit(1_000_000))


@query("asset_states", "J11 S9", f"WITH {REFS} SELECT name, size, state FROM cls")
def _(t):
    return A.classify_assets(_assets(t), _refs(t), _now()).select("name", "size", "state")


@query("asset_summary", "A18 J11", f"""WITH {REFS} SELECT count(*) AS files, count_if(state = 'referenced') AS referenced, count_if(state = 'recent') AS recent, CAST(coalesce(sum(size) FILTER (state = 'recent'), 0) AS BIGINT) AS recent_bytes,
 count_if(state = 'orphan') AS orphans, CAST(coalesce(sum(size) FILTER (state = 'orphan'), 0) AS BIGINT) AS orphan_bytes, (SELECT count(DISTINCT name) FROM refs WHERE name NOT IN (SELECT name FROM assets)) AS missing_references FROM cls""")
def _(t):
    refs = _refs(t)
    return A.asset_summary(A.classify_assets(_assets(t), refs, _now()), refs)


@query("confirmed_deletes", "J12", f"WITH {REFS} SELECT name, size FROM cls WHERE state = 'orphan' AND size % 5 <> 0")
def _(t):
    before = A.classify_assets(_assets(t), _refs(t), _now())
    changed = _assets(t).withColumn("size", F.when(F.col("size") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return A.confirmed_deletes(before, A.classify_assets(changed, _refs(t), _now())).select("name", "size")


@query("embed_references", "X23 U2", """SELECT doc_id, unnest(['pic' || doc_id || '.svg', 'orig' || n_chars || '.jpg', 'pic' || doc_id || '.pdf']) AS name FROM documents""")
def _(t):
    body = F.concat("text", F.lit(" ![[a/b/Pic"), F.col("doc_id").cast("string"), F.lit(".SVG|300]]"))
    orig = F.array(F.struct(F.lit(0).alias("i"), F.concat(F.lit("x/orig"), F.col("n_chars").cast("string"), F.lit(".jpg")).alias("orig")))
    return t.documents.select("doc_id", F.explode(A.references(body, orig)).alias("name"))


@query("reference_loss", "A19 U3", f"""WITH {REFS}, o AS (SELECT doc, name FROM refs WHERE length(name) > 4), a AS (SELECT doc, name, count(*) AS a FROM refs GROUP BY 1, 2), b AS (SELECT doc, name, count(*) AS b FROM o GROUP BY 1, 2)
 SELECT doc, name, a - coalesce(b, 0) AS lost FROM a LEFT JOIN b USING (doc, name) WHERE a > coalesce(b, 0)""")
def _(t):
    r = _refs(t)
    return A.reference_loss(r, r.filter(F.length("name") > 4))


@query("outermost_roots", "S10", """WITH r AS (SELECT DISTINCT lang AS root FROM documents WHERE lang <> 'en' UNION SELECT DISTINCT lang || '/' || source FROM documents) SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r s WHERE starts_with(r.root, s.root || '/'))""")
def _(t):
    d = t.documents
    roots = d.filter("lang <> 'en'").select(F.col("lang").alias("root")).unionByName(d.select(F.concat_ws("/", "lang", "source").alias("root")))
    return A.outermost_roots(roots)


@query("files_of_roots", "S10", WI + "SELECT DISTINCT path FROM items WHERE folder LIKE 'de/%' OR folder = 'en/src1'")
def _(t):
    roots = t.documents.filter("lang = 'de' OR (lang = 'en' AND source = 'src1')").select(
        F.when(F.col("lang") == "de", F.lit("de/")).otherwise("en/src1").alias("root")).unionByName(
        t.documents.filter("lang = 'de'").select(F.concat_ws("/", "lang", "source").alias("root"))).distinct()
    return A.files_below(items(t).select("path"), roots)


@query("attachment_kinds", "S8", WI + """SELECT folder || '/' || id || CASE WHEN starred THEN '答案' ELSE '' END || '.pdf' AS path, CASE WHEN starred THEN 'solution' ELSE 'exam' END AS kind FROM items WHERE folder LIKE 'fr/%' AND type <> '单选题'""")
def _(t):
    ext = F.when(F.col("type") == "单选题", ".MD").otherwise(".pdf")
    files = items(t).select(F.concat("folder", F.lit("/"), F.col("id").cast("string"), F.when(F.col("starred"), "答案").otherwise(""), ext).alias("path"), F.length("body").alias("size"))
    return A.attachments(files, "fr").select("path", "kind")


@query("expired_files", "R3", """WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, m WHERE ts < now - INTERVAL 24 HOUR AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 40)""")
def _(t):
    now = t.events.select(F.max("ts")).scalar()
    files = t.events.select("event_id", F.col("user_id").alias("path"), F.col("ts").alias("mtime"))
    active = t.events.filter("event_type = 'error' AND value > 40").select(F.col("user_id").alias("path"))
    return A.expired_files(files, active, now).select("event_id")


@query("expired_tasks", "R4", """SELECT event_id FROM events WHERE event_type = 'view' OR epoch(ts) < 1706745600 - 7 * 86400""")
def _(t):
    at = F.when(F.col("event_type") == "view", "soon").otherwise((A.micros(F.col("ts")) / 1e6).cast("string"))
    return A.expired_tasks(t.events.select("event_id", at.alias("updated_at")), F.lit(1706745600.0)).select("event_id")


@query("interrupted_tasks", "R5 S11", """SELECT event_id, CASE WHEN event_type IN ('click', 'error') OR value > 10 THEN 'interrupted' ELSE event_type END AS status,
 CASE WHEN value > 10 THEN 'interrupted' ELSE 'done' END AS group_status FROM events""")
def _(t):
    g = F.array(F.struct(F.lit(1).alias("gid"), F.when(F.col("value") > 10, " Converting").otherwise("done").alias("status"), F.lit(None).cast("string").alias("error")))
    tasks = t.events.select("event_id", F.col("event_type").alias("status"), F.lit(None).cast("string").alias("error"), g.alias("groups"))
    out = A.mark_interrupted(tasks, ["click", "error", "converting"], "restarted", F.lit(0.0))
    return out.select("event_id", "status", F.col("groups")[0]["status"].alias("group_status"))


STATUS = "CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'converting' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'pending' ELSE 'awaiting_block_review' END"


def groups(t):
    e = F.col("event_type")
    s = F.when(e == "view", "done").when(e == "click", "converting").when(e == "error", "error").when(e == "purchase", "pending").otherwise("awaiting_block_review")
    return t.events.select("event_id", "ts", F.col("user_id").alias("batch"), s.alias("status"), F.when(F.col("value") > 20, "imported").alias("reviewed"))


@query("batch_overview", "A8", f"""WITH g AS (SELECT user_id AS batch, {STATUS} AS s, value > 20 AS r FROM events) SELECT batch, count(*) AS total, count_if(s IN ('done', 'error', 'awaiting_block_review')) AS done, count_if(s = 'converting') AS converting,
 count_if(s = 'pending') AS pending, count_if(s = 'done' AND NOT r) AS ready, count_if(s = 'awaiting_block_review') AS awaiting_block_review, count_if(r) AS reviewed, count_if(s = 'error') AS errors, bool_and(s = 'error' OR r) AS finished FROM g GROUP BY batch""")
def _(t):
    return A.batch_overview(groups(t))


@query("unfinished_sources", "F12", WI + """SELECT DISTINCT folder FROM items WHERE folder NOT IN (SELECT folder FROM items WHERE type = '单选题' AND starred) OR folder NOT IN (SELECT d.lang || '/' || d.source FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1)""")
def _(t):
    i = items(t)
    originals = t.documents.join(t.labels.filter("toxic = 1"), "doc_id").select(F.concat_ws("/", "lang", "source").alias("folder"))
    return A.ready_sources(i.select("folder").distinct(), i.filter("type = '单选题' AND starred"), originals)


@query("reusable_work", "J25", """SELECT o_orderpriority AS year, o_custkey AS file, max(o_orderkey) AS batch FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0 GROUP BY 1, 2""")
def _(t):
    done = t.orders.select(F.col("o_orderpriority").alias("year"), F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("batch"),
                           F.col("o_orderkey").alias("group"), (F.col("o_orderstatus") == "F").alias("has_output"))
    pending = done.filter("file % 2 = 0").select("year", "file")
    return A.reusable_work(pending, done).select("year", "file", "batch")


@query("progress_by_year", "A25", """SELECT year(o_orderdate) AS year, count(*) AS sources, count_if(o_orderstatus = 'F') AS complete, count_if(o_orderstatus = 'P') AS anomalies, count_if(o_orderstatus NOT IN ('F', 'P')) AS remaining FROM orders GROUP BY 1""")
def _(t):
    s = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "anomaly").otherwise("open")
    return A.progress(t.orders.select(F.year("o_orderdate").alias("year"), s.alias("state")))


@query("recognition_totals", "A17", W + """, k AS (SELECT doc, count_if(zone = 'stem') AS q, count_if(zone = 'solution') AS s FROM paper GROUP BY doc) SELECT count(*) AS papers, CAST(sum(q) AS BIGINT) AS questions, CAST(sum(s) AS BIGINT) AS solutions, count_if(q > s) AS short FROM k""")
def _(t):
    z = F.col("zone")
    per = paper_blocks(t).groupBy("doc").agg(F.count_if(z == "stem").alias("q"), F.count_if(z == "solution").alias("s"))
    return per.agg(F.count("*").alias("papers"), F.sum("q").alias("questions"), F.sum("s").alias("solutions"), F.count_if(F.col("q") > F.col("s")).alias("short"))


@query("recognition_by_file", "A23", W + """SELECT doc, CAST(sum(length(text)) AS BIGINT) AS chars, count_if(zone = 'stem') AS stems, CAST(sum(len(regexp_extract_all(text, '!\\[[^\\]]*\\]\\([^)]*\\)'))) AS BIGINT) AS image_refs FROM paper GROUP BY doc""")
def _(t):
    return paper_blocks(t).groupBy("doc").agg(F.sum(F.length("text")).alias("chars"), F.count_if(F.col("zone") == "stem").alias("stems"),
                                              F.sum(F.regexp_count("text", F.lit(r"!\[[^\]]*\]\([^)]*\)"))).alias("image_refs"))


@query("truncated_replies", "A24", """WITH r AS (SELECT o_orderkey AS id, 1 + o_orderkey % 9 AS expected, o_custkey % 7 AS got FROM orders) SELECT id, CAST(expected AS INTEGER) AS expected, CAST(got AS INTEGER) AS got FROM r WHERE expected >= 3 AND expected - got >= 2""")
def _(t):
    line = lambda n, f: F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), f), "\n")
    want, got = 1 + F.col("o_orderkey") % 9, F.col("o_custkey") % 7
    draft = F.concat(F.lit("<草稿>"), line(want, lambda i: F.concat(i.cast("string"), F.lit(". 题"))), F.lit("\n# 参考答案与解析\n55. 答</草稿>"))
    reply = F.when(got > 0, line(F.greatest(got, F.lit(1)), lambda i: F.lit("- 题"))).otherwise("")
    logs = t.orders.select(F.col("o_orderkey").alias("id"), draft.alias("request"), reply.alias("reply"), F.lit("stop").alias("finish"), F.lit("").alias("system"))
    return AU.truncated_replies(logs)


@query("sampling_hash_order", "R1", """SELECT year(o_orderdate) AS year, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY sha256(year(o_orderdate) || chr(0) || 'f' || o_orderkey)) AS place FROM orders""")
def _(t):
    from ..scale import rank_in_key
    f = t.orders.select(F.year("o_orderdate").alias("year"), "o_orderkey")
    f = f.withColumn("s", SM.score(F.col("year"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))))
    return rank_in_key(f, ["year"], [F.col("s").asc(), F.col("o_orderkey").asc()], "place").select("year", "o_orderkey", "place")


def exam_files(t):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 3 == 0, "全国").otherwise("某地"), F.when(k % 4 == 1, "文科").when(k % 4 == 2, "理科").otherwise(""), F.when(k % 11 == 0, "春季").otherwise(""), k.cast("string"))
    return t.orders.select(F.year("o_orderdate").alias("year"), name.alias("name"))


@query("stratified_sample", "R1")
def _(t):
    return SM.choose(exam_files(t), 0.05)


@query("sampling_plan_totals", "R2", """SELECT year(o_orderdate) AS year, count(*) AS source_count, CAST(greatest(1, least(count(*), floor(count(*) * 0.05 + 0.5))) AS BIGINT) AS sample_count,
 CAST(greatest(1, least(count(*), floor(count(*) * 0.05 + 0.5))) AS DOUBLE) / count(*) AS actual_rate FROM orders GROUP BY 1""")
def _(t):
    f = exam_files(t)
    return SM.plan_totals(f, SM.choose(f, 0.05))


PART = """p AS (SELECT p_partkey AS id, p_brand AS paper, CASE p_type WHEN 'ECONOMY' THEN '单选题' WHEN 'SMALL' THEN '多选题' WHEN 'LARGE' THEN '填空题' ELSE '解答题' END AS type, p_size FROM part)"""


def part_items(t):
    k = F.col("p_type")
    kind = F.when(k == "ECONOMY", "单选题").when(k == "SMALL", "多选题").when(k == "LARGE", "填空题").otherwise("解答题")
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("paper"), kind.alias("type"), "p_size",
                         F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("solution"))


BUCKET = "CASE type WHEN '单选题' THEN 0 WHEN '多选题' THEN 1 WHEN '填空题' THEN 2 ELSE 3 END"


def _order():
    return [F.col("p_size").asc(), F.col("id").asc()]


@query("numbered_by_type", "W20 P16", f"""WITH {PART} SELECT id, paper, row_number() OVER (PARTITION BY paper ORDER BY {BUCKET}, p_size, id) AS num, dense_rank() OVER (PARTITION BY paper ORDER BY {BUCKET}) AS section FROM p""")
def _(t):
    return C.numbered_by_type(part_items(t), "paper", _order()).select("id", "paper", "num", "section")


@query("numbered_in_order", "W21 P16", f"""WITH {PART} SELECT id, row_number() OVER (PARTITION BY paper ORDER BY p_size, id) AS num, CASE WHEN p_size > 45 THEN 'full' WHEN {BUCKET} < 3 THEN 'slot_quarter' ELSE 'slot_half' END AS slot FROM p""")
def _(t):
    return C.numbered_in_order(part_items(t), "paper", _order(), "two", F.col("p_size") > 45).select("id", "num", "slot")


@query("solution_appendix", "W22 P16", f"""WITH {PART} SELECT paper, num, p_name AS solution FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY {BUCKET}, p_size, id) AS num FROM p) JOIN part ON p_partkey = id WHERE part.p_size % 3 > 0""")
def _(t):
    return C.solution_appendix(C.numbered_by_type(part_items(t), "paper", _order()))


@query("section_scores", "A20 P16", f"""WITH {PART}, b AS (SELECT paper, {BUCKET} AS bucket, count(*) AS items FROM p GROUP BY 1, 2) SELECT paper, bucket, items, CASE bucket WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 5 END AS points, CASE bucket WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 5 END * items AS total FROM b""")
def _(t):
    return C.section_scores(part_items(t), "paper")


@query("answer_spaces", "X29", """SELECT l_orderkey AS doc, l_linenumber AS n, CAST(least(2.0 + 0.5 * (l_linenumber - 1), 4.0) AS DOUBLE) AS std, CAST(least(3.0 + (least(5, l_suppkey % 7 + 1) - 1) + 1.5 * (l_linenumber - 1), 12.0) AS DOUBLE) AS practice FROM lineitem""")
def _(t):
    body = F.concat(F.lit("题"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: F.concat(F.lit("\n（"), i.cast("string"), F.lit("）问"))), ""))
    return t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), C.answer_space(body).alias("std"),
                             C.practice_space(body, (F.col("l_suppkey") % 7 + 1).cast("string")).alias("practice"))


@query("image_defaults", "X30", f"""WITH {PART} SELECT id, CASE WHEN p_size % 3 = 0 THEN NULL WHEN {BUCKET} < 2 THEN CASE WHEN p_size % 3 > 1 THEN 'between' ELSE 'opts' END WHEN {BUCKET} = 2 THEN 'between' ELSE 'after' END AS mode,
 CASE WHEN p_size % 3 > 0 AND (({BUCKET} < 2 AND p_size % 3 > 1) OR {BUCKET} >= 2) THEN 'row' ELSE 'column' END AS flow FROM p""")
def _(t):
    d = C.image_defaults(F.col("type"), F.col("p_size") % 3, "physics")
    return part_items(t).select("id", d["mode"].alias("mode"), d["flow"].alias("flow"))


@query("question_parts", "X35", """SELECT p_partkey AS id, k - 1 AS part_no, CASE WHEN k = 1 THEN p_name WHEN k = 2 THEN '（1）' || p_brand ELSE '（2）' || p_type END AS text FROM part, (SELECT unnest([1, 2, 3]) AS k)""")
def _(t):
    body = F.concat("p_name", F.lit("\n（1）"), "p_brand", F.lit("\n　（2）"), "p_type")
    return C.parts(t.part.select(F.col("p_partkey").alias("id"), body.alias("body")))


@query("figure_groups", "W30", """SELECT p_partkey AS id, k AS i, CASE WHEN k < 3 THEN 1 ELSE 2 END AS run, CASE WHEN k = 2 THEN 1 ELSE 0 END AS pair, '![[f' || k || '.png]]' AS figure FROM part, (SELECT unnest([0, 1, 2, 3]) AS k)""")
def _(t):
    body = F.concat("p_name", F.lit("\n![[f0.png]]\n![[f1.png]] ![[f2.png]]\n"), "p_brand", F.lit("![[f3.png]]"))
    return C.figure_groups(t.part.select(F.col("p_partkey").alias("id"), body.alias("body")))


@query("html_table_cells", "X21", """SELECT p_partkey AS id, 0 AS tbl, r AS row, c AS col, CASE WHEN r = 0 AND c = 0 THEN 'name & brand' WHEN r = 0 THEN 'size' WHEN c = 0 THEN p_name || ' ' || p_brand ELSE CAST(p_size AS VARCHAR) END AS text, CASE WHEN r = 0 AND c = 0 THEN 2 ELSE 1 END AS colspan
 FROM part, (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS c)""")
def _(t):
    html = F.concat(F.lit("<p>x</p><table><tr><th colspan=\"2\">name &amp; brand</th><th>size</th></tr><tr><td><b>"), "p_name", F.lit("</b><br/>"), "p_brand",
                    F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table>"))
    return TB.html_cells(t.part.select(F.col("p_partkey").alias("id"), html.alias("html")), "id", "html")


@query("pipe_table_cells", "X21", """SELECT p_partkey AS id, c AS col, CASE c WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'a<b' END AS text FROM part, (SELECT unnest([0, 1, 2]) AS c)""")
def _(t):
    rows = F.array(F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_brand", F.lit("| a&lt;b |")), F.lit("|---|:-:|---|"), F.lit("plain"))
    return TB.pipe_cells(t.part.select(F.col("p_partkey").alias("id"), F.explode(rows).alias("text")), ["id"])


@query("answer_key_rows", "X22", """SELECT p_partkey AS id, CAST(p_size + k AS INTEGER) AS number, CASE k WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE 'z' END AS answer FROM part, (SELECT unnest([0, 1, 2]) AS k)""")
def _(t):
    n = lambda k: (F.col("p_size") + k).cast("string")
    table = F.concat(F.lit("<table><tr><td>题号</td><td>"), n(0), F.lit("</td><td>"), n(1), F.lit("</td><td>"), n(2), F.lit("</td></tr><tr><td>答案</td><td>"), "p_brand",
                     F.lit("</td><td>"), "p_type", F.lit("</td><td>z</td></tr></table>"))
    flat = F.concat(n(0), F.lit(". "), "p_brand", F.lit("  "), n(1), F.lit("． "), "p_type", F.lit(" "), n(2), F.lit("、 z"))
    return TB.answer_key(t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, table).otherwise(flat).alias("text")), ["id"])


@query("reply_columns", "X25", """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'question' END AS kind, '填空' AS type, p_name AS body, p_brand AS solution FROM part""")
def _(t):
    a, b = F.concat(F.lit("@@BODY\n"), "p_name", F.lit("\n@@SOL\n"), "p_brand", F.lit("\n@@SOL\n")), F.concat(F.lit("@@SOL\n"), "p_brand", F.lit("\n@@BODY\n"), "p_name")
    text = F.concat(F.when(F.col("p_size") % 2 == 0, "@@KIND Question\n").otherwise(""), F.lit("@@TYPE 填空\n"), F.when(F.col("p_size") % 3 == 0, a).otherwise(b))
    c = TB.reply_columns(text)
    return t.part.select(F.col("p_partkey").alias("id"), c["kind"].alias("kind"), c["type"].alias("type"), c["body"].alias("body"), c["solution"].alias("solution"))


@query("handout_blocks", "X31", """SELECT p_partkey AS doc, 'q' || p_partkey || '-first' AS block_id, 1 AS start, 5 AS stop, CASE WHEN p_size % 2 = 0 THEN 3 END AS solution_at FROM part""")
def _(t):
    k = F.col("p_partkey").cast("string")
    mark = lambda w, n: F.concat(F.lit(f"<!-- card:{w} q"), k, F.lit(f"-{n} -->"))
    rows = F.array(F.col("p_name"), mark("question", "first"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, mark("solution", "first")).otherwise("x"),
                   F.lit("y"), mark("end", "first"), mark("question", "second"), F.lit("open end"))
    lines = t.part.select(F.col("p_partkey").alias("doc"), F.posexplode(rows).alias("line_no", "text"))
    return TB.handout_blocks(lines, "card")[0].select("doc", "block_id", "start", "stop", "solution_at")


@query("empty_body_classes", "F11 P11", WI + """SELECT id, CASE WHEN type <> '单选题' THEN 'skip' WHEN starred THEN 'review' ELSE 'fix' END AS action FROM items""")
def _(t):
    from ..plans.repair import classify_empty
    sections = F.when(F.col("starred"), F.array(F.struct(F.lit("解析").alias("heading"), F.lit("x").alias("content")))).otherwise(
        F.array(F.struct(F.concat(F.lit("$\\displaystyle "), F.coalesce("number", F.lit(7)).cast("string"), F.lit("$．【2016 北京】")).alias("heading"), F.col("title").alias("content"))))
    i = items(t).withColumn("body", F.when(F.col("type") == "单选题", "").otherwise(F.col("title"))).withColumn("extra_sections", sections)
    return classify_empty(i).select("id", "action")
