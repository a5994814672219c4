"""File readers and report writers, over files written from the tables first."""

import uuid

from pyspark.sql import functions as F

from ..registry import query
from ..session import shared_folder
from ..sinks import tables as K
from ..sources import files as S
from ._items import ITEMS, items


def _folder(t):
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


def _one_file_per_row(df, path, *by):
    return K.write_texts(df, path, list(by))


def _cards(t):
    k, n = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 7).cast("string")
    front = F.concat(F.lit("---\nid: s"), k, F.lit("\nnumber: "), F.when(F.col("s_suppkey") % 5 == 0, "十").otherwise(n), F.lit("\ntags: [a, "), F.col("s_name"), F.lit("]\nkind: "),
                     F.when(F.col("s_suppkey") % 4 == 0, "handout").otherwise("Question"), F.lit("\nextra: x"), n, F.lit("\n---\n"))
    body = F.concat(F.lit("body "), "s_name", F.lit("\r\n\r\n## 备注\nn"), n, F.lit("\n\n## 解析\ns"), k)
    return t.supplier.select(F.concat(front, body).alias("value"), F.concat(F.lit("g"), F.col("s_nationkey")).alias("nation"),
                             F.when(F.col("s_suppkey") % 9 == 0, "_assets").otherwise("cards").alias("kind"))


@query("bank_scan", "S1 S2", """SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey % 7 AS INTEGER) END AS number, 'body ' || s_name AS body, 's' || s_suppkey AS solution, 'n' || (s_suppkey % 7) AS note,
 'a,' || s_name AS tags, 'x' || (s_suppkey % 7) AS extra, 'nation=g' || s_nationkey || '/kind=cards' AS folder FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 9 <> 0""")
def _(t):
    root = _one_file_per_row(_cards(t), _folder(t), "nation", "kind")
    r = S.read_bank(t.spark, root, pattern="*.txt").filter(~F.contains("folder", F.lit("_assets")))
    return r.select("id", "number", "body", "solution", "note", F.array_join("tags", ",").alias("tags"), F.col("extra_meta")["extra"].alias("extra"), "folder")


@query("bank_folder_scan", "S3", """SELECT 's' || s_suppkey AS id FROM supplier WHERE s_nationkey = 3 AND s_suppkey % 4 <> 0 AND s_suppkey % 9 <> 0""")
def _(t):
    root = _one_file_per_row(_cards(t).filter("kind = 'cards'").unionByName(_cards(t).filter("kind <> 'cards'").withColumn("kind", F.lit("skip"))), _folder(t), "nation", "kind")
    return S.read_bank(t.spark, root, "nation=g3/kind=cards", recursive=False, pattern="*.txt").select("id")


@query("item_path_listing", "S4", f"WITH {ITEMS} SELECT id, path FROM items WHERE folder LIKE 'es/%'")
def _(t):
    path = _folder(t)
    items(t).select("id", "path", "folder", "body").write.parquet(path)
    return t.spark.read.parquet(path).filter(F.col("folder").startswith("es/")).select("id", "path")


@query("layout_files", "S7", """SELECT 'nation=' || s_suppkey AS doc, 1 AS page, 'f' || s_suppkey || '.jpg' AS figure, CASE WHEN s_suppkey % 2 = 0 THEN 100.0::DOUBLE ELSE 10.0::DOUBLE END AS x0 FROM supplier""")
def _(t):
    k = F.col("s_suppkey").cast("string")
    box = F.when(F.col("s_suppkey") % 2 == 0, "[0.1,0.2,0.3,0.4]").otherwise("[10,20,30,40]")
    text = F.concat(F.lit('[{"page_idx":1,"type":"image","img_path":"images/f'), k, F.lit('.jpg","bbox":'), box, F.lit("}]"))
    root = _one_file_per_row(t.supplier.select(text.alias("value"), k.alias("nation")), _folder(t), "nation")
    return S.read_layouts(t.spark, root, "*.txt").select("doc", "page", "figure", "x0")


@query("raw_archives", "S6", """SELECT 'run=' || s_suppkey AS archive, 'both ' || s_name AS raw_md FROM supplier""")
def _(t):
    # the reader picks by suffix, so the two raw texts of a run are told apart by folder name here
    k = F.col("s_suppkey").cast("string")
    root = _one_file_per_row(t.supplier.select(F.concat(F.lit("both "), "s_name").alias("value"), k.alias("run")), _folder(t), "run")
    texts = S.read_texts(t.spark, root, "*.txt").withColumn("archive", F.regexp_replace("path", r"/[^/]*$", ""))
    return texts.groupBy("archive").agg(F.min_by(F.regexp_replace("text", r"\n$", ""), F.col("path")).alias("raw_md"))


@query("task_snapshots", "S11 K6", """SELECT CAST(event_id AS VARCHAR) AS task_id, k AS gid, CASE WHEN k = 1 THEN event_type ELSE 'done' END AS status FROM events, (SELECT unnest([1, 2]) AS k)""")
def _(t):
    path = _folder(t)
    g = F.array(F.struct(F.lit(1).alias("gid"), F.col("event_type").alias("status")), F.struct(F.lit(2).alias("gid"), F.lit("done").alias("status")))
    K.write_report(t.events.select(F.lit("batch").alias("kind"), F.col("event_id").cast("string").alias("task_id"), F.struct(g.alias("groups")).alias("payload")), path)
    return S.task_groups(S.read_tasks(t.spark, path, "batch")).select("task_id", "gid", "status")


@query("manifests", "S12 O10", """SELECT 'm' || s_suppkey AS id, s_name AS title FROM supplier WHERE s_suppkey % 3 <> 0""")
def _(t):
    k = F.col("s_suppkey").cast("string")
    text = F.when(F.col("s_suppkey") % 6 == 0, "{ broken").otherwise(F.concat(F.lit('{"schema":'), F.when(F.col("s_suppkey") % 3 == 0, "2").otherwise("1"), F.lit(',"id":"m'), k, F.lit('","title":"'), "s_name", F.lit('","files":[]}')))
    root = _one_file_per_row(t.supplier.select(text.alias("value"), k.alias("run")), _folder(t), "run")
    return S.read_manifests(t.spark, root).select("id", "title")


@query("override_files", "S13", """SELECT CAST(s_suppkey AS INTEGER) AS gid, 'replace' AS operation, s_name AS body FROM supplier""")
def _(t):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('[{"gid":'), k, F.lit(',\n"operation":"replace","body":"'), "s_name", F.lit('"}]'))
    root = _one_file_per_row(t.supplier.select(text.alias("value"), k.alias("run")), _folder(t), "run")
    return S.read_overrides(t.spark, root).select("gid", "operation", "body")


@query("nested_audit_report", "K6", """SELECT l_orderkey AS doc, count(*) AS lines_count FROM lineitem WHERE l_quantity > 45 GROUP BY 1""")
def _(t):
    return _report_back(t, t.lineitem.filter("l_quantity > 45"))


@query("whole_audit_report", "K6", """SELECT l_orderkey AS doc, count(*) AS lines_count FROM lineitem GROUP BY 1""")
def _(t):
    return _report_back(t, t.lineitem)


def _report_back(t, lines):
    path = _folder(t)
    rows = lines.select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey")
    K.write_report(K.nested_report(rows, ["doc"], "lines", ["l_linenumber", "l_partkey"]), path)
    back = t.spark.read.schema("doc long, lines array<struct<l_linenumber:int,l_partkey:long>>, lines_count long").json(path)
    return back.filter(F.size("lines") == F.col("lines_count")).select("doc", "lines_count")


@query("published_versions", "K1", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer")
def _(t):
    path = _folder(t)
    K.publish(t.customer.select("c_custkey", "c_acctbal"), path)
    K.publish(K.read_current(t.spark, path).withColumn("c_acctbal", F.col("c_acctbal") + 1), path)
    return K.read_current(t.spark, path)
