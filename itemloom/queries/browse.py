"""Browse and search: filters, sorts, pages, tags, folders, selections."""

from pyspark.sql import functions as F

from ..functions.text import ancestors, natural_key
from ..operators import folders, ordering, predicates as P
from ..registry import query
from ..scale import global_rank
from ._items import ITEMS, items, natkey

W = f"WITH {ITEMS} "


@query("item_filter_compound", "F1 F2", W + """SELECT id, folder, type FROM items
 WHERE (folder = 'en' OR folder LIKE 'en/%') AND list_contains(tags, 'en') AND list_contains(tags, 'src1')
 AND type = '单选题' AND (lower(body) LIKE '%the%' OR lower(solution) LIKE '%the%' OR lower(note) LIKE '%the%' OR lower(source) LIKE '%the%')""")
def _(t):
    return items(t).filter(P.item_filter(folder="en", tags=["en", "src1"], type="单选题", clauses=[("any", "the")])).select("id", "folder", "type")


@query("item_filter_any_tag", "F1", W + """SELECT id, difficulty FROM items
 WHERE (list_contains(tags, 'fr') OR list_contains(tags, 'src3')) AND starred AND difficulty = '3'""")
def _(t):
    return items(t).filter(P.item_filter(tags=["fr", "src3"], match="or", starred=True, difficulty="3")).select("id", "difficulty")


@query("folder_subtree", "F2 S3", W + "SELECT id, folder FROM items WHERE folder = 'de' OR starts_with(folder, 'de/')")
def _(t):
    return items(t).filter(P.in_subtree(F.col("folder"), "de")).select("id", "folder")


@query("folder_direct_children", "S3", W + "SELECT id, path FROM items WHERE folder = 'en/src2'")
def _(t):
    return items(t).filter(F.col("folder") == "en/src2").select("id", "path")


@query("plain_search", "F3", W + """SELECT id FROM items WHERE contains(lower(body), 'tion the') OR contains(lower(solution), 'tion the')
 OR contains(lower(note), 'tion the') OR contains(lower(source), 'tion the')
 OR len(list_filter(tags, lambda x: contains(lower(x), 'tion the'))) > 0""")
def _(t):
    return items(t).filter(P.plain_search("tion The")).select("id")


@query("field_search", "F4", W + """SELECT id, type, difficulty FROM items WHERE contains(lower(body), 'er') AND contains(lower(source), 'src1')
 AND lower(type) = '填空题' AND starred = true AND len(list_filter(tags, lambda x: contains(lower(x), 'e'))) > 0""")
def _(t):
    c = [("content", "er"), ("source", "SRC1"), ("type", "填空题"), ("starred", "on"), ("tag", "E")]
    return items(t).filter(P.search(c)).select("id", "type", "difficulty")


@query("tag_family_search", "F5", W + """, tree AS (SELECT DISTINCT lang AS parent, source AS descendant FROM documents WHERE n_chars > 5000)
 SELECT id FROM items WHERE len(list_filter(tags, lambda x: contains(lower(x), 'fr'))) > 0
 OR EXISTS (SELECT 1 FROM tree WHERE parent = 'fr' AND list_contains(list_transform(tags, lambda x: lower(x)), descendant))""")
def _(t):
    tree = t.documents.filter("n_chars > 5000").select(F.col("lang").alias("parent"), F.col("source").alias("descendant")).distinct()
    return P.with_tag_family(items(t), tree, "fr").select("id")


ORDER_SQL = {
    "custom": '"order", number NULLS LAST, created, path',
    "created_desc": "created DESC, id",
    "created_asc": "created, number NULLS LAST, created, path",
    "difficulty": "CASE WHEN difficulty = '' THEN '0' ELSE difficulty END, number NULLS LAST, created, path",
    "type": "type, number NULLS LAST, created, path",
    "starred": 'starred DESC, "order", number NULLS LAST, created, path',
    "source": f"{natkey('source')}, {natkey('split_part(folder, chr(47), 1)')}, {natkey('split_part(folder, chr(47), 2)')}, "
              '"order", number NULLS LAST, created, path',
}
COVER = {"custom": "O1", "created_desc": "O2", "created_asc": "O3", "difficulty": "O4", "type": "O5", "starred": "O6", "source": "O7 O8"}
for _mode, _sql in ORDER_SQL.items():
    @query(f"sort_{_mode}", COVER[_mode], W + f"SELECT id, row_number() OVER (ORDER BY {_sql}) AS place FROM items")
    def _(t, mode=_mode):
        keep = items(t).drop("body", "solution", "note", "tags", "title")
        return ordering.snapshot(keep, ordering.sort_keys(mode)).select("id", "place")


@query("natural_path_order", "O8 S4", W + f"""SELECT id, row_number() OVER (ORDER BY {natkey("split_part(path, '/', 1)")},
 {natkey("split_part(path, '/', 2)")}, {natkey("split_part(path, '/', 3)")}) AS place FROM items""")
def _(t):
    slim = items(t).select("id", "path", "folder")
    return global_rank(slim, [ordering.natural_path_key(F.col("path")).asc()], "place").select("id", "place")


@query("item_page_two", "O9", W + """SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY "order", number NULLS LAST, created, path) - 30 AS place
 FROM items) WHERE place BETWEEN 1 AND 30""")
def _(t):
    return ordering.page(items(t).drop("body", "solution"), ordering.sort_keys("custom"), 2).select("id", F.col("place").cast("long").alias("place"))


@query("item_page_snapshot", "O9", W + """SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY type, number NULLS LAST, created, path) AS place
 FROM items) WHERE place BETWEEN 61 AND 90""")
def _(t):
    snap = ordering.snapshot(items(t).drop("body", "solution"), ordering.sort_keys("type"))
    return ordering.snapshot_page(snap, 3).select("id", "place")


@query("trash_newest_first", "O10", """SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events
 WHERE event_type = 'error') WHERE place <= 30""")
def _(t):
    gone = t.events.filter("event_type = 'error'").select("event_id", "ts")
    return ordering.page(gone, [F.col("ts").desc(), F.col("event_id").asc()], 1).select("event_id", F.col("place").cast("long").alias("place"))


@query("best_per_folder", "O11", W + "SELECT folder, max(number) AS best_number, arg_min(id, (-coalesce(number, -1), id)) AS best_id FROM items GROUP BY folder")
def _(t):
    rank = F.struct((-F.coalesce("number", F.lit(-1))).alias("s"), F.col("id"))
    return items(t).groupBy("folder").agg(F.max("number").alias("best_number"), F.min_by("id", rank).alias("best_id"))


@query("selection_in_custom_order", "O12 S5", W + """SELECT id, row_number() OVER (ORDER BY "order", number NULLS LAST, created, path) AS place
 FROM items WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(t):
    basket = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id"))
    chosen = items(t).drop("body", "solution").join(basket, "id", "left_semi")
    return ordering.snapshot(chosen, ordering.sort_keys()).select("id", "place")


@query("lookup_by_ids", "S5", """SELECT o.o_orderkey AS pos, d.doc_id AS id, d.n_chars FROM orders o JOIN documents d ON d.doc_id = o.o_custkey""")
def _(t):
    asked = t.orders.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"))
    return asked.join(t.documents.select(F.col("doc_id").alias("id"), "n_chars"), "id").select("pos", "id", "n_chars")


@query("tag_counts", "A1", W + "SELECT tag, count(*) AS uses, row_number() OVER (ORDER BY count(*) DESC, tag) AS place FROM (SELECT unnest(tags) AS tag FROM items) GROUP BY tag")
def _(t):
    return global_rank(folders.tag_counts(items(t)), [F.col("uses").desc(), F.col("tag").asc()], "place")


CUSTOMER_PATHS = """WITH c AS (SELECT r_name || '/' || n_name || '/' || c_mktsegment AS folder FROM customer JOIN nation ON n_nationkey = c_nationkey
 JOIN region ON r_regionkey = n_regionkey) """


def customer_folders(t):
    return (t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
            .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
            .select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("folder")))


@query("folder_counts", "A2", CUSTOMER_PATHS + """SELECT folder, count(*) AS items FROM (SELECT folder FROM c UNION ALL
 SELECT regexp_replace(folder, '/[^/]*$', '') FROM c UNION ALL SELECT split_part(folder, '/', 1) FROM c) GROUP BY folder""")
def _(t):
    return folders.folder_counts(customer_folders(t))


@query("folder_tree", "A3", CUSTOMER_PATHS + """, n AS (SELECT DISTINCT folder, 2 AS depth FROM c UNION SELECT regexp_replace(folder, '/[^/]*$', ''), 1 FROM c
 UNION SELECT split_part(folder, '/', 1), 0 FROM c)
 SELECT folder, CASE WHEN depth = 0 THEN '' ELSE regexp_replace(folder, '/[^/]*$', '') END AS parent, split_part(folder, '/', depth + 1) AS name,
 depth, depth < 2 AS has_children FROM n""")
def _(t):
    return folders.folder_tree(customer_folders(t))


@query("folder_children", "A3", CUSTOMER_PATHS + """SELECT DISTINCT regexp_replace(folder, '/[^/]*$', '') AS folder, split_part(folder, '/', 2) AS name, true AS has_children
 FROM c WHERE split_part(folder, '/', 1) = (SELECT min(r_name) FROM region)""")
def _(t):
    tree = folders.folder_tree(customer_folders(t))
    first = t.region.select(F.min("r_name")).scalar()
    return tree.filter(F.col("parent") == first).select("folder", "name", "has_children")


@query("folder_ancestors", "A3", W + """SELECT id, unnest([split_part(folder, '/', 1), folder]) AS ancestor FROM items""")
def _(t):
    return items(t).select("id", F.explode(ancestors(F.col("folder"))).alias("ancestor"))


@query("rename_tag_merge", "U5", W + """SELECT id, CASE WHEN list_contains(tags, 'src1') THEN CASE WHEN list_contains(tags, 'en') THEN 'en' ELSE lang2 || ',en' END
 ELSE array_to_string(tags, ',') END AS tags FROM (SELECT *, split_part(folder, '/', 1) AS lang2 FROM items)""")
def _(t):
    return items(t).select("id", F.array_join(folders.rename_tag(F.col("tags"), "src1", "en"), ",").alias("tags"))


@query("add_tags", "U5", W + """SELECT id, CASE WHEN list_contains(tags, 'en') THEN 'en,' || source || ',new' ELSE split_part(folder, '/', 1) || ',' || source || ',new,en' END AS tags FROM items""")
def _(t):
    return items(t).select("id", F.array_join(folders.add_tags(F.col("tags"), ["new ", "en", " "]), ",").alias("tags"))


@query("selection_toggle", "U6", """SELECT doc_id AS id FROM labels GROUP BY doc_id HAVING (max(quality) = 1) <> (max(toxic) = 1)""")
def _(t):
    ids = t.labels.withColumnRenamed("doc_id", "id")
    return folders.toggle(ids.filter("quality = 1"), ids.filter("toxic = 1"))


@query("selection_after_all_and_clear", "U6", """SELECT doc_id AS id FROM documents WHERE lang = 'de' OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1""")
def _(t):
    ids = t.labels.withColumnRenamed("doc_id", "id")
    de = t.documents.filter("lang = 'de'").select(F.col("doc_id").alias("id"))
    return folders.unselect(folders.select_all(ids.filter("quality = 1"), de), ids.filter("toxic = 1"))


@query("name_set_difference", "U1", """SELECT k AS folder, CASE WHEN max(s) = 2 AND min(s) = 1 THEN 'both' WHEN max(s) = 1 THEN 'left' ELSE 'right' END AS side
 FROM (SELECT DISTINCT source || '-' || lang AS k, 1 AS s FROM documents JOIN labels USING (doc_id) WHERE quality = 0
 UNION SELECT DISTINCT source || '-' || lang, 2 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY k""")
def _(t):
    named = t.documents.join(t.labels, "doc_id").withColumn("folder", F.concat_ws("-", "source", "lang"))
    a = named.filter("quality = 0").select("folder").distinct()
    b = named.filter("toxic = 1").select("folder").distinct()
    both, left, right = a.intersect(b), a.subtract(b), b.subtract(a)
    return (both.withColumn("side", F.lit("both")).unionByName(left.withColumn("side", F.lit("left")))
            .unionByName(right.withColumn("side", F.lit("right"))))


@query("next_order_per_folder", "A21", W + 'SELECT folder, max("order") + 1 AS next_order FROM items GROUP BY folder')
def _(t):
    return folders.next_order(items(t))


@query("next_order_empty_folder", "A21", W + """SELECT coalesce(max("order") + 1, 1.0) AS next_order FROM items WHERE folder = 'xx/none'""")
def _(t):
    return folders.next_order_of(items(t), "xx/none")


@query("next_temporary_index", "A22", """SELECT c_mktsegment AS folder, max(c_custkey) + 1 AS next_index FROM customer GROUP BY c_mktsegment""")
def _(t):
    cards = t.customer.select(F.col("c_mktsegment").alias("folder"), F.concat(F.lit("临时卡"), F.col("c_custkey")).alias("title"))
    return folders.next_temporary_index(cards)
