"""Numbered sequences as derived from ``lineitem``, ``conversations`` and ``documents``."""

from pyspark.sql import functions as F

from ..operators.sequence import with_index
from ..session import materialise
from ..scale import dense_chunk, heavy_chunk, running_count, scan

SHIP = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def order_rows(t):
    """Lines of an order in shipping order: doc, idx, number, section, text, zone."""
    slim = t.lineitem.select("l_orderkey", *SHIP, "l_returnflag", "l_linestatus")
    cut = heavy_chunk(slim, ["l_orderkey"], F.datediff("l_shipdate", F.lit("1970-01-01")))
    placed = with_index(cut, ["l_orderkey"], SHIP, F.col("_hc"))
    return materialise(placed.select(
        F.col("l_orderkey").alias("doc"), "idx", F.col("l_linenumber").alias("number"),
        F.col("l_returnflag").alias("section"), F.lit(None).cast("string").alias("group"),
        F.when(F.col("l_linestatus") == "O", "solution").otherwise("stem").alias("zone"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("text")))


ORDERED = """seq AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS idx,
 l_linenumber AS number, l_returnflag AS section, CASE WHEN l_linestatus = 'O' THEN 'solution' ELSE 'stem' END AS zone,
 l_partkey || '-' || l_suppkey AS text FROM lineitem)"""


def talk_blocks(t):
    """Turns as blocks: a question is a stem, an answer a solution with the number of its question."""
    rows = t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), "role", "text")
    numbered = scan(rows, ["doc"], ["idx"], dense_chunk("idx"), {"number": running_count(F.col("role") == "user")})
    return materialise(numbered.filter("role <> 'system'")
            .withColumn("zone", F.when(F.col("role") == "user", "stem").otherwise("solution"))
            .withColumn("number", F.when(F.length("text") % 7 == 0, None).otherwise(F.col("number")).cast("int"))
            .withColumn("group", F.when(F.length("text") % 2 == 0, None).otherwise(F.lit("A"))).drop("role"))


TALK = """talk AS (SELECT doc, idx, text, zone, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE number END AS number,
 CASE WHEN length(text) % 2 = 0 THEN NULL ELSE 'A' END AS grp FROM (SELECT conv_id AS doc, turn AS idx, text, role,
 CASE WHEN role = 'user' THEN 'stem' ELSE 'solution' END AS zone, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
 OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS number FROM conversations) WHERE role <> 'system')"""


def doc_lines(t):
    return t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


LINES = """lines AS (SELECT doc, pos - 1 AS line_no, ls[pos] AS text FROM (SELECT doc, ls, unnest(range(1, len(ls) + 1)) AS pos
 FROM (SELECT doc_id AS doc, string_split(text, chr(10)) AS ls FROM documents)))"""
