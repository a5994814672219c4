"""Names of files and folders over parts, with forbidden characters, device names and long texts worked in."""

from pyspark.sql import functions as F

from ..functions import names as N
from ..registry import query

RAW = "CASE p_size % 6 WHEN 0 THEN concat(' ', p_brand, '/../', p_type, '.md ') WHEN 1 THEN concat('con.', p_name) WHEN 2 THEN repeat(concat(p_name, ' . '), 20) WHEN 3 THEN concat('..', p_name, chr(10), '?') WHEN 4 THEN ' . ' ELSE p_name END"
TITLE = """CASE p_size % 6 WHEN 0 THEN p_brand || '___' || p_type WHEN 1 THEN '_con.' || p_name WHEN 2 THEN rtrim(substr(repeat(p_name || ' . ', 20), 1, 180), ' .') WHEN 3 THEN '_' || p_name || ' _' WHEN 4 THEN '' ELSE p_name END"""


@query("safe_names", "X26", f"""SELECT p_partkey AS id, {TITLE} AS title, CASE p_size % 6 WHEN 0 THEN p_brand || '___' || p_type || '.md' WHEN 1 THEN 'con.' || p_name WHEN 2 THEN trim(rtrim(trim(repeat(p_name || ' . ', 20)), '.'))
 WHEN 3 THEN '_' || p_name || chr(10) || '_' WHEN 4 THEN '' ELSE p_name END AS folder FROM part""")
def _(t):
    raw = F.expr(RAW)
    return t.part.select(F.col("p_partkey").alias("id"), N.safe_title(raw).alias("title"), N.safe_folder(raw).alias("folder"))


@query("default_titles", "X26", f"""WITH p AS (SELECT p_partkey AS id, p_size AS k, {TITLE} AS s, CASE WHEN p_size % 4 < 2 THEN p_size END AS number, CASE WHEN p_size % 4 > 0 THEN 7 END AS seq FROM part),
 n AS (SELECT *, coalesce(number, seq) AS n FROM p)
 SELECT id, CASE WHEN k % 7 = 0 THEN '临时卡' || coalesce(CAST(n AS VARCHAR), '') WHEN s <> '' THEN substr(s || CASE WHEN n IS NULL THEN '' ELSE '第' || n || '题' END, 1, 180)
 WHEN number IS NULL THEN '' ELSE '第' || number || '题' END AS title FROM n""")
def _(t):
    number, seq = F.expr("CASE WHEN p_size % 4 < 2 THEN p_size END"), F.expr("CASE WHEN p_size % 4 > 0 THEN 7 END")
    return t.part.select(F.col("p_partkey").alias("id"), N.default_title(F.expr(RAW), number, seq, F.col("p_size") % 7 == 0).alias("title"))
