"""Gaps, runs, restarts, context, cuts and pairing over the driver tables."""

from pyspark.sql import functions as F

from ..operators import pairing, sequence as S
from ..registry import query
from ._sequences import LINES, ORDERED, TALK, doc_lines, order_rows, talk_blocks

W = f"WITH {ORDERED} "
WT = f"WITH {TALK} "
WL = f"WITH {LINES} "


@query("number_gaps", "W1", W + """, step AS (SELECT doc, number, lag(number) OVER (PARTITION BY doc ORDER BY idx) AS p FROM seq),
 whole AS (SELECT doc FROM seq GROUP BY doc HAVING count(*) = count(DISTINCT number) AND max(number) - min(number) + 1 = count(*))
 SELECT doc, unnest(generate_series(p + 1, number - 1)) AS missing FROM step WHERE number - p BETWEEN 2 AND 11 AND doc NOT IN (SELECT doc FROM whole)""")
def _(t):
    return S.number_gaps(order_rows(t), ["doc"])


@query("number_gaps_per_document", "W1", WT + """, step AS (SELECT doc, grp, number, lag(number) OVER (PARTITION BY doc, grp ORDER BY idx) AS p FROM talk WHERE zone = 'stem' AND number IS NOT NULL),
 whole AS (SELECT doc, coalesce(grp, '-') AS g FROM talk WHERE zone = 'stem' AND number IS NOT NULL GROUP BY doc, grp
 HAVING count(*) = count(DISTINCT number) AND max(number) - min(number) + 1 = count(*))
 SELECT DISTINCT doc, unnest(generate_series(p + 1, number - 1)) AS missing FROM step s WHERE number - p BETWEEN 2 AND 11
 AND NOT EXISTS (SELECT 1 FROM whole w WHERE w.doc = s.doc AND w.g = coalesce(s.grp, '-'))""")
def _(t):
    stems = talk_blocks(t).filter("zone = 'stem'").withColumn("g", F.coalesce("group", F.lit("-")))
    return S.number_gaps(stems, ["doc", "g"]).select("doc", "missing").distinct()


@query("missing_in_range", "W2", """WITH b AS (SELECT l_orderkey AS doc, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1)
 SELECT doc, m AS missing FROM (SELECT doc, unnest(generate_series(lo, hi)) AS m FROM b) WHERE (doc, m) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem)""")
def _(t):
    return S.missing_in_range(t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number")), ["doc"])


@query("missing_requested", "W2", """SELECT o_orderkey AS doc, n AS number FROM (SELECT o_orderkey, unnest([1, 2, 3]) AS n FROM orders)
 WHERE (o_orderkey, n) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem)""")
def _(t):
    asked = t.orders.select(F.col("o_orderkey").alias("doc"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("number"))
    return S.missing_requested(asked, t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number")), ["doc"])


@query("number_continuity", "W3", """SELECT l_orderkey AS doc, count(*) AS rows, count(DISTINCT l_linenumber) AS distinct_numbers, min(l_linenumber) AS low, max(l_linenumber) AS high,
 count(*) = count(DISTINCT l_linenumber) AND max(l_linenumber) - min(l_linenumber) + 1 = count(*) AS contiguous,
 count(*) = count(DISTINCT l_linenumber) AND max(l_linenumber) = count(*) AND min(l_linenumber) = 1 AS from_one FROM lineitem GROUP BY 1""")
def _(t):
    return S.continuity(t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number")), ["doc"])


@query("numbering_restart", "W4", W + """, s AS (SELECT *, max(number) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
 count(*) OVER (PARTITION BY doc) AS n FROM seq) SELECT doc, min(idx) AS restart_at FROM s WHERE number = 1 AND seen >= 5 AND n - idx >= 3 GROUP BY doc""")
def _(t):
    return S.restart_points(order_rows(t), ["doc"])


@query("numbering_restart_by_section", "W4", W + """, c AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n,
 CASE WHEN lag(section) OVER (PARTITION BY doc ORDER BY idx) IS DISTINCT FROM section THEN 1 ELSE 0 END AS ch FROM seq),
 r AS (SELECT *, sum(ch) OVER (PARTITION BY doc ORDER BY idx) AS run FROM c),
 s AS (SELECT *, max(number) OVER (PARTITION BY doc, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r)
 SELECT doc, min(idx) AS restart_at FROM s WHERE number = 1 AND seen >= 5 AND n - idx >= 3 GROUP BY doc""")
def _(t):
    return S.restart_points(order_rows(t), ["doc"], section="section", group="group")


@query("context_fill", "W8", WL + """SELECT doc, line_no, last_value(CASE WHEN length(text) > 200 THEN left(text, 20) END IGNORE NULLS)
 OVER (PARTITION BY doc ORDER BY line_no) AS section_ctx FROM lines""")
def _(t):
    marked = doc_lines(t).withColumn("section", F.when(F.length("text") > 200, F.left("text", F.lit(20))))
    return S.fill_context(marked, ["doc"], ["section"], "line_no").select("doc", "line_no", "section_ctx")


@query("block_formation", "W9 F16", WL + """, b AS (SELECT *, sum(CASE WHEN length(text) > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS block FROM lines)
 SELECT doc, CAST(block AS BIGINT) AS block, md5(string_agg(text, chr(10) ORDER BY line_no)) AS digest, min(line_no) AS first_line, count(*) AS lines FROM b GROUP BY doc, block""")
def _(t):
    out = S.form_blocks(doc_lines(t), ["doc"], F.length("text") > 150)
    return out.select("doc", "block", F.md5("text").alias("digest"), "first_line", "lines")


@query("best_cut", "W10", W + """, p AS (SELECT doc, idx, zone = 'solution' AS sol FROM seq), q AS (SELECT doc, idx, coalesce(sum(CAST(sol AS INT)) OVER (PARTITION BY doc ORDER BY idx
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p), n AS (SELECT doc, count(*) AS rows, sum(CAST(sol AS INT)) AS solutions FROM p GROUP BY doc),
 cand AS (SELECT doc, idx AS c, before FROM q UNION ALL SELECT doc, rows, solutions FROM n),
 best AS (SELECT doc, arg_max(c, (c - 2 * before, -c)) AS c, arg_max(before, (c - 2 * before, -c)) AS before FROM cand GROUP BY doc)
 SELECT doc, rows, CAST(solutions AS BIGINT) AS solutions, CASE WHEN solutions > 0 AND c > 0 AND rows > c AND 2 * (solutions - before) >= rows - c THEN c END AS cut
 FROM best JOIN n USING (doc)""")
def _(t):
    return S.best_cut(order_rows(t), ["doc"], F.col("zone") == "solution")


@query("stem_runs", "W14", W + """, c AS (SELECT *, CASE WHEN zone = 'stem' AND (coalesce(lag(zone) OVER w, 'solution') <> 'stem' OR lag(section) OVER w <> section) THEN 1 ELSE 0 END AS o
 FROM seq WINDOW w AS (PARTITION BY doc ORDER BY idx)), r AS (SELECT *, sum(o) OVER (PARTITION BY doc ORDER BY idx) AS run FROM c)
 SELECT doc, CAST(run AS BIGINT) AS run, any_value(section) AS section, count(*) AS rows, min(idx) AS first_idx FROM r WHERE zone = 'stem' GROUP BY doc, run""")
def _(t):
    r = S.runs(order_rows(t), ["doc"], F.col("zone") == "stem", F.col("section"))
    return r.groupBy("doc", "run").agg(F.min("section").alias("section"), F.count("*").alias("rows"), F.min("idx").alias("first_idx"))


@query("scheme_vote", "W7", W + """, x AS (SELECT *, section = 'R' AS is_sec, idx % 3 = 0 AS kw FROM seq), nums AS (SELECT doc, number, lag(number) OVER (PARTITION BY doc ORDER BY idx) AS p FROM x WHERE NOT is_sec),
 r AS (SELECT doc, count_if(number <= p) AS restarts, count(*) AS numbers FROM nums GROUP BY doc), h AS (SELECT doc, count_if(is_sec) AS sections, count_if(is_sec AND kw) AS with_keyword FROM x GROUP BY doc)
 SELECT doc, sections, with_keyword, coalesce(restarts, 0) AS restarts, coalesce(numbers, 0) AS numbers,
 CASE WHEN sections > 0 AND with_keyword * 2 < sections AND coalesce(numbers, 0) > 0 AND coalesce(restarts, 0) >= greatest(2, sections // 2) THEN 'chinese' ELSE 'arabic' END AS scheme
 FROM h LEFT JOIN r USING (doc)""")
def _(t):
    return S.scheme_vote(order_rows(t), ["doc"], F.col("section") == "R", F.col("idx") % 3 == 0, pos="idx")


@query("lost_number_neighbours", "W16", W + "SELECT doc, idx, number FROM (SELECT *, lead(number) OVER (PARTITION BY doc ORDER BY idx) AS nx FROM seq) WHERE nx = number + 2")
def _(t):
    return S.gaps_of_one(order_rows(t), ["doc"]).filter("lost_after").select("doc", "idx", "number")


@query("shifted_duplicate_repair", "W17", W + """, a AS (SELECT *, lag(number) OVER w AS p, lead(number) OVER w AS n1, lead(number, 2) OVER w AS n2 FROM seq WINDOW w AS (PARTITION BY doc ORDER BY idx)),
 f AS (SELECT doc, number - 1 AS m, min(idx) AS idx FROM a WHERE p = number - 2 AND n1 = number AND n2 = number + 1 GROUP BY doc, number - 1)
 SELECT doc, idx, m AS number FROM f WHERE NOT EXISTS (SELECT 1 FROM seq s WHERE s.doc = f.doc AND s.number = f.m)""")
def _(t):
    return S.repair_shifted_duplicate(order_rows(t), ["doc"], ["group"]).filter("repaired").select("doc", "idx", "number")


PAIRED = """, k AS (SELECT *, row_number() OVER (PARTITION BY doc, grp, number, zone ORDER BY idx) AS k FROM talk),
 pairs AS (SELECT s.doc, s.idx, s.number, s.grp, a.idx AS solution_idx FROM (SELECT * FROM k WHERE zone = 'stem') s LEFT JOIN (SELECT * FROM k WHERE zone = 'solution') a
 ON a.doc = s.doc AND a.grp IS NOT DISTINCT FROM s.grp AND a.number IS NOT DISTINCT FROM s.number AND a.k = s.k)"""


@query("pairs_by_coordinate", "J1", WT + PAIRED + " SELECT doc, idx, solution_idx FROM pairs")
def _(t):
    return pairing.pair_by_coordinate(talk_blocks(t)).select("doc", "idx", "solution_idx")


@query("pairing_conflicts", "J2", WT + PAIRED + """ SELECT doc, 'orphan_solution' AS conflict, idx AS detail FROM talk WHERE zone = 'solution' AND (doc, idx) NOT IN
 (SELECT (doc, solution_idx) FROM pairs WHERE solution_idx IS NOT NULL) UNION ALL SELECT doc, 'unnumbered_stems', count(*) FROM talk WHERE zone = 'stem' AND number IS NULL GROUP BY doc""")
def _(t):
    b = talk_blocks(t)
    return pairing.conflicts(b, pairing.pair_by_coordinate(b))


SEQUENTIAL = """, pl AS (SELECT *, max(CASE WHEN zone = 'stem' THEN idx END) OVER (PARTITION BY doc ORDER BY idx) AS stem_idx FROM talk),
 byorder AS (SELECT s.doc, s.idx, s.number, a.idx AS solution_idx FROM pl s LEFT JOIN pl a ON a.doc = s.doc AND a.stem_idx = s.idx AND a.zone = 'solution' WHERE s.zone = 'stem')"""


@query("pairs_by_order", "J3", WT + SEQUENTIAL + " SELECT doc, idx, solution_idx FROM byorder")
def _(t):
    return pairing.pair_by_order(talk_blocks(t)).select("doc", "idx", "solution_idx")


@query("pairs_by_chosen_mode", "J4 W3", WT + PAIRED + SEQUENTIAL + """, st AS (SELECT doc, count_if(zone = 'stem') AS n, count_if(zone = 'stem' AND number IS NULL) AS bare,
 count(DISTINCT CASE WHEN zone = 'stem' THEN number END) AS dn, max(CASE WHEN zone = 'stem' THEN number END) - min(CASE WHEN zone = 'stem' THEN number END) + 1 AS w FROM talk GROUP BY doc)
 SELECT doc, idx, solution_idx, mode, CASE WHEN bare = 0 AND n > 1 AND dn = n AND w = n THEN number ELSE idx END AS place FROM (
 SELECT doc, idx, number, solution_idx, 'coordinate' AS mode FROM pairs WHERE doc NOT IN (SELECT doc FROM st WHERE n = 0 OR bare * 2 > n)
 UNION ALL SELECT doc, idx, number, solution_idx, 'order' FROM byorder WHERE doc IN (SELECT doc FROM st WHERE n = 0 OR bare * 2 > n)) JOIN st USING (doc)""")
def _(t):
    return pairing.pair_blocks(talk_blocks(t)).select("doc", "idx", "solution_idx", "mode", "place")


@query("pairs_of_two_runs", "J5", W + """, s AS (SELECT *, max(number) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
 count(*) OVER (PARTITION BY doc) AS n FROM seq), cut AS (SELECT doc, min(idx) AS c FROM s WHERE number = 1 AND seen >= 5 AND n - idx >= 3 GROUP BY doc HAVING min(idx) > 0)
 SELECT a.doc, a.idx, a.number, b.idx AS solution_idx, b.text AS solution FROM (SELECT s.* FROM seq s JOIN cut USING (doc) WHERE idx < c) a
 LEFT JOIN (SELECT s.* FROM seq s JOIN cut USING (doc) WHERE idx >= c) b ON a.doc = b.doc AND a.number = b.number""")
def _(t):
    return pairing.pair_two_runs(order_rows(t)).select("doc", "idx", "number", "solution_idx", "solution")


@query("uncovered_numbers", "J24", WT + PAIRED + " SELECT DISTINCT doc, number FROM pairs WHERE solution_idx IS NULL AND number IS NOT NULL")
def _(t):
    return pairing.uncovered_numbers(pairing.pair_by_coordinate(talk_blocks(t)))


@query("label_correction", "J23", """SELECT d.doc_id AS doc, CASE WHEN d.n_chars % 2 = 0 AND NOT coalesce(l.toxic = 1, false) THEN 'stem' ELSE 'solution' END AS zone FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(t):
    b = t.documents.select(F.col("doc_id").alias("doc"), F.when(F.col("n_chars") % 2 == 0, "stem").otherwise("solution").alias("zone"))
    said = t.labels.select(F.col("doc_id").alias("doc"), F.when(F.col("toxic") == 1, "solution").otherwise("stem").alias("kind"))
    return pairing.apply_labels(b, said, ["doc"])


@query("duplicate_numbers", "A6", "SELECT l_orderkey AS doc, l_linenumber AS number, count(*) AS uses FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number")).agg(F.count("*").alias("uses")).filter("uses > 1")


@query("duplicate_surplus", "A5", """SELECT doc, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT l_orderkey AS doc, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY doc""")
def _(t):
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("doc"), "l_linenumber").agg(F.count("*").alias("n"))
    return per.groupBy("doc").agg(F.sum(F.col("n") - 1).alias("surplus"))
