"""Rules for the plain zones of a text, one query each; every table row takes one side of a guard."""

from pyspark.sql import functions as F

from ..functions import zones as Z
from ..registry import query

P = "SELECT p_partkey AS id, "
D = "$\\displaystyle "


def _cases(t, *cases):
    """A text for each part, by its key; ``#`` stands for its name and ``@`` for its key."""
    out = None
    for i, c in enumerate(cases):
        text = F.replace(F.replace(F.lit(c), F.lit("#"), F.col("p_name")), F.lit("@"), F.col("p_partkey").cast("string"))
        test = F.col("p_partkey") % len(cases) == i
        out = F.when(test, text) if out is None else out.when(test, text)
    return t.part.select(F.col("p_partkey").alias("id"), out.alias("text"))


def _sql(*cases):
    quote = lambda c: "replace(replace('" + c.replace("'", "''") + "', '#', p_name), '@', p_partkey::varchar)"
    return P + f"CASE p_partkey % {len(cases)} " + " ".join(f"WHEN {i} THEN {quote(c)}" for i, c in enumerate(cases)) + " END AS text FROM part"


@query("wrapped_letters", "X16", _sql(f"# 设 {D}x$ A组 {D}A.$ 1 $y$ {D}z$", "# P _ {2} x", "# (i) ![u](v.png) w-1.png", f"（{D}m$） ab #"))
def _(t):
    rows = _cases(t, "# 设 x A组 A. 1 $y$ z", "# P _ {2} x", "# (i) ![u](v.png) w-1.png", "（m） ab #")
    return rows.withColumn("text", Z.wrap_letters(F.col("text")))


@query("wrapped_numbers", "X16", _sql(f"值 {D}@$, {D}-@.5$ #", "@. # (@) 第@位 @分 @%", f"{D}@$ - {D}@$ $@$ 方法@", "\\alpha @ #"))
def _(t):
    rows = _cases(t, "值 @, -@.5 #", "@. # (@) 第@位 @分 @%", "@ - @ $@$ 方法@", "\\alpha @ #")
    return rows.withColumn("text", Z.wrap_numbers(F.col("text")))


@query("option_parens", "X16", _sql(f"{D}A.$ # {D}B$ @", f"{D}C.$ f(A) #", f"(# {D}A$) @"))
def _(t):
    rows = _cases(t, f"({D}A.$) # （{D}B$） @", f"{D}(C).$ f(A) #", f"(# {D}A$) @")
    return rows.withColumn("text", Z.strip_option_parens(F.col("text")))


@query("embedded_labels", "X15", _sql("(A) $@$ (B) $y$ #", "$@x$ C. $y$ #", "$\\mathrm{B}@$ # $\\mathrm{A}$ . $y$"))
def _(t):
    rows = _cases(t, "(A) $@(\\mathrm{B})$ $y$ #", "$@x\\mathrm{ C }$ . $y$ #", "$\\mathrm{B}@$ # $\\mathrm{A}$ . $y$")
    return rows.withColumn("text", Z.free_embedded_labels(F.col("text")))


FIRST = ("#( )\n![](a.png)\n\n{}@m/s B. 3 C. 4 D. 5", "#\n![](a.png)\n@ B. 3 C. 4 D. 5", "#( )\n@ B. 3 C. 4 D. 5", "#( )\n![](a.png)\n@ B. 3 D. 4 C. 5", "#( )\n![](a.png)\n" + "y" * 81 + " B. 3 C. 4 D. 5")


@query("missing_first_labels", "X15", _sql(*[c.replace("{}", "A. ") for c in FIRST]).replace("\n", "' || chr(10) || '"))
def _(t):
    return _cases(t, *[c.replace("{}", "  ") for c in FIRST]).withColumn("text", Z.add_first_label(F.col("text")))


COMPACT = ("#(\\quad)A.@J{}B.3.1J{}C.x{}D.y z\n#", "# A.@B.2C.3D.4", "#( )A.@ B.2C.3D.4", "#( )A.$B.@${}B.2{}C.3{}D.4", "#( )A.@B.2C.3D.4A.5")


@query("compact_labels", "X15", _sql(*[c.replace("{}", "\n") for c in COMPACT]).replace("\n", "' || chr(10) || '"))
def _(t):
    return _cases(t, *[c.replace("{}", "") for c in COMPACT]).withColumn("text", Z.split_compact_labels(F.col("text")))
