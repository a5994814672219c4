"""Rules for plain zones, each with texts on both sides of its guards."""

import pytest
from pyspark.sql import functions as F

from itemloom.functions import zones as Z

D = "$\\displaystyle "
CASES = {
    "wrap_letters": [
        ("设 x 与 y.", f"设 {D}x$ 与 {D}y$."), ("A. 1 B. 2", f"{D}A.$ 1 {D}B.$ 2"), ("A. $\\dfrac{5}{2}$ B. 2", f"{D}A.$ $\\dfrac{{5}}{{2}}$ {D}B.$ 2"),
        ("$a$ b", f"$a$ {D}b$"), ("a组 k 步", "a组 k 步"), ("(i) 与 （ I ）", "(i) 与 （ I ）"), ("(a)", f"({D}a$)"), ("ab x1", "ab x1"),
        ("P _ {2} x", "P _ {2} x"), ("x$ y", f"x$ {D}y$"), ("![x](a.png) z", f"![x](a.png) {D}z$"), ("图 a-b.png c", f"图 a-b.png {D}c$"),
        ("<b c> d `e`", f"<b c> {D}d$ `e`"), ("\\alpha x", "\\alpha x"), ("$\\alpha$ x\n\\beta y\nz", f"$\\alpha$ {D}x$\n\\beta y\n{D}z$"), ("填 ___ x", "填 ___ x"), (None, None), ("", "")],
    "wrap_numbers": [
        ("值 3 与 -2", f"值 {D}3$ 与 {D}-2$"), ("0.025x 0.5", f"0.025x {D}0.5$"), ("1 - 2", f"{D}1$ - {D}2$"), ("(a) -2", f"(a) -{D}2$"), ("1. 题 (1) 与 （ 2 ）", "1. 题 (1) 与 （ 2 ）"),
        ("第25位 图 2 方法1 80% 5分 2025 年", "第25位 图 2 方法1 80% 5分 2025 年"), ("3.5分 3.5a", f"3.5分 {D}3$.5a"), ("$1$ 2", f"$1$ {D}2$"), ("$5 6$7", "$5 6$7"), ("x1 2", f"x1 {D}2$"), (None, None)],
    "strip_option_parens": [("($\\displaystyle A.$) （$\\displaystyle B$）", "$\\displaystyle A.$ $\\displaystyle B$"), ("$\\displaystyle (C).$ f(A)", "$\\displaystyle C.$ f(A)"), ("$\\displaystyle f(A)$", "$\\displaystyle f(A)$")],
    "free_embedded_labels": [("(A) $x(\\mathrm{B})$ $y$", "(A) $x$ (B) $y$"), ("$x\\mathrm{ C }$ . $y$", "$x$ C. $y$"), ("$x\\mathrm{A}$ . $y$ $\\mathrm{B}$", "$x\\mathrm{A}$ . $y$ $\\mathrm{B}$")],
    "add_first_label": [
        ("题 ( )\n![](a.png)\n\n 2.0m/s B. 3 C. 4 D. 5", "题 ( )\n![](a.png)\n\nA. 2.0m/s B. 3 C. 4 D. 5"), ("题\n![](a.png)\n2.0 B. 3 C. 4 D. 5", "题\n![](a.png)\n2.0 B. 3 C. 4 D. 5"),
        ("题 ( )\n2.0 B. 3 C. 4 D. 5", "题 ( )\n2.0 B. 3 C. 4 D. 5"), ("( )\n![](a.png)\nB. 3 C. 4 D. 5", "( )\n![](a.png)\nB. 3 C. 4 D. 5"), ("( )\n![](a.png)\n" + "y" * 81 + " B. 3 C. 4 D. 5", "( )\n![](a.png)\n" + "y" * 81 + " B. 3 C. 4 D. 5")],
    "split_compact_labels": [
        ("题 (\\quad)A.3.5JB.3.1JC.xD.y z\n尾", "题 (\\quad)A.3.5J\nB.3.1J\nC.x\nD.y z\n尾"), ("题 A.1B.2C.3D.4", "题 A.1B.2C.3D.4"), ("( )A.1B.2C.3D.4E A.5", "( )A.1B.2C.3D.4E A.5"),
        ("( )A.1 B.2C.3D.4", "( )A.1 B.2C.3D.4"), ("( )A.$A.x$B.2C.3D.4", "( )A.$A.x$\nB.2\nC.3\nD.4"), ("( )A.B.2C.3D.4", "( )A.B.2C.3D.4"), ("( ) q A.1B.2C.3D.4", "( ) q A.1B.2C.3D.4"), ("( )A." + "x" * 65 + "B.2C.3D.4", "( )A." + "x" * 65 + "B.2C.3D.4")],
}


@pytest.mark.parametrize("rule", CASES)
def test_rules(spark, rule):
    rows = [(i, a) for i, (a, _) in enumerate(CASES[rule])]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, t string").select("i", getattr(Z, rule)(F.col("t")).alias("t")).collect()}
    assert [got[i] for i in range(len(rows))] == [b for _, b in CASES[rule]]
