"""Option figures follow their letters."""

from itemloom.operators.relocate import relocate_figures

IMG = "![](images/{}.png)"
LIST = "".join(f"\n\n({c})\n\n![选项{c}](images/{p}.png)" for c, p in zip("ABCD", "pqrs"))


def test_bodies_follow_the_assignment(spark):
    flat = "".join(IMG.format(p) for p in "qprs")
    bodies = {
        1: ("题 ( )\nA. 甲 B. 乙\nC. 丙 D. 丁\n" + flat, "题 ( )\nA.\n\n![选项A](images/p.png) 甲 B.\n\n![选项B](images/q.png) 乙\nC.\n\n![选项C](images/r.png) 丙 D.\n\n![选项D](images/s.png) 丁"),
        2: ("题 ( )\n" + IMG.format("z") + flat + "A. B. C. D.\n【解析】\n" + IMG.format("t"), "题 ( )\n\n![题干图](images/z.png)\n\nA.\n\n![选项A](images/p.png) B.\n\n![选项B](images/q.png) C.\n\n![选项C](images/r.png) D.\n\n![选项D](images/s.png)\n\n【解析】\n" + IMG.format("t")),
        3: ("题 (\\quad)\n" + flat + "\n($A$) ($B$) ($C$) ($D$)", "题 (\\quad)" + LIST),
        4: ("题 ( )\n" + flat + IMG.format("z"), "题 ( )\n\n![题干图](images/z.png)" + LIST),
        5: ("如题干图 ( )\n" + flat, None), 6: ("题\n" + flat, None), 7: ("题 ( ) A. B. C. D.\n" + IMG.format("p"), None), 8: ("题 ( )\n" + flat.replace("s.png", "x.png"), None),
        9: (None, None), 10: ("题 ( )\nA、A. B. C. D.\n" + flat, "题 ( )\nA、A.\n\n![选项A](images/p.png) B.\n\n![选项B](images/q.png) C.\n\n![选项C](images/r.png) D.\n\n![选项D](images/s.png)"), 11: ("题 ( )\n" + flat, None)}
    rows = spark.createDataFrame([(1, i, t) for i, (t, _) in bodies.items()], "doc int, item int, text string")
    marks = [(1, i, c, f"{p}.png") for i in bodies if i != 11 for c, p in zip("ABCD", "pqrs")] + [(1, 11, "A", "p.png")]
    got = {r["item"]: (r.moved, r.text) for r in relocate_figures(rows, spark.createDataFrame(marks, "doc int, item int, label string, figure string")).collect()}
    assert got == {i: (new is not None, new if new is not None else old) for i, (old, new) in bodies.items()}
