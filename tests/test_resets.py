import random

from itemloom.operators import collections as CO, resets as RS


def as_dict(df):
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


def test_titles_before_a_restart(spark):
    text = {
        "plain": ["# 甲校月考", "", "## 一、单选题", "1. a", "正文", "1. b"],
        "section": ["1. a", "## 二、填空题", "1. b"],
        "cover": ["# 乙校期末", "学校：", "![](a.png)", "1. a"],
        "far": ["# 丙校期末", *["学校："] * 20, "1. a"],
        "fence": ["```", "# 不是标题", "1. a", "```", "2. b", "| 3. c |"],
        "bold": ["**丁校联考**", "# 第十二题 求"],
        "long": ["# " + "长" * 121, "1．a"],
        "blank": ["", None],
        "decimal": ["1.5 米", "第3题 x"],
    }
    rows = [(d, i, t) for d, ls in text.items() for i, t in enumerate(ls)]
    got = {(r.doc, r.line_no): (r.number, r.title, r.title_line, r.section) for r in RS.number_hits(spark.createDataFrame(rows, "doc string, line_no long, text string")).collect()}
    assert got == {
        ("plain", 3): (1, "甲校月考", 0, False), ("plain", 5): (1, None, None, False),
        ("section", 0): (1, None, None, False), ("section", 2): (1, None, None, True),
        ("cover", 3): (1, "乙校期末", 0, False), ("far", 21): (1, None, None, False), ("fence", 4): (2, None, None, False),
        ("bold", 1): (12, "丁校联考", 0, False), ("long", 1): (1, "长" * 121, 0, False), ("decimal", 1): (3, None, None, False)}


HITS = "doc string, line_no long, number int, title string, title_line long"


def nested_brute(hits):
    """Parts of one unit as (first line, numbers), or None for a rejected document."""
    if not hits or hits[0][1] != 1:
        return []
    groups, open_ = [], []
    for h in hits:
        if h[1] == 1 and open_ and open_[-1][1] != 1 and len({n for _, n, _ in open_}) >= 5 and h[2]:
            groups.append(open_)
            open_ = []
        open_.append(h)
    groups.append(open_)
    if len(groups) < 2:
        return []
    sets = [sorted({n for _, n, _ in g}) for g in groups]
    if any(len(s) < 5 or len(s) / max(s) < 0.85 for s in sets):
        return None
    return [(g[0][0], s) for g, s in zip(groups, sets)]


def test_nested_units_against_brute_force(spark):
    rnd = random.Random(5)
    hits, units, want, bad = [], [], {}, set()
    for d in range(60):
        doc, line = f"d{d}", 1
        for u in (1, 2):
            units.append((doc, u, line, f"专题{u}", u))
            own = []
            line += 1
            for _ in range(rnd.randint(1, 4)):
                top = rnd.choice([2, 3, 5, 6, 9])
                numbers = list(range(1, top + 1))
                if rnd.random() < 0.08:
                    numbers = [n for n in numbers if n not in (2, 3)]
                if rnd.random() < 0.1:
                    numbers = [1, *numbers]
                if rnd.random() < 0.05:
                    numbers = numbers[1:]
                for j, n in enumerate(numbers):
                    titled = j == 0 and rnd.random() < 0.7
                    if titled:
                        line += 1
                    own.append((line, n, titled))
                    hits.append((doc, line, n, f"卷{line}" if titled else None, line - 1 if titled else None))
                    line += 1
            parts = nested_brute(own)
            if parts is None:
                bad.add(doc)
            elif parts:
                for i, (first, s) in enumerate(parts):
                    at = [x for x in own if x[0] == first][0]
                    want[doc, u, i + 1] = (first - 1 if at[2] else first, f"专题{u}" if i == 0 else f"卷{first}", u if i == 0 else None, s, True)
            else:
                want[doc, u, 1] = (units[-1][2], f"专题{u}", u, sorted({n for _, n, _ in own}), False)
    units.append(("empty", 1, 1, "空", 1))
    want["empty", 1, 1] = (1, "空", 1, [], False)
    want = {k: v for k, v in want.items() if k[0] not in bad}
    parts, rejected = RS.nested_units(spark.createDataFrame(units, "doc string, unit int, start_line long, title string, ordinal int"), spark.createDataFrame(hits, HITS))
    got = {(r.doc, r.unit, r.part): (r.start_line, r.title, r.ordinal, r.question_numbers, r.number_reset) for r in parts.collect()}
    assert got == want
    assert {tuple(r) for r in rejected.collect()} == {(d, "coverage") for d in bad} and bad
    assert any(k[2] > 1 for k in want)


def solution_groups(numbers):
    groups, open_ = [], []
    for n in numbers:
        if n == 1 and len(set(open_)) >= 2:
            groups.append(open_)
            open_ = []
        open_.append(n)
    return groups + [open_]


EXAMS = "collection string, pos int, title string, topic string, ordinal int, question_numbers array<int>, generated_title boolean"
TITLES = "collection string, line_no long, title string, topic string, ordinal int, strong boolean"


def test_solution_groups_against_brute_force(spark):
    rnd = random.Random(9)
    exams, hits, want, bad = [], [], set(), {}
    for d in range(80):
        doc = f"d{d}"
        numbers = [n for _ in range(rnd.randint(1, 4)) for n in rnd.choice([[1, 2, 3], [1, 1, 2], [3], [3, 3, 1], [1, 2, 3, 4, 5], [1]])]
        groups = solution_groups(numbers)
        units = [sorted(set(g)) for g in groups]
        if rnd.random() < 0.15:
            units = units[:-1] or [*units, [1, 2]]
        if rnd.random() < 0.15:
            units[0] = [1, 2, 3, 4, 5, 6, 7, 8]
        exams += [(doc, i + 1, f"第{i + 1}组", f"第{i + 1}组", None, u, True) for i, u in enumerate(units)]
        hits += [(doc, i, n, None, None) for i, n in enumerate(numbers)]
        if len(units) != len(groups):
            bad[doc] = "unit_count"
            continue
        for g, u in zip(groups, units):
            s = set(g)
            if len(s) < 2 or min(s) != 1 or len(s & set(u)) / max(len(s), len(u)) < 0.8:
                bad[doc] = "overlap"
        at = 0
        for i, g in enumerate(groups):
            if doc not in bad:
                want.add((doc, i + 1, at, tuple(sorted(set(g)))))
            at += len(g)
    want = {w for w in want if w[0] not in bad}
    units, rejected = RS.solution_units(spark.createDataFrame(exams, EXAMS), spark.createDataFrame(hits, HITS.replace("doc", "collection")), spark.createDataFrame([], TITLES))
    assert {(r.collection, r.pos, r.start_line, tuple(r.question_numbers)) for r in units.collect()} == want
    assert as_dict(rejected) == {(k,): v for k, v in bad.items()}
    assert want and set(bad.values()) == {"unit_count", "overlap"}


def test_solution_titles_and_the_sparse_tier(spark):
    full = list(range(1, 9))
    thin = [1, 2, 4, 5, 6, 8]                       # 6 of 8: 75 %
    cases = {                                        # second answer group, its title, wanted reason
        "whole": (full, ("精练二：动能定理", "动能定理", 2, True), None),
        "sparse": (thin, ("精练二：动能定理", "动能定理", 2, True), None),
        "weak": (thin, ("二、动能定理", "动能定理", 2, False), "overlap"),
        "ordinal": (thin, ("精练三：动能定理", "动能定理", 3, True), "overlap"),
        "tail": ([1, 2, 3, 4, 5, 6], ("精练二：动能定理", "动能定理", 2, True), "overlap"),
        "order": ([1, 2, 5, 4, 6, 8], ("精练二：动能定理", "动能定理", 2, True), "overlap"),
        "stray": (full, ("精练二：动量定理", "动量定理", 2, True), "title"),
        "generic": (full, ("提升精练二参考答案", "提升精练二参考答案", None, False), None),
        "other": (full, ("提升精练三参考答案", "提升精练三参考答案", None, False), "title"),
        "untitled": (full, None, None),
    }
    exams, hits, titles = [], [], []
    for c, (second, head, _) in cases.items():
        exams += [(c, 1, "精练一：力学", "力学", 1, full, False), (c, 2, "精练二：动能定理", "动能定理", 2, full, False)]
        hits += [(c, i + 1, n, None, None) for i, n in enumerate(full)] + [(c, i + 20, n, None, None) for i, n in enumerate(second)]
        if head:
            titles.append((c, 19, *head))
        titles.append((c, 5, "精练九：光学", "光学", 9, True))   # inside the first group: no group opens there
    units, rejected = RS.solution_units(spark.createDataFrame(exams, EXAMS), spark.createDataFrame(hits, HITS.replace("doc", "collection")), spark.createDataFrame(titles, TITLES))
    assert as_dict(rejected) == {(c,): why for c, (_, _, why) in cases.items() if why}
    second = {r.collection: (r.title, r.start_line, r.generated_title) for r in units.filter("pos = 2").collect()}
    assert second["sparse"] == ("精练二：动能定理", 19, False) and second["untitled"] == ("精练二：动能定理", 20, True)
    assert second["generic"] == ("提升精练二参考答案", 19, False)


def test_provisional_units(spark):
    whole, loose, short, few = range(1, 9), [1, 2, 5, 6, 8], [1, 2, 8], [1, 2, 3]
    cases = {"strict": [(1, True, whole), (2, False, whole)], "loose": [(1, True, whole), (2, True, loose)], "weak": [(1, False, whole), (2, True, loose)],
             "jump": [(1, True, whole), (3, True, loose)], "short": [(1, True, whole), (2, True, short)], "few": [(1, True, few), (2, True, loose)]}
    rows = []
    for doc, units in cases.items():
        for u, (ordinal, strong, numbers) in enumerate(units):
            rows.append((doc, u * 100, True, f"k{u}", None, strong, ordinal))
            rows += [(doc, u * 100 + i + 1, False, None, n, None, None) for i, n in enumerate(numbers)]
    lines = spark.createDataFrame(rows, "doc string, line_no long, is_title boolean, key string, number int, strong boolean, ordinal int")
    units, rejected = CO.provisional_units(lines)
    assert {(r.doc, r.start_line, r.provisional) for r in units.collect()} == {("strict", 0, False), ("strict", 100, False), ("loose", 0, True), ("loose", 100, True)}
    assert {r.doc for r in rejected.collect()} == {"weak", "jump", "short", "few"}
