"""Placing passages on pages and proving swallowed tails, against plain versions."""

import random

from itemloom.operators.layout import locate_by_windows, page_key
from itemloom.plans import importing as IM


def plain_place(item, pages):
    import re
    text = re.sub(r"^\s*(\d{1,3})\s*[.．、]\s*", "", item or "")
    keys, held = page_key(text), [page_key(p) for p in pages]
    if max(map(len, keys)) < 32:
        windows = [(0, keys[0])] if keys[0] else []
    else:
        windows = [(k, key[:192][s:s + n]) for k, key in enumerate(keys) for n in (64, 48, 40, 32) for s in range(0, 97, 16) if s + n <= len(key[:192])]
    votes = set()
    for k, w in windows:
        on = [i for i, p in enumerate(held) if w in p[k]]
        votes |= set(on) if len(on) == 1 else set()
    return votes.pop() if len(votes) == 1 else None


def test_windows_place_items_as_a_full_comparison_does(spark):
    rng = random.Random(5)
    text = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    shared = text(80, "abcdef")
    pages = [text(400, "abcde 中文字典题，。") + (shared if i % 3 == 0 else "") + text(50, "xyz") for i in range(12)] + ["", None, "ＡＢ１２ wide ﬁrst"]
    items = [pages[1][20:160], "7. " + pages[2][5:105], pages[4][10:50] + "?" + pages[4][51:200], pages[0][380:480], shared, pages[5][30:45], "ab12wide", "", None,
             pages[6][0:90] + pages[7][0:90], "x" * 40, pages[3][-20:], "aaaaaaaa" * 30] + [pages[9][k:k + 33 + k] for k in range(12)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item long, text string, key string")
    where = spark.createDataFrame([(i, t, 1) for i, t in enumerate(pages)], "page long, text string, h int").repartition(4)
    got = {r["item"]: r["page"] for r in locate_by_windows(rows, where).collect()}
    want = {i: plain_place(t, pages) for i, t in enumerate(items)}
    assert got == {i: p for i, p in want.items() if p is not None} and len(got) > 12
    assert locate_by_windows(rows.limit(0), where).count() == 0


def test_longest_overlap_and_cover():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab12") for _ in range(rng.randrange(40))) for _ in range(2))
        n = max((n for n in range(1, 41) if any(a[i:i + n] in b for i in range(len(a) - n + 1))), default=0)
        size, i, j = IM.longest_overlap(a, b)
        assert size == n and a[i:i + n] == b[j:j + n]
    assert IM.covered("abcdefghijklmnop", "abcdefghijklmnop") == 16
    assert IM.covered("abcdefghXXijklmnopqr", "abcdefghijklmnopqr") == 18
    assert IM.covered("aaaa", "bbbb") == 0


def test_a_tail_goes_only_with_proof():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))
    own, nxt, more = word(200), word(300), word(200)
    cut = IM.swallowed_from(own + "\n\n" + nxt, nxt)
    assert cut == len(own) + 2
    formula = own + "\n$\\left(" + nxt[:90] + "\\right)$ " + nxt[90:]
    assert IM.swallowed_from(formula, nxt) == formula.index(nxt[:90])
    misread = own + nxt[:150] + "#" + nxt[152:]
    assert IM.swallowed_from(misread, nxt) == len(own)
    for kept in (own + nxt[:40] + more, own + nxt[:100] + more, nxt + own, own + nxt[:150] + "![](a.png)" + nxt[150:], own + nxt + nxt, own, "", None):
        assert IM.swallowed_from(kept, nxt) is None
    assert IM.swallowed_from(own + nxt, nxt[:60]) is None and IM.swallowed_from(own + nxt, None) is None


def test_trimmed_rows(spark):
    own, nxt = "o" * 40 + "0123456789" * 5 + "p" * 40, "".join(chr(97 + i * 7 % 26) + str(i) for i in range(90))
    rows = spark.createDataFrame([(1, 1, own + "\n" + nxt), (1, 2, own), (2, 1, None), (2, 2, own + nxt)], "doc long, number int, text string")
    found = spark.createDataFrame([(1, 2, "2. " + nxt), (2, 2, nxt), (2, 3, nxt), (2, 3, nxt + "x")], "doc long, number int, text string")
    got = {(r.doc, r.number): (r.trimmed, r.text) for r in IM.trim_swallowed_tail(rows, found).collect()}
    assert got == {(1, 1): (True, own), (1, 2): (False, own), (2, 1): (False, None), (2, 2): (False, own + nxt)}  # two recovered texts prove nothing


def test_plain_and_hashed_overlaps_agree(monkeypatch):
    rng = random.Random(5)
    for k in range(60):
        a, b = ("".join(rng.choice("abc" if k % 2 else "abcdefghijkl") for _ in range(rng.randint(0, 90))) for _ in range(2))
        plain = IM.longest_overlap(a, b)
        monkeypatch.setattr(IM, "PLAIN_OVERLAP", -1)
        assert plain == IM.longest_overlap(a, b)
        monkeypatch.undo()
    assert IM.longest_overlap("", "abc") == (0, 0, 0)


def test_keys_of_ascii_texts_equal_those_of_others():
    for text in ("A b<sub>1</sub> ![x](y.png) \\left(Z9_\n", "", "Q!<k", "\\displaystyle 12"):
        key, places = IM.visible_key(text)
        wide, at = IM.visible_key(text + "\u3002")  # not ASCII, adds nothing to a key
        assert (key, places) == (wide, at)


def test_short_keys_need_no_hashed_runs(monkeypatch):
    def fail(key):
        raise AssertionError("a short key was hashed")
    monkeypatch.setattr(IM, "_prefixes", fail)
    rng = random.Random(6)
    own, nxt = ("".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (96, 128))
    assert IM.swallowed_from(own + "\n" + nxt, nxt) == len(own) + 1
