"""Whitening, collocations and the language model against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("itemloom.llm")

from itemloom.llm import collocations, maxent, whitening  # noqa: E402
from itemloom.llm.arrays import texts_from  # noqa: E402
from itemloom.llm.queries import SQL  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<float>, label int, x string, n int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, w string, k string, row string"


def vectors(spark, rows):
    """A table whose extra columns clash with names the operator uses inside."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 1) for i, v in rows], VECTORS).repartition(3)


def documents(spark, texts, langs=None, ids=None):
    ids, langs = range(len(texts)) if ids is None else ids, langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", 1, 0.5, "x", "y", "z") for i, t, g in zip(ids, texts, langs)], DOCS).repartition(3)


# whitening


def test_whitening_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((60, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]).astype(np.float32)
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(None, v[0].tolist()), (7, v[0].tolist())]  # copies, null and equal ids
    odd = [(91, None), (92, [None] * 6), (93, [1.0, float("nan"), 0, 0, 0, 0]), (94, [float("inf")] * 6), (95, [1.0, 2.0]), (96, [])]
    out = whitening.whitened(vectors(spark, rows + odd)).toPandas()
    x = np.floor(256 * v.astype(float))
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, q = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, q = e[::-1], q[:, ::-1]
    assert len(out) == 4 * 62 and set(out.n) == {n} and out.identity_error.max() < 1e-9
    for k in range(4):
        part = out[(out.component == k + 1) & out.vec_id.notna()].drop_duplicates(["vec_id", "deviation"])
        want = {(i, int(((n * r - s) ** 2).sum())): float((r - s / n) @ q[:, k] / math.sqrt(e[k])) for i, r in enumerate(x)}
        want |= {(7, int(((n * x[0] - s) ** 2).sum())): want[0, int(((n * x[0] - s) ** 2).sum())]}
        got = {(int(r.vec_id), r.deviation): r.whitened for r in part.itertuples()}
        sign = np.sign(got[0, next(d for i, d in got if i == 0)] * want[0, next(d for i, d in want if i == 0)])
        assert got.keys() == want.keys() and max(abs(sign * got[i] - want[i]) for i in want) < 1e-9
        assert abs(part.explained.iloc[0] / (e[k] / e.sum()) - 1) < 1e-9


def test_repeated_and_missing_directions(spark):
    corners = [(i, [float(a) * (k == i // 2) for k, a in zip(range(5), [1 if i % 2 else -1] * 5)]) for i in range(10)]  # all eigenvalues equal
    out = whitening.whitened(vectors(spark, corners)).toPandas()
    assert out.component.max() == 4 and out.identity_error.max() < 1e-9 and np.allclose(out.explained, 0.2)
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(8)]  # one direction only
    out = whitening.whitened(vectors(spark, flat)).toPandas()
    assert set(out.component) == {1} and np.allclose(out.explained, 1.0)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])]):
        assert whitening.whitened(vectors(spark, rows)).count() == 0


def test_wide_vectors_stop_when_settled():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 300)) * np.concatenate(([9, 7, 5, 4], np.full(296, 0.5)))
    x -= x.mean(axis=0)
    jobs = []

    def product(known, v):
        jobs.append(1)
        return np.append((x @ known).T @ (x @ v), (x @ v) @ (x @ v))

    def adjoint(known, c):
        u = x @ c
        return np.concatenate((x.T @ u, (x @ known).T @ u, [u @ u]))

    values, right = whitening.bidiagonal(product, adjoint, 300, 4)
    _, s, q = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:4], rtol=1e-12) and np.allclose(np.abs((right * q[:4]).sum(axis=1)), 1) and len(jobs) < 200


# collocations


def plain_phrases(rows, least, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = collections.defaultdict(list)
    cand = [k for k in f if len(k[1]) > 1]
    for lang, g in cand:
        a = f[lang, g]
        cut = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        inside = any(100 * f[lang, h] >= 80 * a for x, h in cand if x == lang and len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h))))
        if not inside:
            out[lang].append((-cut[0], -a, " ".join(g).encode(), f[lang, g[:cut[1]]], f[lang, g[cut[1]:]]))
    return {(lang, r + 1, p.decode(), -a, lft, rgt, n[lang], -s) for lang, v in out.items() for r, (s, a, p, lft, rgt) in enumerate(sorted(v)[:top])}


def corpus():
    rng = random.Random(4)
    words = ["Aa", "bb", "éé", "cc", "dd", "x1", "yy", "zz"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t", " \x0c", "!"]) for _ in range(90)) for _ in range(40)]
    texts += ["Aa bb cc dd éé yy zz " * 300, "", None, " \t\n", ".;", "one two three four five six seven eight. " * 12, "one two three four five six seven eight"] + ["copy of a row"] * 9
    langs = ["en", None, "de", "und", ""] * 20
    return texts, langs[:len(texts)]


def test_collocations_equal_the_plain_count(spark):
    texts, langs = corpus()
    out = collocations.mine(documents(spark, texts, langs, [None, 3] * (len(texts) // 2) + [1] * (len(texts) % 2)), least=8, top=15).collect()
    assert {tuple(r)[:8] for r in out} == plain_phrases(zip(langs, texts), 8, 15) and len(out) == len({(r.lang, r["rank"]) for r in out})
    assert collocations.mine(documents(spark, ["", None, "a b"])).count() == 0
    assert collocations.mine(documents(spark, [])).count() == 0


def test_a_full_table_of_counters_changes_nothing(spark, monkeypatch):
    texts, langs = corpus()
    monkeypatch.setattr(collocations, "FEWEST_BITS", 4)
    monkeypatch.setattr(collocations, "MOST_BITS", 4)  # every counter is reached
    out = collocations.mine(documents(spark, texts, langs), least=8, top=15).collect()
    assert {tuple(r)[:8] for r in out} == plain_phrases(zip(langs, texts), 8, 15)


def test_paths_are_the_unary_runs_and_rings(spark):
    chain = [("en", 4, [i, i + 1, i + 2, i + 3], 9) for i in range(1, 12)]
    ring = [("en", 4, [100 + (i + k) % 5 for k in range(4)], 3) for i in range(5)]
    branch = [("en", 4, [7, 8, 9, 50], 4)]  # leaves the chain at node 7 8 9
    counts = spark.createDataFrame(chain + ring + branch, "lang string, k int, g array<long>, n long")
    got = {tuple(r.path): (r.words, r.least, r.most) for r in collocations.paths(collocations.compacted(counts)).collect()}
    assert got == {tuple(range(1, 10)): (9, 9, 9), tuple(range(7, 15)): (8, 9, 9), (7, 8, 9, 50): (4, 4, 4), (100, 101, 102, 103, 104, 100, 101, 102): (8, 3, 3)}


def test_collocation_sql_states_the_same(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts, langs = corpus()
    docs = documents(spark, [t and t * 3 for t in texts], langs)
    con = duckdb.connect()
    frame = docs.toPandas()  # noqa: F841
    con.execute("create view documents as select * from frame")
    cur = con.execute(SQL["op12_phrase_collocations"])
    names = [d[0] for d in cur.description]
    got = collocations.mine(docs).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall()) and got


# language model


def plain_base(rows):
    tokens = [re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [0] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for (i, _), t, h in zip(rows, tokens, held)]


@pytest.mark.parametrize("head", [1 << 19, 40])
def test_base_scores_equal_the_plain_count(spark, head):
    rng = random.Random(8)
    texts = [" ".join("W%d" % int(300 * rng.random() ** 3) for _ in range(rng.randrange(80))) for _ in range(60)] + ["", None, " \n", "new words only here", "x " * 40_000, "a b"]
    ids = [None, 5, 5] + list(range(10, 10 + len(texts) - 3))
    docs = documents(spark, texts + ["a b"] * 3, ids=ids + [5, 5, None])
    out = maxent.scored(docs, head_words=head).collect()
    want = plain_base(list(zip(ids + [5, 5, None], texts + ["a b"] * 3)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 6))
    assert sorted(map(key, out)) == sorted(map(key, want))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)


def test_empty_tables_and_no_training_rows(spark):
    assert maxent.scored(documents(spark, [])).count() == 0
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = maxent.scored(documents(spark, ["a b c"], ids=[alone])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 4, 0, 0, 0.0, 0.0)


def test_the_model_is_a_distribution_and_learns(spark):
    rng = random.Random(2)
    pairs = {f"w{i}": [f"w{(7 * i + k) % 90}" for k in (1, 2)] for i in range(90)}

    def text():
        w = ["w1"]
        for _ in range(120):
            w.append(rng.choice(pairs[w[-1]]))
        return " ".join(w)

    docs = documents(spark, [text() for _ in range(150)])
    rows = docs.select("doc_id", "text")
    counts = maxent.vocabulary(rows.filter(~maxent.held_out()))
    lex = maxent.lexicon(counts, 70)  # some words are rare, so all kinds of classes take part
    tables = maxent.train(rows.filter(~maxent.held_out()), lex)
    tail = [r.c for r in counts.filter(F.col("c") < lex.least).collect()]
    names = [f"w{i}" for i in range(90)]
    total = 0.0
    held = {r.w % (1 << 64): r.c for r in counts.collect()}
    for word in [*names, "never", ""]:  # the last is the end
        tokens = maxent.tokens_of(pa.array([f"w5 w4 {word}"]))
        at = lex.find(tokens.hashes)
        log = maxent.log_probabilities(lex, tables, tokens, at)[2]
        if at[2] < 0:
            log += math.log10(held.get(int(tokens.hashes[2]), 0) + 0.5) - lex.rare
        total += 10 ** log
    assert tail and abs(total - 1) < 1e-4
    out = maxent.scored(docs).filter("held_out").toPandas()
    assert (out.score > out.base_score).mean() > 0.95 and out.score.sum() > 0.9 * out.base_score.sum()


def test_gradient_steps_equal_plain_loops():
    lex = maxent.Lexicon(1, 10, 2, np.array([3, 5], np.uint64), np.zeros(2), np.array([0, 0]), np.array([0, 1]), np.zeros(2),
                         np.linspace(-1, 0, maxent.CLASSES).astype(np.float32), np.zeros((maxent.NEAR_CLASSES, maxent.CLASS_WORDS), np.float32), 0.0)
    hashes = np.array([3, 5, 9, 3, 3], np.uint64)
    tokens = maxent.Tokens(hashes, np.zeros(5, np.int64), np.arange(5), 1)
    tables, (pasts, seen) = maxent._empty(), ([np.zeros(1 << b, kind) for b in (15, 14)] for kind in (np.float32, np.int64))
    maxent.learn(lex, tables, pasts, seen, tokens)
    cls = np.array([0, 0, maxent.CLASSES - 1, 0, 0])
    top, _ = maxent._rows(tokens, cls)
    share = np.exp(lex.class_bias) / np.exp(lex.class_bias).sum()
    want = np.zeros_like(tables[0])
    past = np.zeros((len(want), 1))
    for rows in top:  # one batch: the same gradient for all four features, one step for each
        pull = np.zeros_like(want)
        for t, r in enumerate(rows):
            pull[r] += (np.arange(maxent.CLASSES) == cls[t]) - share
        past += (pull * pull).sum(axis=1, keepdims=True)
        want += maxent.RATE * pull / np.sqrt(past + maxent.START)
    assert np.abs(want - tables[0]).max() < 1e-4 and seen[0].sum() == 20


def test_word_classes_cover_the_counts(spark):
    counts = spark.createDataFrame([(i, 4000 - i) for i in range(3000)], "w long, c long")
    lex = maxent.lexicon(counts, 2500)
    assert len(lex.known) <= 2500 and lex.words == 3000 and lex.tokens == sum(4000 - i for i in range(3000))
    assert abs(np.exp(lex.class_bias.astype(float)).sum() - 1) < 1e-5
    assert np.allclose(np.exp(lex.word_bias.astype(float)).sum(axis=1)[:maxent.NEAR_CLASSES], 1, atol=1e-4)
    for k in range(maxent.NEAR_CLASSES, maxent.CLASSES - 1):
        assert abs((10 ** lex.inside[lex.class_of == k]).sum() - 1) < 1e-6


def test_tokens_end_every_document():
    tokens = maxent.tokens_of(pa.array(["a B", None, "", "c"]))
    assert tokens.doc.tolist() == [0, 0, 0, 1, 2, 3, 3] and (tokens.hashes[[2, 3, 4, 6]] == maxent.END).all()
    assert (tokens.before(1)[[0, 3, 4, 5]] == maxent.BEFORE).all() and tokens.before(1)[1] == tokens.hashes[0]
    assert len(texts_from(["a"])) == 1
