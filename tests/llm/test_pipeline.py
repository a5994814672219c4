"""The pipeline's stages on a small folder, and the guard of the entry module."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

llm = pytest.importorskip("itemloom.llm")
import corpus_pipeline  # noqa: E402

from tests.llm.test_operators import brute_components, prose  # noqa: E402

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(420):
        bad = i % 6 == 0
        words = prose(i, 60, 10**4).split()
        if bad:
            words[5:5] = [rng.choice(["vile", "nasty"])]
        text = " ".join(words)
        if i % 70 == 1:
            text += ' token = "0123456789abcdef0123"'
        rows.append((i, text, "en" if i % 3 else "de", f"src{i % 5}", len(text)))
        labels.append((i, int(bad), 1))
    rows += [(1000 + i, rows[1 + i][1] + " tail", "en", "src1", 5) for i in range(10)] + [(2000, None, None, None, None), (2001, "", "en", "src1", 0)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = corpus_pipeline.materialise(stages["toxicity"](spark, docs, folder))
    assert clean.columns == corpus_pipeline.COLUMNS
    left = {r.doc_id for r in clean.collect()}
    assert not {i for i in range(420) if i % 6 == 0} & left and {i for i in range(420) if i % 6} <= left and {2000, 2001} <= left

    one = corpus_pipeline.materialise(stages["ngram_jaccard"](spark, clean, folder))
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    want = {i for i, _, c in brute_components([t for _, t in rows], [i for i, _ in rows]) if i == c}
    assert {r.doc_id for r in one.collect()} == want

    safe = corpus_pipeline.materialise(stages["secret_scans"](spark, one, folder))
    texts = {r.doc_id: r for r in safe.collect()}
    before = {r.doc_id: r for r in one.collect()}
    assert set(texts) == set(before) and texts[2000].text is None
    for i, r in texts.items():
        if r.text and "<secret>" in r.text:
            assert "0123456789abcdef0123" not in r.text and r.n_chars == len(r.text)
        else:
            assert r == before[i]
    assert any(r.text and "<secret>" in r.text for r in texts.values())

    mixed = corpus_pipeline.materialise(stages["mixing"](spark, safe, folder))
    taken = {r.doc_id for r in mixed.collect()}
    total = sum(len((r.text or "").split()) for r in texts.values())
    assert taken < set(texts) and 0.85 * total < sum(len(texts[i].text.split()) for i in taken) < 0.99 * total

    pieces = stages["best_fit_packing"](spark, mixed, folder).collect()
    assert {r.doc_id for r in pieces} == taken


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder))
    a, b = (sorted(((r.doc_id, r.piece, r.length, r.ids_crc32) for r in x.collect())) for x in (docs, corpus_pipeline.run(spark, folder)))
    assert a == b


def test_entry_works_without_the_package(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith(('itemloom.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert q and not any(k.startswith('op1_') or k == 'pipeline' for k in q)\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_every_number_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_every_stage_hands_small_batches_to_workers(spark):
    import corpus_pipeline as P
    docs = spark.createDataFrame([(1, "ein kurzer Text"), (2, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'de' lang", "'a' source", "15L n_chars")
    saved = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert P.best_fit_packing(spark, docs, "").count() == 2
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == P.BATCH_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", saved)


def test_mixing_tells_documents_by_their_places(spark):
    """The same documents as by their ids, with no join of texts to ids; a document without words goes though its id is taken."""
    import corpus_pipeline as P
    from itemloom.llm import mixing
    rows = [(i, "wort " * (i % 7 + 1), ("de", "en")[i % 2], f"s{i % 5}") for i in range(300)] + [(1, "", "en", "s1"), (2, None, "de", "s2"), (None, "ohne nummer", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "15L n_chars")
    stage = P.mixing_weights(spark, docs, "")
    assert "LeftSemi" not in stage._jdf.queryExecution().optimizedPlan().toString()
    taken = mixing.mixed(docs, mixing.LEVELS, mixing.WEIGHTS, P.F.floor(P.F.col("all_tokens") * P.MIX_SHARE), epochs=1)
    got = [r.doc_id for r in stage.collect()]
    assert len(got) == len(set(got)) < 301 and set(got) == {r.doc_id for r in taken.collect()}
