"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``K`` least distinct hashes of a text's five-word shingles, A-Z lowered.
Sketches of parts merge into the sketch of the whole (the least K of both). From two sketches
follow resemblance (Jaccard likeness), containment and the number of distinct shingles.

Defined results: a null or wordless text has the empty sketch; two empty sketches are fully
alike (1.0), an empty and another are not (0.0). A text of fewer than five words has its whole
sequence as its one shingle. Equal texts have equal fingerprints. Rows with equal ids are
ordered by text, null ids come first, and each row counts; other columns are ignored.
"""

from __future__ import annotations

import binascii
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, Texts, shingles, slices, texts_from, texts_of, words_of
from .common import documents, partitions, spread
from .ordered import bucketed, dealt, with_heads

K = 128
WIDTH = 5
SPACE = float(1 << 64)


def sketches(texts: Texts, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """Ascending distinct hashes, at most k, of each document."""
    words = words_of(texts)
    value, doc = shingles(words, words.hashes(LOWER), width)
    order = np.argsort(doc, kind="stable")
    value, cut = value[order], np.searchsorted(doc[order], np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        v = value[a:b]
        if len(v) > 4 * k:  # repeated shingles may crowd the first, then all are sorted
            least = np.unique(np.partition(v, 2 * k)[:2 * k])
            if len(least) >= k:
                out.append(least[:k])
                continue
        out.append(np.unique(v)[:k])
    return out


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = merged(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both)) if len(both) else 0.0


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Exact below k, else from the place of the k-th least hash."""
    return float(len(a)) if len(a) < k else (k - 1) * SPACE / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    union = distinct_count(merged(a, b, k), k)
    return float(min(1.0, r * union / max(1.0, distinct_count(a, k))))


def text_of(sketch: np.ndarray) -> str:
    return binascii.b2a_base64(sketch.astype(">u8").tobytes(), newline=False).decode()


def parse(text: str) -> np.ndarray:
    return np.frombuffer(binascii.a2b_base64(text), dtype=">u8").astype(np.uint64)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id and fingerprint (string) of every document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = sketches(texts_of(part.column("text")), k, width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([text_of(x) for x in found], pa.string())], names=["doc_id", "fingerprint"])

    return documents(df, doc_id, text).mapInArrow(run, "doc_id long, fingerprint string")


def merge_fingerprints(df: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each key from those of its parts.

    Each task first merges what it holds of a key; then a key has at most one sketch from a
    task, so a hot key costs no more than others.
    """

    def run(batches):
        held: dict = {}
        for batch in batches:
            for name, text in zip(batch.column("key").to_pylist(), batch.column("f").to_pylist()):
                held[name] = merged(held[name], parse(text), k) if name in held else parse(text)[:k]
            if len(held) > 50_000:
                yield out(held)
                held = {}
        yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([text_of(x) for x in held.values()], pa.string())], names=["key", "f"])

    named = df.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(fingerprint), F.lit("")).alias("f"))
    salted = spread(named.mapInArrow(run, "key string, f string").withColumn("salt", F.pmod(F.hash("f"), F.lit(64))), "key", "salt")
    once = salted.select("key", "f").mapInArrow(run, "key string, f string")
    return spread(once, "key").mapInArrow(run, "key string, f string").select(F.col("key").alias(key), F.col("f").alias(fingerprint))


def likeness(df: DataFrame, left: str, right: str, k: int = K) -> DataFrame:
    """Add resemblance, containment of left in right, and both distinct counts."""

    @F.pandas_udf("resemblance double, containment double, left_count double, right_count double")
    def measure(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            p, q = parse(x or ""), parse(y or "")
            rows.append((resemblance(p, q, k), containment(p, q, k), distinct_count(p, k), distinct_count(q, k)))
        return pd.DataFrame(rows, columns=["resemblance", "containment", "left_count", "right_count"])

    return df.withColumn("_m", measure(left, right)).select("*", "_m.*").drop("_m")


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the beginning of the next one."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprint of each text and of its edit with the next document, and their likeness.

    Rows are dealt once, by stretches of doc_id; each stretch also gets the first row of the
    next one, so that tasks walk their rows in order and remember one document.
    """
    rows, _ = bucketed(documents(df, doc_id, text))
    ready = dealt(with_heads(rows), partitions(df.sparkSession), "guest", "doc_id", "text")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        held = None  # bucket, doc_id, text, sketch of the row that waits for its successor
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, ids, texts = (part.column(c).to_pylist() for c in ("bucket", "doc_id", "text"))
                own = sketches(texts_of(part.column("text")), k, width)
                pairs = []
                for b, d, t, s in zip(bucket, ids, texts, own):
                    if held is not None and held[0] == b:
                        pairs.append((*held[1:], t, s))
                    held = (b, d, t, s)
                if not pairs:
                    continue
                changed = [edited(t, after) for _, t, _, after, _ in pairs]
                other = sketches(texts_from(changed), k, width)
                yield pa.RecordBatch.from_arrays([
                    pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed], pa.string()),
                    pa.array([text_of(p[2]) for p in pairs], pa.string()), pa.array([text_of(x) for x in other], pa.string()),
                    pa.array([resemblance(p[2], x, k) for p, x in zip(pairs, other)], pa.float64()),
                    pa.array([resemblance(p[2], p[4], k) for p in pairs], pa.float64())], names=names)

    return ready.mapInArrow(run, SCHEMA)
