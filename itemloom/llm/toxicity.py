"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled texts train a linear classifier in numpy. With the
class prior p, the risk is p*R(P,+) + max(0, R(U,-) - p*R(P,-)); where the second part falls
below zero the step instead climbs back, so the classifier cannot gain by calling unlabelled
toxic texts clean one by one. Labels of the unlabelled texts are never looked at.

Inputs of a score are the text's lower-cased letter runs and their runs of four bytes
(present or not); language, source, id and labels are not. Training takes at most
``MAX_POSITIVE`` and ``MAX_UNLABELLED`` texts, chosen by hash of the id, and ``MAX_FEATURES``
features; every document is scored, over its whole text.

Defined results: a null text is an empty one and gets the score of no features. Without a
positive or an unlabelled example every score is 0. Labels of null id or null value are
ignored; an id labelled twice counts as toxic if any label says so. Repeated rows are scored
alike. Null ids are scored and never train. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, Texts, mixed, slices, texts_of
from .common import documents

MAX_POSITIVE = 3000
MAX_UNLABELLED = 9000
MAX_FEATURES = 1024
LEAST_SEEN = 3  # positives that hold a feature
BITS = 20
EPOCHS = 300
RATE = 0.05
DECAY = 1e-4
GRAM = 4

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def features(texts: Texts, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs; features are below ``2 << BITS``.

    ``wanted`` (a bool for each feature) keeps only some, which makes scoring cheap.
    """
    data = texts.data
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _LETTER[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[texts.offsets] = True
    starts = np.flatnonzero(inside & (edge[:n] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    from .arrays import Words

    runs = Words(texts, starts, ends, None, None, None)
    whole = (runs.hashes(LOWER) >> np.uint64(64 - BITS)).astype(np.int64)
    place, value = [starts], [whole]
    if n >= GRAM:
        small = _SMALL[data].astype(np.uint32)
        gram = small[:-3] | (small[1:-2] << 8) | (small[2:-1] << 16) | (small[3:] << 24)
        gram = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + (1 << BITS)
        good = inside[:-3] & inside[1:-2] & inside[2:-1] & inside[3:] & ~edge[1:n - 2] & ~edge[2:n - 1] & ~edge[3:n]
        if wanted is not None:
            good &= wanted[gram]
        at = np.flatnonzero(good)
        place.append(at)
        value.append(gram[at])
    if wanted is not None:
        keep = wanted[whole]
        place[0], value[0] = starts[keep], whole[keep]
    at, value = np.concatenate(place), np.concatenate(value)
    doc = np.searchsorted(texts.offsets, at, "right") - 1
    pair = np.unique(doc << (BITS + 1) | value)
    return pair >> (BITS + 1), pair & ((2 << BITS) - 1)


def train(rows: list[np.ndarray], positive: np.ndarray, prior: float, chosen: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen features, their weights and the bias, from the chosen features of each example."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    is_p = positive.astype(bool)
    n_p, n_u = int(is_p.sum()), int((~is_p).sum())
    if not n_p or not n_u:
        return np.zeros(0, np.int64), np.zeros(0), -np.inf
    chosen = np.sort(chosen)
    at = np.full(2 << BITS, -1, dtype=np.int64)
    at[chosen] = np.arange(len(chosen))
    col = at[flat]
    keep = col >= 0
    col, owner = col[keep], owner[keep]
    w, b = np.zeros(len(chosen)), np.log(prior / (1 - prior))
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    share_p, share_u = np.where(is_p, 1 / n_p, 0.0), np.where(is_p, 0.0, 1 / n_u)
    for step in range(1, epochs + 1):
        f = np.bincount(owner, weights=w[col], minlength=len(rows)) + b
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        loss_minus = np.logaddexp(0, np.clip(f, -30, 30))
        rest = (share_u * loss_minus).sum() - prior * (share_p * loss_minus).sum()
        pull = share_u * s - prior * share_p * s
        g = prior * share_p * (s - 1) + pull if rest >= 0 else -pull
        grad = np.append(np.bincount(col, weights=g[owner], minlength=len(w)) + DECAY * w, g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        move = RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return chosen, w, float(b)


def _chosen(share: float) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("nnpu")), F.lit(1 << 20)) < int(share * (1 << 20))


def model(docs: DataFrame, labels: DataFrame, trains: Column | None = None, max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None, max_features: int = MAX_FEATURES):
    """Train on documents (doc_id, text) and labels (doc_id, toxic); ``trains`` says which rows may."""
    trains = F.lit(True) if trains is None else trains
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").na.drop().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(trains)
    count, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not toxic:
        return train([], np.zeros(0), 0.5, np.zeros(0, np.int64))
    prior = min(max(prior if prior is not None else toxic / count, 1e-4), 0.5)
    may = docs.filter(trains & F.col("doc_id").isNotNull())
    total = may.count()
    ids = known.filter((F.col("toxic") == 1) & _chosen(1.2 * max_positive / toxic)).select("doc_id")
    # at most about 1.2 * max_positive ids, whatever the number of labels
    positive = may.join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.lit(1).alias("p"))
    unlabelled = may.filter(_chosen(1.2 * max_unlabelled / max(1, total))).select("doc_id", "text", F.lit(0).alias("p"))

    both = positive.unionByName(unlabelled)
    chosen = _choose(both, max_features)

    def run(batches):
        wanted = np.zeros(2 << BITS, dtype=bool)
        wanted[chosen] = True
        for batch in batches:
            for part in slices(batch, "text"):
                doc, value = features(texts_of(part.column("text")), wanted)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                packed = [value[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("p"), pa.array(packed, pa.binary())], names=["doc_id", "p", "f"])

    found = both.mapInArrow(run, "doc_id long, p int, f binary").toPandas()
    parts = [found[found.p == p].sort_values(["doc_id", "f"], kind="stable").iloc[:most] for p, most in ((1, max_positive), (0, max_unlabelled))]
    rows = [np.frombuffer(f, dtype=np.int32) for part in parts for f in part.f]
    return train(rows, np.repeat([1, 0], [len(p) for p in parts]), prior, chosen)


def _choose(examples: DataFrame, most: int) -> np.ndarray:
    """The features whose share among positives differs most from that among unlabelled texts.

    Tasks send counts, the least that is needed of each feature; only ``most`` features reach
    the driver.
    """

    def run(batches):
        counts = np.zeros((2, 2 << BITS), dtype=np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                doc, value = features(texts_of(part.column("text")))
                p = np.asarray(part.column("p"), dtype=np.int64)[doc]
                for k in (0, 1):
                    counts[k] += np.bincount(value[p == k], minlength=2 << BITS).astype(np.int32)
        seen = np.flatnonzero(counts.any(axis=0))
        for a in range(0, len(seen), 100_000):
            f = seen[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(counts[1, f].astype(np.int64)), pa.array(counts[0, f].astype(np.int64))], names=["f", "p", "u"])

    n_p, n_u = examples.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum(1 - F.col("p")), F.lit(0))).first()
    if not n_p or not n_u:
        return np.zeros(0, np.int64)
    counted = examples.mapInArrow(run, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter(F.col("p") >= LEAST_SEEN)
    gain = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(F.col("u") / n_u + 1.0 / n_u)
    return np.array([r.f for r in counted.orderBy(gain.desc(), "f").limit(most).select("f").collect()], dtype=np.int64)


def scores(docs: DataFrame, fitted, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and predicted of every document (columns doc_id, text), and ``more`` of its columns."""
    chosen, weight, bias = fitted
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", "score double", "predicted int", *[f"`{c}` {kinds[c]}" for c in more]])

    def run(batches):
        wanted = np.zeros(2 << BITS, dtype=bool)
        wanted[chosen] = True
        table = np.zeros(2 << BITS)
        table[chosen] = weight
        for batch in batches:
            for part in slices(batch, "text"):
                doc, value = features(texts_of(part.column("text")), wanted)
                f = np.bincount(doc, weights=table[value], minlength=part.num_rows) + bias
                score = 1 / (1 + np.exp(-np.clip(f, -700, 700)))
                score = np.where(np.isneginf(f), 0.0, score)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *[part.column(c) for c in more]],
                    names=["doc_id", "score", "predicted", *more])

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """Every fifth document by crc32 of its id; these labels are never learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def toxicity(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = documents(df, doc_id, text)
    fitted = model(docs, labels, ~held_out(), **bounds)
    return scores(docs, fitted).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
