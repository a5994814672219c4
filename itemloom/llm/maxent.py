"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

log P(word | history) = log P(class | history) + log P(word | class, history). The history gives
hashed features: the word before, the pair before, and skips to the second and third word
before. Each feature names one row of a weight table; a row holds a weight for each class (or
for each word of a class), so a batch of tokens is a few gathers of rows.

Classes are cut by frequency: ``NEAR_CLASSES`` of ``CLASS_WORDS`` words with a softmax of their
own, ``MID_CLASSES`` of less frequent words and one class of rare and unknown words, inside which a
word has its smoothed share of the counts. All probabilities of a history add up to one.

Training covers every document that may be learnt from, once, in ``ROUNDS`` rounds: tasks take
gradient steps from the common weights on their part of a round's documents; the moves of each row are
averaged over the tasks by how many tokens touched it there. Moves are sent as small integers, so
their sums do not depend on the order in which tasks finish.

Counts cover all training tokens. Words with at least a count found from a histogram, at most
``HEAD_WORDS`` of them, are sent to all tasks. A text's rarer words leave with its number and meet their
counts in a join, so the vocabulary may be of any size.

Defined results: a null text is empty and has one token, its end. A null id has no remainder: it
is not held out and is learnt from. Equal ids and repeated rows are rows of their own. Without
training documents every token is unknown and both scores are 0. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, U, mixed, slices, texts_of, words_of
from .common import documents, materialise, partitions

HEAD_WORDS = 1 << 19
NEAR_CLASSES, CLASS_WORDS, MID_CLASSES = 24, 64, 7
CLASSES = NEAR_CLASSES + MID_CLASSES + 1
NEAR = NEAR_CLASSES * CLASS_WORDS
CLASS_BITS, WORD_BITS = 15, 14  # rows of the two weight tables
ROUNDS = 3
RATE, START = 0.2, 1.0
BATCH = 4096
UNIT, BLOCK = 2048.0, 2048  # a move is sent in 1/UNIT; rows of a block
NONE = np.float32(-1e4)
BEFORE, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
_A, _B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_KINDS = [U(k) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]


def held_out() -> Column:
    """Every fifth document by crc32 of its id is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))


@dataclass
class Tokens:
    """Hashes of the tokens of a slice (words, then one end for each document), and the document of each."""

    hashes: np.ndarray
    doc: np.ndarray
    place: np.ndarray  # inside its document
    size: int

    def before(self, k: int) -> np.ndarray:
        out = np.full(len(self.hashes), BEFORE, dtype=np.uint64)
        if len(out) > k:
            out[k:] = self.hashes[:-k]
        out[self.place < k] = BEFORE
        return out


def tokens_of(column: pa.Array) -> Tokens:
    words = words_of(texts_of(column))
    n = len(words.counts)
    sizes = words.counts + 1
    doc = np.repeat(np.arange(n), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)))
    hashes = np.full(int(first[-1]), END, dtype=np.uint64)
    hashes[np.arange(len(words.starts)) + words.doc] = words.hashes(LOWER)
    return Tokens(hashes, doc, np.arange(len(doc)) - first[doc], n)


def vocabulary(docs: DataFrame) -> DataFrame:
    """w (hash) and c of every token of the documents."""

    def run(batches):
        held, rows = [], 0

        def merged():
            w, n = (np.concatenate(x) for x in zip(*held))
            u, at = np.unique(w, return_inverse=True)
            return u, np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)

        def out():
            u, n = merged()
            for a in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[a:a + 100_000].view(np.int64)), pa.array(n[a:a + 100_000])], names=["w", "c"])

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(np.unique(tokens_of(part.column("text")).hashes, return_counts=True))
                rows += len(held[-1][0])
                if rows > 1_500_000:
                    held = [merged()]
                    rows = len(held[0][0])
                    if rows > 750_000:
                        yield from out()
                        held, rows = [], 0
        if held:
            yield from out()

    return docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The frequent words, their classes, and the counts behind all others."""

    least: int  # rarer words are not in it
    tokens: int
    words: int
    known: np.ndarray  # hashes, sorted
    base: np.ndarray  # log10 (c + 0.5) of each
    class_of: np.ndarray
    slot: np.ndarray  # inside a near class, else -1
    inside: np.ndarray  # log10 P(word | class) of a mid class, else 0
    class_bias: np.ndarray  # natural logarithms of unigram shares
    word_bias: np.ndarray
    rare: float  # log10 of the rare class's smoothed count

    @property
    def whole(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.words + 1)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each token, or -1."""
        u, back = np.unique(hashes, return_inverse=True)
        at = np.searchsorted(self.known, u)
        at[at == len(self.known)] = 0
        hit = (self.known[at] == u) if len(self.known) else np.zeros(len(u), dtype=bool)
        return np.where(hit, at, -1)[back]


def lexicon(counts: DataFrame, most: int = HEAD_WORDS) -> Lexicon:
    bins = counts.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int").alias("b")).agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).collect()  # at most 16 * 63 rows
    bins.sort(key=lambda r: -r.b)
    total, words = sum(r.n for r in bins), sum(r.v for r in bins)
    least, held, taken = (bins[0].high + 1 if bins else 1), 0, 0
    for r in bins:
        if held + r.v > most:
            break
        held, least, taken = held + r.v, r.low, taken + r.n
    head = counts.filter(F.col("c") >= least).toPandas()  # at most ``most`` rows
    w, c = head.w.to_numpy(dtype=np.int64).view(np.uint64), head.c.to_numpy(dtype=np.int64)
    order = np.lexsort((w, -c))
    w, c = w[order], c[order]
    mass = c + 0.5
    rank = np.arange(len(w))
    cls = np.minimum(rank // CLASS_WORDS, NEAR_CLASSES)
    slot = np.where(rank < NEAR, rank % CLASS_WORDS, -1)
    mid = rank >= NEAR
    if mid.any():
        run = np.cumsum(mass[mid])
        cls[mid] = NEAR_CLASSES + np.minimum((MID_CLASSES * (run - mass[mid] / 2) / run[-1]).astype(int), MID_CLASSES - 1)
    shares = np.bincount(cls, weights=mass, minlength=CLASSES).astype(float)
    shares[CLASSES - 1] = (total - taken) + 0.5 * (words - held) + 0.5
    inside = np.where(mid, np.log10(mass) - np.log10(shares[cls]), 0.0)
    word_bias = np.full((NEAR_CLASSES, CLASS_WORDS), NONE, dtype=np.float32)
    near = ~mid
    word_bias[cls[near], slot[near]] = np.log(mass[near] / shares[cls[near]])
    class_bias = np.where(shares > 0, np.log(np.maximum(shares, 1e-300) / shares.sum()), NONE).astype(np.float32)
    back = np.argsort(w)
    return Lexicon(int(least), int(total), int(words), w[back], np.log10(mass)[back], cls[back].astype(np.int64), slot[back].astype(np.int64), inside[back], class_bias, word_bias, float(np.log10(shares[-1])))


def _rows(tokens: Tokens, cls: np.ndarray):
    """Rows of the two tables that each token's history names."""
    p1, p2, p3 = tokens.before(1), tokens.before(2), tokens.before(3)
    pair = mixed(p2 * _A + p1)
    top = [(mixed(p * _B + kind) >> U(64 - CLASS_BITS)).astype(np.int64) for p, kind in zip((p1, pair, p2, p3), _KINDS)]
    of = cls.astype(np.uint64) * _A
    inner = [(mixed(p * _B + (kind ^ of)) >> U(64 - WORD_BITS)).astype(np.int64) for p, kind in zip((p1, p2), _KINDS[4:])]
    return top, inner


def _scores(bias: np.ndarray, table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Scores of all columns; weights stay far below what an exponential of 32 bits can hold."""
    x = table.take(rows[0], axis=0)
    x += bias
    more = np.empty_like(x)
    for r in rows[1:]:
        x += table.take(r, axis=0, out=more, mode="clip")
    return x


def _pull(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Gradient of the log-likelihood of the columns ``of`` by the scores, in place of them."""
    np.exp(x, out=x)
    x /= -x.sum(axis=1, keepdims=True)
    x[np.arange(len(of)), of] += 1
    return x


def _logs(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log10 of the share of the columns ``of``; the scores are used up."""
    own = x[np.arange(len(of)), of]
    return (own - np.log(np.exp(x, out=x).sum(axis=1))) / np.log(10)


def _step(table: np.ndarray, past: np.ndarray, seen: np.ndarray, rows: list[np.ndarray], pull: np.ndarray) -> None:
    """One gradient step on the rows named; a row's rate falls with the squares it has met."""
    for r in rows:
        order = np.argsort(r.astype(np.uint16), kind="stable")
        s = r[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        u, g = s[first], np.add.reduceat(pull.take(order, axis=0), first, axis=0)
        past[u] += np.einsum("ij,ij->i", g, g)
        g *= (RATE / np.sqrt(past[u] + START))[:, None]
        table[u] += g
        seen[u] += np.diff(np.append(first, len(s)))


def learn(lex: Lexicon, tables: list[np.ndarray], pasts: list[np.ndarray], seen: list[np.ndarray], tokens: Tokens) -> None:
    """Gradient steps on the log-likelihood of a slice, in batches of ``BATCH`` tokens."""
    at = lex.find(tokens.hashes)
    cls = np.where(at >= 0, lex.class_of[at], CLASSES - 1) if len(lex.known) else np.full(len(at), CLASSES - 1)
    slot = np.where(at >= 0, lex.slot[at], -1) if len(lex.known) else np.full(len(at), -1)
    top, inner = _rows(tokens, cls)
    for a in range(0, len(at), BATCH):
        s = slice(a, a + BATCH)
        c = cls[s]
        rows = [r[s] for r in top]
        pull = _pull(_scores(lex.class_bias, tables[0], rows), c)
        near = np.flatnonzero(slot[s] >= 0)
        _step(tables[0], pasts[0], seen[0], rows, pull)
        if len(near):
            rows = [r[s][near] for r in inner]
            pull = _pull(_scores(lex.word_bias[c[near]], tables[1], rows), slot[s][near])
            _step(tables[1], pasts[1], seen[1], rows, pull)


def _empty() -> list[np.ndarray]:
    return [np.zeros((1 << CLASS_BITS, CLASSES), dtype=np.float32), np.zeros((1 << WORD_BITS, CLASS_WORDS), dtype=np.float32)]


def train(docs: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weight tables after one pass over all documents, an equal part in each round."""
    spark, tables = docs.sparkSession, _empty()
    if not lex.tokens:
        return tables
    words = spark.sparkContext.broadcast(lex)  # at most HEAD_WORDS words
    for k in range(rounds):
        weights = spark.sparkContext.broadcast(tables)  # of fixed size
        moved = _moved(docs.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k), words, weights)
        tables = [t.copy() for t in tables]
        for r in moved.collect():  # at most as many numbers as the tables have
            t, at = tables[r.table], r.block * BLOCK
            t[at:at + BLOCK] += np.frombuffer(r.z, dtype=np.float32).reshape(-1, t.shape[1])
        weights.unpersist()
    return tables


def _moved(docs: DataFrame, words, weights) -> DataFrame:
    """table, block, z: the mean move of each row of weights by the tasks of one round."""
    widths = (CLASSES, CLASS_WORDS)

    def run(batches):
        tables = [t.copy() for t in weights.value]
        pasts, seen = ([np.zeros(len(t), dtype=kind) for t in tables] for kind in (np.float32, np.int64))
        for batch in batches:
            for part in slices(batch, "text"):
                learn(words.value, tables, pasts, seen, tokens_of(part.column("text")))
        zipper = zstandard.ZstdCompressor(level=1)
        for k, (now, old, n) in enumerate(zip(tables, weights.value, seen)):
            for b in range(0, len(n), BLOCK):
                if n[b:b + BLOCK].any():
                    move = np.clip(np.rint((now[b:b + BLOCK] - old[b:b + BLOCK]) * UNIT), -32767, 32767).astype(np.int16)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b // BLOCK], pa.int32()), pa.array([zipper.compress(n[b:b + BLOCK].tobytes() + move.tobytes())], pa.binary())], names=["table", "block", "z"])

    def add(batches):
        unzip, at, total, count = zstandard.ZstdDecompressor(), None, None, None

        def out():
            mean = (total / np.maximum(count, 1)[:, None] / UNIT).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["table", "block", "z"])

        for batch in batches:
            for k, b, z in zip(*(batch.column(c).to_pylist() for c in ("table", "block", "z"))):
                if (k, b) != at:
                    if at is not None:
                        yield out()
                    at, total, count = (k, b), np.zeros((BLOCK, widths[k]), dtype=np.int64), np.zeros(BLOCK, dtype=np.int64)
                raw = unzip.decompress(z)
                n = np.frombuffer(raw, dtype=np.int64, count=BLOCK)
                count += n
                total += n[:, None] * np.frombuffer(raw, dtype=np.int16, offset=8 * BLOCK).reshape(BLOCK, widths[k])
        if at is not None:
            yield out()

    sent = docs.select("text").mapInArrow(run, "table int, block int, z binary")
    dealt = sent.repartition(partitions(docs.sparkSession), "table", "block").sortWithinPartitions("table", "block")
    return dealt.mapInArrow(add, "table int, block int, z binary")


def log_probabilities(lex: Lexicon, tables: list[np.ndarray], tokens: Tokens, at: np.ndarray) -> np.ndarray:
    """log10 P of each token; of a rare token only that of its class."""
    known = at >= 0
    cls = np.where(known, lex.class_of[at], CLASSES - 1) if len(lex.known) else np.full(len(at), CLASSES - 1)
    slot = np.where(known, lex.slot[at], -1) if len(lex.known) else np.full(len(at), -1)
    out = np.where(known, lex.inside[at], 0.0) if len(lex.known) else np.zeros(len(at))
    top, inner = _rows(tokens, cls)
    for a in range(0, len(at), BATCH):
        s = slice(a, a + BATCH)
        c = cls[s]
        out[s] += _logs(_scores(lex.class_bias, tables[0], [r[s] for r in top]), c)
        near = np.flatnonzero(slot[s] >= 0)
        if len(near):
            out[a + near] += _logs(_scores(lex.word_bias[c[near]], tables[1], [r[s][near] for r in inner]), slot[s][near])
    return out


def _parts(docs: DataFrame, lex: Lexicon, tables: list[np.ndarray]) -> DataFrame:
    """A numbered row for each document: sums over its frequent tokens, and its rare words."""
    words, weights = (docs.sparkSession.sparkContext.broadcast(x) for x in (lex, tables))

    def run(batches):
        number, lexic = TaskContext.get().partitionId() << 40, words.value
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = tokens_of(part.column("text"))
                at = lexic.find(tokens.hashes)
                known, n = at >= 0, tokens.size
                logs = log_probabilities(lexic, weights.value, tokens, at)
                base = np.where(known, lexic.base[at], 0.0) if len(lexic.known) else np.zeros(len(at))
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((tokens.hashes[rare], tokens.doc[rare]))]
                d, w = tokens.doc[order], tokens.hashes[order]
                first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])))) if len(d) else np.zeros(0, np.int64)
                offsets = pa.array(np.searchsorted(d[first], np.arange(n + 1)), pa.int32())
                count = lambda m: pa.array(np.bincount(tokens.doc[m], minlength=n))
                total = lambda v: pa.array(np.bincount(tokens.doc, weights=v, minlength=n))
                yield pa.RecordBatch.from_arrays([
                    pa.array(number + np.arange(n)), part.column("doc_id"), count(slice(None)), count(known), count(rare), total(base), total(logs),
                    pa.ListArray.from_arrays(offsets, pa.array(w[first].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(first, len(d)))))],
                    names=["row", "doc_id", "n_tokens", "n_head", "n_rare", "base", "logs", "w", "k"])
                number += n

    return docs.mapInArrow(run, "row long, doc_id long, n_tokens long, n_head long, n_rare long, base double, logs double, w array<long>, k array<long>")


def scored(df: DataFrame, doc_id: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    docs = documents(df, doc_id, text)
    learns = docs.filter(~held_out())
    counts = materialise(vocabulary(learns))
    lex = lexicon(counts, head_words)
    tables = train(learns, lex, rounds)
    parts = materialise(_parts(docs, lex, tables))
    rare = parts.select("row", F.explode(F.arrays_zip("w", "k")).alias("p")).select("row", F.col("p.w").alias("w"), F.col("p.k").alias("k"))
    met = rare.join(counts.filter(F.col("c") < lex.least), "w", "left")
    sums = met.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return parts.join(sums, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * lex.whole).alias("base_score"), (F.col("logs") + more - F.col("n_rare") * lex.rare).alias("score"))
