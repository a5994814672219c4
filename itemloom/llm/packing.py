"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document's ids and an end id are cut into pieces of at most ``LIMIT`` ids; only documents
longer than that are cut. Full pieces are sequences already. The others are dealt by hash into
shards of about ``SHARD`` pieces, so no task holds more, and every shard is evolved on
``ISLANDS`` islands. An individual is a set of bins. Crossover takes whole well-filled bins of
one parent into the other, removes the bins that now hold pieces twice, and best-fits the
displaced pieces, longest first. After each epoch every island sends its elite to the next
island of its ring; the fewest bins of all islands win. An island goes on as long as it saves
bins. Then bins of all shards are opened, the badly filled ones first and at last all that are
not full; their pieces are dealt and evolved anew, and the outcome stays if it saves bins.

Only piece lengths travel; ids stay where they were made.

Defined results: a null text is an empty one and has the end id alone; each repeated row is a
document of its own; null ids are packed too; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import slices, texts_of
from .common import documents, materialise
from .tokens import encoder, vocabulary_path

LIMIT = 2048
END_ID = 0
SHARD = 8192
ISLANDS = 2
EPOCHS = 2
PEOPLE = 3
GENERATIONS = 3  # without a bin saved, while bins are above their least number; as many are made in any case
SLICE = 1 << 18  # bytes of text encoded at once; arrays of a slice take some hundred times as much
OPEN_BELOW = (0.9, 0.98, 1.0)  # parts of a sequence that are filled; turn by turn, pieces of less filled ones are dealt again
KNOWN = 400_000  # distinct pieces of words a worker remembers


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    vocab = vocabulary or vocabulary_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        enc = encoder(vocab, KNOWN)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, counts = enc.encode(texts_of(part.column("text")))
                own, at, rows = part.column("doc_id").to_pylist(), 0, []
                for d, n in zip(own, counts.tolist()):
                    whole = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k, a in enumerate(range(0, n + 1, limit)):
                        cut = whole[a:a + limit]
                        rows.append((d, k, a, len(cut), zlib.crc32(cut.tobytes())))
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return documents(df, doc_id, text).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Free space of bins, with the least one that takes a length found from a bit for each space."""

    def __init__(self, limit: int):
        self.limit, self.bits, self.stacks, self.count = limit, 0, {}, 0

    def add(self, free: int) -> int:
        self.count += 1
        self._put(free, self.count - 1)
        return self.count - 1

    def _put(self, free: int, b: int) -> None:
        if free:
            self.stacks.setdefault(free, []).append(b)
            self.bits |= 1 << free

    def fit(self, length: int) -> int:
        room = self.bits >> length
        if not room:
            return self.add(self.limit - length)
        free = (room & -room).bit_length() - 1 + length
        stack = self.stacks[free]
        b = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self._put(free - length, b)
        return b


def best_fit(lengths: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    out, bins = np.empty(len(lengths), np.int64), Bins(limit)
    sizes = lengths.tolist()
    for i in order.tolist():
        out[i] = bins.fit(sizes[i])
    return out


def fitness(lengths: np.ndarray, solution: np.ndarray, limit: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones."""
    fill = np.bincount(solution, weights=lengths)
    return int((fill > 0).sum()), -float(((fill / limit) ** 2).sum())


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of ``b`` enter ``a``."""
    fill_b = np.bincount(b, weights=lengths)
    good = np.flatnonzero(fill_b >= limit * 0.995)
    injected = np.zeros(len(fill_b), bool)
    injected[good[rng.random(len(good)) < 0.5]] = True
    comes = injected[b]  # pieces that arrive inside an injected bin
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[comes]] = True  # bins of a that now hold a piece twice
    fill_a = np.bincount(a, weights=lengths)
    broken |= (fill_a > 0) & (fill_a < limit * 0.9)  # badly filled bins are dealt anew
    displaced = np.flatnonzero(broken[a] & ~comes)
    out, bins = np.full(len(a), -1, np.int64), Bins(limit)
    for solution, keep, fill in ((b, comes, fill_b), (a, ~broken[a] & ~comes, fill_a)):
        used, back = np.unique(solution[keep], return_inverse=True)
        new = np.array([bins.add(int(limit - fill[u])) for u in used.tolist()], np.int64)
        if len(new):
            out[keep] = new[back]
    sizes = lengths.tolist()
    for i in displaced[np.lexsort((rng.random(len(displaced)), -lengths[displaced]))].tolist():
        out[i] = bins.fit(sizes[i])
    return out


def evolve(lengths: np.ndarray, seed: int, guests: list[np.ndarray], limit: int = LIMIT, people: int = PEOPLE, generations: int = GENERATIONS) -> np.ndarray:
    """The best individual once ``generations`` in a row saved no bin; ``guests`` join the first people."""
    rng = np.random.default_rng(seed)
    crowd = list(guests)
    while len(crowd) < people:
        noise = rng.normal(0, 0.002 * limit * len(crowd), len(lengths))
        crowd.append(best_fit(lengths, np.argsort(-(lengths + noise), kind="stable"), limit))
    ranked = sorted(((fitness(lengths, x, limit), k, x) for k, x in enumerate(crowd)), key=lambda r: r[:2])
    least, g, idle = -(-int(lengths.sum()) // limit), 0, 0
    while g < generations or idle < generations and ranked[0][0][0] > least:
        before = ranked[0][0][0]
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = crossover(lengths, ranked[min(i, j)][2], ranked[max(i, j)][2], limit, rng)
        ranked = sorted([*ranked, (fitness(lengths, child, limit), people + g, child)], key=lambda r: r[:2])[:people]
        g, idle = g + 1, 0 if ranked[0][0][0] < before else idle + 1
    best = ranked[0][2]
    return np.unique(best, return_inverse=True)[1]


def evolved(loose: DataFrame, shards: int, limit: int, islands: int, epochs: int) -> DataFrame:
    """uid, length, sequence_id of loose pieces (uid, length), each shard packed by itself."""
    dealt = loose.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    people = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).select("shard", "island", "uid", F.col("length").cast("int").alias("length"), F.lit(None).cast("int").alias("own"), F.lit(None).cast("int").alias("guest"))

    def island(epoch):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("uid")
            guests = [frame[c].to_numpy(np.int64) for c in ("own", "guest") if frame[c].notna().all()]
            s, i = int(frame["shard"].iloc[0]), int(frame["island"].iloc[0])
            best = evolve(frame["length"].to_numpy(np.int64), zlib.crc32(f"{s}:{i}:{epoch}".encode()), guests, limit)
            return pd.DataFrame({"shard": frame["shard"], "island": frame["island"], "uid": frame["uid"], "length": frame["length"], "bin": best})

        return run

    for epoch in range(epochs):
        made = materialise(people.groupBy("shard", "island").applyInPandas(island(epoch), "shard int, island int, uid long, length int, bin int"))
        if epoch + 1 < epochs:
            away = made.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "uid", F.col("bin").alias("guest"))
            people = made.withColumnRenamed("bin", "own").join(away, ["shard", "island", "uid"]).select(*people.columns)
    won = (made.groupBy("shard", "island").agg(F.max("bin").alias("bins")).groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("w")).select("shard", F.col("w.island").alias("island")))
    return made.join(won, ["shard", "island"]).select("uid", "length", (F.col("shard").cast("long") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"))


def pack(cut: DataFrame, limit: int = LIMIT, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Add sequence_id and offset to pieces (columns of ``pieces``)."""
    frozen = materialise(cut.withColumn("uid", F.monotonically_increasing_id()))
    loose = frozen.filter(F.col("length") < limit).select("uid", "length")
    shards = max(1, -(-loose.count() // shard))
    made = materialise(evolved(loose, shards, limit, islands, epochs))
    for turn, share in enumerate(OPEN_BELOW if shards > 1 else (), 1):  # pieces of different shards share no bin yet
        fill = made.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count("*").alias("n"))
        spare = materialise(fill.filter(F.col("fill") < limit * share))
        bins, tokens, n = spare.agg(F.count("*"), F.sum("fill"), F.sum("n")).first()
        if not bins or bins <= -(-tokens // limit):
            continue
        opened = made.join(spare, "sequence_id", "left_semi").select("uid", "length")
        again = materialise(evolved(opened, -(-n // shard), limit, islands, epochs))
        if again.select("sequence_id").distinct().count() < bins:
            again = again.withColumn("sequence_id", F.lit(turn << 56) + F.col("sequence_id"))
            made = materialise(made.join(spare, "sequence_id", "left_anti").select(*again.columns).unionByName(again))
    placed = made.select("uid", "sequence_id")
    whole = frozen.join(placed, "uid", "left").withColumn("sequence_id", F.coalesce("sequence_id", -F.col("uid") - 1))
    row = Window.partitionBy("sequence_id").orderBy("uid")  # at most as many rows as ids in a sequence
    return whole.withColumn("offset", F.sum("length").over(row) - F.col("length")).drop("uid")


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut and pack every document."""
    return pack(pieces(df, doc_id, text)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
