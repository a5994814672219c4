"""Phrase collocations from a weighted de Bruijn graph of the words of each language.

Nodes are runs of three words, edges runs of four, with their occurrences as weight. Each word
position gives one row: the longest run of up to four words that starts there. So edges are the
only thing counted, and rows with fewer words are the corrections where a piece ends. The count
of a shorter phrase is the flow of its node: the weights of the edges that begin with it plus
the rows that end at it. Frequent edges form the graph that ``paths`` compacts: where a node has
one edge in and one out, the two edges join, by pointer doubling in Spark joins.

Rows stay few because of a bound known before counting: a table of counters, filled by hashed
runs of two to four words, can only overestimate. A position gives a longer run only if its
counter reaches the least count, so no frequent run is ever lost and every count of one is
exact. The table has at most ``MOST_BITS`` bits, whatever the corpus; beyond about 10^9 words
it rules out less and the exchange nears one row for each word, with the same result.

Words travel as 64-bit hashes and phrases as rows of them; the texts of the words that are
needed come from a second pass, which fails if two words of a language share a hash.

Defined results: a null text is empty, a null language is ``und`` (and one with the language
``und``); doc_id is not read, so null or equal ids change nothing and repeated rows count as
often as they occur. Empty tables and texts without phrases give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, U, Words, mixed, slices, texts_of
from .common import materialise, partitions, spread

LEAST = 30  # occurrences of a candidate; at most 255
LONGEST = 4
TOP = 2000
SHARE = (100, 80)  # a phrase goes if SHARE[0] * f(longer) >= SHARE[1] * f(phrase)
FEWEST_BITS, MOST_BITS, BLOCK_BITS = 20, 27, 16
NEEDED_BITS = 20
ROWS = 120_000  # rows of a task before they are added up
NO_LANG = "und"

BREAKS = np.zeros(256, dtype=bool)
BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
OUTSIDE = BREAKS.copy()
OUTSIDE[[0x20, 0x09]] = True
_TURN = U(0x9E3779B97F4A7C15)


def _words(part: pa.RecordBatch):
    """Words of a slice, the hash of each (never 0), its row, and whether it and the next share a piece."""
    texts = texts_of(part.column("text"))
    data, n = texts.data, len(texts.data)
    inside = ~OUTSIDE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[texts.offsets] = True
    starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:n])) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1 if n else np.zeros(0, np.int64)
    row = np.searchsorted(texts.offsets, starts, "right") - 1
    piece = np.concatenate(([0], np.cumsum(BREAKS[data])))[starts]
    same = np.zeros(len(starts), dtype=bool)
    same[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    w = Words(texts, starts, ends, None, None, None).hashes(LOWER)
    w[w == 0] = 1
    return texts, starts, ends, w, row, same


def _grams(part: pa.RecordBatch, w: np.ndarray, row: np.ndarray, same: np.ndarray):
    """For two to LONGEST words: where such a run starts, and its hash with that of the language."""
    names = texts_of(part.column("lang"))
    lang = Words(names, names.offsets[:-1], names.offsets[1:], None, None, None).hashes() if len(names.data) else np.zeros(len(names), np.uint64)
    h, fits = mixed(w ^ lang[row]), np.ones(len(w), dtype=bool)
    for k in range(1, LONGEST):
        n = len(w) - k
        if n <= 0:
            break
        fits = fits[:n] & same[k - 1:k - 1 + n]
        h = mixed(h[:n] * _TURN + w[k:])
        yield k, fits, h


def _bits(total_bytes: int) -> int:
    return min(MOST_BITS, max(FEWEST_BITS, int(max(1, total_bytes) / 8).bit_length()))


def reached(docs: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit for each of 2^bits counters: whether the runs that share it occur ``least`` times."""
    size, block = 1 << bits, min(bits, BLOCK_BITS)

    def count(batches):
        seen = np.zeros(size, dtype=np.uint8)
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, _, w, row, same = _words(part)
                found = [(h[fits] >> U(64 - bits)).astype(np.int64) for _, fits, h in _grams(part, w, row, same)]
                if found:
                    at, n = np.unique(np.concatenate(found), return_counts=True)
                    seen[at] = np.minimum(seen[at] + n, 255)
        zipper, blocks = zstandard.ZstdCompressor(level=1), seen.reshape(-1, 1 << block)
        for k in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zipper.compress(blocks[k].tobytes())], pa.binary())], names=["block", "z"])

    def add(batches):
        unzip, at, total = zstandard.ZstdDecompressor(), None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "z"])

        for batch in batches:
            for k, z in zip(batch.column("block").to_pylist(), batch.column("z").to_pylist()):
                if k != at:
                    if at is not None:
                        yield out()
                    at, total = k, np.zeros(1 << block, dtype=np.uint16)
                total = np.minimum(total + np.frombuffer(unzip.decompress(z, max_output_size=1 << block), dtype=np.uint8), 255)
        if at is not None:
            yield out()

    counted = docs.mapInArrow(count, "block long, z binary").repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block")
    flags = np.zeros((size >> block, (1 << block) // 8), dtype=np.uint8)
    for r in counted.mapInArrow(add, "block long, z binary").collect():  # 2^bits bits, at most 16 MB
        flags[r.block] = np.frombuffer(r.z, dtype=np.uint8)
    return flags.ravel()


def _summed(lang: list, grams: np.ndarray, n: np.ndarray):
    """Equal rows of grams (uint64, LONGEST columns) of a language added up."""
    key = grams[:, 0].copy()
    for k in range(1, LONGEST):
        key = mixed(key * _TURN + grams[:, k])
    key = key ^ mixed(lang.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    g, l_ = grams[order], lang[order]
    first = np.concatenate(([True], (g[1:] != g[:-1]).any(axis=1) | (l_[1:] != l_[:-1])))
    at = np.flatnonzero(first)
    return l_[at], g[at], np.add.reduceat(n[order], at)


def edges(docs: DataFrame, flags: np.ndarray, bits: int) -> DataFrame:
    """lang, w1 to w4 (0: none) and n: edges of the graph, and shorter runs where they end."""
    shared = docs.sparkSession.sparkContext.broadcast(flags)  # 2^bits bits

    def run(batches):
        flag, names, held, rows = shared.value, {}, [], 0

        def out():
            lang, grams, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            text = pa.array(list(names), pa.string())
            for a in range(0, len(n), 50_000):
                s = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([text.take(pa.array(lang[s])), *[pa.array(grams[s, k].view(np.int64)) for k in range(LONGEST)], pa.array(n[s])],
                                                 names=["lang", "w1", "w2", "w3", "w4", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                _, _, _, w, row, same = _words(part)
                if not len(w):
                    continue
                grams = np.zeros((len(w), LONGEST), dtype=np.uint64)
                grams[:, 0] = w
                good = np.ones(len(w), dtype=bool)
                for k, fits, h in _grams(part, w, row, same):
                    b = (h >> U(64 - bits)).astype(np.int64)
                    good = good[:len(h)] & fits & ((flag[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).astype(bool)
                    at = np.flatnonzero(good)
                    grams[at, k] = w[at + k]
                code = np.array([names.setdefault(v, len(names)) for v in part.column("lang").to_pylist()], dtype=np.int64)
                held.append(_summed(code[row], grams, np.ones(len(w), dtype=np.int64)))
                rows += len(held[-1][2])
                if rows > 2 * ROWS:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    rows = len(held[0][2])
                    if rows > ROWS:
                        yield from out()
                        held, rows = [], 0
        if held:
            yield from out()

    kinds = "lang string, w1 long, w2 long, w3 long, w4 long, n long"
    keys = ["lang", "w1", "w2", "w3", "w4"]
    return docs.mapInArrow(run, kinds).groupBy(*keys).agg(F.sum("n").alias("n"))


def flows(counted: DataFrame, least: int) -> DataFrame:
    """lang, k, g (hashes) and n of every phrase of one to LONGEST words that occurs ``least`` times.

    A node's flow: the edges that begin with it plus the pieces that end in it.
    """
    out = None
    for k in range(LONGEST, 0, -1):
        names = [f"w{i}" for i in range(1, k + 1)]
        level = counted.filter(F.col(names[-1]) != 0).groupBy("lang", *names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        level = level.select("lang", F.lit(k).alias("k"), F.array(*names).alias("g"), "n")
        out = level if out is None else out.unionByName(level)
    return out


def candidates(counts: DataFrame) -> DataFrame:
    """lang, k, g, a, l, r and score of each phrase of two words or more, by its lowest-scoring cut."""
    cuts = (counts.filter("k > 1").select("lang", "k", "g", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
            .withColumn("first", F.slice("g", F.lit(1), F.col("cut"))).withColumn("rest", F.slice("g", F.col("cut") + 1, F.col("k") - F.col("cut"))))
    part = counts.select(F.col("lang").alias("_l"), F.col("g").alias("_g"), F.col("n").alias("_n"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(part, (F.col("lang") == F.col("_l")) & (F.col(side) == F.col("_g"))).withColumn(name, F.col("_n")).drop("_l", "_g", "_n", side)
    score = F.expr("(cast(a as decimal(19, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b")
    return cuts.groupBy("lang", "k", "g", "a").agg(best).select("lang", "k", "g", "a", "b.l", "b.r", "b.score")


def kept(found: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """Candidates that no longer candidate holds nearly as often."""
    spans = [(k, at, size) for k in range(3, LONGEST + 1) for size in range(2, k) for at in range(1, k - size + 2)]
    inner = None
    for k in range(3, LONGEST + 1):
        parts = F.array_distinct(F.array(*[F.slice("g", at, size) for kk, at, size in spans if kk == k]))
        rows = found.filter(F.col("k") == k).select("lang", "a", F.explode(parts).alias("g"))
        inner = rows if inner is None else inner.unionByName(rows)
    most = inner.groupBy(F.col("lang").alias("_l"), F.col("g").alias("_g")).agg(F.max("a").alias("_a"))
    match = (F.col("lang") == F.col("_l")) & (F.col("g") == F.col("_g")) & (F.col("_a") * share[0] >= F.col("a") * share[1])
    return found.join(most, match, "left_anti")


def compacted(counts: DataFrame) -> DataFrame:
    """Frequent edges with the unary path each is on: lang, g, n, top (the path's first edge), steps from it.

    Two edges are on one path where the node between them has no other edge. Each edge is on
    one path. Of a ring of unary nodes the path begins at its least edge.
    """
    edge = counts.filter(F.col("k") == LONGEST).select("lang", "g", "n", F.slice("g", 1, LONGEST - 1).alias("tail"), F.slice("g", 2, LONGEST - 1).alias("head"))
    into = edge.groupBy("lang", F.col("head").alias("node")).agg(F.count("*").alias("i"), F.min("g").alias("before"))
    out = edge.groupBy("lang", F.col("tail").alias("node")).agg(F.count("*").alias("o"))
    unary = into.join(out, ["lang", "node"]).filter("i = 1 and o = 1").select("lang", F.col("node").alias("tail"), "before")
    state = materialise(edge.join(unary, ["lang", "tail"], "left").select("lang", "g", "n", F.col("before").alias("to"), F.when(F.col("before").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("steps"), F.col("g").alias("low")))
    state = _doubled(state)
    ring = state.filter(F.col("to").isNotNull())
    if ring.limit(1).count():
        cut = ring.withColumn("to", F.when(F.col("low") == F.col("g"), F.lit(None)).otherwise(F.col("to")))
        links = cut.select("lang", "g", "n").join(edge.join(unary, ["lang", "tail"]).select("lang", "g", "before"), ["lang", "g"]).join(cut.select("lang", "g", "low"), ["lang", "g"])
        again = links.select("lang", "g", "n", F.when(F.col("g") == F.col("low"), F.lit(None)).otherwise(F.col("before")).alias("to"), F.when(F.col("g") == F.col("low"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("steps"), F.col("g").alias("low"))
        state = state.filter(F.col("to").isNull()).unionByName(_doubled(materialise(again)))
    return state.select("lang", "g", "n", "top", "steps")


def paths(state: DataFrame) -> DataFrame:
    """One row for each compacted path: lang, g (first edge), words, path (their hashes), least and most weight."""
    spot = F.sort_array(F.collect_list(F.struct("steps", F.element_at("g", -1).alias("w"))))  # one path's edges
    joined = state.groupBy("lang", F.col("top").alias("g")).agg(spot.alias("p"), F.min("n").alias("least"), F.max("n").alias("most"))
    path = F.concat(F.slice("g", 1, LONGEST - 1), F.transform("p", lambda s: s["w"]))
    return joined.select("lang", "g", (F.size("p") + LONGEST - 1).alias("words"), path.alias("path"), "least", "most")


def _doubled(state: DataFrame) -> DataFrame:
    """Each edge's first edge of its path (``top``) and the steps to it; ``to`` stays set in rings."""
    state = state.withColumn("top", F.col("g"))
    rounds = max(1, int(state.count()).bit_length())
    for _ in range(rounds):
        if not state.filter(F.col("to").isNotNull()).limit(1).count():
            break
        far = state.select(F.col("lang").alias("_l"), F.col("g").alias("_g"), F.col("to").alias("_to"), F.col("steps").alias("_s"), F.col("low").alias("_low"), F.col("top").alias("_top"))
        hop = state.join(far, (F.col("lang") == F.col("_l")) & (F.col("to") == F.col("_g")), "left")
        state = materialise(hop.select(
            "lang", "g", "n", F.col("_to").alias("to"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"),
            F.least("low", "_low").alias("low"), F.coalesce("_top", "top").alias("top")))
    return state


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """lang, w and word of the needed hashes (columns lang, w)."""
    marks = np.zeros(1 << NEEDED_BITS, dtype=bool)
    shift = 64 - NEEDED_BITS
    spots = needed.select(F.shiftrightunsigned("w", shift).alias("b")).distinct()
    marks[[r.b for r in spots.collect()]] = True  # at most 2^NEEDED_BITS numbers

    def run(batches):
        seen = {}
        for batch in batches:
            for part in slices(batch, "text"):
                texts, starts, ends, w, row, _ = _words(part)
                at = np.flatnonzero(marks[(w >> U(shift)).astype(np.int64)])
                langs = part.column("lang").to_pylist()
                code = {v: i for i, v in enumerate(dict.fromkeys(langs))}
                of = np.array([code[v] for v in langs], dtype=np.int64)[row[at]] if len(at) else np.zeros(0, np.int64)
                out = []
                for lang, i in code.items():
                    u, first = np.unique(w[at[of == i]], return_index=True)
                    spot = at[of == i][first]
                    old = seen.get(lang, np.zeros(0, np.uint64))
                    new = ~np.isin(u, old)
                    seen[lang] = np.union1d(old, u[new])
                    out += [(lang, int(h), texts.data[starts[s]:ends[s]].tobytes().lower().decode("utf-8", "replace")) for h, s in zip(u[new].view(np.int64), spot[new])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["lang", "w", "word"])

    words = docs.mapInArrow(run, "lang string, w long, word string").distinct().join(needed, ["lang", "w"], "left_semi")
    one = words.groupBy("lang", "w").agg(F.min("word").alias("word"), F.max("word").alias("other"))
    return one.select("lang", "w", F.when(F.col("word") == F.col("other"), F.col("word")).otherwise(F.raise_error(F.lit("two words share a hash"))).alias("word"))


def _best(rows: DataFrame, order: list[Column], rank, top: int, salt: Column) -> DataFrame:
    """Rows of each language whose ``rank`` is at most ``top``, first within salted parts of it."""
    n = partitions(rows.sparkSession)
    part = rows.withColumn("_salt", F.pmod(salt, F.lit(n)))
    part = part.withColumn("_r", rank().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_r") <= top).drop("_r", "_salt")
    return part.withColumn("rank", rank().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def mine(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, share: tuple[int, int] = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases, and path_words.

    ``path_words`` is the number of words of the longest compacted path that holds the phrase;
    for a phrase on no frequent edge it is the phrase's own.
    """
    docs = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"))
    bits = _bits(int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]))
    counted = materialise(edges(docs, reached(docs, bits, least), bits))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = materialise(flows(counted, least))
    order = [F.desc("score"), F.desc("a")]
    first = materialise(_best(kept(materialise(candidates(counts)), share), order, F.rank, top, F.xxhash64("g")).drop("rank"))
    words = first.select("lang", "g", F.posexplode("g").alias("at", "w"))
    known = _texts(docs, materialise(words.select("lang", "w").distinct()))
    named = (words.join(known, ["lang", "w"]).groupBy("lang", "g").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("p"))
             .select("lang", "g", F.array_join(F.transform("p", lambda s: s["word"]), " ").alias("phrase")))  # at most LONGEST words
    best = _best(first.join(named, ["lang", "g"]), [*order, F.asc("phrase")], F.row_number, top, F.xxhash64("g"))
    held = _held(materialise(compacted(counts)), best)
    return (best.join(totals, "lang").join(held, ["lang", "g"], "left")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.coalesce("path_words", F.col("k").cast("long")).alias("path_words")))


def _held(state: DataFrame, best: DataFrame) -> DataFrame:
    """lang, g and path_words of the phrases (lang, g) that some path holds."""
    sizes = state.groupBy("lang", "top").agg((F.count("*") + LONGEST - 1).alias("words"))
    parts = F.array_distinct(F.array(*[F.slice("g", at, k) for k in range(2, LONGEST + 1) for at in range(1, LONGEST - k + 2)]))
    runs = state.join(sizes, ["lang", "top"]).select("lang", "words", F.explode(parts).alias("g"))
    return runs.groupBy("lang", "g").agg(F.max("words").alias("path_words")).join(best.select("lang", "g"), ["lang", "g"], "left_semi")
