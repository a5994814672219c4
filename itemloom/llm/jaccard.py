"""N-gram Jaccard self-join by prefixes under several global orders.

Texts with equal shingle sets form a class first; classes with Jaccard likeness of at least
``PER_CENT`` / 100 are linked, and components of links are found.

1. Sieve: under a hash order, two linked classes of n and m shingles share at least l shingles
   within their first r + l, where r is the number of shingles a class can miss (a tenth at
   0.9) and l may be any number; l is ``SIEVE`` of a class's shingles. A class is kept only if
   l of its first r + l shingles occur in the same stretch of another class.
2. Order: shingles of the kept classes are counted. An order that puts rare shingles first,
   ties broken by a hash, gives each class a prefix of r + 1 shingles; linked classes share a
   prefix shingle under each such order. Shingles that no other class has come first and can
   match nothing, so classes of mostly own shingles end here.
3. Candidates: classes that share a prefix shingle under the first order are tied (each to the
   least class of the shingle, so rows stay linear), and ties make candidate groups.
4. Verification: a group is cut into blocks of at most ``BLOCK`` classes and every pair of
   blocks goes to a task. There a pair must share prefix shingles under all ``ORDERS`` orders;
   what the intersection of filters leaves is verified by exact counts of shared shingles. A
   task returns a spanning forest of its links, or every link if asked.

Shingles are told apart by 64-bit hashes, texts' sets by 128 bits; 64 of them name a class.

Defined results: a null text is an empty one; texts without words have no shingles, link with
nothing and are components of their own, as are rows without an id; a text with fewer words
than the shingle size has its whole sequence as one shingle. Repeated rows fall in one class.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, Texts, distinct, mixed, shingles, slices, texts_of, words_of
from .common import documents, materialise, settled
from .components import components
from .zipped import unzipped, zipped

SIZE = 3
PER_CENT = 90
SIEVE = 0.06
ORDERS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xD1342543DE82EF95)
BLOCK = 256
SEEN = 1_000_000


def sets_of(texts: Texts, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and value of each distinct shingle (sorted), and the shingles of each document."""
    words = words_of(texts)
    value, doc = shingles(words, words.hashes(LOWER), size)
    doc, value = distinct(doc, value)
    return doc, value, np.bincount(doc, minlength=len(texts))


def class_keys(doc: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over a set's shingles, the same in whatever order."""
    out = np.zeros((len(count), 2), dtype=np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        at = np.concatenate(([0], np.cumsum(count[some])[:-1]))
        for k, salt in enumerate((0x8CB92BA72F3D8DD7, 0xAAF5E2B1D7C3C4A9)):
            out[some, k] = np.add.reduceat(mixed(value ^ np.uint64(salt)), at)
    return out


def _key_bytes(keys: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(keys).tobytes()
    return [raw[i:i + 16] for i in range(0, len(raw), 16)]


def missable(n, per_cent: int = PER_CENT):
    """Shingles of a class of n that a linked class may lack."""
    return n - -(-n * per_cent // 100)


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (distinct shingles) and the class key k of every document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                doc, value, count = sets_of(texts_of(part.column("text")), size)
                keys = class_keys(doc, value, count)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count), pa.array(_key_bytes(keys), pa.binary()), pa.array(keys[:, 0].copy().view(np.int64))], names=["doc_id", "n", "k", "k64"])

    return docs.mapInArrow(run, "doc_id long, n long, k binary, k64 long")


def sieved(docs: DataFrame, classes: DataFrame, size: int, per_cent: int, share: float) -> DataFrame:
    """The classes (k64, n) that may have a link.

    A shingle's rows are cut down to its least and greatest class before the shuffle, and the
    join back to the rows can be split by shingle, so a very common shingle is no hot task.
    """

    def run(batches):
        seen: set[int] = set()  # a task sends each class once, so copies stay cheap
        for batch in batches:
            for part in slices(batch, "text"):
                doc, value, count = sets_of(texts_of(part.column("text")), size)
                keys = class_keys(doc, value, count)[:, 0].view(np.int64)
                new = np.zeros(len(keys), dtype=bool)
                for i, key in enumerate(keys.tolist()):
                    new[i] = key not in seen
                    seen.add(key)
                if len(seen) > SEEN:
                    seen.clear()
                least = np.maximum(1, np.ceil(share * count)).astype(np.int64)
                rank = np.arange(len(doc)) - np.concatenate(([0], np.cumsum(count)[:-1]))[doc]
                head = np.flatnonzero((rank < (missable(count, per_cent) + least)[doc]) & new[doc])
                own = doc[head]
                yield pa.RecordBatch.from_arrays([pa.array(value[head].view(np.int64)), pa.array(keys[own])], names=["t", "k64"])

    heads = docs.mapInArrow(run, "t long, k64 long")
    met = heads.groupBy("t").agg(F.min("k64").alias("a"), F.max("k64").alias("b")).filter("a != b").select("t")
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    found = heads.join(met, "t").groupBy("k64", "t").agg(F.lit(1)).groupBy("k64").agg(F.count("*").alias("c"))
    return classes.join(found, "k64").filter(F.col("c") >= least).drop("c")


def shared_sets(docs: DataFrame, kept: DataFrame, size: int, per_cent: int) -> DataFrame:
    """k, n, t, f of the kept classes that have a prefix shingle in common with others.

    ``kept`` has doc_id, k and n; ``t`` holds the shingles that other kept classes have as
    well, ``f`` the number of classes that have each.
    """

    def run(batches):
        for part, texts in unzipped(batches):
            doc, value, count = sets_of(texts, size)
            wanted = np.asarray(part.column("k"), dtype=np.int64)
            keep = (class_keys(doc, value, count)[:, 0].view(np.int64) == wanted)[doc]  # an id may stand for several texts
            yield pa.RecordBatch.from_arrays([pa.array(wanted[doc[keep]]), pa.array(value[keep].view(np.int64))], names=["k", "t"])

    # the same join at every size: texts and kept classes meet by id, never by broadcast
    rows = zipped(docs).join(kept.select("doc_id", "k").hint("merge"), "doc_id").mapInArrow(run, "k long, t long")
    often = rows.groupBy("t").agg(F.count("*").alias("f")).filter("f > 1")
    sets = rows.join(often, "t").groupBy("k").agg(F.collect_set(F.struct("f", "t")).alias("s")).join(kept.select("k", "n"), "k")
    own = F.col("n") - F.size("s")
    return sets.filter(own < missable_column(per_cent) + 1).select("k", "n", F.col("s.t").alias("t"), F.col("s.f").alias("f"))


def missable_column(per_cent: int):
    return F.expr(f"n - (n * {per_cent} + 99) div 100")


def prefixes(t: np.ndarray, f: np.ndarray, n: int, per_cent: int, salt: int) -> np.ndarray:
    """Shared shingles within the prefix of a class under one order."""
    length = missable(n, per_cent) + 1 - (n - len(t))
    order = np.lexsort((mixed(t.view(np.uint64) ^ np.uint64(salt)), f))
    return t[order[:max(0, length)]]


def ties(sets: DataFrame, per_cent: int) -> DataFrame:
    """Edges from each class to the least class that shares a prefix shingle with it."""

    def run(batches):
        for batch in batches:
            keys, found = [], []
            for k, n, t, f in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "t", "f"))):
                head = prefixes(np.array(t, np.int64), np.array(f, np.int64), n, per_cent, ORDERS[0])
                keys += [k] * len(head)
                found.append(head)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["k", "t"])

    rows = sets.mapInArrow(run, "k long, t long")
    least = rows.groupBy("t").agg(F.min("k").alias("m"))
    return rows.join(least, "t").filter("k != m").select(F.col("k").alias("u"), F.col("m").alias("v")).distinct()


def overlaps(lists: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Number of common values of every two lists (distinct values each)."""
    m = len(lists)
    out = np.zeros((m, m), dtype=np.float32)
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    if not len(owner):
        return out
    _, column, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    owner, (used, column) = owner[keep], np.unique(column[keep], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, len(used), width):
        low, high = np.searchsorted(column, (a, a + width))
        dense = np.zeros((m, min(width, len(used) - a)), dtype=np.float32)
        dense[owner[low:high], column[low:high] - a] = 1
        out += dense @ dense.T
    return out


def block_links(keys: list, n: np.ndarray, tokens: list[np.ndarray], counts: list[np.ndarray], side: np.ndarray, per_cent: int, forest: bool) -> list[tuple]:
    """Links between the classes of a block pair; ``side`` tells the two blocks apart."""
    m = len(keys)
    left = np.tril(np.ones((m, m), dtype=bool), -1)
    if side.min() != side.max():
        left &= side[:, None] != side[None, :]
    left &= (100 * np.minimum(n[:, None], n[None, :]) >= per_cent * np.maximum(n[:, None], n[None, :]))
    for salt in ORDERS:  # a pair must share a prefix shingle under each order
        if not left.any():
            return []
        left &= overlaps([prefixes(t, f, int(k), per_cent, salt) for t, f, k in zip(tokens, counts, n)]) > 0
    rows = np.flatnonzero(left.any(axis=0) | left.any(axis=1))
    if not len(rows):
        return []
    both = overlaps([tokens[i] for i in rows]).astype(np.int64)
    size = n[rows]
    linked = (100 * both >= per_cent * (size[:, None] + size[None, :] - both)) & left[np.ix_(rows, rows)]
    a, b = np.nonzero(linked)
    jac = both[a, b] / (size[a] + size[b] - both[a, b])
    out, root = [], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y, j in zip(a.tolist(), b.tolist(), jac.tolist()):
        if forest:
            p, q = top(x), top(y)
            if p == q:
                continue
            root[p] = q
        out.append((keys[rows[x]], keys[rows[y]], j))
    return out


def links(sets: DataFrame, groups: DataFrame, per_cent: int, forest: bool = True, block: int = BLOCK) -> DataFrame:
    """Verified links u, v, jaccard inside the candidate groups (node, label)."""
    slices_ = groups.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))
    rows = (sets.join(groups.withColumnRenamed("node", "k"), "k").join(slices_, "label")
            .withColumn("own", F.pmod(F.xxhash64("k"), F.col("cuts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = block_links(frame["k"].tolist(), frame["n"].to_numpy(np.int64), [np.asarray(t, np.int64) for t in frame["t"]], [np.asarray(f, np.int64) for f in frame["f"]], frame["own"].to_numpy(), per_cent, forest)
        return pd.DataFrame(found, columns=["u", "v", "jaccard"])

    return rows.select("label", "i", "j", "k", "n", "t", "f", "own").groupBy("label", "i", "j").applyInPandas(run, "u long, v long, jaccard double")


def joined(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, per_cent: int = PER_CENT, share: float = SIEVE) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every document."""
    docs = documents(df, doc_id, text)
    info = materialise(profiles(docs, size))
    classes = info.filter("n > 0").groupBy("k").agg(F.min("doc_id").alias("rep"), F.max("k64").alias("k64"), F.max("n").alias("n"))
    kept = settled(sieved(docs, classes, size, per_cent, share).filter("rep is not null").select(F.col("rep").alias("doc_id"), F.col("k64").alias("k"), "n"))
    sets = settled(shared_sets(docs, kept, size, per_cent))
    groups = components(ties(sets, per_cent))
    found = components(materialise(links(sets, groups, per_cent)))
    named = classes.join(found.withColumnRenamed("node", "k64"), "k64", "left").withColumn("label", F.coalesce("label", "k64")).select("k", "label", "rep")
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    placed = materialise(named.join(least, "label").select("k", "component"))
    return info.join(placed, "k", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
