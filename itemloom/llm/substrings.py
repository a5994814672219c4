"""Substring deduplication over the windows of a token graph, joined in runs to spans.

Every window of ``WINDOW`` words is an edge of a De Bruijn graph: it leads from the node of its
first words to the node of its last ones. Three steps keep the graph to what can repeat:

1. Copies and anchors. A text equal to an earlier one is one span of that one's words; the
   first of equal texts stands for all in what follows. A window's anchor is the least of its
   ``GRAM``-word runs under a hash order. Equal windows have equal anchors, so only anchors
   seen more than once can stand for repeated edges. A document sends each of its anchors
   once; one of a window that it repeats inside itself counts twice.
2. Edges. Windows with a repeated anchor become rows (96-bit edge hash, document, start). A
   grouping finds each edge's first source coordinate, a join gives it to all occurrences.
3. Paths. Occurrences in a row whose first coordinates run in a row too become one span with one
   source, also through a branch: nodes and their degrees are not built. Spans that meet cover
   words together.

Groupings combine before the shuffle and joins back can be split by key, so a passage in a
third of all documents costs no single task. Texts travel compressed, dealt by document once;
all steps use that exchange.

Defined results: a null text has no words. Documents of fewer than WINDOW words lose nothing.
Rows that share an id are documents of their own, ordered by text under that id; fully equal
rows too, so the second loses its windows to the first. Rows without an id lose nothing and
take nothing. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Texts, mixed, windows, words_of
from .common import documents, settled
from .zipped import unzipped, zipped

WINDOW = 20
GRAM = 8
ORDERS = (0x1D8E4E27C47D124F,)  # of the runs, one anchor from each
ROW = 40  # bits of a start inside rows that share an id


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, rn (number of the row among those of its id), the zipped text and its size."""
    return zipped(docs).withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("z")) - 1)


def _copies(rows: DataFrame) -> DataFrame:
    """doc_id and its rows (rn) whose whole text stands in an earlier row, with that row."""
    keyed = rows.filter("doc_id is not null").select("doc_id", "rn", F.md5("z").alias("k"))
    first = keyed.groupBy("k").agg(F.min(F.struct("doc_id", "rn")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("k", "f")
    again = keyed.join(first, "k").filter((F.col("doc_id") != F.col("f.doc_id")) | (F.col("rn") != F.col("f.rn")))
    return again.groupBy("doc_id").agg(F.collect_list(F.struct("rn", F.col("f.doc_id").alias("source_doc"), F.col("f.rn").alias("source_rn"))).alias("copies"))


def graph(texts: Texts, window: int = WINDOW, gram: int = GRAM):
    """Words, and for every window: its first word's index, two edge hashes, its anchors."""
    words = words_of(texts)
    one = words.hashes(which=0)
    edge, at = windows(one, words, window)
    if not len(at):
        return words, at, edge, edge, (edge, edge)
    second, _ = windows(words.hashes(which=1), words, window, 0xB5297A4D3F84D5B5)
    run = np.zeros(len(one) - gram + 1, dtype=np.uint64)
    for k in range(gram):
        run *= np.uint64(0x9FB21C651E98DF25)
        run += one[k:k + len(run)]
    need, anchors = window - gram + 1, []
    for salt in ORDERS:
        least, span = mixed(run ^ np.uint64(salt)), 1
        while 2 * span <= need:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if need > span:
            least = np.minimum(least[:len(least) - (need - span)], least[need - span:])
        anchors.append(least[at])
    return words, at, edge, second, anchors


def _anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id and the anchors (rn, h) of its windows that occur more than once in the corpus."""

    def run(batches):
        for part, texts in unzipped(batches):
            words, at, edge, _, anchors = graph(texts, window, gram)
            doc = words.doc[at]
            order = np.lexsort((edge, doc))
            same = (edge[order][1:] == edge[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            inside = np.zeros(len(at), dtype=np.int32)
            inside[order[1:][same]] = 1
            anchor, doc, inside = np.concatenate(anchors), np.tile(doc, len(anchors)), np.tile(inside, len(anchors))
            pick = np.lexsort((-inside, anchor, doc))
            d, h, c = doc[pick], anchor[pick], inside[pick]
            first = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(d) else np.zeros(0, bool)
            own = pa.array(d[first])
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(c[first] + 1, pa.int32()), part.column("doc_id").take(own), part.column("rn").take(own)], names=["h", "c", "doc_id", "rn"])

    found = rows.filter("doc_id is not null").select("doc_id", "rn", "z", "size").mapInArrow(run, "h long, c int, doc_id long, rn int")
    often = found.groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1").select("h")
    return found.select("h", "doc_id", "rn").join(often, "h").groupBy("doc_id").agg(F.collect_set(F.struct("rn", "h")).alias("anchors"))


def _edges(rows: DataFrame, anchors: DataFrame, window: int, gram: int) -> DataFrame:
    """e1, e2, doc_id, at of every window whose anchors repeat; at holds the row number above ROW bits."""

    def run(batches):
        for part, texts in unzipped(batches):
            words, at, edge, second, anchors = graph(texts, window, gram)
            doc = words.doc[at]
            rns = np.asarray(part.column("rn"), dtype=np.int64)
            lists = part.column("anchors")
            keep = np.zeros(len(at), dtype=bool)
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            for i in range(part.num_rows):
                if cut[i + 1] > cut[i]:
                    own = lists[i].values
                    h = np.asarray(own.field("h"), dtype=np.int64)[np.asarray(own.field("rn")) == rns[i]]
                    keep[cut[i]:cut[i + 1]] = np.logical_and.reduce([np.isin(x[cut[i]:cut[i + 1]].view(np.int64), h) for x in anchors])
            k = np.flatnonzero(keep)
            own = doc[k]
            start = (at[k] - words.first[own]) | (rns[own] << ROW)
            yield pa.RecordBatch.from_arrays([pa.array(edge[k].view(np.int64)), pa.array((second[k] >> np.uint64(32)).astype(np.uint32).view(np.int32)), part.column("doc_id").take(pa.array(own)), pa.array(start)],
                                             names=["e1", "e2", "doc_id", "at"])

    return rows.join(anchors, "doc_id").select("doc_id", "rn", "z", "size", "anchors").mapInArrow(run, "e1 long, e2 int, doc_id long, at long")


def occurrences(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, at, source_doc, source_at of every window that starts earlier too."""
    edges = _edges(rows, settled(_anchors(rows, window, gram)), window, gram)
    first = edges.groupBy("e1", "e2").agg(F.min(F.struct("doc_id", "at")).alias("s"), F.count("*").alias("n")).filter("n > 1")
    return (edges.join(first, ["e1", "e2"]).filter((F.col("doc_id") != F.col("s.doc_id")) | (F.col("at") != F.col("s.at")))
            .select("doc_id", "at", F.col("s.doc_id").alias("source_doc"), F.col("s.at").alias("source_at")))


def paths(starts: np.ndarray, source_doc: np.ndarray, source_at: np.ndarray, window: int = WINDOW):
    """Compact windows into spans (start, end, source document, source start) of words."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, d, a = starts[order], source_doc[order], source_at[order]
    breaks = np.flatnonzero((np.diff(s) != 1) | (np.diff(d) != 0) | (np.diff(a) != 1)) + 1
    low = np.concatenate(([0], breaks))
    high = np.concatenate((breaks, [len(s)])) - 1
    return list(zip(s[low].tolist(), (s[high] + window).tolist(), d[low].tolist(), a[low].tolist()))


SPANS = "array<struct<start:long,end:long,source_doc:long,source_start:long>>"


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), its kept_sha256, spans.

    ``spans`` are the compacted repeated paths of the document with their source; a word is
    removed if a span covers it. Without ``with_text`` the kept text itself is left out.
    """
    rows = _packed(documents(df, doc_id, text))
    rows = rows.join(settled(_copies(rows)), "doc_id", "left")
    once = rows.filter(~F.coalesce(F.exists("copies", lambda c: c["rn"] == F.col("rn")), F.lit(False)))
    # positions of one document, never more than it has words
    found = settled(occurrences(once, window, gram)).groupBy("doc_id").agg(F.collect_list(F.struct("at", "source_doc", "source_at")).alias("met"))
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source_doc", pa.int64()), ("source_start", pa.int64())]))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", *["kept"] * with_text]

    def run(batches):
        low = (1 << ROW) - 1
        for part, texts in unzipped(batches):
            words = words_of(texts)
            rns, met, copies = np.asarray(part.column("rn"), dtype=np.int64), part.column("met"), part.column("copies")
            removed, sums, kept, spans = [], [], [], []
            raw = texts.data.tobytes()
            for i in range(part.num_rows):
                a, b = int(words.first[i]), int(words.first[i + 1])
                gone, found_ = np.zeros(b - a + 1, dtype=np.int64), []
                if met[i].is_valid:
                    own = met[i].values
                    at = np.asarray(own.field("at"), dtype=np.int64)
                    mine = (at >> ROW) == rns[i]
                    found_ = paths(at[mine] & low, np.asarray(own.field("source_doc"))[mine], np.asarray(own.field("source_at"))[mine], window)
                if copies[i].is_valid and b - a >= window:
                    found_ = [(0, b - a, c["source_doc"], 0) for c in copies[i].as_py() if c["rn"] == rns[i]] or found_
                for s, e, _, _ in found_:
                    gone[s] += 1
                    gone[e] -= 1
                left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                whole = b" ".join([raw[x:y] for x, y in zip(words.starts[a + left].tolist(), words.ends[a + left].tolist())])
                removed.append(b - a - len(left))
                sums.append(hashlib.sha256(whole).hexdigest())
                spans.append([{"start": s, "end": e, "source_doc": d, "source_start": p & low} for s, e, d, p in found_])
                if with_text:
                    kept.append(whole.decode("utf-8", "replace"))
            arrays = [part.column("doc_id"), pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(spans, kinds)]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.string())] if with_text else []), names=names)

    schema = f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {SPANS}" + (", kept string" if with_text else "")
    return rows.join(found, "doc_id", "left").select("doc_id", "rn", "z", "size", "met", "copies").mapInArrow(run, schema)
