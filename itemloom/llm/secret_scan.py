"""Secret scan: base rules, and a linear-chain conditional random field over a text's tokens.

Base rules give spans of kinds assign, access and hex. The field tags tokens as secret begin,
inside or outside. Tokens are runs of ``[A-Za-z0-9+/_.-]``. Viterbi runs over windows of all
tokens, words and short ones among them, up to ``AROUND`` tokens from a suspicious one: one
with a key word in it or of a random shape (``suspicious``). Within a window the weights alone
decide. Features are the token's shape, its neighbours (signs before and after, words before
and after) and those of the file (length, share of digits, number of suspicious tokens).

Weights are learnt by gradient steps on the log-likelihood, with the base rules' spans as
labels (of an assignment its value), from at most ``MAX_TRAIN`` documents chosen by hash of their id and at most
``MAX_RUNS`` stretches of each; decoding covers every whole text. Spans the field adds have
kind ``crf``; those that base spans cover whole are left out, and base spans stay as they are.

Defined results: a null text is an empty one and has no spans; repeated rows are scanned
alike; null ids are kept; an empty table gives an empty result; other columns are ignored.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, slices, texts_of
from .common import Cover, documents

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")

MAX_TRAIN = 4000
MAX_RUNS = 20
AROUND = 3
SLAB = 1 << 14
WORDS = (b"passw", b"passphrase", b"passcode", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"auth", b"private", b"signature")
SLOTS = 16
WIDTH = 1 << 14
OUT, BEGIN, INSIDE = 0, 1, 2
EPOCHS = 60

_HEX = np.zeros(256, dtype=bool)
_HEX[48:58] = _HEX[97:103] = True
_RUN = np.zeros(256, dtype=bool)
_RUN[48:58] = _RUN[65:91] = _RUN[97:123] = True
_RUN[[0x2B, 0x2F, 0x5F, 0x2E, 0x2D]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_CONSONANT = _UPPER | _LOWER
_CONSONANT[list(b"aeiouyAEIOUY")] = False


def runs(texts: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the longest runs of a class inside one document."""
    inside = table[texts.data]
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[texts.offsets] = True
    starts = np.flatnonzero(inside & (edge[:n] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends


def base_spans(text: str, hex_runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the base rules in a text; the runs of hexadecimal digits come from the caller."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", a, b) for a, b in hex_runs]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _counts(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags)))


def suspicious(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens open a window: those with a key word, with 8 characters and a digit, with 6
    characters, a letter and a digit, with 16 characters, with 8 and a capital after a small
    letter, or with 8 and five consonants in a row."""
    data, size = texts.data, ends - starts
    upper, lower = _UPPER[data], _LOWER[data]
    digits, letters = _counts(_DIGIT[data]), _counts(upper | lower)
    turns = _counts(upper & np.concatenate(([False], lower[:-1])))
    place = np.arange(len(data))
    hard = place - np.maximum.accumulate(np.where(_CONSONANT[data], -1, place)) >= 5
    hard = _counts(hard)
    has = lambda c, skip=0: c[ends] > c[np.minimum(starts + skip, ends)]
    hot = (size >= 16) | has(digits) & ((size >= 8) | (size >= 6) & has(letters)) | (size >= 8) & (has(turns, 1) | has(hard, 4))
    small = np.where(upper, data | 0x20, data).astype(np.uint8).tobytes()
    for word in WORDS:
        at = np.array([m.start() for m in re.finditer(word, small)], dtype=np.int64)
        k = np.searchsorted(starts, at, "right") - 1
        hot[k[at + len(word) <= ends[k]]] = True
    return hot


def near(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens within ``AROUND`` of a suspicious one of their document: number, byte range and
    document of each; and the documents of the suspicious ones."""
    starts, ends = runs(texts, _RUN)
    doc = np.searchsorted(texts.offsets, starts, "right") - 1
    at = np.flatnonzero(suspicious(texts, starts, ends))
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, np.maximum(at - AROUND, first[doc[at]]), 1)
    np.add.at(change, np.minimum(at + AROUND + 1, first[doc[at] + 1]), -1)
    number = np.flatnonzero(np.cumsum(change)[:-1])
    return number, starts[number], ends[number], doc[number], doc[at]


_WORD = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=1 << 16, typed=True)
def _code(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode()) % WIDTH


def _log(n: int) -> int:
    return int(n).bit_length()


@lru_cache(maxsize=1 << 16)
def _shape(token: str) -> tuple[str, tuple[int, ...]]:
    """Kinds of characters of a token, and the features that do not depend on its place."""
    n_digit = sum(c.isdigit() for c in token)
    n_upper = sum(c.isupper() for c in token)
    n_lower = sum(c.islower() for c in token)
    turns = sum((x.isdigit() != y.isdigit()) for x, y in zip(token, token[1:]))
    kinds = "".join(k for k, n in (("D", n_digit), ("A", n_upper), ("a", n_lower), ("s", len(token) - n_digit - n_upper - n_lower)) if n)
    only_hex = all(c in "0123456789abcdefABCDEF" for c in token)
    return kinds, (
        _code("kinds", kinds), _code("length", min(len(token), 48) // 4, kinds), _code("hex", only_hex, kinds), _code("turns", min(turns, 12)),
        _code("digits", round(8 * n_digit / len(token))), _code("dots", min(token.count("."), 4), min(token.count("-"), 4)),
        _code("head", re.sub(r"[0-9]", "9", token[:4])),
    )


def token_features(text: str, a: int, b: int, size: int, digits: int, tokens: int) -> list[int]:
    """Feature numbers of the token ``text[a:b]`` in its file, always ``SLOTS`` of them."""
    kinds, shape = _shape(text[a:b])
    before, after = text[max(0, a - 40):a], text[b:b + 24]
    left = re.sub(r"\s+", " ", re.search(r"[^A-Za-z0-9]*\Z", before).group())[-3:]
    right = re.sub(r"\s+", " ", re.match(r"[^A-Za-z0-9]*", after).group())[:2]
    words = _WORD.findall(before)
    last = words[-1].lower() if words else ""
    following = _WORD.match(after.lstrip())
    return [
        *shape, _code("left", left), _code("right", right), _code("word", last[-12:], left[-1:]),
        _code("sign", "=" in left or ":" in left, kinds), _code("at", before[-1:] == "@" or after[:1] == "@"),
        _code("next", following.group().lower()[:12] if following else ""), _code("size", _log(size)),
        _code("share", _log(1000 * digits // max(1, size))), _code("tokens", _log(tokens)),
    ]


def _stretches(texts: Texts, doc: int, number: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Tokens of one document in stretches of tokens that follow on one another.

    Yields lists of (start, end) in code points. ``starts`` and ``ends`` are byte offsets.
    """
    base = texts.offsets[doc]
    raw = texts.data[base:texts.offsets[doc + 1]]
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    a, b = heads[starts - base], heads[ends - base]
    cuts = np.flatnonzero(np.diff(number) > 1) + 1
    for x, y in zip(np.split(a, cuts), np.split(b, cuts)):
        yield list(zip(x.tolist(), y.tolist()))


def scan_slice(texts: Texts):
    """For each document: text, base spans, stretches and (size, digits, tokens) of the file.

    The text is decoded only where something was found that needs it.
    """
    hs, he = runs(texts, _HEX)
    keep = he - hs >= 16
    hs, he = hs[keep], he[keep]
    hdoc = np.searchsorted(texts.offsets, hs, "right") - 1
    number, ts, te, tdoc, odd = near(texts)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[texts.data])))
    signs = np.zeros(256, dtype=bool)
    signs[[0x3A, 0x3D]] = True
    marked = np.concatenate(([0], np.cumsum(signs[texts.data])))
    o = texts.offsets
    count = len(texts)
    hcut, tcut = np.searchsorted(hdoc, np.arange(count + 1)), np.searchsorted(tdoc, np.arange(count + 1))
    ocut = np.searchsorted(odd, np.arange(count + 1))
    for i in range(count):
        has_token, has_hex = tcut[i + 1] > tcut[i], hcut[i + 1] > hcut[i]
        if not (has_token or has_hex or marked[o[i + 1]] > marked[o[i]]):
            # an access key or a secret without digits has a sign or AKIA with it
            raw = texts.data[o[i]:o[i + 1]].tobytes()
            if b"AKIA" not in raw:
                yield None
                continue
        text = texts.text(i)
        raw = texts.data[o[i]:o[i + 1]]
        spans = []
        if has_hex:
            heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            spans = [(int(heads[a - o[i]]), int(heads[b - o[i]])) for a, b in zip(hs[hcut[i]:hcut[i + 1]], he[hcut[i]:hcut[i + 1]])]
        stretches = list(_stretches(texts, i, number[tcut[i]:tcut[i + 1]], ts[tcut[i]:tcut[i + 1]], te[tcut[i]:tcut[i + 1]])) if has_token else []
        yield text, base_spans(text, spans), stretches, (len(text), int(digits[o[i + 1]] - digits[o[i]]), int(ocut[i + 1] - ocut[i]))


def values(text: str, spans) -> list[tuple[str, int, int]]:
    """Base spans without the name and sign of an assignment."""
    return [(k, ASSIGN.match(text, a).start(1) if k == "assign" else a, b) for k, a, b in spans]


def _labels(stretch, spans) -> list[int]:
    out, open_span = [], None
    for a, b in stretch:
        over = next((s for s in spans if s[1] < b and a < s[2]), None)
        out.append(OUT if over is None else INSIDE if over == open_span else BEGIN)
        open_span = over
    return out


class Field:
    """Weights of the linear-chain field: WIDTH x 3 emissions and 3 x 3 transitions."""

    def __init__(self):
        self.emit = np.zeros((WIDTH, 3))
        self.move = np.zeros((3, 3))
        self.first = np.zeros(3)

    def blocked(self) -> np.ndarray:
        move = self.move.copy()
        move[OUT, INSIDE] = -1e9  # inside needs a begin before it
        return move

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> "Field":
        """Adaptive gradient ascent; sequences of one length go through forward-backward together."""
        by: dict[int, list] = {}
        for x, y in sequences:
            by.setdefault(len(y), []).append((x, y))
        groups = []
        for length, g in by.items():
            step = max(1, SLAB // length)
            groups += [(np.array([x for x, _ in g[k:k + step]]), np.array([y for _, y in g[k:k + step]])) for k in range(0, len(g), step)]
        total = sum(len(y) for _, y in groups)
        if not total:
            self.first[OUT] = 1e6
            self.emit[:, OUT] = 1e3
            return self
        se, sm, sf = np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8), np.full_like(self.first, 1e-8)
        for _ in range(epochs):
            ge, gm, gf = -decay * self.emit, -decay * self.move, -decay * self.first
            for x, y in groups:
                self._gradient(x, y, ge, gm, gf, total)
            for w, g, s in ((self.emit, ge, se), (self.move, gm, sm), (self.first, gf, sf)):
                s += g * g
                w += rate * g / np.sqrt(s)
        return self

    def _gradient(self, x, y, ge, gm, gf, total) -> None:
        m, length = y.shape
        move = self.blocked()
        e = self.emit[x].sum(axis=2)  # m, length, 3
        alpha = np.empty_like(e)
        first = self.first.copy()
        first[INSIDE] = -1e9
        alpha[:, 0] = e[:, 0] + first
        for t in range(1, length):
            alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move[None], axis=1) + e[:, t]
        beta = np.zeros_like(e)
        for t in range(length - 2, -1, -1):
            beta[:, t] = np.logaddexp.reduce(move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None])
        want = np.eye(3)[y]
        diff = (want - p) / total
        for tag in range(3):
            ge[:, tag] += np.bincount(x.reshape(-1), np.repeat(diff[:, :, tag].reshape(-1), x.shape[2]), WIDTH)
        gf += diff[:, 0].sum(axis=0)
        for t in range(1, length):
            pair = np.exp(alpha[:, t - 1, :, None] + move[None] + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            seen = want[:, t - 1, :, None] * want[:, t, None, :]
            gm += (seen - pair).sum(axis=0) / total

    def decode(self, x: np.ndarray) -> list[int]:
        """Viterbi: the best tags of one stretch (features length x SLOTS)."""
        e = self.emit[x].sum(axis=1)
        move = self.blocked()
        first = self.first.copy()
        first[INSIDE] = -1e9
        score = e[0] + first
        back = []
        for t in range(1, len(e)):
            step = score[:, None] + move
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + e[t]
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def _codes(text, stretch, file) -> np.ndarray:
    return np.array([token_features(text, a, b, *file) for a, b in stretch], dtype=np.int32)


def sample(docs: DataFrame, most: int) -> DataFrame:
    """About ``most`` documents, the same ones for the same ids."""
    total = max(1, docs.count())
    return docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("field")), F.lit(1 << 20)) < int(min(1.0, most / total) * (1 << 20)))


def train(docs: DataFrame, most: int = MAX_TRAIN, most_runs: int = MAX_RUNS) -> Field:
    """Fit on a bounded sample of documents, with the base rules' spans as labels.

    A stretch longer than 64 tokens is cut for training.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                xs, ys = [], []
                for got in scan_slice(texts_of(part.column("text"))):
                    if got is None:
                        continue
                    text, spans, stretches, file = got
                    spans = values(text, spans)
                    ranked = sorted(stretches, key=lambda s: (not any(_labels(s, spans)), zlib.crc32(str(s[0]).encode())))
                    for stretch in ranked[:most_runs]:
                        stretch = stretch[:64]
                        xs.append(_codes(text, stretch, file).tobytes())
                        ys.append(bytes(_labels(stretch, spans)))
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])

    rows = sample(docs, most).mapInArrow(run, "x binary, y binary").toPandas()
    rows = rows.sort_values(["x", "y"])  # the same order whatever the partitions
    pairs = [(np.frombuffer(x, np.int32).reshape(-1, SLOTS), np.frombuffer(y, np.uint8).astype(np.int64)) for x, y in zip(rows.x, rows.y)]
    return Field().fit(pairs)


def added_spans(field: Field, text: str, spans, stretches, file) -> list[tuple[str, int, int]]:
    """Spans that the field finds and that base spans do not cover whole."""
    out, base = [], Cover(spans)
    for stretch in stretches:
        tags = field.decode(_codes(text, stretch, file))
        k = 0
        while k < len(tags):
            if tags[k] == OUT:
                k += 1
                continue
            a, b = stretch[k]
            k += 1
            while k < len(tags) and tags[k] == INSIDE:
                b = stretch[k][1]
                k += 1
            while text[b:b + 1] == "=":
                b += 1
            if not base.holds(a, b):
                out.append(("crf", a, b))
    return out


def find(docs: DataFrame, field: Field, more: tuple[str, ...] = (), redact: str | None = None) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every document, with ``more`` of its columns.

    With ``redact`` also the text in which every span is replaced by that mark.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", "spans array<struct<kind:string,start:long,end:long>>", *["redacted string"] * (redact is not None), *[f"`{c}` {kinds[c]}" for c in more]])
    pair = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column("text")
                found, changed = [], []
                for i, got in enumerate(scan_slice(texts_of(column))):
                    spans = []
                    if got is not None:
                        text, base, stretches, file = got
                        spans = sorted(base + added_spans(field, text, base, stretches, file), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                    found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                    if redact is not None:
                        changed.append(cut(text, spans, redact) if spans else column[i].as_py())
                arrays = [part.column("doc_id"), pa.array(found, pair)]
                arrays += [pa.array(changed, pa.string())] if redact is not None else []
                yield pa.RecordBatch.from_arrays([*arrays, *[part.column(c) for c in more]],
                                                 names=["doc_id", "spans", *["redacted"] * (redact is not None), *more])

    return docs.mapInArrow(run, schema)


def cut(text: str, spans, mark: str) -> str:
    """Replace every stretch that spans cover by the mark."""
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as one string."""
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                        F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "crf")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), of("crf").alias("n_crf"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_TRAIN) -> DataFrame:
    """Train on the table's sample, then find the spans of every document."""
    docs = documents(df, doc_id, text)
    return find(docs, train(docs, most))
