"""Personal data: base rules, and a semi-Markov conditional random field over spans.

Base rules give emails, network addresses, card and phone numbers. The field scores whole
candidate segments of a token stretch (at most ``MOST_CHARS`` characters, and ``MOST_DIGITS``
digits in a number) as email, ip, card, phone or as a single outside token; a dynamic
programme over segment ends chooses boundaries and types together. Features are of the whole span: its shape, digit groups, signs, check
sums, length, and the words and signs around it.

Segments must look possible for their type (an ``@`` for an email, the number of digits the
type allows otherwise); tokens that no possible segment can hold are outside by rule, so the
best segmentation decomposes at them and the programme runs over stretches of number-like
tokens only. A stretch is never cut: its segments are made for ``BLOCK`` ends at a time.

Weights are learnt by gradient steps on the log-likelihood with the base rules' spans as
labels, from at most ``MAX_TRAIN`` documents chosen by hash of their id and at most
``MAX_STRETCHES`` pieces of stretches of each; a piece ends where no base span is, and one that
holds a base span which is no candidate teaches nothing. Decoding covers every whole text. An added span keeps the
kind that the field gave it and is left out only if base spans cover it whole; a span of a base
rule that another rule also claims stays as well.

Defined results: a null text is an empty one and has no spans; repeated rows are scanned
alike; null ids are kept; an empty table gives an empty result; other columns are ignored.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, slices, texts_of
from .common import Cover, documents

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is taken whole, so no start inside it can fare better
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_TRAIN = 4000
MAX_STRETCHES = 20
MOST_CHARS = 80
MOST_DIGITS = 19  # of the longest kind of number
BLOCK = 512
WIDTH = 1 << 13
SLOTS = 12
EPOCHS = 60

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` has one leftmost start: the run of local signs before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str, has_digit: bool) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if has_digit:
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _digits(m.group())
                if 13 <= len(d) <= 19 and luhn(d):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found  # by kind as listed, then start


_NUMBERS = re.compile(r"(?<![0-9A-Za-z@+(._%-])(?=[A-Za-z+(._%-]*+[0-9@])[0-9A-Za-z@._%+()-]++(?:\x20?[(+]?[0-9][0-9A-Za-z@._%+()-]*+)*+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)


def stretches(text: str):
    """Stretches of number-like or address-like text, as lists of (start, end) of tokens."""
    for m in _NUMBERS.finditer(text):
        yield [(t.start(), t.end()) for t in _TOKEN.finditer(text, m.start(), m.end())]


def pieces(tokens: list[tuple[int, int]], spans):
    """A stretch for training: cut after 400 characters, at a token's end that no base span goes across."""
    first = 0
    for k, (_, at) in enumerate(tokens):
        if at - tokens[first][0] > 400 and not any(a < at < b for _, a, b in spans):
            yield tokens[first:k + 1]
            first = k + 1
    if first < len(tokens):
        yield tokens[first:]


def allowed(text: str, kind: int) -> bool:
    """Whether a segment may have a kind at all."""
    if kind == 0:
        return text.count("@") == 1 and 5 <= len(text) and not text[0] == "@" and text[-1].isalnum()
    if not ("0" <= text[-1] <= "9") or not (text[0] in "+(" or "0" <= text[0] <= "9") or any(c.isalpha() or c == "@" for c in text):
        return False
    n = len(_digits(text))
    if kind == 1:
        return text.count(".") == 3 and " " not in text and n <= 12
    return 13 <= n <= 19 if kind == 2 else 7 <= n <= 15


def _code(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode()) % WIDTH


_GROUP = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[A-Za-z]+")


def span_features(text: str, a: int, b: int, kind: int) -> list[int]:
    """Feature numbers of the whole segment ``text[a:b]``, for one kind; always ``SLOTS``."""
    span = text[a:b]
    d = _digits(span)
    groups = [len(g) for g in _GROUP.findall(span)]
    signs = "".join(dict.fromkeys(c for c in span if not c.isalnum()))
    before, after = text[max(0, a - 30):a], text[b:b + 3]
    words = _LETTERS.findall(before)
    parts = span.split(".")
    return [
        _code(kind, "bias"), _code(kind, "digits", len(d)), _code(kind, "groups", *groups[:6]), _code(kind, "signs", signs),
        _code(kind, "head", span[0] if not span[0].isalnum() else "x"), _code(kind, "luhn", len(d) >= 13 and luhn(d)),
        _code(kind, "small", len(parts) == 4 and all(p.isdigit() and _small(p) for p in parts)),
        _code(kind, "length", min(len(span), 40) // 3), _code(kind, "dot", "." in span.partition("@")[2], "@" in span),
        _code(kind, "before", before[-1:] if not before[-1:].isalpha() else "a"), _code(kind, "after", after[:1] if not after[:1].isalpha() else "a"),
        _code(kind, "word", words[-1].lower()[-10:] if words else ""),
    ]


def outside_features(text: str, a: int, b: int) -> list[int]:
    token = text[a:b]
    shape = "9" if token[0].isdigit() else "a" if token[0].isalpha() else token[0]
    return [_code("out", "bias"), _code("out", shape), _code("out", shape, min(len(token), 20)), _code("out", text[a - 1:a] if a else "", shape)] + [_code("out", "pad")] * (SLOTS - 4)


def _starts(text: str, tokens: list[tuple[int, int]], e: int) -> list[tuple[int, bool, bool]]:
    """First tokens of segments that end with token ``e``: whether as an email, as a number."""
    b = tokens[e][1]
    mail = text[b - 1].isalnum() and "@" in text[max(0, b - MOST_CHARS):b]
    number = "0" <= text[b - 1] <= "9"
    out, ats, digits, s = [], 0, 0, e
    while s >= 0 and (mail or number) and b - tokens[s][0] <= MOST_CHARS:
        c = text[tokens[s][0]]
        if "0" <= c <= "9":
            digits += tokens[s][1] - tokens[s][0]
        ats += c == "@"
        mail = mail and ats < 2
        number = number and digits <= MOST_DIGITS and c != "@" and not c.isalpha()
        out.append((s, mail and ats == 1, number))
        s -= 1
    return out[::-1]


class Segments:
    """Candidate segments of a stretch with their features, grouped by end.

    With ``low`` and ``high`` only those that end with one of these tokens.
    """

    def __init__(self, text: str, tokens: list[tuple[int, int]], low: int = 0, high: int | None = None):
        self.tokens = tokens
        self.first, self.last, self.kind, feats = [], [], [], []
        for e in range(low, len(tokens) if high is None else high):
            self.first.append(e)
            self.last.append(e)
            self.kind.append(OUTSIDE)
            feats.append(outside_features(text, *tokens[e]))
            for s, mail, number in _starts(text, tokens, e):
                a, b = tokens[s][0], tokens[e][1]
                for kind in (0,) * mail + (1, 2, 3) * number:
                    if allowed(text[a:b], kind):
                        self.first.append(s)
                        self.last.append(e)
                        self.kind.append(kind)
                        feats.append(span_features(text, a, b, kind))
        self.feats = np.array(feats, dtype=np.int32)

    def gold(self, spans) -> list[int] | None:
        """Numbers of the segments that the base spans make; the rest is outside.

        None if a base span is no candidate.
        """
        by = {(self.tokens[s][0], self.tokens[e][1], k): i for i, (s, e, k) in enumerate(zip(self.first, self.last, self.kind))}
        out, at = [], 0
        wanted = {a: (b, KINDS.index(k)) for k, a, b in reversed(spans)}
        while at < len(self.tokens):
            a = self.tokens[at][0]
            i = by.get((a, wanted[a][0], wanted[a][1])) if a in wanted else None
            if i is None:
                if a in wanted:
                    return None
                i = by[(a, self.tokens[at][1], OUTSIDE)]
            out.append(i)
            at = self.last[i] + 1
        return out


class SegmentField:
    """Semi-Markov field: a weight for each feature number and for each pair of kinds."""

    def __init__(self):
        self.w = np.zeros(WIDTH)
        self.move = np.zeros((OUTSIDE + 2, OUTSIDE + 1))  # the last row: at the beginning

    def _forward(self, seg: Segments, score: np.ndarray) -> np.ndarray:
        alpha = np.full((len(seg.tokens) + 1, OUTSIDE + 2), -np.inf)
        alpha[0, OUTSIDE + 1] = 0.0
        for i, (s, e, k) in enumerate(zip(seg.first, seg.last, seg.kind)):
            value = np.logaddexp.reduce(alpha[s] + self.move[:, k]) + score[i]
            alpha[e + 1, k] = np.logaddexp(alpha[e + 1, k], value)
        return alpha

    def decode(self, seg: Segments) -> list[tuple[int, int, int]]:
        """Best segmentation as (first token, last token, kind), outside left out."""
        return self._best(len(seg.tokens), [seg])

    def decode_stretch(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The same for a stretch of any length: features are held for ``BLOCK`` ends at a time."""
        n = len(tokens)
        return self._best(n, (Segments(text, tokens, k, min(k + BLOCK, n)) for k in range(0, n, BLOCK)))

    def _best(self, n: int, blocks) -> list[tuple[int, int, int]]:
        alpha = np.full((n + 1, OUTSIDE + 2), -np.inf)
        alpha[0, OUTSIDE + 1] = 0.0
        start = np.zeros((n + 1, OUTSIDE + 1), np.int32)
        previous = np.zeros((n + 1, OUTSIDE + 1), np.int8)
        for seg in blocks:
            score = self.w[seg.feats].sum(axis=1)
            for i, (s, e, k) in enumerate(zip(seg.first, seg.last, seg.kind)):
                into = alpha[s] + self.move[:, k]
                value = into.max() + score[i]
                if value > alpha[e + 1, k]:
                    alpha[e + 1, k], start[e + 1, k], previous[e + 1, k] = value, s, into.argmax()
        at, k, out = n, int(alpha[n].argmax()), []
        while at > 0:
            s = int(start[at, k])
            if k != OUTSIDE:
                out.append((s, at - 1, k))
            at, k = s, int(previous[at, k])
        return out[::-1]

    def _gradient(self, seg: Segments, gold: list[int], gw: np.ndarray, gm: np.ndarray) -> None:
        score = self.w[seg.feats].sum(axis=1)
        alpha = self._forward(seg, score)
        n = len(seg.tokens)
        beta = np.full((n + 1, OUTSIDE + 2), -np.inf)
        beta[n] = 0.0
        z = np.logaddexp.reduce(alpha[n])
        for i in range(len(seg.kind) - 1, -1, -1):
            s, e, k = seg.first[i], seg.last[i], seg.kind[i]
            here = score[i] + beta[e + 1, k]
            p = np.exp(alpha[s] + self.move[:, k] + here - z)
            total = p.sum()
            if total > 0:
                np.subtract.at(gw, seg.feats[i], total)
                gm[:, k] -= p
            beta[s] = np.logaddexp(beta[s], self.move[:, k] + here)
        last = OUTSIDE + 1
        for i in gold:
            np.add.at(gw, seg.feats[i], 1.0)
            gm[last, seg.kind[i]] += 1
            last = seg.kind[i]

    def fit(self, pairs, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> "SegmentField":
        """Adaptive gradient ascent over stretches, each distinct stretch with its count."""
        if not pairs:
            self.move[:, :OUTSIDE] = -1e6
            return self
        sw, sm = np.full(WIDTH, 1e-8), np.full_like(self.move, 1e-8)
        batch = max(1, len(pairs) // 8)
        for _ in range(max(1, epochs // 8)):
            for k in range(0, len(pairs), batch):
                gw, gm = -decay * self.w, -decay * self.move
                some = pairs[k:k + batch]
                for seg, gold in some:
                    self._gradient(seg, gold, gw, gm)
                for w, g, s in ((self.w, gw / len(some), sw), (self.move, gm / len(some), sm)):
                    s += g * g
                    w += rate * g / np.sqrt(s)
        return self


def scan_slice(texts: Texts):
    """For each document its text and base spans, or None where nothing can be found."""
    digits = np.concatenate(([0], np.cumsum(_DIGIT[texts.data])))
    ats = np.concatenate(([0], np.cumsum(texts.data == 0x40)))
    o = texts.offsets
    for i in range(len(texts)):
        n, m = digits[o[i + 1]] > digits[o[i]], ats[o[i + 1]] > ats[o[i]]
        if not n and not m:
            yield None
            continue
        text = texts.text(i)
        yield text, base_spans(text, bool(n))


def _worth(text: str, tokens) -> bool:
    a, b = tokens[0][0], tokens[-1][1]
    return "@" in text[a:b] or sum("0" <= c <= "9" for c in text[a:b]) >= 4


def sample(docs: DataFrame, most: int) -> DataFrame:
    """About ``most`` documents, the same ones for the same ids."""
    total = max(1, docs.count())
    return docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("segments")), F.lit(1 << 20)) < int(min(1.0, most / total) * (1 << 20)))


def train(docs: DataFrame, most: int = MAX_TRAIN, most_stretches: int = MAX_STRETCHES) -> SegmentField:
    """Fit on stretches of a bounded sample; each is carried as its text with 40 signs around."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for got in scan_slice(texts_of(part.column("text"))):
                    if got is None:
                        continue
                    text, spans = got
                    kept = [t for whole in stretches(text) for t in pieces(whole, spans) if _worth(text, t)]
                    kept = [t for t in kept if all(t[0][0] <= a and b <= t[-1][1] for _, a, b in spans if a < t[-1][1] and t[0][0] < b)]
                    kept.sort(key=lambda t: (not any(t[0][0] < b and a < t[-1][1] for _, a, b in spans), zlib.crc32(text[t[0][0]:t[-1][1]].encode("utf-8", "replace"))))
                    for tokens in kept[:most_stretches]:
                        a, b = max(0, tokens[0][0] - 40), tokens[-1][1] + 40
                        near = [(k, s - a, e - a) for k, s, e in spans if s >= a and e <= b]
                        rows.append((text[a:b], tokens[0][0] - a, tokens[-1][1] - a, ",".join(f"{k}:{s}:{e}" for k, s, e in near)))
                cols = list(zip(*rows)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["t", "a", "b", "s"])

    rows = sample(docs, most).mapInArrow(run, "t string, a int, b int, s string").toPandas().drop_duplicates().sort_values(["t", "a"])
    pairs = []
    for t, a, b, s in rows.itertuples(index=False):
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(t, a, b)]
        spans = [(k, int(x), int(y)) for k, x, y in (v.split(":") for v in s.split(",") if v)]
        seg = Segments(t, tokens)
        gold = seg.gold(spans)
        if gold is not None:
            pairs.append((seg, gold))
    return SegmentField().fit(pairs)


def added_spans(field: SegmentField, text: str, spans) -> list[tuple[str, int, int]]:
    out, base = [], Cover(spans)
    for tokens in stretches(text):
        if not _worth(text, tokens) or base.holds(tokens[0][0], tokens[-1][1]):
            continue
        for s, e, kind in field.decode_stretch(text, tokens):
            a, b = tokens[s][0], tokens[e][1]
            if not base.holds(a, b):
                out.append((KINDS[kind], a, b))
    return out


def find(docs: DataFrame, field: SegmentField) -> DataFrame:
    """doc_id and spans (array of kind, start, end, base) of every document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                for got in scan_slice(texts_of(part.column("text"))):
                    spans = []
                    if got is not None:
                        text, base = got
                        spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(field, text, base)]
                        spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                    found.append([{"kind": k, "start": a, "end": b, "base": x} for k, a, b, x in spans])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as one string."""
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_TRAIN) -> DataFrame:
    """Train on the table's sample, then find the spans of every document."""
    docs = documents(df, doc_id, text)
    return find(docs, train(docs, most))
