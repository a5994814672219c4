"""Token ids of whole texts with the tokenizers library, remembered piece by piece.

The vocabulary's rule splits a text at white space, then into runs of letters, single digits
and runs of other signs, so a text's ids are the ids of those pieces in a row. Each distinct
piece of a slice goes to the library once; pieces met before come from a memory of bounded
size. Words of ASCII and Latin-1 letters, digits and signs are split here and their pieces
go to the library's model; every other word goes through the library's whole chain.
Pieces are told apart by 128 bits of hash.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from .arrays import EXACT, WHITE, Texts, Words, words_of

VOCABULARY = "word_bpe_49k.json"
MEMORY_ENTRIES = 2_000_000

LETTER, DIGIT, SIGN, LEAD = 1, 2, 3, 0xC3
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = SIGN
_KIND[0x30:0x3A] = DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:0xC0] = _KIND[LEAD] = LETTER
_ODD = ~WHITE & (_KIND == 0)
_ODD[0x27] = True  # an apostrophe may begin a contraction
_FOLD = EXACT.copy()
_FOLD[0x41:0x5B] = EXACT[0x61:0x7B]
_FOLD[0x80:0x9F] = EXACT[0xA0:0xBF]  # the second byte of a Latin-1 capital


class Encoder:
    """Ids of texts by one vocabulary file; made once in each worker."""

    def __init__(self, path: str, entries: int = MEMORY_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.entries = entries
        self._forget()

    def _forget(self) -> None:
        self.keys = self.proof = np.zeros(0, np.uint64)
        self.start = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def plain(self, text: str) -> list[int]:
        """The library's own ids of a text."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new(self, pieces: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = iter("\n".join(p for p, entire in zip(pieces, whole.tolist()) if not entire).lower().translate(self.table).split("\n"))
        tokenize = self.model.tokenize
        found: list[list[int]] = []
        for piece, entire in zip(pieces, whole.tolist()):
            found.append(self.plain(piece) if entire else [t.id for t in tokenize(next(plain))])
        return np.fromiter(map(len, found), np.int64, len(found)), np.array(list(chain.from_iterable(found)), np.uint32)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row (uint32) and the number of ids of each document."""
        words = words_of(texts)
        if not len(words.starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts, ends, whole, first = _pieces(texts, words)
        split = Words(texts, starts, ends, None, None, None)
        key = split.hashes(_FOLD, 0)
        if whole.any():
            at = np.flatnonzero(whole)
            key[at] = Words(*_cut(texts.data, starts[at], ends[at]), None, None, None).hashes(EXACT, 0) ^ np.uint64(0x5851F42D4C957F2D)
        key, where, back = np.unique(key, return_index=True, return_inverse=True)
        proof = Words(*_cut(texts.data, starts[where], ends[where]), None, None, None).hashes(_FOLD, 1)
        at = np.searchsorted(self.keys, key)
        inside = at < len(self.keys)
        known = np.zeros(len(key), dtype=bool)
        known[inside] = (self.keys[at[inside]] == key[inside]) & (self.proof[at[inside]] == proof[inside])
        lengths, source = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
        lengths[known] = self.size[at[known]]
        source[known] = self.start[at[known]]
        pool, new = self.ids, np.flatnonzero(~known)
        if len(new):
            raw = texts.data.tobytes()
            pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())]
            size, ids = self._new(pieces, whole[where[new]])
            lengths[new] = size
            source[new] = len(pool) + np.concatenate(([0], np.cumsum(size)[:-1]))
            pool = np.concatenate((pool, ids))
        length = lengths[back]
        out = gather(pool, source[back], length)
        total = np.concatenate(([0], np.cumsum(length)))
        counts = total[first[1:]] - total[first[:-1]]
        if len(new):
            self._remember(key[new], proof[new], lengths[new], source[new], pool)
        return out, counts

    def _remember(self, key, proof, lengths, source, pool) -> None:
        """Add distinct keys in rising order, whose ids lie in ``pool``; the newest entry of a key stays."""
        if len(self.keys) + len(key) > self.entries:
            self._forget()
            key, proof, lengths, source = (x[:self.entries] for x in (key, proof, lengths, source))
            pool, source = gather(pool, source, lengths), np.cumsum(lengths) - lengths
        at = np.searchsorted(self.keys, key)
        old = np.zeros(len(key), dtype=bool)
        old[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == key[at < len(self.keys)]
        add = ~old
        made = []
        for have, new in ((self.keys, key), (self.proof, proof), (self.start, source), (self.size, lengths)):
            have[at[old]] = new[old]
            made.append(np.insert(have, at[add], new[add]))
        self.keys, self.proof, self.start, self.size = made
        self.ids = pool


def _pieces(texts: Texts, words: Words):
    """Pieces of all words: byte ranges, which are words for the whole chain, first piece of each document."""
    data = texts.data
    odd = _ODD[data]
    after = np.concatenate((data[1:], [np.uint8(0x20)]))
    odd |= (data == LEAD) & ((after == 0x97) | (after == 0xB7) | (after < 0x80)) | (data == 0x3C) & (after == 0x7C)
    run = np.concatenate(([0], np.cumsum(odd)))
    strange = run[words.ends] > run[words.starts]
    kind = _KIND[data]
    head = np.empty(len(data), dtype=bool)
    head[0] = True
    head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    head &= kind > 0
    if strange.any():
        span = gather_ranges(words.starts[strange], words.ends[strange])
        head[span] = False
    head[words.starts] = True
    starts = np.flatnonzero(head)
    word = np.searchsorted(words.starts, starts, "right") - 1
    ends = np.minimum(np.concatenate((starts[1:], [len(data)])), words.ends[word])
    return starts, ends, strange[word], np.searchsorted(starts, texts.offsets)


def gather_ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    total = np.cumsum(length)
    return np.repeat(start - np.concatenate(([0], total[:-1])), length) + np.arange(total[-1])


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    length = end - start
    offsets = np.concatenate(([0], np.cumsum(length)))
    return Texts(data[gather_ranges(start, end)], offsets), offsets[:-1], offsets[1:]


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``pool[start:start + length]`` of every entry in a row."""
    if not len(length) or not length.any():
        return np.zeros(0, pool.dtype)
    return pool[gather_ranges(start, start + length)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, entries: int = MEMORY_ENTRIES) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, entries)
    return _ENCODERS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
