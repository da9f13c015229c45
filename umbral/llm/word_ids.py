"""Ids of whole texts from a word-end vocabulary, each different word encoded once.

Such a vocabulary drops white space and never merges across it, nor across the border of letters, digits and other signs, so
a text's ids are those of its words one after another. Texts are cut with numpy, equal pieces become one by Arrow's dictionary, and only pieces not seen
before go to ``tokenizers``. Words with other than ASCII bytes, an apostrophe (the vocabulary knows endings like ``'s``) or ``<`` (added tokens) stay
whole and as they are, so every rule of the vocabulary about them is the library's own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from umbral.llm.text import LOWER, SPACED, text_bytes

_LETTER, _DIGIT, _SIGN, _WHOLE = 1, 2, 3, 4
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_UNSAFE = np.zeros(256, bool)
_UNSAFE[128:] = _UNSAFE[39] = _UNSAFE[60] = True
#: The letters U+00C0 to U+00FF (but two signs among them) are this byte and one of the others.
_LEAD = 0xC3
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x80:0xC0] = True
_FOLLOWS[0x97] = _FOLLOWS[0xB7] = False
_LAST_LETTER = "\u00ff"


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces one after another, where each begins there, and the first piece of each text (one more entry at each end)."""
    data, edges = text_bytes(texts)
    inside = SPACED[data]
    cuts = np.zeros(len(data) + 1, bool)
    cuts[edges] = True
    before, after = np.r_[False, inside[:-1]][: len(data)], np.r_[inside[1:], False][: len(data)]
    start = np.flatnonzero(inside & (~before | cuts[:-1]))
    end = np.flatnonzero(inside & (~after | cuts[1:])) + 1
    unsafe, kinds = _UNSAFE[data], _KIND[data]
    lead = np.flatnonzero(data[:-1] == _LEAD)
    lead = lead[_FOLLOWS[data[lead + 1]]]
    unsafe[lead] = unsafe[lead + 1] = False
    kinds[lead] = kinds[lead + 1] = _LETTER
    unsafe = np.r_[0, np.cumsum(unsafe, dtype=np.int32)]
    whole = np.repeat(unsafe[end] > unsafe[start], end - start)
    kind = np.zeros(len(data), np.uint8)
    kind[inside] = np.where(whole, _WHOLE, kinds[inside])
    data = np.where(kind == _WHOLE, data, LOWER[data])
    first = inside & (cuts[:-1] | (kind != np.r_[np.uint8(0), kind[:-1]][: len(data)]) | (kind == _DIGIT))
    begin = np.flatnonzero(first)
    return data[inside], np.r_[0, np.cumsum(inside)][np.r_[begin, len(data)]], np.searchsorted(begin, edges)


class WordIds:
    """Encoder with a memory of at most ``most`` pieces (and those of one batch, which holds less than 2 GB of text).

    When the memory is full, pieces that were met in one batch only are forgotten.
    """

    def __init__(self, tokenizer: str, most: int = 1 << 19, together: int = 512):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer)
        self.most, self.together = most, together
        size = self.model.get_vocab_size()
        self.closes = np.array([(self.model.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size, self.met = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _forget(self) -> None:
        keep = np.flatnonzero(self.met[: len(self.known)] > 1)
        if len(keep) > self.most // 2:
            keep = keep[:0]
        size, names = self.size[keep], list(self.known)
        ids = self.pool[np.arange(size.sum()) + np.repeat(self.at[keep] - np.r_[0, np.cumsum(size)][:-1], size)]
        self.known, self.used = {}, 0
        self._store([names[k] for k in keep.tolist()], ids, size)

    def _store(self, pieces: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        """New pieces with their ids, one piece's after another's."""
        k, n = len(self.known), len(ids)
        while self.used + n > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        while k + len(pieces) > len(self.at):
            self.at, self.size, self.met = (np.r_[x, np.zeros_like(x)] for x in (self.at, self.size, self.met))
        self.pool[self.used : self.used + n] = ids
        new = slice(k, k + len(pieces))
        self.at[new], self.size[new], self.met[new] = self.used + np.cumsum(size) - size, size, 0
        self.used += n
        self.known.update(zip(pieces, range(k, k + len(pieces)), strict=True))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        spelled = [p.decode() for p in new]
        words = [k for k, s in enumerate(spelled) if s.isalpha() and max(s) <= _LAST_LETTER]
        rest = sorted(set(range(len(new))).difference(words))
        for low in range(0, len(words), self.together):
            some = words[low : low + self.together]
            ids = np.array(self._ids([" ".join([spelled[k] for k in some])])[0], np.uint32)
            size = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
            if len(size) != len(some):  # a vocabulary whose words do not close
                rest += some
            else:
                self._store([new[k] for k in some], ids, size)
        found = self._ids([spelled[k] for k in rest])
        self._store([new[k] for k in rest], np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more entry at the end). Null is empty."""
        data, edges, first = cut(texts)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_pylist()
        if len(self.known) > self.most:
            self._forget()
        entries = [self.known.get(p) for p in different]
        new = [p for p, k in zip(different, entries, strict=True) if k is None]
        if new:
            self._learn(new)
            entries = [self.known[p] for p in different]
        entries = np.array(entries, np.int64)
        self.met[entries] += 1
        entry = entries[coded.indices.to_numpy()]
        size = self.size[entry]
        out = np.r_[0, np.cumsum(size)]
        ids = self.pool[np.arange(out[-1]) + np.repeat(self.at[entry] - out[:-1], size)]
        return ids, out[first]


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> WordIds:
    """One encoder for all batches of a worker process."""
    return WordIds(tokenizer)
