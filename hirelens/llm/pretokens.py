"""Vectorised pre-tokens of word_bpe_49k.json: code points in, hashes and places of pre-tokens out."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from hirelens.llm.common import _powers, mix, text_slices
from hirelens.llm.tokens import PLAIN, pre_tokenizer

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CLASS = np.array([_SPACE if chr(c) in "\t\n\r " else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x180)], np.uint8)
_S, _T, _M, _D, _R, _V, _L, _E, _MARK = (ord(c) for c in "stmdrvle'")


def _plain(text: str, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the pre-tokens of a lower-cased plain text; edges are the places where texts begin."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(code)
    kind = _CLASS[code]
    edge = np.zeros(n + 3, bool)
    edge[edges] = True
    first = edge[:n] | (kind != np.concatenate(([255], kind[:-1]))) | (kind == _NUMBER)
    # An apostrophe that is a whole run and has one of the short endings after it takes the ending along.
    tail = np.concatenate((code, np.zeros(3, np.uint32)))
    tail_first = np.concatenate((first, np.ones(3, bool)))
    at = np.flatnonzero((code == _MARK) & first)
    at = at[tail_first[at + 1] & ~edge[at + 1]]
    x, y = tail[at + 1], np.where(edge[at + 2], 0, tail[at + 2])
    one = np.isin(x, (_S, _T, _M, _D))
    two = ((x == _R) & (y == _E)) | ((x == _V) & (y == _E)) | ((x == _L) & (y == _L))
    for mask, size in ((one, 2), (two, 3)):
        first[at[mask] + 1] = False
        after = at[mask] + size
        after = after[after < n]
        first[after] = True
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, n))
    word = kind[begin] != _SPACE
    return begin[word], size[word]


def pre_token_slices(texts: pa.Array, tokenizer) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, Callable[[int], str]]]:
    """(first row, rows, hash, row and place of every pre-token, place to string) for slices of whole texts."""
    slow = pre_tokenizer(tokenizer)
    for lo, hi, data, offsets in text_slices(texts, 1 << 18):
        whole = data.tobytes().decode("utf-8")
        if PLAIN.fullmatch(whole) and "<|" not in whole:
            heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
            text = whole.lower()
            begin, size = _plain(text, heads)
            row = np.searchsorted(heads, begin, "right") - 1
        else:
            parts, begins, sizes, rows, at = [], [], [], [], 0
            for i in range(hi - lo):
                one = data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8")
                if PLAIN.fullmatch(one) and "<|" not in one:
                    one = one.lower()
                    b, s = _plain(one, np.zeros(1, np.int64)) if one else (np.zeros(0, np.int64),) * 2
                else:
                    tokens = slow(one)
                    one = "".join(tokens)
                    s = np.array([len(t) for t in tokens], np.int64)
                    b = np.cumsum(s) - s
                parts.append(one)
                begins.append(b + at)
                sizes.append(s)
                rows.append(np.full(len(b), i))
                at += len(one)
            text, begin, size, row = "".join(parts), np.concatenate(begins), np.concatenate(sizes), np.concatenate(rows)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        power, inverse = _powers(len(code) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(code + np.uint64(0x632BE59BD9B4E019)) * power[:len(code)], dtype=np.uint64)))
        hashes = mix((sums[begin + size] - sums[begin]) * inverse[begin]) if len(begin) else np.zeros(0, np.uint64)
        yield lo, hi - lo, hashes, row, begin, (lambda i, text=text, begin=begin, size=size: text[begin[i]:begin[i] + size[i]])


class PieceTable:
    """Ids of pre-tokens seen so far, by hash; a new pre-token is encoded once. Emptied beyond `most` entries."""

    def __init__(self, tokenizer, most: int = 1 << 20):
        self.tokenizer, self.most = tokenizer, most
        vocabulary = tokenizer.get_vocab()
        #: Whether an id ends a word.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each): all at once as words of one text, if its ids with a word end are as many as the words."""
        if not any("<|" in t for t in texts):
            ids = np.array(self.tokenizer.encode(" ".join(texts), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(texts) and len(ids) and ends[-1] == len(ids) - 1:
                return ids, np.diff(ends, prepend=-1)
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)

    def clear(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def places(self, keys: np.ndarray, string: Callable[[int], str], sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, size) in `ids` of sorted distinct keys; `sample` has a pre-token of each key."""
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(np.append(self.keys, np.uint64(0))[at] != keys) if len(self.keys) else np.arange(len(keys))
        new = np.union1d(new, np.flatnonzero(at == len(self.keys)))
        if len(new):
            texts = [string(sample[i]) for i in new]
            parts = [self._encode(texts[lo:lo + 256]) for lo in range(0, len(texts), 256)]
            flat, sizes = (np.concatenate(x) for x in zip(*parts))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
            self.ids[self.used:self.used + len(flat)] = flat
            first = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.first = np.insert(self.first, at[new], first)
            self.size = np.insert(self.size, at[new], sizes)
            at = np.searchsorted(self.keys, keys)
        return self.first[at], self.size[at]


def id_slices(texts: pa.Array, tokenizer, table: PieceTable) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, ids, offsets of the rows): the ids of whole texts as the tokenizer gives them."""
    for lo, rows, hashes, row, _, string in pre_token_slices(texts, tokenizer):
        keys, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        first, size = table.places(keys, string, sample) if len(keys) else (np.zeros(0, np.int64),) * 2
        first, size = first[inverse], size[inverse]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.repeat(first - (ends - size), size) + np.arange(total)
        per = np.bincount(row, size, rows).astype(np.int64)
        yield lo, rows, table.ids[gather], np.concatenate(([0], np.cumsum(per)))
