"""Token ids of whole texts, from the vocabulary file of a public tokenizer.

Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. The
tokenizers used here never join characters across ASCII white space, so a
text's ids are those of its words, and a worker encodes a word once.
"""

from __future__ import annotations

import os
import re

import numpy as np
import regex
import xxhash

#: Words that a worker remembers before it starts afresh (some 100 MB).
MEMORY = 1 << 20
#: Bytes of text that are worked on at once, give or take a word: arrays of some 40 bytes a byte stay under 100 MB.
SLICE = 2 << 20
#: Bytes of a word that its key holds as they are, in words of eight.
LANES = 3
_FIRST = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1 for letters, 2 for signs that every pre-tokenizer here parts from letters (so "word," is "word" and ",").
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*b",.!?;:*$%&#"]] = 2
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Words of plain letters and signs, for which the number of pieces can be told without the tokenizer.
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\xbf])+")
_workers: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for the vocabulary file at ``path``, kept between tasks."""
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def _table() -> dict[str, np.ndarray]:
    return {"key": np.zeros(0, np.uint64), "exact": np.zeros((0, LANES), np.uint64), "start": np.zeros(0, np.int64), "count": np.zeros(0, np.int64)}


def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.argsort(keys := np.concatenate([a["key"], b["key"]]), kind="stable")
    return {"key": keys[order]} | {k: np.concatenate([a[k], b[k]])[order] for k in ("exact", "start", "count")}


def _mixed(exact: np.ndarray) -> np.ndarray:
    """64 bits of each row of ``exact``, to sort and search by; rows that agree in them are told apart by ``exact``."""
    h = np.zeros(len(exact), np.uint64)
    for lane, m in zip(exact.T, _MIX, strict=True):
        h = (h ^ lane) * m
        h ^= h >> np.uint64(31)
    return h


class WordEncoder:
    """Encodes batches of texts by way of a table from words to ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        last = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[last] = True
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self._forget()

    def _forget(self) -> None:
        self.old, self.new = _table(), _table()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and where each begins among them. data: the texts' UTF-8 bytes, end to end, parted at ``offsets``.

        Long batches and texts are cut at white space, so working arrays don't grow with them.
        """
        ids, before, at = [], np.zeros(len(offsets), np.int64), 0
        total = 0
        while at < len(data) or not ids:
            end = len(data)
            if end - at > SLICE:
                space = np.flatnonzero(_SPACE[data[at + SLICE : at + 2 * SLICE]])
                end = at + SLICE + int(space[0]) if len(space) else self._gap(data, at + 2 * SLICE)
            inside = np.searchsorted(offsets, [at, end], side="left")
            inside[1] = len(offsets) if end == len(data) else inside[1]
            got, starts = self._encode(data[at:end], offsets[inside[0] : inside[1]] - at)
            before[inside[0] : inside[1]] = total + starts
            ids.append(got)
            total += len(got)
            at = end
            if end == len(data):
                break
        return ids[0] if len(ids) == 1 else np.concatenate(ids), before

    @staticmethod
    def _gap(data: np.ndarray, at: int) -> int:
        """The next white space from ``at`` on: only a word longer than a slice gets here."""
        while at < len(data):
            space = np.flatnonzero(_SPACE[data[at : at + SLICE]])
            if len(space):
                return at + int(space[0])
            at += SLICE
        return len(data)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for a slice; offsets: those that lie in it."""
        text, low = data, data
        if len(data):
            # Lower case changes nothing that the tokenizer wouldn't, except beside marks that combine and in its own special tokens.
            low = _LOWER[data]
            odd = np.flatnonzero((data >= 0xCC) | ((data == 60) & (np.append(data[1:], 0) == 124)))
            parts = np.concatenate([[0], offsets, [len(data)]])
            for t in np.unique(np.searchsorted(parts, odd, side="right") - 1).tolist():
                low[parts[t] : parts[t + 1]] = data[parts[t] : parts[t + 1]]
            text = low
        word = ~_SPACE[text]
        first, last = word.copy(), word.copy()
        kind = _KIND[text]
        parted = (kind[1:] + kind[:-1] == 3) & (kind[1:] > 0) & (kind[:-1] > 0)
        first[1:] &= ~word[:-1] | parted
        last[:-1] &= ~word[1:] | parted
        inner = offsets[(offsets > 0) & (offsets < len(text))]
        first[inner] |= word[inner]
        last[inner - 1] |= word[inner - 1]
        a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
        start, n = self._find(text, a, z)
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(a, offsets)]

    @staticmethod
    def _exact(text: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """``LANES`` numbers of each word: its own bytes (255 after its end), or for longer words their 128-bit XXH3 and length (after 254). UTF-8 has neither byte, so none is taken for another."""
        n = z - a
        padded = np.concatenate([text, np.zeros(8 * LANES, np.uint8)])
        eight = np.ndarray(len(text) + 8 * LANES - 7, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
        held = [_FIRST[np.clip(n - 8 * k, 0, 8)] for k in range(LANES)]
        lanes = np.stack([eight[a + 8 * k] & m | ~m for k, m in enumerate(held)], axis=1)
        for i in np.flatnonzero(n > 8 * LANES).tolist():
            low, high = divmod(xxhash.xxh3_128_intdigest(text[a[i] : z[i]]), 2**64)
            lanes[i] = low, high, (0xFE << 56) | int(n[i])
        return lanes

    def _find(self, text: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in the pool, and how many they are; words not met before are learned."""
        each = self._exact(text, a, z)
        distinct, some, back = np.unique(_mixed(each), return_index=True, return_inverse=True)
        exact = each[some]
        start, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)

        def look(table: dict[str, np.ndarray]) -> None:
            if len(table["key"]):
                at = np.minimum(np.searchsorted(table["key"], distinct), len(table["key"]) - 1)
                hit = (table["exact"][at] == exact).all(axis=1)
                start[hit], count[hit] = table["start"][at[hit]], table["count"][at[hit]]

        look(self.old)
        look(self.new)
        unknown = np.flatnonzero(start < 0)
        if len(unknown):
            if len(self.old["key"]) + len(self.new["key"]) + len(unknown) > MEMORY:
                self._forget()
                unknown = np.arange(len(distinct))
            begin, n = self._learn([text[a[i] : z[i]].tobytes() for i in some[unknown].tolist()])
            start[unknown], count[unknown] = begin, n
            self.new = _merged(self.new, {"key": distinct[unknown], "exact": exact[unknown], "start": begin, "count": n})
            if len(self.new["key"]) > 1 << 16:
                self.old, self.new = _merged(self.old, self.new), _table()
        start, count = start[back], count[back]
        other = np.flatnonzero((exact[back] != each).any(axis=1))
        if len(other):  # words whose 64 bits agree with another's: rare enough to encode where they stand
            start[other], count[other] = self._learn([text[a[i] : z[i]].tobytes() for i in other.tolist()])
        return start, count

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of ``words`` into the pool: where each begins, and how many they are."""
        plain, pieces, rest = [], [], []
        for i, w in enumerate(words):
            if _LETTERS.fullmatch(w):
                plain.append(i)
                pieces.append(1)
            elif _PLAIN.fullmatch(w) and b"<|" not in w:
                plain.append(i)
                pieces.append(len(self.pieces.findall(w.decode().lower())))
            else:
                rest.append(i)
        order, ids, count = [], [], []
        lines = [plain[s : s + 64] for s in range(0, len(plain), 64)]
        for j, (part, got) in enumerate(zip(lines, self._ids([b" ".join([words[i] for i in part]) for part in lines]), strict=True)):
            k = np.array(pieces[64 * j : 64 * j + 64])
            stops = np.concatenate([[0], np.flatnonzero(self.ends[got]) + 1])
            if len(stops) == k.sum() + 1:
                order += part
                ids.append(got)
                count.append(np.diff(stops[np.concatenate([[0], np.cumsum(k)])]))
            else:  # the pieces weren't foreseen right: one by one
                rest += part
        for i, got in zip(rest, self._ids([words[i] for i in rest]), strict=True):
            order.append(i)
            ids.append(got)
            count.append(np.array([len(got)]))
        more, n = np.concatenate(ids), np.concatenate(count)
        if self.used + len(more) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(more) + self.used, np.uint32)])
        self.pool[self.used : self.used + len(more)] = more
        start, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[order], count[order] = self.used + np.cumsum(n) - n, n
        self.used += len(more)
        return start, count

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]
