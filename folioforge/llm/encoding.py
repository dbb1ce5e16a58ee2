"""Whole-text encoding with the tokenizers library, one call for each distinct word.

Both vocabularies split a text at white space before they merge, so a text's ids
are those of its units in order. Units are hashed in bulk and each distinct one
is encoded once; texts whose units could depend on their neighbours (a unit that
ends in a rarer kind of white space) are encoded whole. Where the vocabulary sees
white space, plain units are encoded some hundreds at a time: the ids that begin
with the blank show where each of them begins.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa

from folioforge.llm.common import SAME, SPACES, distinct, units, utf8, words

#: Units remembered at most; beyond, all are forgotten.
CACHE = 1_200_000
#: Plain units that are encoded as one text, and bytes that make a unit other than plain.
JOINED = 256
_ODD = np.array([b >= 127 or b < 32 for b in range(256)])


#: The blank as byte-level vocabularies write it.
BLANK = chr(256 + 32)


class Rows:
    """A map from 64-bit keys to row numbers, as sorted arrays: the older keys and the newest ones."""

    def __init__(self):
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        for known, rows in self.parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[at] == keys, rows[at], out)
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Keys that are not known yet."""
        old, new = self.parts
        new = self._merged(new, (keys, rows))
        self.parts = [old, new] if 4 * len(new[0]) < len(old[0]) else [self._merged(old, new), (new[0][:0], new[1][:0])]

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, rows = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        order = np.argsort(keys, kind="stable")
        return keys[order], rows[order]


class UnitEncoder:
    """Encodes Arrow text columns; ``keep_space`` says whether the vocabulary sees white space."""

    def __init__(self, path: str, keep_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep_space = Tokenizer.from_file(path), keep_space
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of pieces that begin with the blank
        self.begins[[i for t, i in vocabulary.items() if t.startswith(BLANK)]] = True
        self.clear()

    def clear(self) -> None:
        self.rows, self.unsafe = Rows(), set()
        self.sizes, self.starts, self.pool, self.used, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint16), 0, 0

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each on its own, and how many each has."""
        got = self.ids(texts)
        return np.fromiter(itertools.chain.from_iterable(got), np.int64), np.fromiter(map(len, got), np.int64, len(got))

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like _units, for units of one blank and plain characters: encoded together and parted where a piece begins with the blank."""
        flat, _ = self._units(["".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)])
        first = np.flatnonzero(self.begins[flat])
        if len(first) != len(texts) or (len(first) and first[0]):
            return self._units(texts)  # a blank was joined with something: one by one
        return flat, np.diff(first, append=len(flat))

    def _learn(self, hashes: np.ndarray, texts: list[str], plain: np.ndarray) -> None:
        """``plain`` marks the units that may be encoded together; they come first."""
        n, k = len(texts), int(plain.sum())
        parts = [self._joined(texts[:k]), self._units(texts[k:])]
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(flat) and flat.max() > 65_535:
            raise ValueError("ids of more than 16 bits")
        while self.count + n > len(self.sizes):
            self.sizes, self.starts = np.concatenate((self.sizes, np.zeros_like(self.sizes))), np.concatenate((self.starts, np.zeros_like(self.starts)))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.sizes[self.count : self.count + n] = sizes
        self.starts[self.count : self.count + n] = self.used + np.cumsum(sizes) - sizes
        if self.keep_space:
            self.unsafe.update(self.count + k + i for i, t in enumerate(texts[k:]) if t[-1].isspace() and t[-1] not in " \t\n\x0b\x0c\r")
        self.rows.add(hashes, np.arange(self.count, self.count + n))
        self.used, self.count = self.used + len(flat), self.count + n

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids (16 bits), each text's followed by ``end``, and the n + 1 offsets of the texts."""
        data, at = utf8(column)
        starts, ends, hashes, bounds = units(data, at) if self.keep_space else words(data, at, SPACES, SAME)
        unique, first, inverse = distinct(hashes)
        if self.count + len(unique) > CACHE:
            self.clear()
        rows = self.rows.get(unique)
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            raw = data.tobytes()
            s, e = starts[first[fresh]], ends[first[fresh]]
            odd = np.concatenate(([0], np.cumsum(_ODD[data])))
            plain = np.zeros(len(fresh), bool)
            if self.keep_space:
                longer = np.flatnonzero(e - s > 1)
                plain[longer] = (data[s[longer]] == 32) & (data[s[longer] + 1] != 32) & (odd[e[longer]] == odd[s[longer]])
            order = np.argsort(~plain, kind="stable")
            fresh, s, e, plain = fresh[order], s[order], e[order], plain[order]
            before = self.count
            self._learn(unique[fresh], [raw[i:j].decode() for i, j in zip(s.tolist(), e.tolist(), strict=True)], plain)
            rows[fresh] = np.arange(before, self.count)
        where = rows[inverse]
        sizes = self.sizes[where]
        total = np.concatenate(([0], np.cumsum(sizes)))
        gathered = self.pool[np.repeat(self.starts[where] - total[:-1], sizes) + np.arange(total[-1])]
        offsets = total[bounds]
        n = len(at) - 1
        bad = np.flatnonzero(np.isin(rows, list(self.unsafe))) if self.unsafe else []
        if len(bad):
            hit = np.isin(inverse, bad)
            odd = np.flatnonzero(np.add.reduceat(np.append(hit, False), np.minimum(bounds[:-1], len(hit))) * (np.diff(bounds) > 0))
            parts = [gathered[offsets[i] : offsets[i + 1]] for i in range(n)]
            for i in odd.tolist():
                parts[i] = np.array(self.ids([column[i].as_py()])[0], np.uint16)
            gathered = np.concatenate(parts)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        finish = offsets[1:] + np.arange(n)
        out = np.full(len(gathered) + n, end, np.uint16)
        inner = np.ones(len(out), bool)
        inner[finish] = False
        out[inner] = gathered
        return out, np.concatenate(([0], finish + 1))


@functools.lru_cache(4)
def encoder(path: str, keep_space: bool) -> UnitEncoder:
    return UnitEncoder(path, keep_space)
