"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie of byte strings. Each node has a failure link, to the
node that is left once the longest pieces at its beginning are taken off, and
the number of pieces so taken. One pass over a word's bytes counts its pieces;
no piece is built and no byte is read twice. A word is looked up with a blank
before it, as the vocabulary's word-initial pieces have.

Every single byte is in the vocabulary, so each word can be split. Defined cases: null and empty texts
and texts of separators only have 0 words and 0 tokens; repeated rows are counted alike.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm.common import SAME, SPACES, distinct, per_text, slices, utf8, words

CACHE = 400_000


@functools.lru_cache(4)
def vocabulary(path: str) -> tuple[bytes, ...]:
    """Byte strings of a byte-level BPE vocabulary file; its printable stand-ins for bytes are undone."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data.get("added_tokens", [])}
    return tuple(sorted(bytes(byte[c] for c in t) for t in data["model"]["vocab"] if t not in special))


class Automaton:
    """step[(node << 8) | byte] is the trie; link and pops are the failure links and popped-piece counts."""

    def __init__(self, pieces: tuple[bytes, ...]):
        step, ends, parents = {}, [False], [(0, 0)]
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            at = 0
            for b in piece:
                at_next = step.get(at << 8 | b)
                if at_next is None:
                    at_next = step[at << 8 | b] = len(ends)
                    ends.append(False)
                    parents.append((at, b))
                at = at_next
            ends[at] = True
        depth = [0] * len(ends)
        for v in range(1, len(ends)):  # a parent always comes before its children
            depth[v] = depth[parents[v][0]] + 1
        self.step, self.link, self.pops = step, [0] * len(ends), [0] * len(ends)
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[v]:
                self.pops[v] = 1  # the whole string is a piece: take it, nothing is left
                continue
            u, b = parents[v]
            z, n = self.link[u], self.pops[u]
            while (to := step.get(z << 8 | b)) is None:
                n += self.pops[z]
                z = self.link[z]
            self.link[v], self.pops[v] = to, n

    def count(self, word: bytes) -> int:
        step, link, pops, u, n = self.step.get, self.link, self.pops, 0, 0
        for b in word:
            while (to := step(u << 8 | b)) is None:
                n += pops[u]
                u = link[u]
            u = to
        while u:
            n += pops[u]
            u = link[u]
        return n


@functools.lru_cache(2)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every text; ``path`` is a byte-level BPE vocabulary file that all nodes have."""

    def run(batches):
        machine, known = automaton(path), {}
        for b in slices(batches):
            data, at = utf8(b.column("text"))
            starts, ends, hashes, bounds = words(data, at, SPACES, SAME)
            unique, first, inverse = distinct(hashes)
            if len(known) > CACHE:
                known.clear()
            counts = np.zeros(len(unique), np.int64)
            raw = data.tobytes()
            for i, (h, s, e) in enumerate(zip(unique.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True)):
                n = known.get(h)
                if n is None:
                    n = known[h] = machine.count(b" " + raw[s:e])
                counts[i] = n
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(bounds)), pa.array(per_text(counts[inverse], bounds))], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
