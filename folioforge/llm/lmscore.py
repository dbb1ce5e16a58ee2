"""Language-model scoring with a weighted backoff automaton.

The model is a trigram automaton. Its states are the histories that training has
seen, of two tokens, of one, and the root; a text begins in the state START. With
c the training counts, h a history and h' the same without its first token,

    arc       (c(h, w) + K * P(w | h')) / (c(h) + K)     for each n-gram that was seen
    failure   K / (c(h) + K), to the state h'
    root      P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))  for every token

so each state's probabilities sum to 1. An arc leads to the longest seen history
that the text then ends in. One traversal, left to right, carries the state: it
takes the token's arc, or follows failure arcs until a state has one, and adds up
the logarithms. The texts of a block walk side by side.

K is the discount, one for each order, from the training part: the mass that all
failure arcs get along the training text is that of the n-grams seen once, which is
what leaving one occurrence out would leave unseen.

The automaton grows with the corpus, so no task and no driver holds it whole.
Documents are dealt into blocks by row number. Every block asks for the counts of
its own distinct n-grams, in key ranges; each range adds up what the blocks counted
and answers each block with the totals of exactly those keys. A block then builds
the part of the automaton that its texts can reach. Keys are hashes: 64 bits of a
token, so that token counts are exact up to 2^-64; of longer n-grams as many as give
a key another one's count with a chance of 2^-16 or so.

Defined cases: null text is empty (one end token); repeated rows count each time
they occur and are dealt apart; without training texts all tokens are unknown; a
null doc_id is held out as the empty id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import mix, utf8, words

#: Stand for the start and the end of a text; no word hashes to them but by chance of 2^-64.
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
#: Text of a block of documents and of a range of keys; their numbers are apart, and rows are blocks x ranges.
BLOCK_CHARS, RANGE_CHARS = 8_000_000, 24_000_000
#: Values of K at which ranges tell the mass of the failure arcs.
GRID = 2.0 ** np.arange(-3, 14)
ORDERS = (1, 2, 3)


def streams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's words and then END; and the n + 1 offsets."""
    data, at = utf8(table.column("text"))
    _, _, hashes, bounds = words(data, at)
    n = len(bounds) - 1
    ends = bounds[1:] + np.arange(n)  # where each END stands
    tokens = np.empty(len(hashes) + n, np.uint64)
    real = np.ones(len(tokens), bool)
    real[ends] = False
    tokens[real], tokens[ends] = hashes, END
    return tokens, np.concatenate(([0], ends + 1))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def grams(tokens: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the token and of the bigram that end at each position, of the trigrams, and the positions where these end.

    A text's first bigram begins with START; a trigram ends at every position but the first.
    """
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = START
    two = _joined(before, tokens)
    later = np.ones(len(tokens), bool)
    later[starts[:-1]] = False
    spots = np.flatnonzero(later)
    short = np.uint64(64 - bits)
    return tokens, two >> short, _joined(two[spots - 1], tokens[spots]) >> short, spots


# --- what blocks and ranges send each other


def _deal(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Bounds of each key range in sorted keys."""
    edges = np.array([(i << bits) // ranges for i in range(1, ranges)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences; the two upper planes, which are nearly constant, compressed."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    first, steps[0] = int(steps[0]), 0
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    low = max(0, width - 2)
    return first.to_bytes(8, "little") + bytes([width]) + len(keys).to_bytes(8, "little") + planes[:low].tobytes() + zlib.compress(planes[low:].tobytes(), 1)


def unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    first, width, n = int.from_bytes(raw[:8], "little"), raw[8], int.from_bytes(raw[9:17], "little")
    low = max(0, width - 2)
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :low] = np.frombuffer(raw, np.uint8, low * n, 17).reshape(low, n).T
    planes[:, low:width] = np.frombuffer(zlib.decompress(raw[17 + low * n :]), np.uint8).reshape(width - low, n).T
    steps = planes.reshape(-1).view("<u8").astype(np.uint64)
    steps[0] = first
    return np.cumsum(steps, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the narrowest whole numbers that hold them."""
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << (8 * w))
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def _training_counts(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each occurs in training."""
    u, n = np.unique(keys, return_counts=True)
    rest = keys[~training]
    if len(rest):
        v, m = np.unique(rest, return_counts=True)
        n[np.searchsorted(u, v)] -= m
    return u, n


_ASK = {"bucket": pa.int32(), "block": pa.int32(), **{f"{x}{i}": pa.binary() for i in ORDERS for x in "kc"}}
_TOLD = {"block": pa.int32(), "bucket": pa.int32(), **{f"t{i}": pa.binary() for i in ORDERS}, "stats": pa.binary()}
_DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}


def _table(rows: list[tuple], schema: dict) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.values())], names=list(schema))


def _ddl(schema: dict) -> str:
    return ", ".join(f"{k} {_DDL[t]}" for k, t in schema.items())


def ask(ranges: int, bits: int):
    """Per block and key range: the block's distinct n-grams with their training counts."""

    def one(key, table):
        tokens, starts = streams(table)
        training = np.repeat(table.column("training").to_numpy(), np.diff(starts))
        *keys, spots = grams(tokens, starts, bits)
        columns = []
        for order in ORDERS:
            u, n = _training_counts(keys[order - 1], training[spots] if order == 3 else training)
            b = _deal(u, ranges, 64 if order == 1 else bits)
            columns.append([pack_keys(u[b[i] : b[i + 1]]) for i in range(ranges)])
            columns.append([pack_counts(n[b[i] : b[i + 1]]) for i in range(ranges)])
        return _table(list(zip(range(ranges), [key[0].as_py()] * ranges, *columns, strict=True)), _ASK)

    return one


def failure_mass(c: np.ndarray) -> np.ndarray:
    """For each K of GRID: the mass that histories of these counts give to their failure arcs along the training text."""
    u, n = np.unique(c[c > 0], return_counts=True)
    return (n * u * GRID[:, None] / (u + GRID[:, None])).sum(axis=1)


def answer():
    """Per key range: the total of every key, back to each block in the order of its own sorted keys.

    ``stats`` has the range's N and V, the numbers of bigrams and trigrams seen once, and its failure masses.
    """

    def one(key, table):
        blocks, told, numbers, masses = table.column("block").to_pylist(), [], [], []
        for order in ORDERS:
            keys = [unpack_keys(k) for k in table.column(f"k{order}").to_pylist()]
            counts = np.concatenate([unpack_counts(c) for c in table.column(f"c{order}").to_pylist()])
            u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, weights=counts, minlength=len(u)).astype(np.int64)  # exact below 2^53
            cuts = np.cumsum([0, *map(len, keys)])
            told.append([pack_counts(total[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            numbers += [total.sum(), (total > 0).sum()] if order == 1 else [(total == 1).sum()]
            if order < 3:
                masses.append(failure_mass(total))
        stats = np.concatenate((numbers, *masses)).astype("<f8").tobytes()
        return _table(list(zip(blocks, [key[0].as_py()] * len(blocks), *told, [stats] * len(blocks), strict=True)), _TOLD)

    return one


# --- the automaton


def strength(once: float, mass: np.ndarray) -> float:
    """K at which the failure arcs' mass is ``once``, between the points of GRID by logarithms."""
    if once <= mass[0] or not mass[-1]:
        return float(GRID[0])
    if once >= mass[-1]:
        return float(GRID[-1])
    i = int(np.searchsorted(mass, once))
    part = np.log(once / mass[i - 1]) / np.log(mass[i] / mass[i - 1])
    return float(GRID[i - 1] * (GRID[i] / GRID[i - 1]) ** part)


class Automaton:
    """The part of the automaton that the texts of a block can reach.

    State 0 is the root. ``arcs`` are the sorted keys state * tokens + token of
    all other states' arcs, with ``weight`` and ``to``; the root has ``root`` and
    ``root_to`` by token; ``fail`` and ``fail_weight`` go by state.
    """

    def __init__(self, end: int, c1: np.ndarray, bigrams: tuple[np.ndarray, np.ndarray, np.ndarray], trigrams: tuple[np.ndarray, np.ndarray, np.ndarray], n: float, v: float, k2: float, k3: float):
        """c1 by token; bigrams (first token, or len(c1) for START, second token, count); trigrams (bigram it begins with, bigram it ends with, count)."""
        size = self.size = len(c1)
        p1 = (c1 + 0.1) / (n + 0.1 * (v + 1))
        follows = np.append(c1, c1[end] if size else 0).astype(np.float64)  # how often each token, and START, has another one after it
        follows[end] = 0
        one = np.where(follows > 0, np.cumsum(follows > 0), 0)
        first, second, c2 = bigrams
        c2 = np.minimum(c2, follows[first])
        is_state = (c2 > 0) & (second != end)
        two = np.where(is_state, one.max(initial=0) + np.cumsum(is_state), 0)
        p2 = (c2 + k2 * p1[second]) / (follows[first] + k2)
        begin, last, c3 = trigrams
        c3 = np.minimum(c3, np.minimum(c2[begin], c2[last]))
        p3 = (c3 + k3 * p2[last]) / (c2[begin] + k3)

        seen2, seen3 = c2 > 0, c3 > 0
        keys = np.concatenate((one[first[seen2]] * size + second[seen2], two[begin[seen3]] * size + second[last[seen3]]))
        order = np.argsort(keys)
        self.arcs = np.append(keys[order], np.iinfo(np.int64).max)  # a last key that nothing asks for
        self.weight = np.log10(np.concatenate((p2[seen2], p3[seen3])))[order]
        self.to = np.concatenate((two[seen2], two[last[seen3]]))[order]
        self.root, self.root_to, self.start = np.log10(p1), one[:-1], int(one[-1])
        states = int(max(one.max(initial=0), two.max(initial=0))) + 1
        self.fail, self.fail_weight = np.zeros(states, np.int64), np.zeros(states)
        self.fail_weight[one[one > 0]] = np.log10(k2 / (follows[one > 0] + k2))
        self.fail[two[is_state]] = one[second[is_state]]
        self.fail_weight[two[is_state]] = np.log10(k3 / (c2[is_state] + k3))

    def walk(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log10 probability of each text, a run of token ids; one step of all texts that are as long, then the next."""
        length = np.diff(starts)
        order = np.argsort(-length, kind="stable")
        at, falling = starts[:-1][order], -length[order]
        state, total = np.full(len(order), self.start), np.zeros(len(order))
        for j in range(-int(falling[0]) if len(falling) else 0):
            n = int(np.searchsorted(falling, -j))
            token, s, gain, came = ids[at[:n] + j], state[:n], total[:n], np.full(n, -1)
            here = np.flatnonzero(s)
            while len(here):
                key = s[here] * self.size + token[here]
                spot = np.searchsorted(self.arcs, key)
                hit = self.arcs[spot] == key
                taken, spot = here[hit], spot[hit]
                gain[taken] += self.weight[spot]
                came[taken] = self.to[spot]
                here = here[~hit]
                gain[here] += self.fail_weight[s[here]]
                s[here] = self.fail[s[here]]
                here = here[s[here] > 0]
            here = np.flatnonzero(came < 0)
            gain[here] += self.root[token[here]]
            came[here] = self.root_to[token[here]]
            state[:n] = came
        out = np.empty(len(order))
        out[order] = total
        return out


COLUMNS = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def traverse(bits: int):
    """Per block: its texts, and the totals of its keys, to one row for each text."""

    def one(key, table, told):
        if not table.num_rows:
            return _table([], COLUMNS)
        told = told.sort_by("bucket")
        counts = [np.concatenate([unpack_counts(t) for t in told.column(f"t{i}").to_pylist()]) for i in ORDERS]
        stats = np.sum([np.frombuffer(s, "<f8") for s in told.column("stats").to_pylist()], axis=0)
        (n, v, once2, once3), masses = stats[:4], stats[4:].reshape(2, len(GRID))
        tokens, starts = streams(table)
        _, two, three, spots = grams(tokens, starts, bits)
        single, ids = np.unique(tokens, return_inverse=True)
        _, first2, inverse2 = np.unique(two, return_index=True, return_inverse=True)
        _, first3 = np.unique(three, return_index=True)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[starts[:-1]] = len(single)
        end = int(np.searchsorted(single, END))
        machine = Automaton(end, counts[0], (before[first2], ids[first2], counts[1]), (inverse2[spots[first3] - 1], inverse2[spots[first3]], counts[2]), n, v, strength(once2, masses[0]), strength(once3, masses[1]))
        base, known = machine.root[ids], (counts[0] > 0)[ids]
        sizes = np.diff(starts)
        out = {
            "doc_id": table.column("doc_id"), "held_out": pa.array(~table.column("training").to_numpy()), "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.add.reduceat(known.astype(np.int64), starts[:-1])), "train_tokens": pa.array(np.full(len(sizes), int(n))),
            "base_score": pa.array(np.add.reduceat(base, starts[:-1])), "score": pa.array(machine.walk(ids, starts)),
        }
        return pa.Table.from_arrays([out[k].cast(t) for k, t in COLUMNS.items()], names=list(COLUMNS))

    return one


def score(docs: DataFrame, training: str, block_chars: int = BLOCK_CHARS, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Score every text; ``training`` is the SQL condition of the rows to learn from (null counts as false).

    Rows are dealt to blocks twice, by their numbers in the input. These must be the same when a part is read again, as
    they are for files: write a frame that comes from a shuffle before it is scored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.expr(training), F.lit(False)).alias("training"))
    size = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0
    blocks, ranges = max(1, -(-size // block_chars)), max(1, -(-size // range_chars))
    bits = min(64, 16 + int(size).bit_length())
    # by row number, the same whenever a split of the input is read, so that repeated rows part
    number = F.xxhash64(F.monotonically_increasing_id())
    dealt = rows.withColumn("block", F.pmod(number, F.lit(blocks)).cast("int")).repartition(blocks, "block")
    told = dealt.groupBy("block").applyInArrow(ask(ranges, bits), _ddl(_ASK)).groupBy("bucket").applyInArrow(answer(), _ddl(_TOLD))
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(traverse(bits), _ddl(COLUMNS))
