"""Lempel-Ziv phrase fingerprints.

A text is parsed into LZ78 phrases: each is the longest phrase met before plus
one code point. The set of phrases is hashed, and the ``SIZE`` smallest hashes
are the fingerprint (a bottom-k minimum-hash signature). Texts that compress
each other share phrases, so the likeness of two fingerprints, the share of
common hashes among the smallest of the union, estimates the Jaccard index of
their phrase sets; sets of at most ``SIZE`` phrases are compared exactly.

Defined cases: null text is empty; two empty texts have likeness 1, an empty and
a non-empty one 0. Repeated rows are rows of their own; rows of the same doc_id
are ordered by a hash of their text; null ids come last in descending order.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import BASE, mix, slices

SIZE = 128
PART_CHARS = 8_000_000
#: Ranges at most, each of them read as a stream, and rows sampled for the bounds of a range: both bound what the driver holds.
MOST_PARTS, SAMPLED = 8192, 64


def codes(text: str) -> tuple[bytes | array, int]:
    """The code points of a text, and the number of bits that hold any of them."""
    try:
        return text.encode("latin-1"), 8
    except UnicodeEncodeError:
        return array("I", text.encode(f"utf-32-{sys.byteorder[0]}e", "surrogatepass")), 21


def walk(points: bytes | array, bits: int, trie: dict[int, int], node: int = 0) -> int:
    """Go on with an LZ78 parse that stands at ``node`` of its trie of phrases; where it stands after the last code point.

    The n-th phrase is the node n << bits, the root 0; the trie has node + code
    point -> node, in the order of the phrases. A phrase is one dictionary look-up
    a code point, however long it is.
    """
    put, fresh, step = trie.setdefault, (len(trie) + 1) << bits, 1 << bits
    for c in points:
        node = put(node + c, fresh)
        if node is fresh:  # no such phrase so far
            fresh += step
            node = 0
    return node


def edges(trie: dict[int, int]) -> np.ndarray:
    return np.fromiter(trie, np.uint64, len(trie))


def spelled(tries: list[np.ndarray], bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and hashes of the phrases of many tries, given by their edges, and the n + 1 offsets of the tries.

    Phrases are spelled from the root, those of one length at a time.
    """
    count = np.array([len(t) for t in tries], np.int64)
    at = np.concatenate(([0], np.cumsum(count)))
    edge = np.concatenate(tries) if tries else np.zeros(0, np.uint64)
    shift = np.repeat(np.array(bits, np.uint64), count)
    before = (edge >> shift).astype(np.int64) - 1  # the phrase that one code point makes this one, none for -1
    gain = (edge & ((np.uint64(1) << shift) - np.uint64(1))) + np.uint64(1)
    begins = before < 0
    before += np.repeat(at[:-1], count)
    length, total = np.zeros(len(edge), np.int64), np.zeros(len(edge), np.uint64)
    now, rest = np.flatnonzero(begins), np.flatnonzero(~begins)
    n, power = 1, np.ones(1, np.uint64)
    length[now], total[now] = n, gain[now]
    while len(rest):
        n, power = n + 1, power * BASE
        stem = before[rest]
        ready = length[stem] > 0
        now, stem, rest = rest[ready], stem[ready], rest[~ready]
        length[now], total[now] = n, total[stem] + gain[now] * power
    return length, mix(total ^ length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), at


def phrases(text: str) -> tuple[list[int], dict[int, int]]:
    """Ends of the LZ78 phrases of a text, and their trie."""
    trie: dict[int, int] = {}
    points, bits = codes(text)
    rest = walk(points, bits, trie)
    ends = np.cumsum(spelled([edges(trie)], [bits])[0]).tolist()
    return ends + [len(text)] * (rest > 0), trie


def ascending(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, sorted; np.unique hashes them, which takes several times as long."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def signatures(tries: list[np.ndarray], bits: list[int]) -> list[np.ndarray]:
    """For each trie the smallest hashes of its phrases, ascending."""
    _, hashes, at = spelled(tries, bits)
    small, count = hashes >> np.uint64(32), np.diff(at)
    owner = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    # few of the hashes can be among the smallest: drop the rest before sorting, except where that leaves too few
    least = small < np.repeat(((2 * SIZE << 32) // np.maximum(count, 1)).astype(np.uint64), count)
    keys = owner << np.uint64(32) | small
    kept = ascending(keys[least])
    have = np.bincount((kept >> np.uint64(32)).astype(np.int64), minlength=len(count))
    few = have < np.minimum(count, SIZE)
    if few.any():
        kept = ascending(keys[least | np.repeat(few, count)])
    begin = np.searchsorted(kept, np.arange(len(count) + 1, dtype=np.uint64) << np.uint64(32))
    values = (kept & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [values[lo : min(lo + SIZE, hi)] for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def likenesses(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Estimated Jaccard indexes of pairs of phrase sets from their signatures."""
    both = np.full((len(a), 2 * SIZE), 1 << 32, np.int64)
    for row, x, y in zip(both, a, b, strict=True):
        row[: len(x)] = x
        row[SIZE : SIZE + len(y)] = y
    both.sort(axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    rank = np.cumsum(~again, axis=1)  # in the union, from 1
    within = (both < 1 << 32) & (rank <= SIZE)
    union = (within & ~again).sum(axis=1)
    return np.where(union > 0, (within & again).sum(axis=1) / np.maximum(union, 1), 1.0)


def packed(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def fingerprint(text: str | None) -> str:
    return packed(signatures([edges(phrases(text or "")[1])], [codes(text or "")[1]])[0])


def compare(a: str, b: str) -> float:
    return float(likenesses(*([np.frombuffer(base64.b64decode(x), "<u4")] for x in (a, b)))[0])


def _bytes(*keys: np.ndarray) -> np.ndarray:
    """Strings of 24 bytes in the order of descending ids, then ascending hashes, then ascending row numbers."""
    ids, hashes, rows = (k.view(np.uint64) ^ np.uint64(1 << 63) for k in keys)
    return np.ascontiguousarray(np.stack((~ids, hashes, rows), axis=1).astype(">u8")).view("S24").ravel()


def _keys(batch) -> np.ndarray:
    return _bytes(*(batch.column(c).to_numpy() for c in ("_id", "_h", "_row")))


def _number(cuts: np.ndarray):
    def run(batches):
        for b in batches:
            keys = _keys(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(cuts, keys, "right").astype(np.int32))], names=[*b.schema.names, "part"])

    return run


def with_next(docs: DataFrame, part_chars: int = PART_CHARS) -> tuple[DataFrame, int]:
    """Deal (doc_id, text) into ranges of descending doc_id, each followed by the first row of the next range.

    Rows come in order within a range; ``guest`` marks the row of the other range.
    Only one row of a range moves twice. Rows of the same id and text are told apart by their number in the input, so that a crowd
    of them (null ids, for instance) goes to several ranges as well; which of them goes where is of no account.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_h", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    size = rows.agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.count("*").alias("n")).first()
    parts = min(MOST_PARTS, max(1, -(-(size.bytes or 0) // part_chars)))
    cuts = _bytes(*[np.zeros(0, np.int64)] * 3)
    if parts > 1:  # bounds from a sample of the keys; every row is dealt by them
        share = min(1.0, SAMPLED * parts / size.n)
        drawn = rows.select("_id", "_h", "_row").where(F.pmod(F.xxhash64("_id", "_h", "_row"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).toArrow()
        keys = np.sort(_keys(drawn))
        cuts = np.unique(keys[[len(keys) * i // parts for i in range(1, parts)]]) if len(keys) else cuts
    dealt = rows.mapInArrow(_number(cuts), "doc_id long, text string, _id long, _h long, _row long, part int").drop("_row")
    # the first key of each range is the guest of the range before it, and of the last one for the first
    first = F.min(F.struct((-1 - F.col("_id")).alias("down"), F.col("_h").alias("h"))).alias("first")
    tops = rows.select("_id", "_h", "_row").mapInArrow(_number(cuts), "_id long, _h long, _row long, part int").groupBy("part").agg(first).select("part", (-1 - F.col("first.down")).alias("_id"), F.col("first.h").alias("_h"))
    order = Window.orderBy("part")  # MOST_PARTS rows
    last = F.max("part").over(Window.partitionBy())
    guests = F.broadcast(tops.withColumn("to", F.coalesce(F.lag("part").over(order), last)).select("_id", "_h", "to"))
    moved = rows.join(guests, ["_id", "_h"])
    one = F.min(F.struct("text", "doc_id", "_id", "_h")).alias("m")  # one of a crowd leaves each task
    moved = moved.groupBy("to").agg(one).select("m.doc_id", "m.text", "m._id", "m._h", F.col("to").alias("part"), F.lit(True).alias("guest"))
    both = dealt.withColumn("guest", F.lit(False)).unionByName(moved)
    return both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "guest", F.desc("_id"), "_h", "text"), len(cuts) + 1


COLUMNS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _parsed(text: str, after: str | None, own: bool) -> tuple[list[np.ndarray], int]:
    """Edges of the tries of a text (if ``own``) and of its edited form (if a text comes after it); the half that both keep is parsed once."""
    kept = len(text) - len(text) // 2
    points, bits = codes(text + (after or "")[: len(text) // 2])
    trie: dict[int, int] = {}
    node = walk(points[:kept], bits, trie)
    out = []
    for wanted, tail, known in ((own, points[kept : len(text)], trie.copy()), (after is not None, points[len(text) :], trie)):
        if wanted:
            walk(tail, bits, known, node)
            out.append(edges(known))
    return out, bits


def _compared(batches):
    """Rows of ``with_next`` to results. The last row of a slice waits, with its signature, for the first of the next slice."""
    held, known = [], []
    for b in slices(batches):
        rows = held + list(zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "text", "guest")), strict=True))
        after = [n[2] if n[0] == r[0] and not r[3] else None for r, n in zip(rows, rows[1:], strict=False)] + [None]
        tries, bits = [], []
        for i, (row, text) in enumerate(zip(rows, after, strict=True)):
            found, width = _parsed(row[2], text, i >= len(known))
            tries += found
            bits += [width] * len(found)
        found = iter(signatures(tries, bits))
        own, edited = [], []
        for i, text in enumerate(after):
            own.append(known[i] if i < len(known) else next(found))
            edited.append(None if text is None else next(found))
        at = [i for i, text in enumerate(after) if text is not None]
        held, known = rows[-1:], own[-1:]
        texts = [rows[i][2] for i in at]
        digests = [hashlib.sha256((t[: len(t) - len(t) // 2] + after[i][: len(t) // 2]).encode("utf-8", "surrogatepass")).hexdigest() for i, t in zip(at, texts, strict=True)]
        mine, other = [own[i] for i in at], [edited[i] for i in at]
        values = ([rows[i][1] for i in at], [len(t) for t in texts], digests, [packed(x) for x in mine], [packed(x) for x in other], likenesses(mine, other), likenesses(mine, [own[i + 1] for i in at]))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, COLUMNS.values(), strict=True)], names=list(COLUMNS))


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, its edited form and the next text, and compare them; see the module's head for the cases."""
    dealt, _ = with_next(docs.select("doc_id", "text"))
    return dealt.mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
