"""Hierarchical multi-length packing.

A document's ids, with its end id, are cut into full windows of the largest
context size; the rest goes to the smallest context tier that holds it. Tiers
are packed from the longest to the shortest: a rest opens a window, the best
fitting whole rests of this and shorter tiers fill its gap, and a piece cut from
a shorter one closes it. What is left over at the end of a pool is cut into
powers of two. So every sequence is as long as a power of two and none is padded.

A task packs its own documents, in pools of bounded size, so no text is shuffled.
The sequences of one length are then numbered over all tasks and dealt to step
groups: as few as hold them with ``STEP_TOKENS`` each at most, and no group has more
than one sequence more than another.

Defined cases: null text is empty (one end id); repeated rows are documents of
their own; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import slices, small_batches, written
from folioforge.llm.encoding import encoder

TIERS = (2048, 1024, 512, 256)
POOL_TOKENS = 2_000_000
STEP_TOKENS = 16_384

#: ``nth`` numbers the sequences of a length that a task has made.
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, task int, nth long"
_TYPES = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()]
Piece = tuple[int, int, int]  # document, first id, number of ids


def fill(size: int, window: list[Piece], rests: list[tuple[int, int, int]]) -> list[Piece]:
    """Fill a window up to ``size`` from rests (length, document, start), sorted: best fits first, then one cut."""
    gap = size - sum(p[2] for p in window)
    while gap and rests:
        i = bisect_right(rests, (gap, 1 << 60, 0)) - 1
        if i >= 0:
            n, doc, start = rests.pop(i)
            window.append((doc, start, n))
            gap -= n
        else:
            n, doc, start = rests.pop()  # all are longer than the gap: cut the longest
            window.append((doc, start, gap))
            insort(rests, (n - gap, doc, start + gap))
            gap = 0
    return window


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces that hold each id of documents of these sizes once; each is as long as a power of two."""
    longest = tiers[0]
    out = [[(doc, start, longest)] for doc, n in enumerate(sizes) for start in range(0, n - longest + 1, longest)]
    rests = sorted((n % longest, doc, n - n % longest) for doc, n in enumerate(sizes) if n % longest)
    for tier, shorter in zip(tiers, [*tiers[1:], 0], strict=True):
        while rests and rests[-1][0] > shorter and sum_at_least(rests, tier):
            n, doc, start = rests.pop()
            if n > tier:  # left over from a longer tier that lacked the ids for another window
                insort(rests, (n - tier, doc, start + tier))
            out.append(fill(tier, [(doc, start, min(n, tier))], rests))
    # fewer ids than the next tier's window are left, or the smallest tier's: powers of two
    total = sum(r[0] for r in rests)
    while total:
        size = min(longest, 1 << total.bit_length() - 1)
        out.append(fill(size, [], rests))
        total -= size
    return out


def sum_at_least(rests: list[tuple[int, int, int]], size: int) -> bool:
    total = 0
    for r in reversed(rests):
        total += r[0]
        if total >= size:
            return True
    return False


def pieces(docs: DataFrame, path: str, end: int = 1, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row for each piece: see SCHEMA; ``context`` is its sequence's length."""

    def run(batches):
        coder, task = encoder(path, False), TaskContext.get().partitionId()
        pool, held, made, numbers = [], 0, 0, {}

        def flush():
            nonlocal made
            cols = [[] for _ in _TYPES]
            for window in pack([len(ids) for _, ids in pool], tiers):
                context = sum(p[2] for p in window)
                nth = numbers[context] = numbers.get(context, -1) + 1
                offset = 0
                for doc, start, n in window:
                    doc_id, ids = pool[doc]
                    crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                    for c, v in zip(cols, (doc_id, start, n, crc, len(ids), (task << 32) + made, offset, context, task, nth), strict=True):
                        c.append(v)
                    offset += n
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for b in slices(batches):
            ids, offsets = coder.encode(b.column("text"), end)
            for doc_id, lo, hi in zip(b.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                pool.append((doc_id, ids[lo:hi]))
                held += hi - lo
                if held >= pool_tokens:
                    yield flush()
                    pool, held = [], 0
        if pool:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame, path: str, end: int = 1, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row for each piece, with its sequence's length ``context`` and the sequence's ``step_group``."""
    with small_batches(docs.sparkSession):
        made = written(pieces(docs, path, end, tiers, pool_tokens))
    # one row for each task and length
    each = made.where("offset = 0").groupBy("task", "context").agg(F.count("*").alias("n"))
    tasks = Window.partitionBy("context").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("_before", F.sum("n").over(tasks) - F.col("n")).withColumn("_all", F.sum("n").over(Window.partitionBy("context"))).drop("n")
    groups = F.ceil(F.col("_all") * F.col("context") / STEP_TOKENS)
    # a group holds as many whole sequences as fit, which for powers of two is all of STEP_TOKENS
    number = F.expr("(_before + nth) * _groups div _all")
    grouped = made.join(each.withColumn("_groups", groups.cast("long")), ["task", "context"]).withColumn("step_group", F.col("context") * F.lit(1 << 40) + number)
    return grouped.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group")
