"""Line dedup by sorted line hashes and keep bitmaps.

A line's key is the line without white space at its ends, in lower case (A-Z). Each
document posts a row for each of its distinct keys: the key's hash and where the
lines stand. The rows are partitioned by ranges of (hash, document) and sorted
inside, so that equal keys follow each other, by document; a key that very many
documents have spans several ranges. One stream over each range finds the runs of
keys that enough documents have, with ``least`` rows in memory at most. A run at an
end of a range may go on in the next, so its first ``least`` rows stay open and meet
those of the other ranges afterwards; that many a range, whatever the data.

What comes out is a compressed bitmap of the lines to keep for each document that
loses lines. No text moves for that; ``drop_lines`` joins bitmaps and texts.

A document is a distinct pair of doc_id and text: repeated rows count once, and each of
them loses the same lines. Null and empty texts are one empty line; blank lines have
no key and stay; a null doc_id is an id like any other; an empty table gives no rows.
Only doc_id and text are looked at, and returned, whatever the other columns. Keys
are compared by 64 bits: two keys of n in the table are mixed up with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import LOWER, SPACES, slices, span_hashes, utf8, written

_NEWLINE = 10


def line_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all texts, and the n + 1 line offsets of the texts; an empty text is one line."""
    breaks = np.flatnonzero(data == _NEWLINE)
    bounds = np.searchsorted(breaks, at) + np.arange(len(at))
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    inner = np.ones(len(starts), bool)
    inner[bounds[:-1]] = False
    starts[bounds[:-1]], starts[inner] = at[:-1], breaks + 1
    inner[:] = True
    inner[bounds[1:] - 1] = False
    ends[bounds[1:] - 1], ends[inner] = at[1:], breaks
    return starts, ends, bounds


def line_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the lines that are not blank, the hashes of their keys, and the line offsets of the texts."""
    starts, ends, bounds = line_spans(data, at)
    solid = np.flatnonzero(~SPACES[data])
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    filled = np.flatnonzero(first < last)
    return filled, span_hashes(LOWER[data], solid[first[filled]], solid[last[filled] - 1] + 1), bounds


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def postings(docs: DataFrame) -> DataFrame:
    """(line_hash, doc_id, text_hash, n_lines, lines) for each distinct key of each document; ``lines`` holds 32-bit line numbers."""

    def run(batches):
        for b in slices(batches):
            filled, hashes, bounds = line_keys(*utf8(b.column("text")))
            doc = np.searchsorted(bounds, filled, "right") - 1
            order = np.lexsort((hashes, doc))
            doc, hashes, number = doc[order], hashes[order], (filled - bounds[doc])[order].astype("<i4")
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
            cut = np.flatnonzero(fresh)
            held = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(np.append(4 * cut, 4 * len(doc)).astype(np.int32)), pa.py_buffer(number)])
            own = pa.array(doc[cut])
            columns = [pa.array(hashes[cut].view(np.int64)), b.column("doc_id").take(own), b.column("text_hash").take(own), pa.array(np.diff(bounds)[doc[cut]].astype(np.int32)), held]
            yield pa.RecordBatch.from_arrays(columns, names=["line_hash", "doc_id", "text_hash", "n_lines", "lines"])

    kinds = [("line_hash", T.LongType()), ("doc_id", docs.schema["doc_id"].dataType), ("text_hash", T.LongType()), ("n_lines", T.IntegerType()), ("lines", T.BinaryType())]
    return _named(docs).mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


class _Runs:
    """The runs of equal hashes in a sorted stream; only the run that may go on is held, ``least`` rows of it."""

    def __init__(self, least: int, keep_first: bool):
        self.least, self.keep_first = least, keep_first
        self.hash, self.last, self.n, self.waiting, self.first = None, None, 0, [], True

    def _settled(self, b: pa.RecordBatch, with_head: bool) -> pa.RecordBatch:
        """Rows to drop, without their hash; the first of a run may keep its first line."""
        lines = b.column("lines")
        if with_head and self.keep_first and b.num_rows:
            h = b.column("line_hash").to_numpy()
            heads = np.concatenate(([True], h[1:] != h[:-1])).tolist()
            lines = pa.array([x[4:] if head else x for x, head in zip(lines.to_pylist(), heads, strict=True)], pa.binary())
        none = pa.nulls(b.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([none, *b.columns[1:4], lines], names=b.schema.names)

    def _close(self) -> list[pa.RecordBatch]:
        """The run has ended, and another follows."""
        if self.first:
            return self.waiting  # it may have begun in the range before
        return [self._settled(b, i == 0) for i, b in enumerate(self.waiting)] if self.n >= self.least else []

    def _grow(self, b: pa.RecordBatch) -> list[pa.RecordBatch]:
        """Add rows to the held run; what is beyond the first ``least`` is settled at once."""
        room = max(0, self.least - self.n)
        self.n += b.num_rows
        if room:
            self.waiting.append(b.slice(0, room))
        return [self._settled(b.slice(room), False)] if b.num_rows > room else []

    def take(self, b: pa.RecordBatch) -> list[pa.RecordBatch]:
        ids = list(zip(*(b.column(c).to_pylist() for c in ("line_hash", "doc_id", "text_hash")), strict=True))
        fresh = [x != y for x, y in zip(ids, [self.last, *ids[:-1]], strict=True)]
        self.last = ids[-1]
        b = b.filter(pa.array(fresh))
        if not b.num_rows:
            return []
        h = b.column("line_hash").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]))
        if self.hash is None:
            self.hash = h[0]
        out, begin = [], 0
        if h[0] == self.hash:
            out += self._grow(b.slice(0, int(cuts[1])))
            begin = 1
        if begin == len(cuts) - 1:
            return out
        out += self._close()
        self.first = False
        inner = np.diff(cuts)[begin:-1] >= self.least
        if len(inner):
            part = b.slice(int(cuts[begin]), int(cuts[-2] - cuts[begin]))
            out.append(self._settled(part.filter(pa.array(np.repeat(inner, np.diff(cuts)[begin:-1]))), True))
        self.hash, self.n, self.waiting = h[-1], 0, []
        return out + self._grow(b.slice(int(cuts[-2])))

    def end(self) -> list[pa.RecordBatch]:
        return self.waiting  # it may go on in the next range


def _decide(least: int, keep_first: bool):
    def run(batches):
        runs = _Runs(least, keep_first)
        for b in batches:
            if b.num_rows:
                yield from runs.take(b)
        yield from runs.end()

    return run


def keep_bitmaps(docs: DataFrame, least: int = 10, keep_first: bool = False) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped and keep of each document that loses lines.

    Lines whose key ``least`` documents or more have are dropped; ``keep_first`` keeps the first of them by
    doc_id, text and place (with ``least`` 1 also lines repeated in one document go but for the first).
    ``keep`` is a zlib-compressed bitmap, a bit for each line from the first on, 1 for a line that stays.
    """
    posted = written(postings(docs))
    order = [F.col("line_hash"), F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    found = written(posted.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_decide(least, keep_first), posted.schema))
    # what lies at the ends of the ranges
    edge = found.where("line_hash is not null")
    enough = edge.groupBy("line_hash").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    edge = edge.join(enough, "line_hash")
    if keep_first:
        head = F.row_number().over(Window.partitionBy("line_hash").orderBy(*order[1:])) == 1
        edge = edge.withColumn("_head", head).withColumn("lines", F.when(F.col("_head"), F.expr("substring(lines, 5)")).otherwise(F.col("lines")))
    columns = ["doc_id", "text_hash", "n_lines", "lines"]
    dropped = found.where("line_hash is null").select(*columns).union(edge.select(*columns))
    by_document = dropped.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_list("lines").alias("lines"))

    def draw(batches):
        for b in batches:
            keep, gone = [], []
            for n, parts in zip(b.column("n_lines").to_pylist(), b.column("lines").to_pylist(), strict=True):
                bits = np.ones(n, bool)
                bits[np.frombuffer(b"".join(parts), "<i4")] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
                gone.append(n - int(bits.sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("n_lines").cast(pa.int64()), pa.array(gone, pa.int64()), pa.array(keep, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])

    kinds = [("doc_id", docs.schema["doc_id"].dataType), ("text_hash", T.LongType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("keep", T.BinaryType())]
    out = by_document.mapInArrow(draw, T.StructType([T.StructField(*k) for k in kinds]))
    return out.where("n_dropped > 0")


def _kept(text: bytes, n_lines: int, keep: bytes) -> bytes:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n_lines].astype(bool)
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = line_spans(data, np.array([0, len(data)]))
    return b"\n".join(text[s:e] for s, e in zip(starts[bits].tolist(), ends[bits].tolist(), strict=True))


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, n_lines and n_dropped of every row of docs, its text without the lines that its bitmap drops; null stays null."""
    known = written(bitmaps.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("n_lines").alias("_lines"), "keep"))
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h"))
    # bitmaps are small beside texts: they are hashed, and texts need no sort
    both = _named(docs).join(known.hint("shuffle_hash"), on, "left").select("doc_id", "text", "_lines", "keep")

    def run(batches):
        for b in slices(batches):
            texts, keep = b.column("text"), b.column("keep")
            data, at = utf8(texts)
            _, _, bounds = line_spans(data, at)
            n_lines, gone = np.diff(bounds), np.zeros(b.num_rows, np.int64)
            hit = np.flatnonzero(np.asarray(keep.is_valid()))
            if len(hit):
                values = texts.cast(pa.binary()).to_pylist()
                for i in hit.tolist():
                    n, bits = b.column("_lines")[i].as_py(), keep[i].as_py()
                    gone[i] = n - int(np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[:n].sum())
                    values[i] = _kept(values[i], n, bits)
                texts = pa.array(values, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, pa.array(n_lines), pa.array(gone)], names=["doc_id", "text", "n_lines", "n_dropped"])

    kinds = [("doc_id", docs.schema["doc_id"].dataType), ("text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())]
    return both.mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


def dedup_lines(docs: DataFrame, least: int = 10, keep_first: bool = False) -> DataFrame:
    """``drop_lines`` by the bitmaps of ``keep_bitmaps``."""
    return drop_lines(docs, keep_bitmaps(docs, least, keep_first))
