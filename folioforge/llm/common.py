"""Helpers shared by the training-data operators.

``words``/``units`` turn the UTF-8 buffer of an Arrow string column into 64-bit
span hashes without building a Python object for each word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.session import shared_dir, small_batches, written  # noqa: F401

#: Bytes hashed at once; bounds the scratch arrays whatever the text length.
SEGMENT = 1 << 20
#: Bytes of text that an operator takes from an Arrow batch at once.
SLICE_BYTES = 1 << 20
#: Code points that end a word: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def with_starts(df: DataFrame, size: str, order: list[str], into: str = "start", keys: list[str] | None = None) -> DataFrame:
    """Add the sum of ``size`` over all rows before each row of the same ``keys``, by ``order``, nulls first; df is best a written table.

    Rows are dealt to ranges of about equal numbers by their order, whatever its
    values, with the row number last, so that equal rows part too. They are summed
    inside the ranges; only the ranges' totals (one row per range and key) meet in
    one window.
    """
    keys = keys or []
    by = [F.col(c).asc_nulls_first() for c in [*order, "_tie"]]
    ranged = written(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).withColumn("_block", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "_block").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy(*keys, "_block").agg(F.sum(size).alias("_total"))
    totals = totals.withColumn("_before", F.sum("_total").over(outer) - F.col("_total"))
    joined = ranged.withColumn("_inside", F.sum(size).over(inner) - F.col(size))
    on = F.lit(True)
    t = totals.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate([*keys, "_block"])], "_before")
    for i, k in enumerate([*keys, "_block"]):
        on = on & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    out = joined.join(t, on).withColumn(into, (F.col("_before") + F.col("_inside")).cast("long"))
    return out.drop("_tie", "_block", "_before", "_inside", *[f"_t{i}" for i in range(len(keys) + 1)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gaps(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


SPACES = gaps(b" \t\n\x0b\x0c\r")
#: Every ASCII byte but letters and digits separates.
PUNCTUATION = gaps(bytes(b for b in range(128) if not chr(b).isalnum()))
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator, column: str = "text", most: int = SLICE_BYTES, rows: int = 4096) -> Iterator:
    """Cut Arrow batches so that each piece holds about ``most`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(at, at[lo] + most, "right")) - 1
            hi = min(max(hi, lo + 1), lo + rows, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def give_back() -> None:
    """Return freed memory to the machine: a Python worker lives on after its task, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, _INVERSE)):
            steps = np.full(max(n, SEGMENT + 1), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for ascending, disjoint, non-empty spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        hi = int(ends[j - 1])
        power, inverse = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def spans(data: np.ndarray, at: np.ndarray, table: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts; no word spans two texts."""
    gap = table[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[at] = True
    before = np.empty(len(data) + 1, bool)  # position i: nothing of the same word stands before i
    before[0] = True
    before[1:] = gap
    before |= fresh
    starts = np.flatnonzero(before[:-1] & ~gap)
    after = np.empty(len(data) + 1, bool)  # position i: a word that ran up to i ends here
    after[-1] = True
    after[:-1] = gap
    after |= fresh
    return starts, np.flatnonzero(after[1:] & ~gap) + 1


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray = SPACES, case: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of all texts, and the n + 1 word offsets of the texts."""
    starts, ends = spans(data, at, table)
    hashes = span_hashes(case[data] if case is not SAME else data, starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, at)


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like words, but each span is a run of spaces and the word after it: spans cover every byte."""
    gap = SPACES[data]
    cut = gap.copy()
    cut[1:] &= ~gap[:-1]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[at] = True
    starts = np.flatnonzero(cut | fresh[:-1])
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, at)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, where each first stands, and the number of each hash among them."""
    codes, unique = pd.factorize(hashes)
    first = np.empty(len(unique), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return unique, first, codes


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over each text's words."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[at[1:]] - total[at[:-1]]
