"""Phrase collocations by prefix-free parsing.

A text is a row of words, some of them with a break before them. Where the hash of two
words in a row has ``TRIGGER_BITS`` zero bits, a chunk begins; it owns the words up to the next
chunk (``MOST_OWN`` at most) and repeats up to ``LONGEST`` - 1 words after them that no break cuts off.
So each phrase of up to ``LONGEST`` words that begins in a chunk's own words lies in the
chunk as a whole, and is counted there and nowhere else. As cuts follow the content, copies and
shared passages give the same chunks: the dictionary of distinct chunks with their
frequencies stands for the corpus, and phrases are counted inside it, weighted.

A phrase is not rarer than a longer one around it. Words are counted first, then pairs of
frequent words, then phrases of 3 to 5 words all of whose pairs are frequent, each
time by hashes; the frequent ones go to the next step as a bitmap of fixed size (``MOST_BITS``), which
lets some rare ones in and leaves no frequent one out. What is left is counted once more by
its text, so the counts are exact.

Defined cases: null and empty texts have no words; null lang is 'und'; repeated rows count each;
an empty table gives no rows. Only text and lang are looked at, whatever the other columns.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import LOWER, gaps, mix, slices, span_hashes, spans, utf8, written
from folioforge.llm.divergence import pieces

LONGEST = 5
TRIGGER_BITS, MOST_OWN = 5, 512
#: Bits of a bitmap of frequent phrases at most (16 MB), and bits for each of them below that.
MOST_BITS, BITS_EACH = 1 << 27, 16
UNKNOWN = "und"
_BREAKS = gaps(b".,;:!?\n\x0b\x0c\r")
_GAPS = _BREAKS | gaps(b" \t")
_SPACE, _BREAK = ord(" "), ord("\n")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _chunk_starts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Numbers of the words at which a chunk begins: each text's first, then by the hash of two words in a row."""
    two = mix(hashes[:-1] * _STEP + hashes[1:]) if len(hashes) else hashes
    found = np.union1d(np.flatnonzero(two >> np.uint64(64 - TRIGGER_BITS) == 0) + 1, bounds[:-1][np.diff(bounds) > 0]).astype(np.int64)
    size = np.diff(np.append(found, len(hashes)))
    more = [np.arange(s + MOST_OWN, s + n, MOST_OWN) for s, n in zip(found[size > MOST_OWN].tolist(), size[size > MOST_OWN].tolist(), strict=True)]
    return np.sort(np.concatenate([found, *more]))


def chunks(docs: DataFrame) -> DataFrame:
    """(lang, chunk, own): the chunks of all texts. Words stand apart by a blank, or by a line feed where there is a break."""

    def run(batches):
        for b in slices(batches):
            data, at = utf8(b.column("text"))
            starts, ends = spans(data, at, _GAPS)
            data = LOWER[data]
            if not len(starts):
                continue
            bounds = np.searchsorted(starts, at)
            begin = _chunk_starts(span_hashes(data, starts, ends), bounds)
            breaks = np.concatenate(([0], np.cumsum(_BREAKS[data])))
            apart = np.ones(len(starts) + 1, bool)  # word i begins a piece; and the end of all words
            apart[1:-1] = breaks[starts[1:]] > breaks[ends[:-1]]
            apart[bounds] = True
            # every word and one byte after it
            size = ends - starts + 1
            offsets = np.concatenate(([0], np.cumsum(size)))
            flat = np.append(data, np.uint8(_SPACE))[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, size)]
            flat[offsets[1:] - 1] = np.where(apart[1:], _BREAK, _SPACE)
            stop = np.append(begin[1:], len(starts))
            piece_end = np.flatnonzero(apart)
            last = np.minimum(stop + LONGEST - 1, piece_end[np.searchsorted(piece_end, stop - 1, "right")])
            doc = np.searchsorted(bounds, begin, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(doc)), pieces(flat, offsets[begin], offsets[last] - 1), pa.array(stop - begin)], names=["lang", "chunk", "own"])

    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    return plain.mapInArrow(run, "lang string, chunk string, own long")


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary: lang, chunk, own and n, how often the corpus has the chunk."""
    return chunks(docs).groupBy("lang", "chunk", "own").agg(F.count("*").alias("n"))


class _Words:
    """The words of a batch of chunks, and the phrases that begin in a chunk's own words."""

    def __init__(self, b: pa.RecordBatch):
        self.data, at = utf8(b.column("chunk"))
        self.starts, self.ends = spans(self.data, at, _GAPS)
        bounds = np.searchsorted(self.starts, at)
        self.chunk = np.searchsorted(bounds, np.arange(len(self.starts)), "right") - 1
        self.weight = b.column("n").to_numpy()[self.chunk]
        self.lang = b.column("lang").dictionary_encode()
        salts = np.array([zlib.crc32(x.encode()) for x in self.lang.dictionary.to_pylist()], np.uint64)
        self.code = self.lang.indices.to_numpy()[self.chunk]
        self.words = mix(span_hashes(self.data, self.starts, self.ends) + salts[self.code] * _STEP)
        n = len(self.starts)
        apart = np.ones(n + 1, bool)
        apart[1:-1] = self.data[self.starts[1:] - 1] == _BREAK
        apart[bounds] = True
        end = np.flatnonzero(apart)
        #: Words from each one to the end of its piece; none where the chunk doesn't own the word.
        self.room = end[np.searchsorted(end, np.arange(n), "right")] - np.arange(n) if n else np.zeros(0, np.int64)
        self.room[np.arange(n) - bounds[self.chunk] >= b.column("own").to_numpy()[self.chunk]] = 0

    def hashes(self, k: int) -> np.ndarray:
        """The hash of the k words from each one on, whatever they are."""
        out = self.words.copy()
        for i in range(1, min(k, len(out))):
            out[:-i] = mix(out[:-i] * _STEP + self.words[i:] + np.uint64(k))
        return out

    def all_of(self, good: np.ndarray, n: int) -> np.ndarray:
        """Whether n in a row, from each one on, are good; false at the end."""
        out = good.copy()
        for i in range(1, min(n, len(out))):
            out[:-i] &= good[i:]
        out[max(len(out) - n + 1, 0) :] = False
        return out


def _listed(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _candidates(w: _Words, maps: list[np.ndarray], k: int) -> np.ndarray:
    """Where a phrase of k words begins of which the maps (of words, of pairs, of longer ones) leave no part out."""
    at = w.room >= k
    if k >= 2 and maps:
        at &= w.all_of(_listed(w.words, maps[0]), 2)
    if k >= 3:
        at &= w.all_of(_listed(w.hashes(2), maps[1]), k - 1)
    return np.flatnonzero(at)


def _counted(dictionary: DataFrame, maps: list[np.ndarray], sizes: range, least: int) -> DataFrame:
    """(phrase, n): hashes of the phrases of these sizes that the corpus has ``least`` times or more."""
    shared = dictionary.sparkSession.sparkContext.broadcast(maps)

    def run(batches):
        for b in slices(batches, "chunk", 4 << 20, 1 << 20):
            w = _Words(b)
            found = [(w.hashes(k)[at], w.weight[at]) for k in sizes for at in [_candidates(w, shared.value, k)]]
            codes, unique = pd.factorize(np.concatenate([h for h, _ in found]))
            n = np.zeros(len(unique), np.int64)
            np.add.at(n, codes, np.concatenate([x for _, x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n)], names=["phrase", "n"])

    rows = dictionary.mapInArrow(run, "phrase long, n long")
    return rows.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """A bit for each hash, by its lower bits; at most MOST_BITS in all come to the driver."""
    frequent = written(frequent)
    n = min(MOST_BITS, max(1 << 15, 1 << (BITS_EACH * frequent.count()).bit_length()))
    slot = F.col("phrase").bitwiseAND(n - 1)
    rows = frequent.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND((1 << 15) - 1)).alias("bits")).toArrow()
    out = np.zeros(n // 8, np.uint8)
    for part, bits in zip(rows.column("part").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def phrase_counts(dictionary: DataFrame, least: int = 100) -> DataFrame:
    """(lang, phrase, k, n) of every phrase of up to LONGEST words that its language has ``least`` times or more."""
    maps: list[np.ndarray] = []
    for sizes in (range(1, 2), range(2, 3), range(3, LONGEST + 1)):
        maps.append(_bitmap(_counted(dictionary, maps, sizes, least)))
    shared = dictionary.sparkSession.sparkContext.broadcast(maps)

    def run(batches):
        for b in slices(batches, "chunk", 4 << 20, 1 << 20):
            w, maps = _Words(b), shared.value
            for k in range(1, LONGEST + 1):
                at = _candidates(w, maps, k)
                hashes = w.hashes(k)[at]
                good = _listed(hashes, maps[min(k, 3) - 1])
                at, hashes = at[good], hashes[good]
                codes, _ = pd.factorize(hashes)
                first = np.unique(codes, return_index=True)[1]
                n = np.zeros(len(first), np.int64)
                np.add.at(n, codes, w.weight[at])
                lang = w.lang.dictionary.take(pa.array(w.code[at[first]]))
                yield pa.RecordBatch.from_arrays([lang, pieces(w.data, w.starts[at[first]], w.ends[at[first] + k - 1]), pa.array(np.full(len(first), k, np.int32)), pa.array(n)], names=["lang", "phrase", "k", "n"])

    rows = dictionary.mapInArrow(run, "lang string, phrase string, k int, n long")
    return rows.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _words_of(begin: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), begin, n), " ")


def scores(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words or more, by their lowest-scoring cut.

    ``counts`` is that of ``phrase_counts``, ``totals`` has (lang, n), the words of each language.
    """
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = counts.where("k > 1").select("lang", "phrase", F.col("k").alias("_k"), F.col("n").alias("a"), cut)
    cuts = cuts.withColumn("_left", _words_of(1, F.col("cut"))).withColumn("_right", _words_of(F.col("cut") + 1, F.col("_k")))
    part = lambda side, into: counts.select(F.col("lang"), F.col("phrase").alias(side), F.col("n").alias(into))
    full = cuts.join(part("_left", "l"), ["lang", "_left"]).join(part("_right", "r"), ["lang", "_right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")), wide("l") * wide("r"))
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    return full.groupBy("lang", "phrase", "a", "n").agg(best.alias("_b")).select("lang", "phrase", "a", "_b.l", "_b.r", "n", "_b.score")


def maximal(candidates: DataFrame, counts: DataFrame, percent: int = 100) -> DataFrame:
    """The candidates (lang, phrase, a) but those inside a longer phrase that has ``percent`` of their occurrences.

    Phrases between the two have no fewer than the longer one, so those of one word more decide.
    """
    longer = counts.where("k > 2")
    inner = [_words_of(1, F.col("k") - 1), _words_of(2, F.col("k") - 1)]
    around = longer.select("lang", F.explode(F.array(*inner)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_around"))
    return candidates.join(around, ["lang", "phrase"], "left").where(f"_around is null or 100 * _around < {percent} * a").drop("_around")


def ranked(scored: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language by score, a (both descending) and phrase; a language's rows meet by shares first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = Window.partitionBy("lang", "_share").orderBy(*order)
    first = scored.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= most)
    return first.drop("_share").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def mine(docs: DataFrame, least: int = 100, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``most`` phrases of 2 to LONGEST words."""
    dictionary = written(parse(docs))
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    counts = written(phrase_counts(dictionary, least))
    found = maximal(scores(counts, totals), counts)
    return ranked(found, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
