"""Source divergence audit by a pointer sort of word starts.

Each slice of an Arrow text buffer is a shard: a pointer stands at every word start,
and the pointers are sorted in place of the words, by a multikey quicksort that
compares eight bytes at a time and goes on only inside runs of words that are equal so
far and longer. Equal runs of a shard give a term's occurrences and documents for each
group (lang, source); shards add up. A language keeps the terms that ``least`` of its
documents have.

Term shares are smoothed integers, p = 1 + floor(SCALE * (count + 1) / (N + V)) with
N the sum of the group's counts of kept terms and V their number. The divergence
of p from q adds up floor((p - q)^2 / q): ``term_divergence`` tells it for each
term that a group has more often than its language, ``pair_divergence`` for each two
sources of a language, over all kept terms. Terms that neither, one or both sources
have are summed apart, so that only terms of both are paired, inside a task and added
up there. Everything is exact.

Defined cases: null text, lang and source are ''; documents without terms still make
their group occur; a language without kept terms has p = 1 everywhere, pairs of value
0 and no terms; repeated rows are documents of their own; an empty table gives no rows.
Only text, lang and source are looked at, whatever the other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import LOWER, gaps, slices, spans, utf8, written

SCALE = 1_000_000_000
SHARD_BYTES = 4 << 20
#: Every ASCII byte but letters separates.
_GAPS = gaps(bytes(b for b in range(128) if not chr(b).isalpha()))


def _eight(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each pointer on as one number, zeros beyond the word; ``data`` has eight bytes more than the text."""
    view = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    out = view[at].astype(np.uint64)
    short = left < 8
    shift = (8 * (8 - left[short])).astype(np.uint64)
    out[short] = (out[short] >> shift) << shift
    return out


def pointer_sort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the words by group and bytes, equal ones by their place, and where in it each run of equal words begins.

    No word has a zero byte, so one that ends compares as lower.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = _eight(padded, starts, ends - starts)
    order = np.lexsort((key, group))
    fresh = np.ones(len(order) + 1, bool)
    fresh[1:-1] = (group[order][1:] != group[order][:-1]) | (key[order][1:] != key[order][:-1])
    depth = 8
    while True:
        # members of runs of more than one, of which some word goes on
        run = np.cumsum(fresh[:-1]) - 1
        longer = (ends - starts)[order] > depth
        many = np.zeros(run[-1] + 1 if len(run) else 0, bool)
        many[run[longer]] = True
        many &= np.bincount(run, minlength=len(many)) > 1
        at = np.flatnonzero(many[run])
        if not len(at):
            return order, np.flatnonzero(fresh[:-1])
        own, where = order[at], run[at]
        left = np.maximum(ends[own] - starts[own] - depth, 0)
        key = _eight(padded, np.minimum(starts[own] + depth, len(data)), np.minimum(left, 8))
        again = np.lexsort((key, where))
        order[at], key, where = own[again], key[again], where[again]
        fresh[at[1:]] |= (where[1:] == where[:-1]) & (key[1:] != key[:-1])
        depth += 8


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[s:e]."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    spots = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, size)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[spots])]).cast(pa.string())


def shard_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): the terms of each group in each shard; a null term, n 0, for each group there."""

    def run(batches):
        for b in slices(batches, most=SHARD_BYTES, rows=1 << 20):
            table = pa.table({c: b.column(c) for c in ("lang", "source")})
            groups = table.group_by(["lang", "source"]).aggregate([])
            number = {g: i for i, g in enumerate(zip(groups["lang"].to_pylist(), groups["source"].to_pylist(), strict=True))}
            code = np.array([number[g] for g in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)], np.int64)
            data, at = utf8(b.column("text"))
            starts, ends = spans(data, at, _GAPS)
            data = LOWER[data]
            doc = np.searchsorted(at, starts, "right") - 1
            order, first = pointer_sort(data, starts, ends, code[doc])
            # within a run the pointers go up, and so do their documents
            change = np.ones(len(order), bool)
            change[1:] = doc[order][1:] != doc[order][:-1]
            change[first] = True
            ids, n = order[first], np.diff(np.append(first, len(order)))
            in_docs = np.add.reduceat(change, first).astype(np.int64) if len(first) else n
            pick = pa.array(np.concatenate((code[doc[ids]], np.arange(groups.num_rows))))
            columns = [pa.array(groups["lang"]).take(pick), pa.array(groups["source"]).take(pick)]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            zeros = np.zeros(groups.num_rows, np.int64)
            terms = pa.concat_arrays([pieces(data, starts[ids], ends[ids]), pa.nulls(groups.num_rows, pa.string())])
            yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(np.concatenate((n, zeros))), pa.array(np.concatenate((in_docs, zeros)))], names=["lang", "source", "term", "n", "docs"])

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total); 1 where the total is 0."""
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")).alias("_wide")
    quotient = F.call_function("div", wide, total.cast("decimal(20,0)"))
    return F.lit(1) + F.when(total > 0, quotient).otherwise(0)


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def groups_and_counts(docs: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, total, terms, kept, zero) and the counts (lang, source, term, n, p, q, zero) of their kept terms, both written.

    ``total`` is N + V, ``terms`` V, ``kept`` how many kept terms the group has, ``zero`` the share of a term that
    it doesn't have; p is the group's share of the term, q its language's.
    """
    counts = written(shard_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= least)
    kept = written(counts.join(terms.select("lang", "term", "whole"), ["lang", "term"]))
    # a third of all rows may be one language's: sums are made in two steps, by Spark's partial aggregation
    langs = kept.select("lang", "term", "whole").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("_words"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("_n"), F.count("*").alias("kept"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    total = F.coalesce("_n", F.lit(0)) + F.coalesce("terms", F.lit(0))
    groups = groups.select("lang", "source", total.alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("_words", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("_whole"))
    groups = written(groups.withColumn("zero", share(F.lit(0), F.col("total"))))
    known = groups.select("lang", "source", "total", "zero", "_whole")
    counts = kept.join(known, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total")).alias("p"), share(F.col("whole"), F.col("_whole")).alias("q"), "zero")
    return groups.drop("_whole"), written(counts)


def term_divergence(counts: DataFrame, most: int = 200) -> DataFrame:
    """lang, source, item (the term), value and rank of the ``most`` terms by which each group stands out."""
    found = counts.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # Spark keeps the first ranks of each group in every task before it shuffles
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def both_present(counts: DataFrame) -> DataFrame:
    """(lang, source, item, both, over, under, n) for each two sources with a kept term in common, summed over these terms.

    ``both`` sums f(p, q), ``over`` f(p, the item's zero), ``under`` f(the source's zero, q). A term's sources meet in
    one row, are paired in the task and added up there: a row for each pair and task goes out.
    """
    shares = F.array_sort(F.collect_list(F.struct("source", "p", "zero")))
    terms = counts.groupBy("lang", "term").agg(shares.alias("shares")).where("size(shares) > 1").select("lang", "shares")

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            lists = b.column("shares")
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            source = flat.field("source").dictionary_encode()
            lang = b.column("lang").dictionary_encode()
            names, tongues = source.dictionary.to_pylist(), lang.dictionary.to_pylist()
            code, of = source.indices.to_numpy(), lang.indices.to_numpy()[owner]
            p, zero = flat.field("p").to_numpy(), flat.field("zero").to_numpy()
            # each entry beside the one that stands k places behind it in its term's list
            for k in range(1, int(np.bincount(owner).max(initial=0))):
                a = np.flatnonzero(owner[k:] == owner[:-k])
                for x, y in ((a, a + k), (a + k, a)):
                    f = [(p[x] - p[y]) ** 2 // p[y], (p[x] - zero[y]) ** 2 // zero[y], (zero[x] - p[y]) ** 2 // p[y], np.ones(len(a), np.int64)]
                    pair = (of[x].astype(np.int64) * len(names) + code[x]) * len(names) + code[y]
                    keys, at = np.unique(pair, return_inverse=True)
                    sums = np.zeros((len(keys), 4), np.int64)
                    for i, v in enumerate(f):
                        np.add.at(sums[:, i], at, v)
                    for key, row in zip(keys.tolist(), sums, strict=True):
                        name = (tongues[key // len(names) ** 2], names[key // len(names) % len(names)], names[key % len(names)])
                        total[name] = total.get(name, 0) + row
        rows = list(total)
        numbers = np.array([total[r] for r in rows], np.int64).reshape(len(rows), 4)
        yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.string()) for i in range(3)), *(pa.array(numbers[:, i]) for i in range(4))], names=["lang", "source", "item", "both", "over", "under", "n"])

    parts = terms.mapInArrow(run, "lang string, source string, item string, both long, over long, under long, n long")
    return parts.groupBy("lang", "source", "item").agg(*[F.sum(c).alias(c) for c in ("both", "over", "under", "n")])


def pair_divergence(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value and rank; a row for each two of them."""
    told = groups.select("lang", "source", "terms", "kept", "zero")
    other = told.select(F.col("lang").alias("_lang"), F.col("source").alias("item"), F.col("kept").alias("_kept"), F.col("zero").alias("_zero"))
    # the result has a row for each two sources of a language, so the groups meet each other by language
    pairs = told.join(other, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("item"))).drop("_lang")
    # few different shares stand for all terms of a group
    shares = written(counts.groupBy("lang", "source", "p").agg(F.count("*").alias("m")))
    key = ["lang", "source", "item"]
    lonely = pairs.select(*key, "zero", "_zero")
    own = lonely.join(shares, ["lang", "source"]).groupBy(*key).agg(F.sum(F.col("m") * apart("p", "_zero")).alias("own"))
    theirs = lonely.join(shares.withColumnRenamed("source", "item"), ["lang", "item"]).groupBy(*key).agg(F.sum(F.col("m") * apart("zero", "p")).alias("theirs"))
    full = pairs.join(own, key, "left").join(theirs, key, "left").join(both_present(counts), key, "left").fillna(0, ["own", "theirs", "both", "over", "under", "n"])
    neither = F.col("terms") - F.col("kept") - F.col("_kept") + F.col("n")
    value = F.col("both") + F.col("own") - F.col("over") + F.col("theirs") - F.col("under") + neither * apart("zero", "_zero")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return full.select(*key, value.alias("value")).withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank of both reports."""
    groups, counts = groups_and_counts(docs, least)
    parts = [("pair", pair_divergence(groups, counts)), ("term", term_divergence(counts, most))]
    pair, term = (x.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, x in parts)
    return pair.unionByName(term)
