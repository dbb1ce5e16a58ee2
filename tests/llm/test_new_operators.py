"""Source divergence, line dedup and collocations against brute-force versions."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import collocations, common, divergence, linededup

from .test_operators import ODD, lower


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, repeated rows, ties, odd white space and breaks."""
    rng = random.Random(3)
    lines = ["  All rights reserved. ", "ALL RIGHTS RESERVED.", "\tthe end", "", "   ", "one line; of, words: here", "voilà l'été d'Ångström", "x" * 9, "alphabetical alphabetically alphabet"]
    out = [(None, "\n".join(lines), None, None), (None, "\n".join(lines), None, None), (1, None, "en", "a"), (2, "", "en", "b"), (3, "\n\n", None, "b"), (4, "12 34", "de", "a"), (5, "word " * 30_000, "en", None)]
    for i in range(6, 90):
        own = [rng.choice(lines) for _ in range(rng.randint(1, 9))] + [" ".join(rng.choice("red green blue old new house garden wall".split()) for _ in range(rng.randint(1, 60)))]
        rng.shuffle(own)
        out.append((i, "\n".join(own), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "b", None, "c"])))
    return [*out, out[-1], out[-1]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, lang, source, 0, "x", "y", "z", 1) for i, t, lang, source in rows]
    return spark.createDataFrame(full, ODD).repartition(5).withColumnsRenamed({"word": "line_hash", "block": "term", "label": "phrase"}).withColumn("rank", common.F.lit(1))


# 11 ------------------------------------------------------------------------


def test_pointer_sort():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé ") for _ in range(n)) for n in (400, 0, 1, 3000)] + ["a" * 70 + " " + "a" * 71 + " " + "a" * 70 + " " + "a" * 8 + " " + "a" * 16]
    data, at = common.utf8(pa.array(texts))
    starts, ends = common.spans(data, at)
    group = np.array([rng.randint(0, 1) for _ in starts])
    order, first = divergence.pointer_sort(data, starts, ends, group)
    keys = [(g, bytes(data[s:e]), s) for g, s, e in zip(group.tolist(), starts.tolist(), ends.tolist(), strict=True)]
    got = [keys[i] for i in order]
    assert got == sorted(keys)
    assert first.tolist() == [i for i, k in enumerate(got) if i == 0 or k[:2] != got[i - 1][:2]]


def brute_audit(rows, least, most):
    terms = [(i, lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t or ""))) for i, (_, t, lang, source) in enumerate(rows)]
    groups, seen, whole, counts = {(a, b) for _, a, b, _ in terms}, collections.defaultdict(set), collections.Counter(), collections.Counter()
    for i, lang, source, words in terms:
        for w in words:
            seen[lang, w].add(i)
            whole[lang, w] += 1
            counts[lang, source, w] += 1
    kept = {lang: [w for (a, w), d in seen.items() if a == lang and len(d) >= least] for lang in {g[0] for g in groups}}
    share = lambda n, words, v: 1 + (10**9 * (n + 1) // (words + v) if v else 0)
    p = {g: {w: share(counts[*g, w], sum(counts[*g, x] for x in kept[g[0]]), len(kept[g[0]])) for w in kept[g[0]]} for g in groups}
    q = {lang: {w: share(whole[lang, w], sum(whole[lang, x] for x in ws), len(ws)) for w in ws} for lang, ws in kept.items()}
    out = []
    for g in groups:
        lang, source = g
        pairs = [(sum((p[g][w] - p[h][w]) ** 2 // p[h][w] for w in kept[lang]), h[1]) for h in groups if h[0] == lang and h != g]
        single = [((p[g][w] - q[lang][w]) ** 2 // q[lang][w], w) for w in kept[lang] if counts[lang, source, w] and p[g][w] > q[lang][w]]
        for part, found in (("pair", pairs), ("term", single)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered) if part == "pair" or i < most]
    return sorted(out)


@pytest.mark.parametrize(("least", "most"), [(3, 200), (1, 5), (10_000, 200)])
def test_divergence(docs, rows, least, most):
    got = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in divergence.audit(docs, least, most).collect()]
    assert sorted(got) == brute_audit(rows, least, most)


def test_divergence_of_nothing(docs):
    assert divergence.audit(docs.where("false")).collect() == []


# 12 ------------------------------------------------------------------------


def brute_lines(rows, least, keep_first):
    """The kept text of each distinct (doc_id, text)."""
    key = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    have = collections.defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            have[key(line)].add((i, t))
    return {k for k, d in have.items() if k and len(d) >= least}, key


@pytest.mark.parametrize(("least", "keep_first", "parts"), [(10, False, 1), (10, False, 40), (2, False, 7), (1, True, 1), (1, True, 40), (12, True, 60)])
def test_line_dedup(spark, docs, rows, least, keep_first, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = linededup.dedup_lines(docs, least, keep_first).toPandas()
        bitmaps = linededup.keep_bitmaps(docs, least, keep_first).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    gone, key = brute_lines(rows, least, keep_first)
    ids = [(None if np.isnan(i) else int(i), t) for i, t in zip(got.doc_id, got.text, strict=True)]
    assert len(got) == len(rows)
    want, seen = collections.Counter(), set()
    hashes = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()}
    for i, t in sorted({(i, t) for i, t, *_ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r])):
        lines, kept = (t or "").split("\n"), []
        for line in lines:
            k = key(line)
            if k not in gone or (keep_first and k not in seen):
                kept.append(line)
                seen.add(k)
        want[i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += sum((i, t) == r[:2] for r in rows)
    assert collections.Counter((*x, n, d) for x, n, d in zip(ids, got.n_lines, got.n_dropped, strict=True)) == want
    for n, d, bits in zip(bitmaps.n_lines, bitmaps.n_dropped, bitmaps.keep, strict=True):
        drawn = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))
        assert d > 0 and n - drawn[:n].sum() == d and len(drawn) - 8 < n <= len(drawn)


def test_line_spans():
    texts = ["a\nb", "", "\n", "x\n", None, "\n\ny"]
    data, at = common.utf8(pa.array(texts))
    starts, ends, bounds = linededup.line_spans(data, at)
    lines = [bytes(data[s:e]).decode() for s, e in zip(starts, ends, strict=True)]
    assert [lines[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [(t or "").split("\n") for t in texts]


def test_line_dedup_of_nothing(docs):
    assert linededup.dedup_lines(docs.where("false")).collect() == []


# 13 ------------------------------------------------------------------------


def brute_phrases(rows, least, most):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(t or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if a >= least}
        inside = lambda p, x: any(x[i : i + len(p)] == p for i in range(len(x) - len(p) + 1))
        found = []
        for p, a in frequent.items():
            if len(p) < 2 or any(len(x) > len(p) and 100 * b >= 100 * a and inside(p, x) for x, b in frequent.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), c[p[:k]], c[p[k:]], n[lang]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, x, y, m, s) for i, (s, a, p, x, y, m) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("least", "most"), [(10, 2000), (2, 7), (3, 2000)])
def test_collocations(docs, rows, least, most):
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.mine(docs, least, most).collect())
    assert got == brute_phrases(rows, least, most)


def test_parse_assigns_each_phrase_once(docs, rows):
    """Chunks own every word once, repeat four words at most, and copies share them."""
    found = collocations.parse(docs).collect()
    words = sum(len(re.findall("[^\x20\x09\x0a-\x0d.,;:!?]+", t or "")) for _, t, *_ in rows)
    assert sum(r.own * r.n for r in found) == words
    assert all(r.own <= len(r.chunk.split()) <= r.own + 4 for r in found) and max(r.n for r in found) >= 3
    assert max(r.own for r in found) <= collocations.MOST_OWN


def test_collocations_of_nothing(docs):
    assert collocations.mine(docs.where("false")).collect() == [] and collocations.mine(docs.where("text is null")).collect() == []
