"""Each operator against a brute-force version on small fixtures."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.llm import common, encoding, idstore, knn, language, lmscore, lzprint, mixing, neardup, packing, queries, tokencount, toxicity

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, word string, block string, label int"
VOCABULARY = queries.vocabulary_path("byte_bpe_50k.json")
WORDS = queries.vocabulary_path("word_bpe_49k.json")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", lower(t or ""))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, odd white space, and columns whose names clash."""
    base = "the quick brown fox jumps over the lazy dog and runs into the dark wood where nobody ever goes at night "
    texts = [None, "", "   \n", "x", "The END", base, base, base + "once", base.upper(), "a b c　 d\n\n e  f \t", "🙂 voilà l'été d'Ångström", "longword" * 20_000, (base * 40).strip(), "12 345 <|endoftext|> z", "\x1c \x85 q", "one two", "Two One"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", 0, "x", "y", "z", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, base, None, None, 0, "x", "y", "z", 1)], ODD)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def pdf():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def test_word_hashes():
    texts = ["Ab c", "", None, "  ab\tC ", "é", "x" * 3_000_000 + " ab"]
    data, at = common.utf8(pa.array(texts))
    starts, ends, hashes, bounds = common.words(data, at)
    assert np.diff(bounds).tolist() == [2, 0, 0, 2, 1, 2]
    assert hashes[0] == hashes[2] == hashes[-1] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 4
    starts, ends, _, bounds = common.units(data, at)
    assert bytes(data[starts[0] : ends[0]]) == b"Ab" and bytes(data[starts[1] : ends[1]]) == b" c" and starts[0] == 0 and ends[-1] == len(data)
    assert (starts[1:] == ends[:-1]).all()


def test_starts(spark):
    rows = [(i * 5000 % 70_001, i % 7, "k" if i % 3 else None) for i in range(300)] + [(None, 4, "k"), (5000, 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, size long, key string")
    got = sorted((r.start, r["size"]) for r in common.with_starts(df, "size", ["doc_id", "size"], keys=["key"]).where("key is null").collect())
    assert [s for s, _ in got] == list(np.cumsum([0, *[n for _, n in got]])[:-1])


# 1 -------------------------------------------------------------------------


def test_language(spark, odd, nothing):
    out = queries.op1_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet"), on="doc_id")
    held = out[out.held_out]
    assert len(out) == 1000 and (held.lang_pred == held.lang).mean() > 0.97 and out.score.between(0, 1).all() and out.rejected.mean() < 0.01
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    model = language.fit(odd)
    got = language.predict(odd, model).toPandas().set_index("doc_id")
    assert got.lang_pred[[0, 1, 2]].tolist() == ["und"] * 3 and got.rejected[[0, 1, 2]].all() and (got.lang_pred[[5, 10]] == "en").all().all()
    assert language.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in language.predict(odd, language.fit(nothing)).collect()} == {"und"}
    foreign = spark.createDataFrame([(1, "съешь ещё этих мягких французских булок да выпей чаю " * 5)], "doc_id long, text string")
    assert language.predict(foreign, language.fit(spark.read.parquet(f"{SF}/documents.parquet"))).first().rejected


def test_language_copies(spark):
    """A text that a third of a language's rows share takes one place of the sample, wherever its hash puts it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("doc_id", "text", "lang")
    es = docs.where("lang = 'es'")
    n = es.count()
    drawn = es.where("pmod(xxhash64(text), 1000000) < 100000").orderBy(F.xxhash64("text")).limit(1)
    copies = drawn.crossJoin(spark.range(n // 2)).drop("id")
    once, often = language.fit(docs, per_language=n // 3), language.fit(docs.unionByName(copies), per_language=n // 3)
    assert once["langs"] == often["langs"]
    for k in ("idf", "centres", "reach"):
        assert np.allclose(once[k], often[k])
    got = language.predict(es, often).toPandas()
    assert (got.lang_pred == "es").mean() > 0.95 and got.rejected.mean() < 0.05


def test_language_counts_beyond_16_bits(spark):
    """A long repetitive text is learnt as it is scored: no count is cut."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"], 20)), "a") for i in range(20)] + [(20, "xyxyzz " * 90_000, "a"), (21, "qqq rrr " * 60, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, centroids=25)
    counts = language.ngram_counts(*common.utf8(pa.array([rows[20][1]])))
    assert counts.max() > 70_000
    exact = language.tfidf(counts, model["idf"])
    assert np.max(exact @ model["centres"].T) > 1 - 1e-6


def test_language_rejects_junk(spark):
    """Random letters are rejected whatever the sample's size and its oddest row; labelled documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs.where(queries.remainder(F.col("doc_id"), 5) != 0))
    rng = np.random.default_rng(1)
    base64 = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    junk = ["".join(rng.choice(a, n)) for a in (base64, list("abcdefghijklmnopqrstuvwxyz ")) for n in (100, 300, 1000, 2000, 8000) for _ in range(10)]
    got = language.predict(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), model).toPandas()
    assert got.rejected.all()
    # 5375 is one line, 'A. All rights reserved.', which is nearest to another language
    assert {r.doc_id for r in language.predict(docs, model).where("rejected").collect()} <= {5375}


def test_language_brute_force(spark, documents, pdf):
    """The nearest of all centroids by cosine, and the rejection rule, from counts of byte n-grams in plain Python."""
    model = language.fit(documents)
    shift = 33 - language.DIMENSIONS.bit_length()
    got = {r.doc_id: r for r in language.predict(documents, model).collect()}
    assert len(model["centres"]) == 4 * len(model["langs"]) and np.allclose(np.linalg.norm(model["centres"], axis=1), 1, atol=1e-5)
    for doc_id, text in zip(pdf.doc_id[:60], pdf.text[:60], strict=True):
        raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in lower(text).encode())
        counts = collections.Counter((((int.from_bytes(raw[i : i + n], "big") + n) * 2654435769) % (1 << 32)) >> shift for n in (2, 3) for i in range(len(raw) - n + 1))
        x = np.zeros(language.DIMENSIONS)
        for s, c in counts.items():
            x[s] = math.log1p(c) * model["idf"][s]
        cosines = model["centres"].astype(float) @ (x / max(np.linalg.norm(x), 1e-9))
        best = int(np.argmax(cosines))
        usual = math.sqrt(len(counts) / (len(counts) + language.HALF))
        r = got[doc_id]
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        lang = model["owner"][best]
        assert r.lang_pred == model["langs"][lang] and abs(r.score - max(cosines[best], 0)) < 1e-4
        if abs(cosines[best] - model["reach"][lang] * usual) > 1e-4:
            assert r.rejected == (cosines[best] < model["reach"][lang] * usual)


def test_ngrams_do_not_cross_texts():
    one = language.ngram_counts(*common.utf8(pa.array(["abcd"])))
    two = language.ngram_counts(*common.utf8(pa.array(["zz", "abcd", "yy"])))
    assert (one[0] == two[1]).all() and one.sum() == 5


# 2 -------------------------------------------------------------------------


def brute_model(texts, training):
    """Counts of a trigram model, its strengths, and p(w | u, v) by recursion over the orders; None is the end, 0 the start."""
    c = [collections.Counter(), collections.Counter(), collections.Counter()]
    follows = collections.Counter()
    for t, learn in zip(texts, training, strict=True):
        s = [0, *words_of(t), None]
        if learn:
            c[0].update((w,) for w in s[1:])
            c[1].update(zip(s, s[1:], strict=False))
            c[2].update(zip(s, s[1:], s[2:], strict=False))
            follows.update((w,) for w in s[:-1])
    n, v = sum(c[0].values()), len(c[0])
    mass = lambda counter: np.array([sum(x * k / (x + k) for x in counter.values()) for k in lmscore.GRID])
    once = lambda counter: sum(x == 1 for x in counter.values())
    k2, k3 = lmscore.strength(once(c[1]), mass(c[0])), lmscore.strength(once(c[2]), mass(c[1]))

    def p(w, history=()):
        if not history:
            return (c[0][(w,)] + 0.1) / (n + 0.1 * (v + 1))
        k, seen = (k2, follows[history]) if len(history) == 1 else (k3, c[1][history])
        return (c[len(history)][(*history, w)] + k * p(w, history[1:])) / (seen + k)

    return c[0], n, p


def brute_lm(texts, training):
    c, n, p = brute_model(texts, training)
    out = []
    for t in texts:
        s = [0, *words_of(t), None]
        base = sum(math.log10(p(w)) for w in s[1:])
        score = sum(math.log10(p(w, tuple(s[max(i - 1, 0) : i + 1]))) for i, w in enumerate(s[1:]))
        out.append((len(s) - 1, sum(c[(w,)] > 0 for w in s[1:]), n, base, score))
    return out


def test_lm_score(documents, pdf, odd, nothing):
    for df, frame in ((documents, pdf), (odd, odd.toPandas())):
        training = [zlib.crc32(("" if i != i or i is None else str(int(i))).encode()) % 10 != 0 for i in frame.doc_id]
        want = brute_lm(frame.text, training)
        got = lmscore.score(df, f"{queries.REMAINDER} % 10 <> 0", block_chars=60_000, range_chars=170_000).toPandas()
        key = lambda r: (r[0], r[1], r[2], round(r[3], 6), round(r[4], 6))
        assert sorted(map(key, got[["n_tokens", "n_known", "train_tokens", "base_score", "score"]].values.tolist())) == sorted(map(key, want))
    assert lmscore.score(nothing, "true").count() == 0
    only = lmscore.score(odd, "false").toPandas()
    assert (only.train_tokens == 0).all() and (only.n_known == 0).all()


def test_lm_one_hot_row(spark, documents):
    """A text that a third of all rows repeat, without ids, is dealt to many blocks and counted each time."""
    row = documents.where("length(text) > 2000").orderBy("doc_id").select(F.lit(None).cast("long").alias("doc_id"), "text").limit(1)
    rows = documents.select("doc_id", "text").unionByName(row.crossJoin(spark.range(100)).drop("id"))
    pdf = rows.toPandas()
    got = lmscore.score(rows, "true", block_chars=60_000, range_chars=170_000).toPandas()
    want = brute_lm(pdf.text, [True] * len(pdf))
    assert sorted(round(x, 6) for x in got.score) == sorted(round(w[4], 6) for w in want)


def test_lm_held_out(spark):
    """Held-out tokens are likelier than under a bigram mixture of one fixed strength (-3.29 at this size) and the base."""
    got = queries.op2_lm_score(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert held.score.sum() / held.n_tokens.sum() > -3.29 and held.base_score.sum() < held.score.sum()


def test_lm_states_sum_to_one():
    texts = ["a b a c", "b a", "c", "a b c"]
    _, _, p = brute_model(texts, [True] * 4)
    for history in ((), (0,), ("a",), ("c",), ("a", "b"), (0, "a"), ("b", "b"), ("unseen",)):
        assert abs(sum(p(w, history) for w in ("a", "b", "c", "unseen", None)) - 1) < 1e-9


def test_lm_automaton_by_hand():
    """Tokens 0 = a, 1 = b, 2 = end: an arc's weight differs from what its failure arcs give, and a walk takes the arc where there is one."""
    bigrams = np.array([[3, 0], [0, 1], [1, 0], [0, 2], [1, 2]]).T  # START a, a b, b a, a end, b end
    trigrams = np.array([[0, 1], [1, 2], [2, 3]]).T  # START a b, a b a, b a end
    machine = lmscore.Automaton(2, np.array([5, 3, 2]), (*bigrams, np.array([2, 3, 2, 1, 1])), (*trigrams, np.array([2, 1, 1])), 10.0, 3.0, 2.0, 1.0)
    p1 = [(x + 0.1) / (10 + 0.4) for x in (5, 3, 2)]
    p2 = {(3, 0): (2 + 2 * p1[0]) / 4, (0, 1): (3 + 2 * p1[1]) / 7, (1, 0): (2 + 2 * p1[0]) / 5, (0, 2): (1 + 2 * p1[2]) / 7, (1, 2): (1 + 2 * p1[2]) / 5}
    arc = (2 + p2[0, 1]) / 3  # from the state START a
    back = 1 / 3 * p2[0, 1]
    assert abs(arc - back) > 0.3
    # a b b end: START -a-> (START, a) -b-> (a, b), which has no arc b: to (b), which has none either: to the root
    want = p2[3, 0] * arc * (1 / 4) * (2 / 5) * p1[1] * p2[1, 2]
    assert abs(machine.walk(np.array([0, 1, 1, 2]), np.array([0, 4]))[0] - math.log10(want)) < 1e-12
    # side by side with a shorter one: (START, a) has no arc end, (a) has
    both = machine.walk(np.array([0, 2, 0, 1, 1, 2]), np.array([0, 2, 6]))
    assert abs(both[0] - math.log10(p2[3, 0] * (1 / 3) * p2[0, 2])) < 1e-12 and abs(both[1] - math.log10(want)) < 1e-12
    assert abs(lmscore.strength(4.0, np.interp(np.log(lmscore.GRID), [np.log(1), np.log(2)], [2, 8]) + 0) - lmscore.GRID[3] * 2 ** (np.log(2) / np.log(4))) < 1e-9


def test_lm_packing():
    rng = np.random.default_rng(0)
    for n, high in ((0, 9), (1, 9), (5000, 1 << 20), (5000, 1 << 63), (100_000, 1 << 45)):
        keys = np.unique(rng.integers(0, high, n, dtype=np.uint64))
        assert (lmscore.unpack_keys(lmscore.pack_keys(keys)) == keys).all()
    for counts in ([], [0, 3], [255, 256], [1 << 33]):
        assert lmscore.unpack_counts(lmscore.pack_counts(np.array(counts, np.int64))).tolist() == counts


# 3 -------------------------------------------------------------------------


def brute_phrases(t):
    known, out, i = set(), [], 0
    while i < len(t):
        n = 1
        while i + n < len(t) and t[i : i + n] in known:
            n += 1
        known.add(t[i : i + n])
        i += n
        out.append(i)
    return out, known


def test_phrases_and_likeness(pdf):
    for t in [*pdf.text[:20], "", "a", "aaaaaaa", "abababab🙂"]:
        assert lzprint.phrases(t)[0] == brute_phrases(t)[0]
    a, b = "the cat sat on the mat", "the cat sat on the hat"
    sets = [{x for x in brute_phrases(t)[1]} for t in (a, b)]
    assert abs(lzprint.compare(lzprint.fingerprint(a), lzprint.fingerprint(b)) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 1e-9
    assert lzprint.compare(lzprint.fingerprint(""), lzprint.fingerprint(None)) == 1 and lzprint.compare(lzprint.fingerprint(""), lzprint.fingerprint("x")) == 0


def test_edits(documents, odd, nothing):
    hashed = lambda df: [(r.doc_id if r.doc_id is not None else -(1 << 63), r.h, r.text, r.doc_id) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()]
    for df in (documents, odd):
        rows = sorted(hashed(df), key=lambda r: (-r[0], r[1]))
        texts = [r[2] for r in rows]
        after = texts[1:] + texts[:1]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after, strict=True)]
        rows_out = lzprint.with_next(df, 20_000)
        assert rows_out[1] > 1
        got = [tuple(r) for r in lzprint.edits(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]
        prints = {t: lzprint.fingerprint(t) for t in {*texts, *edited}}
        want = [(r[3], len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t], prints[e], lzprint.compare(prints[t], prints[e]), lzprint.compare(prints[t], prints[n])) for r, t, e, n in zip(rows, texts, edited, after, strict=True)]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert lzprint.edits(nothing).count() == 0


def test_equal_ids_part(spark):
    """Rows of one id, or without ids, are dealt to several ranges."""
    rows = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a text of its own, number "), F.col("id").cast("string")).alias("text"))
    dealt, n = lzprint.with_next(rows, 4000)
    assert n > 5 and dealt.where("not guest").groupBy("part").count().agg(F.max("count")).first()[0] < 150
    assert lzprint.edits(rows).count() == 400


def test_edits_over_ranges(spark, documents, monkeypatch):
    whole = lzprint.edits(documents).toPandas().sort_values("doc_id").reset_index(drop=True)
    real = lzprint.with_next
    monkeypatch.setattr(lzprint, "with_next", lambda df: real(df, 20_000))
    pd.testing.assert_frame_equal(lzprint.edits(documents).toPandas().sort_values("doc_id").reset_index(drop=True), whole)


def compared(rows, monkeypatch):
    """What op3's task makes of rows of one range, 50 to a batch, with the CPU seconds that it takes."""

    class Given:
        def select(self, *columns):
            return self

        def mapInArrow(self, task, schema):  # noqa: N802
            return task

    monkeypatch.setattr(lzprint, "with_next", lambda df: (Given(), 1))
    every = [*[(0, i, t, False) for i, t in enumerate(rows)], (0, 0, rows[0], True)]
    schema = pa.schema({"part": pa.int32(), "doc_id": pa.int64(), "text": pa.string(), "guest": pa.bool_()})
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*every[i : i + 50], strict=True), schema, strict=True)], schema=schema) for i in range(0, len(every), 50)]
    began = time.process_time()
    out = list(lzprint.edits(Given())(iter(batches)))
    return pa.Table.from_batches(out).to_pylist(), time.process_time() - began


def test_edits_in_few_seconds(pdf, monkeypatch):
    """Both parses, signatures and likenesses of a row take less than three times as long as one plain parse of its text."""
    texts = [t for t in pdf.text if t] * 4
    ratios = []
    for _ in range(3):
        began = time.process_time()
        for t in texts:
            known, piece = set(), ""
            for c in t:
                piece += c
                if piece not in known:
                    known.add(piece)
                    piece = ""
        plain = time.process_time() - began
        got, took = compared(texts, monkeypatch)
        assert len(got) == len(texts)
        ratios.append(took / plain)
    assert min(ratios) < 3, ratios


def test_edits_of_odd_texts(monkeypatch):
    """Narrow texts before wide ones and the other way round, runs, empty and long texts: as each text parsed on its own."""
    texts = ["", "a", "aa", "", "narrow text \xff " * 9, "中文字符 " * 300, "🙂" * 500, "x", "a" * 30_000, "".join(chr(i % 3000) for i in range(40_000)), "\x00\x00\x00\x01", "\x00" * 10, *("ab" * i for i in range(60)), "b" * 1_200_000, "end"]
    for t in texts[:-2]:
        assert lzprint.phrases(t)[0] == brute_phrases(t)[0]
    got, _ = compared(texts, monkeypatch)
    for i, (t, n, r) in enumerate(zip(texts, texts[1:] + texts[:1], got, strict=True)):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        sets = [brute_phrases(x)[1] for x in (t, e, n)] if max(len(t), len(n)) < 10_000 else None
        prints = [lzprint.fingerprint(x) for x in (t, e, n)]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(prints[:2])
        for other, near in ((1, r["near_edited"]), (2, r["near_next"])):
            assert near == lzprint.compare(prints[0], prints[other])
            if sets and max(map(len, sets)) <= lzprint.SIZE:
                union = sets[0] | sets[other]
                assert near == (len(sets[0] & sets[other]) / len(union) if union else 1) or len(union) > lzprint.SIZE


def test_signatures_where_few_hashes_are_small():
    """A trie whose hashes all lie above the expected bound still gives its smallest ones."""
    trie = lzprint.edges(lzprint.phrases("".join(chr(i % 3000 + 300) for i in range(9000)))[1])
    whole = np.unique((lzprint.spelled([trie], [21])[1] >> np.uint64(32)).astype(np.uint32))
    assert lzprint.signatures([trie, trie[:0], trie], [21, 8, 21])[2].tolist() == whole[: lzprint.SIZE].tolist()
    high = trie[np.isin((lzprint.spelled([trie], [21])[1] >> np.uint64(32)).astype(np.uint32), whole[2 * len(whole) // 3 :]) & (trie < 1 << 21)]
    assert len(high) > 500  # single code points, none of whose hashes is below the bound
    want = np.unique((lzprint.spelled([high], [21])[1] >> np.uint64(32)).astype(np.uint32))[: lzprint.SIZE]
    assert lzprint.signatures([high], [21])[0].tolist() == want.tolist() and len(want) == lzprint.SIZE


# 4 -------------------------------------------------------------------------


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        k = next(k for k in range(min(len(word) - i, 128), 0, -1) if word[i : i + k] in pieces or k == 1)
        i, n = i + k, n + 1
    return n


def test_token_counts(documents, pdf, odd, nothing):
    pieces = set(tokencount.vocabulary(VOCABULARY))
    for df, frame in ((documents, pdf), (odd, None)):
        frame = df.toPandas() if frame is None else frame
        want = []
        for t in frame.text:
            ws = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", t or "")]
            want.append((len(ws), sum(greedy(b" " + w, pieces) for w in ws)))
        got = tokencount.count_tokens(df, VOCABULARY).toPandas()
        assert sorted(map(tuple, got[["n_words", "n_tokens"]].values.tolist())) == sorted(want)
    assert tokencount.count_tokens(nothing, VOCABULARY).count() == 0


def test_automaton_small():
    machine = tokencount.Automaton((b"abc", b"ab", b"bcd", b"cdef"))
    for w in (b"abcd", b"abcdef", b"ababc", b"cde", b"xabcdx", b""):
        assert machine.count(w) == greedy(w, {b"abc", b"ab", b"bcd", b"cdef"})


# 5 -------------------------------------------------------------------------


def brute_topk(rows, every, k):
    ok = [(i, [math.floor(x * 256) for x in v]) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i is not None and i % every == 0:
            dot = lambda x: sum(a * b for a, b in zip(q, x, strict=False))  # noqa: B023, E731
            s = sorted((-dot(x), j is None, j or 0) for n, (j, x) in enumerate(ok) if n != at)[:k]
            out += [(i, r + 1, None if none else j, -n) for r, (n, none, j) in enumerate(s)]
    return sorted(map(repr, out))


def clustered(n, width=8, spread=0.1, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(int(i), [float(x) for x in centres[i % 6] + spread * rng.normal(size=width)]) for i in range(n)]


def test_exact_topk(spark, monkeypatch):
    rows = clustered(600)
    rows += [(600 + i, [0.25] * 8) for i in range(300)]  # ties
    rows += [(1000, None), (1050, []), (1100, [float("nan")] * 8), (1150, [None] * 8), (1200, [float("inf")] + [0.0] * 7), (1250, [0.5] * 3)]
    rows += [(50, [0.5] * 8), (50, [0.5] * 8), (None, [2.0] * 8), (-100, [-1.0] * 8)]  # repeated ids and rows, no id, below 0
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("block", F.lit("x")).withColumn("row", F.lit(1))
    want = brute_topk(rows, 50, 5)
    for salt, queries_, cells, slab in ((16_384, 512, 1 << 23, 1 << 18), (100, 3, 800, 4)):
        monkeypatch.setattr(knn, "SALT_ROWS", salt)
        monkeypatch.setattr(knn, "BLOCK_QUERIES", queries_)
        monkeypatch.setattr(knn, "TILE_CELLS", cells)
        monkeypatch.setattr(knn, "SLAB_QUERIES", slab)
        for pivots in (8, None):
            assert sorted(repr(tuple(r)) for r in knn.top_k(df, pivots=pivots).collect()) == want
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert knn.top_k(few.where("false")).count() == 0


def test_topk_large_components(spark):
    """Components beyond 2^31 and products beyond 2^53 are exact; what no long holds is an error."""
    rows = [(i, [i - 30.0, float(i), 0.25]) for i in range(1, 60) if i != 50]
    rows += [(100, [1e8, 3.0, 0.0]), (150, [0.0, 1e7, 1e7 + 1 / 256]), (200, [1.0, -1e7, 5e6]), (201, [1.0, 2e6 + 1 / 256, 2e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_topk(rows, 50, 5)
    assert sorted(repr(tuple(r)) for r in knn.top_k(df).collect()) == want and any(abs(int(w.split()[-1][:-1])) > 1 << 53 for w in want)
    for far in (1e300, 3.0e8):
        with pytest.raises(Exception, match="too large for a long"):
            knn.top_k(spark.createDataFrame([(0, [far] * 3), (1, [far] * 3)], "vec_id long, embedding array<double>")).collect()


def test_topk_bounds_prune(spark, monkeypatch):
    """On clustered vectors, less than half of the pairs of query block and vector are replicated."""
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 16)
    df = spark.createDataFrame(clustered(6000, 16), "vec_id long, embedding array<double>")
    plan = knn.exchange(df)
    blocks = plan.queries.select("block").distinct().count()
    assert blocks > 5 and sum(there for there, _ in plan.moved.values()) < 0.5 * blocks * 6000


def test_topk_turns_round(spark, monkeypatch):
    """Where bounds prune little the queries go to shares of the vectors; fewer rows move, the answers are the same."""
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(knn, "TILE_CELLS", 500 * 16)
    monkeypatch.setattr(knn, "SLAB_QUERIES", 64)
    small = np.random.default_rng(5).normal(size=(3000, 16)) / 1e6  # no answer to any query: this region sends few rows
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(small)]
    rows += [(3000 + i, [10 * x for x in v]) for i, v in clustered(1500, 16, 0.01)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plan = knn.exchange(df)
    there = {r for r, (there, back) in plan.moved.items() if there <= back}
    assert plan.passed is not None and there and len(there) < len(plan.moved)
    turned = [v for r, v in plan.moved.items() if r not in there]
    assert sum(back for _, back in turned) < 0.5 * sum(sent for sent, _ in turned)
    assert plan.needed.count() == sum(plan.moved[r][0] for r in there)
    assert sorted(repr(tuple(r)) for r in knn.top_k(df).collect()) == brute_topk(rows, 50, 5)


# 6 -------------------------------------------------------------------------


def labelled(spark, n=600):
    rng = np.random.default_rng(3)
    filler = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(filler, 30))
        toxic = i % 4 == 0
        if toxic:
            ws[rng.integers(30)] = str(rng.choice(["scumbag", "vermin"]))
            if i % 3:
                ws[0] = "muslims"  # groups are named more often in toxic texts
        elif i % 19 == 0:
            ws[0] = "muslims"
        rows.append((i, " ".join(ws), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark, odd, nothing):
    df = labelled(spark)
    fair, free = toxicity.fit(df), toxicity.fit(df, fairness=0.0)
    neutral = spark.createDataFrame([(1, "muslims word1 word2"), (2, "women word1 word2"), (3, "word1 word2"), (4, "Vermin! word1"), (5, None), (6, "")], "doc_id long, text string")
    score = lambda m: {r.doc_id: r.score for r in toxicity.predict(neutral, m).collect()}
    a, b = score(fair), score(free)
    assert a[4] > 0.5 > max(a[1], a[2], a[3], a[5], a[6]) and a[1] - a[3] < 0.3 * (b[1] - b[3])
    got = toxicity.predict(odd, fair)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.predict(nothing, fair).count() == 0
    assert {r.predicted for r in toxicity.predict(neutral, toxicity.fit(df.where("false"))).collect()} == {0}


def test_toxicity_solver():
    """The solution is where the loss, written out, has no slope, and the loss is convex; the gap of counterfactuals shrinks."""
    rng = np.random.default_rng(4)
    x = (rng.random((400, 12)) < 0.3).astype(np.int8)
    y = (x[:, 0] + x[:, 1] + 0.4 * x[:, 2] + 0.3 * rng.normal(size=400) > 0.8).astype(float)
    base, other = toxicity.swapped(x, np.array([2, 5, 7]))
    assert (base[:, [2, 5, 7]].any(axis=1)).all() and (other[: len(other) // 2][:, 5] == base[: len(base) // 2][:, 2]).all() and not other[len(other) // 2 :][:, [2, 5, 7]].any()

    def loss(w, fairness):
        z = x @ w[:-1] + w[-1]
        changed = (base.astype(float) - other) @ w[:-1]
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (0.1 * (w[:-1] ** 2).sum() + 1e-3 * w[-1] ** 2 + fairness * (changed**2).sum())

    gaps = []
    for fairness in (0.0, 10.0):
        w = toxicity.solve(x, y, base, other, 0.1, fairness)
        for i in range(len(w)):
            step = np.zeros(len(w))
            step[i] = 1e-4
            assert abs(loss(w + step, fairness) - loss(w - step, fairness)) / 2e-4 < 1e-3
        assert all(loss(w + 0.1 * rng.normal(size=len(w)), fairness) > loss(w, fairness) for _ in range(50))
        gaps.append(np.abs((base.astype(float) - other) @ w[:-1]).mean())
    assert gaps[1] < 0.2 * gaps[0]


def test_toxicity_sample(spark):
    """At most about the bound is taken, by labels; what several texts share an id for is bounded too; labels may name no document."""
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text").unionByName(spark.range(2000).selectExpr("7L as doc_id", "concat('more ', id) as text"))
    labels = spark.range(5000).selectExpr("id as doc_id", "cast(if(id % 9 = 0, null, id % 2) as int) as toxic")
    labels = labels.unionByName(labels.where("doc_id = 7"))
    taken = toxicity.sample(docs, labels, 500)
    assert taken.columns == ["doc_id", "text", "toxic"] and 200 < taken.count() < 700 and taken.where("toxic is null").count() == 0
    whole = toxicity.sample(docs, labels, 100_000)
    assert whole.count() == docs.join(labels.where("toxic is not null").distinct(), "doc_id").count()
    assert toxicity.sample(docs, labels.where("false"), 10).count() == 0


def test_toxicity_held_out(spark):
    out = queries.op6_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.98 and held[held.toxic == 0].predicted.mean() < 0.005


# 7 -------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap, target, open_ = {s: 2 * sizes[s] for s in names}, {}, set(names)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > cap[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {(None if i == 3 else f"s{i}"): int(rng.integers(0, 10 ** int(rng.integers(1, 6)))) for i in range(9)}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def swap_or_not(x, n, which, inverse=False):
    """The permutation with whole numbers of any size."""
    p, q = (1 << 31) - 1, (1 << 31) - 19
    rounds = [(pow(48_271, i + 1, p), pow(69_621, i + 1, p)) for i in range(12)]
    for a, b in reversed(rounds) if inverse else rounds:
        y = ((which + 1) * a % p * 65536 + (which + 1) * b % 65536 - x) % n
        if (max(x, y) % p * a + (which + 1) * b) % p * b % q // 32768 % 2:
            x = y
    return x


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 90_000_000_000])
def test_permutation(spark, n):
    """A bijection for any number of blocks, another one for each source and pass, without overflow."""
    js = list(range(n)) if n <= 1000 else [0, 1, 65_535, 65_536, n // 3, n - 1]
    df = spark.createDataFrame([(j,) for j in js], "j long")
    seen = {}
    for which in (0, 3, 4, 10**9):
        there = mixing.permuted("j", f"cast({n} as bigint)", f"cast({which} as bigint)")
        rows = df.select("j", F.expr(there).alias("x")).select("j", "x", F.expr(mixing.permuted("x", f"cast({n} as bigint)", f"cast({which} as bigint)", inverse=True)).alias("back")).collect()
        assert [r.back for r in rows] == js and [r.x for r in rows] == [swap_or_not(j, n, which) for j in js]
        assert n > 1000 or sorted(r.x for r in rows) == js
        seen[which] = tuple(r.x for r in rows)
    if n == 1000:
        assert len(set(seen.values())) == 4
        # neighbours are no longer neighbours, and few indexes stay where they were
        assert all(np.mean(np.abs(np.diff(x)) <= 2) < 0.02 and np.mean(np.array(x) == np.arange(n)) < 0.02 for x in seen.values())


def brute_mix(rows):
    """taken and the shards of each row, in plain Python: targets, permutation, draw and cut."""
    keyed = sorted(range(len(rows)), key=lambda i: rows[i][0])
    sizes = collections.Counter()
    for _, source, n in rows:
        sizes[source] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = brute_targets(sizes)
    plan, total = {}, 0
    for k, s in enumerate(order):
        want = min(math.floor(targets[s] + 0.5), 2 * sizes[s])
        blocks = -(-sizes[s] // 32)
        slots, left, j = [], want, 0
        while left > 0:
            block = swap_or_not(j % blocks, blocks, 2 * k + j // blocks)
            n = min(min(32, sizes[s] - 32 * block), left)
            slots.append((block, n))
            left, j = left - n, j + 1
        plan[s], total = (k, slots), total + len(slots)
    p, q, (a, b) = (1 << 31) - 1, (1 << 31) - 19, (pow(48_271, 8, (1 << 31) - 1), pow(69_621, 8, (1 << 31) - 1))
    shards = max(1, -(-total // mixing.SHARD_SLOTS))
    out, at = {}, collections.Counter()
    for s, (k, slots) in plan.items():
        drawn = sorted((j % p * a + (k + 1) * b) % p * b % q % shards for j in range(len(slots)))
        plan[s] = collections.defaultdict(list)
        for (block, n), shard in zip(slots, drawn, strict=True):
            plan[s][block].append((n, shard))
    for i in keyed:
        d, s, n = rows[i]
        got = [(min(at[s] + n, 32 * x + w) - max(at[s], 32 * x), shard) for x in range(at[s] // 32, (at[s] + n - 1) // 32 + 1) for w, shard in plan[s][x]] if n else []
        out[d] = (sum(w for w, _ in got if w > 0), len({shard for w, shard in got if w > 0}))
        at[s] += n
    return out


@pytest.mark.parametrize("slots", [8192, 40])
def test_mix_brute_force(spark, documents, monkeypatch, slots):
    """Also many sources of a few words: each takes its target; the draw shows in the shards."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", slots)
    tiny = spark.createDataFrame([(10_000 + i, "w " * (1 + i % 45), f"t{i // 2:03}") for i in range(90)], "doc_id long, text string, source string")
    df = documents.select("doc_id", "text", "source").union(tiny)
    rows = [(r.doc_id, r.source, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in df.collect()]
    got = mixing.mix_report(df).toPandas()
    assert {r.doc_id: (r.taken, r.shards) for r in got.itertuples()} == brute_mix(rows)
    for _, g in got.fillna({"source": "-"}).groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5
    assert got.shards.max() > 1 or slots > 1000
    assert sum(len(words_of(r.text)) for r in mixing.mix_documents(df).collect()) == got.taken.sum()


def test_mix(spark, documents, odd, nothing):
    for df in (documents, odd):
        rows = df.toPandas()
        sizes = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in rows.text]
        got = mixing.mix_report(df).toPandas()
        assert sorted(got["size"]) == sorted(sizes) and (got.taken <= 2 * got["size"]).all()
        again = mixing.mix_report(df).toPandas()
        key = ["doc_id", "source", "size", "taken"]
        assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
        for _, g in got.fillna({"source": "-"}).groupby("source"):
            assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5 and g["size"].sum() == g.source_size.iloc[0]
        mixed = mixing.mix_documents(df)
        assert mixed.columns == df.columns
        texts = mixed.toPandas()
        assert sum(len(words_of(t)) for t in texts.text) == got.taken.sum()
        whole = {w for t in rows.text for w in words_of(t)}
        assert {w for t in texts.text for w in words_of(t)} <= whole
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0


def test_mix_shards(spark, documents, monkeypatch):
    """Each slot has one shard and takes one block, a block has one slot in a pass, and a shard's counts are near their law."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 300)
    slots, placed = mixing.mix(documents)
    got = slots.toPandas()
    assert got.shard.nunique() == -(-len(got) // 300) > 3
    for _, g in got.groupby("source"):
        assert sorted(g.slot) == list(range(len(g))) and not g.duplicated(["pass", "block"]).any()
        expected = len(g) / got.shard.nunique()
        assert (g.groupby("shard").size() - expected).abs().max() < 5 * expected**0.5 + 5
    rows = mixing.mix_shards(slots, placed).toPandas()
    assert rows.groupby(["source", "slot"]).words.sum().max() == mixing.BLOCK and rows.words.sum() == got.words.sum() and rows.shard.nunique() == got.shard.nunique()


def test_mix_plan_is_native(documents):
    plan = mixing.mix_report(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# 8 -------------------------------------------------------------------------


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates(spark, documents, odd, nothing):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):  # families of edited copies
        base = list(rng.choice(vocabulary, 60))
        for _ in range(12):
            t = list(base)
            for k in rng.integers(0, 60, 3 + g % 4):
                t[k] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows), "the same passage that many share " * 3 + str(rng.integers(1 << 30))) for _ in range(30)]
    families = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("class", F.lit(2))
    for df in (families, documents, odd):
        for n in (2, 5):
            pairs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
            got = sorted(map(repr, map(tuple, neardup.near_duplicates(df, shingle_words=n).select("doc_id", "n_shingles", "component_id").collect())))
            assert got == sorted(map(repr, brute_components(pairs, n, 80)))
    assert neardup.near_duplicates(nothing).count() == 0


def test_crowds_just_below_the_threshold(spark, monkeypatch):
    """What is compared grows with the crowd, not with its square, and no link is lost: 95 common words and 12 own ones, likeness 0.797."""
    met = []

    def spied(f):
        def spy(rest, percent, alike):
            larger, smaller = neardup.with_bands(rest, percent)
            met[-1] += larger.join(smaller, neardup.BAND_KEY).count()
            return f(rest, percent, alike)

        return spy

    monkeypatch.setattr(neardup, "across_bands", spied(neardup.across_bands))
    common = [f"c{i}" for i in range(95)]
    for n in (300, 600, 1200):
        rng = np.random.default_rng(n)
        rows = [(i, " ".join(common + [f"o{i}.{k}" for k in range(12)])) for i in range(n)]
        # some of other sizes, some with links, one to another crowd member's text
        rows += [(n + i, " ".join(common[: 80 + i % 15] + [f"p{i}.{k}" for k in range(11)])) for i in range(40)]
        rows += [(n + 40 + i, rows[int(rng.integers(n))][1] + f" more{i}") for i in range(10)]
        met.append(0)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        if n == 300:
            assert got == {d: c for d, _, c in brute_components(rows, 2, 80)}
        assert len(got) == n + 50
    assert met[1] <= 2.2 * met[0] + 1000 and met[2] <= 2.2 * met[1] + 1000 and met[2] < 20_000, met


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 300)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 300: 200}


def test_crowds_of_one_id_and_text(spark):
    """A third of the rows has no id and the same text: they go to several tasks, in op3's ranges and op9's store."""
    rows = [(None, "the same text again and again " * 20)] * 400 + [(i, f"text {i} " * 30) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    dealt, n = lzprint.with_next(df, part_chars=30_000)
    sizes = [r["count"] for r in dealt.where("doc_id is null").groupBy("part").count().collect()]
    assert n > 6 and len(sizes) >= 3 and max(sizes) < 300
    got = lzprint.edits(df).toPandas()
    assert len(got) == 1200 and (got[got.doc_id.isna()].near_next > 0.99).sum() == 399  # after the last comes the first
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder = idstore.write_store(df, VOCABULARY, end=0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stage = spark.read.parquet(f"{folder}/stage").where("kind = 'recipe'").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in stage) == 1200 and max(r["count"] for r in stage) < 1.3 * 1200 / len(stage) and len(stage) > 2
    assert idstore.read_report(spark, folder, idstore.root(spark, folder)).count() == 1200


# 9 and 10 ------------------------------------------------------------------


def library_ids(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("path", "keep"), [(VOCABULARY, True), (WORDS, False)])
def test_encoder(odd, pdf, path, keep):
    texts = [r.text for r in odd.select("text").collect()] + pdf.text.tolist() + ["  lead", "tail  ", "a\n b", "a \nb", "it's we'LL", " x   y", "İstanbul ΣΑΣ J̌", "<|ENDOFTEXT|><|endoftext|>x"]
    coder = encoding.UnitEncoder(path, keep)
    ids, offsets = coder.encode(pa.array(texts, pa.string()), 7)
    want = library_ids(path, texts, 7)
    got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == want


def test_token_store(spark, documents, odd, nothing):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want = library_ids(VOCABULARY, [t for _, t in rows], 0)
        folder = idstore.write_store(df, VOCABULARY, 0)
        got = sorted(map(tuple, idstore.read_report(spark, folder).collect()), key=lambda r: r[1])
        key = lambda d: (d is not None, d or 0)
        assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist() and [key(r[0]) for r in got] == sorted(key(r[0]) for r in got)
        assert sorted((key(d), n, c) for d, _, n, c in got) == sorted((key(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(rows, want, strict=True))
        back = sorted((key(r.doc_id), r.ids) for r in idstore.reconstruct(spark, folder).collect())
        assert back == sorted((key(d), i) for (d, _), i in zip(rows, want, strict=True))
        names = [r.name for r in idstore.read_chunks(spark, folder).collect()]
        assert len(set(map(bytes, names))) == len(names)
        assert idstore.read_manifest(spark, folder).where("level = 0").agg(F.sum("documents")).first()[0] == len(rows)
    folder = idstore.write_store(nothing, VOCABULARY, 0)
    assert idstore.read_report(spark, folder).count() == 0


def test_store_notices_a_change(spark, documents, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(idstore, "RANGE", 500)
    monkeypatch.setattr(idstore, "FAN", 4)
    folder = idstore.write_store(documents.limit(60), VOCABULARY, 0, str(tmp_path / "s"))
    bad = idstore.read_chunks(spark, folder).withColumn("payload", F.expr("concat(payload, X'0100')"))
    with pytest.raises(Exception, match="other content"):
        bad.mapInArrow(idstore._read_chunk, "name binary, size long, crc long").collect()
    levels = idstore.read_manifest(spark, folder).groupBy("level").count().orderBy("level").collect()
    assert len(levels) > 2 and levels[-1]["count"] == 1
    known = idstore.root(spark, folder)
    idstore.verify(spark, folder, known)
    with pytest.raises(ValueError, match="another root"):
        idstore.verify(spark, folder, "0" * 64)
    rows = idstore.read_recipes(spark, folder).orderBy("start").collect()
    schema = idstore.read_recipes(spark, folder).schema
    swapped = [*rows[:3], rows[4], rows[3], *rows[5:]]
    swapped = [tuple(r)[:5] + (old.start,) for r, old in zip(swapped, rows, strict=True)]
    changed = [(r.doc_id + 1000 if i == 7 else r.doc_id, *tuple(r)[1:]) for i, r in enumerate(rows)]
    for i, other in enumerate((rows[:-1], [*rows, rows[0]], swapped, changed)):
        spoilt = str(tmp_path / f"s{i}")
        spark.createDataFrame(other, schema).write.parquet(f"{spoilt}/recipes")
        for part in ("stage", "manifest"):
            spark.read.parquet(f"{folder}/{part}").write.parquet(f"{spoilt}/{part}")
        with pytest.raises(ValueError, match="not those of the manifest"):
            idstore.read_report(spark, spoilt)
    other = spark.createDataFrame(rows, schema).withColumn("names", F.expr("substr(names, 17)"))
    with pytest.raises(Exception, match="other chunks"):
        other.select("start", "name", "names", "sizes").mapInArrow(idstore._expand, "chunk binary, start long, expected long, after long").collect()


def test_crc_of_parts():
    raw = np.random.default_rng(0).bytes(5000)
    cuts = [0, 16, 17, 3000, 5000]
    parts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    added = idstore.crc_followed_by(np.array([zlib.crc32(p) for p in parts], np.uint32), np.array([5000 - b for b in cuts[1:]]))
    assert np.bitwise_xor.reduce(added) == zlib.crc32(raw)


@pytest.mark.parametrize("sizes", [[], [1], [2048], [2049, 1], [5000, 300, 700, 20, 1, 1], list(range(1, 900, 7))])
def test_pack(sizes):
    out = packing.pack(sizes)
    for window in out:
        n = sum(p[2] for p in window)
        assert n <= 2048 and n & (n - 1) == 0
    covered = sorted((d, s, n) for w in out for d, s, n in w)
    assert all(n > 0 for _, _, n in covered)
    for doc, size in enumerate(sizes):
        pieces = [(s, n) for d, s, n in covered if d == doc]
        assert [s for s, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist() and sum(n for _, n in pieces) == size


def test_pack_documents(documents, odd, nothing):
    for df in (documents, odd):
        rows = [r.text for r in df.select("text").collect()]
        want = library_ids(WORDS, rows, 1)
        got = packing.pack_documents(df, WORDS).toPandas()
        assert got.length.sum() == sum(map(len, want))
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() == g.context.iloc[0] <= 2048
        assert got.groupby("step_group").length.sum().max() <= packing.STEP_TOKENS
        whole = got.drop_duplicates("sequence_id")
        for context, g in whole.groupby("context"):  # groups over all tasks: as few as hold them, no two apart by more than one sequence
            sizes = g.groupby("step_group").size()
            assert len(sizes) == -(-len(g) * context // packing.STEP_TOKENS) and sizes.max() - sizes.min() <= 1
        if len(whole) > 100:  # nothing is padded, and most ids stand in the longest windows
            assert (whole.context & (whole.context - 1) == 0).all() and whole.context[whole.context == 2048].sum() > 0.5 * whole.context.sum()
    ids = {r.doc_id: i for r, i in zip(documents.select("doc_id").collect(), library_ids(WORDS, [r.text for r in documents.select("text").collect()], 1), strict=True)}
    for r in packing.pack_documents(documents, WORDS).collect():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert packing.pack_documents(nothing, WORDS).count() == 0
