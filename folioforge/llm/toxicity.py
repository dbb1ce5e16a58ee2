"""Counterfactual-regularised toxicity classifier.

A logistic regression over the presence of telling words and word beginnings. For each labelled
text that names an identity group, the same text with the group swapped for
another group, and for a neutral word, is added as a counterfactual; the squared
change of its score is penalised, so that naming a group moves no score.

Defined cases: null and empty texts score the intercept; without labelled rows
of both classes every score is the share of positives (0 without rows). Rows of
``labels`` that repeat a doc_id count once each; null labels are left out.
At most ``most_rows`` labelled texts are used for the fit. ``sample`` chooses them by hash of
doc_id from the labels alone, so the documents are read once and only the chosen texts move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import LOWER, PUNCTUATION, slices, span_hashes, utf8, words, written

MOST_ROWS = 20_000
#: Rows that the solver turns into doubles at once.
SOLVE_ROWS = 2048

# Words that name a group of people, and neutral words to put in their place.
IDENTITY_TERMS = (
    "women men woman man girls boys female male muslim muslims islam christian christians jewish jews hindu hindus buddhist atheist "
    "black white asian latino african european arab mexican chinese indian american gay lesbian bisexual transgender straight queer "
    "immigrant immigrants refugee refugees disabled blind deaf elderly young old "
    "femmes hommes musulmans juifs noirs frauen muslime juden schwarze mujeres hombres musulmanes inmigrantes"
).split()
NEUTRAL_TERMS = "people person persons folks gens personnes leute menschen gente personas".split()

#: Bytes of the word beginnings that are features beside whole words, for inflected languages.
STEMS = (4, 5)


def hash_words(terms: list[str]) -> np.ndarray:
    raw = [t.lower().encode() for t in terms]
    ends = np.cumsum([len(r) for r in raw])
    return span_hashes(LOWER[np.frombuffer(b"".join(raw), np.uint8)], ends - [len(r) for r in raw], ends)


def hash_stems(terms: list[str]) -> np.ndarray:
    """The stem features that the terms' own beginnings would be."""
    return np.concatenate([hash_words([t.encode()[:n].decode("latin-1") for t in terms if len(t.encode()) > n]) ^ np.uint64(n) for n in STEMS])


def _distinct(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each word, and of the stem that begins each longer word, of each text; they repeat."""
    data, at = utf8(batch.column("text"))
    starts, ends, hashes, bounds = words(data, at, PUNCTUATION)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    owners, found = [owner], [hashes]
    for n in STEMS:
        longer = ends - starts > n
        owners.append(owner[longer])
        found.append(span_hashes(LOWER[data], starts[longer], starts[longer] + n) ^ np.uint64(n))
    return np.concatenate(owners), np.concatenate(found)


def presence(batch: pa.RecordBatch, features: np.ndarray) -> np.ndarray:
    """rows x features, 1 where the text has the word; ``features`` is sorted."""
    owner, hashes = _distinct(batch)
    out = np.zeros((batch.num_rows, len(features)), np.float32)
    if len(features):
        slot = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
        hit = features[slot] == hashes
        out[owner[hit], slot[hit]] = 1
    return out


def _choose(rows: DataFrame, positives: int, total: int, features: int, least: int, z: float) -> np.ndarray:
    """Hashes of the words whose share among toxic texts differs most from that among the others, by a two-proportion z."""

    def count(batches):
        for b in slices(batches):
            owner, hashes = _distinct(b)
            toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            order = np.lexsort((owner, hashes))
            h, o = hashes[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            u, inverse = np.unique(h[new], return_inverse=True)
            pos = np.bincount(inverse, weights=toxic[o[new]], minlength=len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(pos), pa.array(np.bincount(inverse, minlength=len(u)))], names=["h", "pos", "n"])

    seen = rows.mapInArrow(count, "h long, pos long, n long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).where(F.col("n") >= least)
    p, q = F.col("n") / total, F.col("pos") / positives - (F.col("n") - F.col("pos")) / (total - positives)
    score = F.abs(q) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / positives + 1 / (total - positives)))
    best = seen.withColumn("z", score).where(F.col("z") >= z).orderBy(F.desc("z"), "h").limit(features)
    return np.array([r.h for r in best.collect()], np.int64).view(np.uint64)


def swapped(x: np.ndarray, identity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with identity terms and their counterfactuals: each term replaced by the next one, and by a neutral word, which is no feature."""
    has = x[:, identity].any(axis=1) if len(identity) else np.zeros(len(x), bool)
    base = x[has]
    turned, plain = base.copy(), base.copy()
    turned[:, np.roll(identity, -1)] = base[:, identity]
    plain[:, identity] = 0
    return np.concatenate((base, base)), np.concatenate((turned, plain))


def _blocks(x: np.ndarray, intercept: float):
    """x in doubles, with a last column of one value, some rows at a time."""
    for lo in range(0, len(x), SOLVE_ROWS):
        part = x[lo : lo + SOLVE_ROWS]
        yield slice(lo, lo + len(part)), np.hstack((part.astype(np.float64), np.full((len(part), 1), intercept)))


def solve(x: np.ndarray, y: np.ndarray, base: np.ndarray, other: np.ndarray, ridge: float, fairness: float) -> np.ndarray:
    """Newton steps for the penalised logistic loss; returns the weights, the intercept last."""
    n = x.shape[1] + 1
    pull = np.diag(np.append(np.full(n - 1, ridge), 1e-3))
    for _, d in _blocks(base.astype(np.int8) - other.astype(np.int8), 0.0):
        pull += fairness * d.T @ d
    w = np.zeros(n)
    for _ in range(40):
        curve, slope = pull.copy(), pull @ w
        for at, part in _blocks(x, 1.0):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curve += (part * (p * (1 - p))[:, None]).T @ part
            slope += part.T @ (p - y[at])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most about ``most_rows`` labelled rows of docs, written; repeated rows count once.

    ``labels`` has doc_id and toxic, of the rows that may be learnt from.
    """
    marked = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_d"), F.col("toxic").cast("int").alias("toxic")).distinct()
    h = F.pmod(F.xxhash64("_d"), F.lit(1 << 40))
    total = marked.count()
    # a bounded number of ids and flags, whatever the size of labels
    chosen = marked.where(h < F.lit(min(1 << 40, int(most_rows / max(total, 1) * (1 << 40)))))
    rows = written(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_d")).select("doc_id", "text", "toxic").distinct())
    n = rows.count()
    if n > 1.1 * most_rows:  # ids that many texts share
        rows = written(rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(int(most_rows / n * (1 << 40)))))
    return rows


def fit(labelled: DataFrame, most_rows: int = MOST_ROWS, features: int = 512, least: int = 4, z: float = 5.0, ridge: float = 0.01, fairness: float = 10.0) -> dict:
    """Fit on (doc_id, text, toxic); ``most_rows`` bounds the labelled texts used."""
    rows = labelled.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    total = rows.count()
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    if total > most_rows:
        rows = rows.where(F.col("_h") < F.lit(int(1.1 * most_rows / total * (1 << 40)))).orderBy("_h").limit(most_rows)
    rows = written(rows.select("text", "toxic"))
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total, positives = sum(counts.values()), counts.get(1, 0)
    if not positives or positives == total:
        return {"features": np.zeros(0, np.uint64), "weights": np.array([30.0 if positives else -30.0])}
    identity, neutral = hash_words(IDENTITY_TERMS), hash_words(NEUTRAL_TERMS)
    # a group's name must not come back through its beginning, nor a neutral word be telling
    barred = np.concatenate((neutral, hash_stems(IDENTITY_TERMS), hash_stems(NEUTRAL_TERMS)))
    chosen = np.union1d(np.setdiff1d(_choose(rows, positives, total, features, least, z), barred), identity)

    def vectors(batches):
        for b in slices(batches, rows=1024):
            x = presence(b, chosen)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([np.flatnonzero(r).astype(np.uint16).tobytes() for r in x], pa.binary())], names=["toxic", "at"])

    got = rows.mapInArrow(vectors, "toxic int, at binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["toxic"], r["at"]))
    x = np.zeros((len(got), len(chosen)), np.int8)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.uint16)] = 1
    y = np.array([r["toxic"] for r in got], np.float64)
    base, other = swapped(x, np.searchsorted(chosen, identity))
    return {"features": chosen, "weights": solve(x, y, base, other, ridge, fairness)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) to every row of docs."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    source = docs.select(*keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` and the listed terms

    def score(batches):
        m = shared.value
        for b in slices(batches):
            logit = presence(b, m["features"]) @ m["weights"][:-1] + m["weights"][-1]
            s = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return source.mapInArrow(score, T.StructType([*source.schema.fields, *added]))
