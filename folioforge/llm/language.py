"""Language identification by nearest clustered centroid.

Each text becomes a hashed byte n-gram vector, weighted by TF-IDF and
normalised; every language is described by several spherical k-means centroids,
and a text takes the language of the centroid with the largest cosine. As short
texts have small cosines, a cosine is compared with what the number of the text's
distinct n-grams lets expect; a text is rejected if it stays below ``slack`` times
the ``low`` quantile of that ratio among the language's training texts.

Defined cases: null text or text without a letter gives ``und``, score 0 and is
rejected; without training rows every text is ``und``. Ties go to the first
language in code-point order. Repeated rows are scored alike; other columns are
not looked at. The fit takes at most ``per_language`` distinct labelled texts of
each language, chosen by hash; everything else covers all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import LOWER, mix, slices, utf8

DIMENSIONS = 4096
UNKNOWN = "und"
#: Distinct n-grams at which a text's cosine is expected to be sqrt(1/2) of a very long text's.
HALF = 200
#: ASCII letters in lower case and all bytes of longer code points stay; the rest is one blank.
_KEEP = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in LOWER], np.uint8)
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def ngram_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed 2- and 3-byte grams, one row of DIMENSIONS for each text; no gram spans two texts."""
    n = len(at) - 1
    clean = _KEEP[data].astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    out = np.zeros(n * DIMENSIONS, np.int64)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    for size in (2, 3):
        if len(clean) < size:
            continue
        code = clean[: len(clean) - size + 1].copy()
        for k in range(1, size):
            code = (code << np.uint32(8)) | clean[k : len(clean) - size + 1 + k]
        slot = ((code + np.uint32(size)) * np.uint32(2654435769)) >> shift
        first = owner[: len(code)]
        same = first == owner[size - 1 :]
        out += np.bincount(first[same] * DIMENSIONS + slot[same], minlength=len(out))
    return out.reshape(n, DIMENSIONS)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x


def expected(counts: np.ndarray) -> np.ndarray:
    """What the number of distinct n-grams lets expect of a text's cosine, relative to a very long text."""
    n = (counts > 0).sum(axis=1)
    return np.sqrt(n / (n + HALF))


def has_letter(texts: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    out = found[at[1:]] > found[at[:-1]]
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from mutually distant starts."""
    centres = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]
        nearest = np.argmax(x @ c.T, axis=1)
        c = np.array([x[nearest == i].mean(axis=0) if (nearest == i).any() else c[i] for i in range(len(c))])
    return (c / np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]).astype(np.float32)


def fit(labelled: DataFrame, per_language: int = 1000, centroids: int = 4, slack: float = 0.5, low: float = 0.01) -> dict:
    """Fit on (text, lang), both non-null; at most ``per_language`` texts of each language, by hash of the text.

    Copies count as one text, so that a text that many rows share takes one place.
    """
    rows = labelled.select("text", "lang").where("text is not null and lang is not null").withColumn("_h", F.xxhash64("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.countDistinct("_h").alias("n")).collect()}
    if not sizes:
        return {"langs": [], "idf": None, "centres": None, "owner": None, "reach": None}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.3 * per_language / n))])
    # only the texts in reach are compared whole; their copies are merged before the shuffle
    near = rows.where(F.pmod("_h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))
    chosen = near.withColumn("_r", rank).where(F.col("_r") <= per_language).select("text", "lang")

    def sparse(batches):
        for b in slices(batches, rows=256):
            data, at = utf8(b.column("text"))
            counts = ngram_counts(data, at)
            found = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang").cast(pa.string()), pa.array([i.astype(np.uint16).tobytes() for i in found], pa.binary()), pa.array([c[i].astype(np.uint32).tobytes() for c, i in zip(counts, found, strict=True)], pa.binary())],
                names=["lang", "at", "n"],
            )

    got = chosen.mapInArrow(sparse, "lang string, at binary, n binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], r["at"], r["n"]))
    seen = np.zeros(DIMENSIONS, np.int64)
    for r in got:
        seen[np.frombuffer(r["at"], np.uint16)] += 1
    idf = (np.log((1 + len(got)) / (1 + seen)) + 1).astype(np.float32)
    langs, parts, reach = sorted({r["lang"] for r in got}), [], []
    for lang in langs:  # only one language's vectors are held in full
        own = [r for r in got if r["lang"] == lang]
        counts = np.zeros((len(own), DIMENSIONS), np.uint32)
        for i, r in enumerate(own):
            counts[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.uint32)
        x = tfidf(counts, idf)
        parts.append(_clusters(x, centroids))
        usual = np.maximum(expected(counts), 1e-9)
        reach.append(slack * float(np.quantile(np.max(x @ parts[-1].T, axis=1) / usual, low)))
    owner = np.concatenate([np.full(len(c), i) for i, c in enumerate(parts)])
    return {"langs": langs, "idf": idf, "centres": np.concatenate(parts), "owner": owner, "reach": np.array(reach)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Add lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected to every row of docs."""
    langs = np.array([*model["langs"], UNKNOWN], object)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 centroids a language of 4096 floats: bounded
    source = docs.select(*keep)

    def score(batches):
        m = shared.value
        for b in slices(batches, rows=256):
            data, at = utf8(b.column("text"))
            n = b.num_rows
            best, cosine, rejected = np.full(n, len(langs) - 1), np.zeros(n), np.ones(n, bool)
            if m["centres"] is not None:
                known = has_letter(b.column("text"), data, at)
                counts = ngram_counts(data, at)
                sims = tfidf(counts, m["idf"]) @ m["centres"].T
                top = np.argmax(sims, axis=1)
                value = np.clip(sims[np.arange(n), top].astype(float), 0, 1)
                best = np.where(known, m["owner"][top], best)
                cosine = np.where(known, value, 0.0)
                rejected = ~known | (value < m["reach"][np.minimum(best, len(m["reach"]) - 1)] * expected(counts))
            extra = [pa.array(langs[best].tolist(), pa.string()), pa.array(cosine), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*source.schema.fields, *added])
    return source.mapInArrow(score, schema)
