"""Token ids in a content-addressed store.

Every text is encoded and followed by the end id. A rolling hash over the ids
cuts the stream of each document into chunks, so that equal passages give equal
chunks wherever they stand. A chunk is named by its BLAKE2b digest and stored
once, as little-endian 16-bit ids; a document is a recipe, the list of its
chunks' names. Recipes lie in ascending doc_id order with the number of ids
before each document. The manifest is a Merkle tree: a document's leaf is the hash of
its recipe's name, id and place, a node the hash of the leaves of a range of places
(``RANGE`` ids), a node above it that of ``FAN`` nodes, and so on to the root. Reading
recomputes each chunk's name from its bytes, each recipe's from its chunks' names, and
the tree from the recipes, and fails on a difference: on a chunk or recipe that is
changed, removed, added or swapped, and, given the root, on a changed manifest.

Defined cases: null text is empty (one end id); a null doc_id comes first;
repeated rows are documents of their own, in the order of their names; an empty
table gives empty files. The folder lies under spark.checkpoint.dir unless given.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import mix, powers, shared_dir, slices, with_starts, written
from folioforge.llm.encoding import encoder

WINDOW, LEAST, MOST, MEAN_BITS = 16, 64, 1024, 8
_POLYNOMIAL = np.uint32(0xEDB88320)
_SPREAD = mix(np.arange(1, 65_537, dtype=np.uint64))
RANGE, FAN = 1 << 20, 1024


def cuts(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of each document's chunks: where the hash of the last WINDOW ids has MEAN_BITS zero bits, LEAST to MOST ids apart."""
    n = len(ids)
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_SPREAD[ids] * power[:n], out=total[1:])
    window = mix((total[WINDOW:] - total[: max(n + 1 - WINDOW, 0)]) * inverse[: max(n + 1 - WINDOW, 0)])
    spots = np.flatnonzero(window >> np.uint64(64 - MEAN_BITS) == 0) + WINDOW
    bounds = np.searchsorted(spots, offsets)
    out = []
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        last, ends = lo, []
        for spot in [*spots[bounds[i] : bounds[i + 1]].tolist(), hi]:
            while spot - last > MOST:
                last += MOST
                ends.append(last)
            if spot < hi and spot - last >= LEAST:
                last = spot
                ends.append(last)
        if last < hi:
            ends.append(hi)
        out.append(ends)
    return out


ROWS = "kind string, name binary, doc_id long, n_tokens long, payload binary, sizes binary"
_TYPES = {"kind": pa.string(), "name": pa.binary(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "payload": pa.binary(), "sizes": pa.binary()}


def _digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def _encode(path: str, end: int):
    """Texts to recipe rows, and to chunk rows the first time that this task meets a chunk."""

    def run(batches):
        coder, met = encoder(path, True), set()
        for b in slices(batches, most=2 << 20):
            ids, offsets = coder.encode(b.column("text"), end)
            out, at = [], 0
            for doc_id, ends in zip(b.column("doc_id").to_pylist(), cuts(ids, offsets), strict=True):
                begin, names, sizes = at, [], []
                for stop in ends:
                    payload = ids[at:stop].tobytes()
                    name = _digest(payload)
                    if name not in met:
                        met.add(name)
                        out.append(("chunk", name, None, None, payload, None))
                    names.append(name)
                    sizes.append(stop - at)
                    at = stop
                joined = b"".join(names)
                out.append(("recipe", _digest(joined), doc_id, at - begin, joined, np.array(sizes, "<u4").tobytes()))
            if len(met) > 500_000:
                met.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES.values())], names=list(_TYPES))

    return run


def _once(batches):
    """Chunk rows with a name met before in this partition go; all rows of a name are in one partition.

    The names held are those of the partition's unique chunks, 16 bytes for some 600 of payload.
    """
    met = set()
    for b in batches:
        keep = []
        for kind, name in zip(b.column("kind").to_pylist(), b.column("name").to_pylist(), strict=True):
            keep.append(kind == "recipe" or name not in met)
            if kind == "chunk":
                met.add(name)
        yield b.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, path: str, end: int, folder: str | None = None) -> str:
    """Write the store of docs' texts; returns its folder, with stage (kind=chunk: the chunks), recipes and manifest."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    rows = docs.select("doc_id", "text").mapInArrow(_encode(path, end), ROWS)
    # copies of a text, and rows of one id or of none, don't meet
    own = F.xxhash64("name", "doc_id", F.monotonically_increasing_id())
    rows.withColumn("_to", F.when(F.col("kind") == "chunk", F.xxhash64("name")).otherwise(own)).repartition("_to").drop("_to").mapInArrow(_once, ROWS).write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/stage")
    recipes = _stage(spark, folder, "recipe").select("doc_id", "name", "n_tokens", F.col("payload").alias("names"), "sizes")
    placed = with_starts(recipes, "n_tokens", ["doc_id", "name"])
    placed.repartitionByRange(F.col("start")).sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    tree(read_recipes(spark, folder)).write.parquet(f"{folder}/manifest")
    return folder


def _node(hashes: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("start", F.col(hashes).alias("h"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), ""), 256).alias("node")


def tree(recipes: DataFrame) -> DataFrame:
    """level, range, start, documents, n_tokens and node of the Merkle tree over the recipes; the highest level has the root alone."""
    told = [F.min("start").alias("start"), F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens")]
    leaf = F.sha2(F.concat_ws("|", F.hex("name"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens"), 256)
    leaves = recipes.select("start", "n_tokens", F.lit(1).cast("long").alias("documents"), leaf.alias("leaf"), F.floor(F.col("start") / RANGE).alias("range"))
    level = written(leaves.groupBy("range").agg(_node("leaf"), *told).withColumn("level", F.lit(0)))
    columns = ["level", "range", "start", "documents", "n_tokens", "node"]
    out, height, last = level.select(columns), 0, level.agg(F.max("range").alias("n")).first().n or 0
    while last > 0:
        height, last = height + 1, last // FAN
        level = written(level.withColumn("range", F.floor(F.col("range") / FAN)).groupBy("range").agg(_node("node"), *told).withColumn("level", F.lit(height)))
        out = out.unionByName(level.select(columns))
    return out


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("level int, range long, start long, documents long, n_tokens long, node string").parquet(f"{folder}/manifest")


def root(spark: SparkSession, folder: str) -> str | None:
    """The hash that stands for all ids of the store; None for an empty one."""
    found = read_manifest(spark, folder).agg(F.max_by("node", "level").alias("node")).first()
    return found.node


def verify(spark: SparkSession, folder: str, known_root: str | None = None) -> None:
    """Fail unless the recipes' tree is the manifest, and its root the known one."""
    if known_root is not None and root(spark, folder) != known_root:
        raise ValueError("the store has another root")
    on = ["level", "range"]
    stored = read_manifest(spark, folder).select(*on, F.col("node").alias("stored"))
    bad = tree(read_recipes(spark, folder)).select(*on, "node").join(stored, on, "full").where("not (node <=> stored)")
    if not bad.isEmpty():
        raise ValueError(f"the recipes are not those of the manifest: {bad.limit(3).collect()}")


def _stage(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{folder}/stage").where(F.col("kind") == kind)


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, name binary, n_tokens long, names binary, sizes binary, start long").parquet(f"{folder}/recipes")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _stage(spark, folder, "chunk").select("name", "payload")


def times_x(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of CRC-32 polynomials (bit-reflected) modulo its generator."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(len(a), np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLYNOMIAL, np.uint32(0))
    return out


def crc_followed_by(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds to the whole's when n_bytes follow it; the whole's CRC is the parts' exclusive or."""
    lengths, inverse = np.unique(n_bytes, return_inverse=True)
    factor = np.full(len(lengths), 1 << 31, np.uint32)
    square = np.full(1, 1 << 23, np.uint32)  # x^8: one byte
    left = lengths.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        factor[odd] = times_x(factor[odd], np.full(int(odd.sum()), square[0], np.uint32))
        square = times_x(square, square)
        left >>= 1
    return times_x(factor[inverse], crc)


def _read_chunk(batches):
    for b in batches:
        sizes, crcs = [], []
        for name, payload in zip(b.column("name").to_pylist(), b.column("payload").to_pylist(), strict=True):
            if _digest(payload) != name:
                raise ValueError(f"chunk {name.hex()} has other content than its name says")
            ids = np.frombuffer(payload, "<u2")
            sizes.append(len(ids))
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["name", "size", "crc"])


def _expand(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            names = part.column("names").to_pylist()
            if [_digest(n) for n in names] != part.column("name").to_pylist():
                raise ValueError("a recipe has other chunks than its name says")
            sizes = [np.frombuffer(s, "<u4").astype(np.int64) for s in part.column("sizes").to_pylist()]
            counts = [len(s) for s in sizes]
            after = [s.sum() - np.cumsum(s) for s in sizes]
            flat = [n[i : i + 16] for n in names for i in range(0, len(n), 16)]
            cols = [np.repeat(part.column("start").to_numpy(), counts), np.concatenate(sizes or [np.zeros(0, np.int64)]), np.concatenate(after or [np.zeros(0, np.int64)])]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.binary()), *map(pa.array, cols)], names=["chunk", "start", "expected", "after"])


def _shift(batches):
    for b in batches:
        if b.column("expected").to_pylist() != b.column("size").to_pylist():
            raise ValueError("a chunk has another length than a recipe says")
        crc = crc_followed_by(b.column("crc").to_numpy().astype(np.uint32), 4 * b.column("after").to_numpy())
        yield pa.RecordBatch.from_arrays([b.column("start"), b.column("size"), pa.array(crc.astype(np.int64))], names=["start", "size", "crc"])


def read_report(spark: SparkSession, folder: str, known_root: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the stored files, once their tree is verified.

    A document's CRC follows from its chunks' CRCs, so only names and numbers move.
    """
    verify(spark, folder, known_root)
    recipes = read_recipes(spark, folder)
    chunks = read_chunks(spark, folder).mapInArrow(_read_chunk, "name binary, size long, crc long")
    wanted = recipes.select("start", "name", "names", "sizes").mapInArrow(_expand, "chunk binary, start long, expected long, after long")
    # a chunk that many documents share is split by Spark's skew join; a missing one stays null and fails
    met = wanted.join(chunks, F.col("chunk") == F.col("name"), "left").select("start", "expected", "size", "crc", "after")
    found = met.mapInArrow(_shift, "start long, size long, crc long").groupBy(F.col("start").alias("_s")).agg(F.sum("size").alias("n_tokens"), F.expr("bit_xor(crc)").alias("ids_crc32"))
    return recipes.select("doc_id", "start").join(found, F.col("start") == F.col("_s")).select("doc_id", "start", "n_tokens", "ids_crc32")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and the array of ids of every document."""
    wanted = read_recipes(spark, folder).select("start", "name", "names", "sizes").mapInArrow(_expand, "chunk binary, start long, expected long, after long")
    met = wanted.join(read_chunks(spark, folder), F.col("chunk") == F.col("name"))
    whole = met.groupBy("start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("o"), F.hex("payload").alias("p")))), lambda x: x["p"]), "").alias("h"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("start"), pa.array([np.frombuffer(bytes.fromhex(h), "<u2").astype(np.int32) for h in b.column("h").to_pylist()], pa.list_(pa.int32()))], names=["start", "ids"])

    return read_recipes(spark, folder).select("doc_id", "start").join(whole.mapInArrow(run, "start long, ids array<int>"), "start").select("doc_id", "start", "ids")
