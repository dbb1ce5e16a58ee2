"""Near-duplicate detection by a signature-coordinate inverted join.

Each text is a set of word shingles with a minimum-hash signature of ``LONG``
coordinates. Texts with equal sets form a class. Classes are posted under each
(coordinate, value) of the first ``COORDINATES``. A pair above the threshold
agrees in at least ``matches`` of these (it misses that with a chance of 1e-6 at
most), so it must meet in a class's ``COORDINATES - matches + 1`` rarest ones:
only that prefix is posted, and values that one class has alone are skipped.
Collisions of a pair that meets are counted over the whole long signature, of
which two bits a coordinate travel with a posting, so pairs below the match
threshold go before any text is read. The rest is confirmed on the full sets.

No group's pairs are all made, and none is capped:

1. Each posting list is joined with one member only, its head: the member whose
   coordinates are the most common ones. That links the bulk of a group of copies,
   and components follow.
2. The members of long lists that still hold several components are posted once
   more, by the rarest of their shingles. Two sets above the threshold share one of
   those (prefix filter), and a member that its head could not link has rare
   shingles, so its lists are short. Each of these lists has a head as well.
3. The pairs across components that are left, in short lists of coordinates and in
   the lists of rare shingles, are made. Members of a list's largest component meet
   the others only. In a long list of a rare shingle two sets meet only if their sizes and the shingle's places
   in them leave room for enough common shingles: the key has the size bands of both, and a
   set is posted for the bands that it has room for (``with_bands``).

Defined cases: null, empty and blank texts have no shingles and stay alone;
texts shorter than a shingle are one whole sequence; repeated rows share a
class; a null doc_id gives a row whose component is the class's smallest id (null if none).
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import give_back, mix, slices, small_batches, utf8, words, written

COORDINATES = 32
LONG = 128
#: Longs that hold two bits of each coordinate of the long signature.
LANES = [f"l{i}" for i in range(LONG // 32)]
#: The chance to miss a pair that is just at the threshold, for each of both counts.
MISS = 1e-6
#: Ids that are broadcast at most (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 200_000
#: Members up to which all pairs of a posting list are compared.
SHORT_LIST = 32
#: Counters by which shingles are ordered from the rarest on.
BUCKETS = 1 << 19
#: Size bands: each size is in the band floor(BANDS * ln(size)).
BANDS = 64
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 62, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 62, LONG, dtype=np.uint64)


@functools.cache
def needed(n: int, chance: float) -> int:
    """The most agreements that n coordinates, each agreeing with this chance, fall short of with a chance of MISS at most."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n, m) * chance**m * (1 - chance) ** (n - m)
        if below > MISS:
            return m
    return n


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text."""
    _, _, hashes, bounds = words(data, at)
    chain = hashes.copy()
    for k in range(1, n):
        chain[:-k] = mix(chain[:-k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(chain[lo : hi - n + 1]))
        elif hi > lo:
            whole = np.uint64(hi - lo)
            for h in hashes[lo:hi]:
                whole = mix(np.array([whole ^ h], np.uint64))[0] + np.uint64(1)
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the LONG minimum hashes."""
    least = np.full(LONG, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        np.minimum(least, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def lanes(signatures: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates in a long; one row for each signature."""
    two = (signatures & 3).astype(np.uint64).reshape(len(signatures), len(LANES), 32)
    return (two << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, class (null without shingles), first coordinates and lanes of every text."""

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(*utf8(b.column("text")), n)
            keys = [class_key(s) if len(s) else None for s in sets]
            found = np.array([signature(s) for s in sets], np.uint32).reshape(len(sets), LONG)
            packed = lanes(found)
            columns = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in found[:, :COORDINATES]], pa.binary()), *(pa.array(packed[:, i]) for i in range(len(LANES)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class", "signature", *LANES])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, class long, signature binary, " + ", ".join(f"{x} long" for x in LANES))


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(class, shingles) of the wanted classes, written; the sets are made again from one text of each."""

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(*utf8(b.column("text")), n)
            keys = [class_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "shingles"])

    # by a hash, so that a null id is a key like any other; what it lets in besides has another class
    wanted = written(classes.join(wanted.select("class"), "class", "left_semi").select("class", F.xxhash64("doc_id").alias("_d")))
    named = wanted.select("_d")
    if wanted.count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    texts = docs.select("doc_id", "text").join(named, F.xxhash64("doc_id") == F.col("_d"), "left_semi")
    sets = texts.mapInArrow(run, "class long, shingles binary").where("class is not null")
    return written(sets.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"]))


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """(place, class, rank, size, lanes) for the rarest coordinates of each class that another class shares.

    A place is coordinate and value in one long. The rank grows with how common
    all of a class's coordinates are.
    """

    def explode(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(b.num_rows, COORDINATES)
            place = sig.astype(np.int64) * COORDINATES + np.arange(COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("class").to_numpy(), COORDINATES)), pa.array(place.ravel())], names=["class", "place"])

    every = classes.select("class", "signature").mapInArrow(explode, "class long, place long")
    shared = every.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    common = F.sum(F.floor(16 * F.log2("n"))).alias("rank")
    met = every.join(shared, "place").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "place"))).alias("p"), common)
    # the coordinates that no other class has come first in the order of rarity, and need no posting
    room = F.greatest(F.size("p") - F.lit(matches - 1), F.lit(0))
    posted = met.select("class", "rank", F.slice("p", 1, room)["place"].alias("places")).where("size(places) > 0")
    return posted.join(classes.select("class", "size", *LANES), "class").select(F.explode("places").alias("place"), "class", "rank", "size", *LANES)


def agreeing(x: str, y: str) -> str:
    """SQL: in how many coordinates of the long signature two rows with lanes agree, by two bits of each."""
    odd = 0x5555555555555555
    apart = lambda v: f"bit_count((({v}) | shiftright({v}, 1)) & {odd})"
    return f"{LONG} - (" + " + ".join(apart(f"({x}.{lane} ^ {y}.{lane})") for lane in LANES) + ")"


def likely(percent: int, x: str = "x", y: str = "y") -> str:
    """SQL: whether sizes and long signatures let two classes be alike."""
    least = needed(LONG, percent / 100 + (1 - percent / 100) / 4)
    return f"100 * least({x}.size, {y}.size) >= {percent} * greatest({x}.size, {y}.size) and {agreeing(x, y)} >= {least}"


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall into each of BUCKETS; that many numbers, whatever the data."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b.column("shingles").to_pylist():
                np.add.at(total, (np.frombuffer(x, np.uint64) % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = sets.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def rare_postings(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, columns of members, at) for the rarest shingles of each member.

    ``at`` is the shingle's place (from 0) in the set, from the rarest on. Sets of which ``least`` shingles must
    be common share one of the first ``size - least + 1`` in any order that all sets follow, also in that of
    counts which some shingles share; here ``least`` is for the smallest set that can be alike, and
    ``prefixes_meet`` looks at the pair's own sizes.
    """
    shared = sets.sparkSession.sparkContext.broadcast(bucket_counts(sets))

    def post(batches):
        counts = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                names, shingles, places = [], [], []
                for name, raw in zip(part.column("class").to_pylist(), part.column("shingles").to_pylist(), strict=True):
                    x = np.frombuffer(raw, np.uint64)
                    room = len(x) - -(-percent * len(x) // 100) + 1
                    first = np.lexsort((x, counts[(x % np.uint64(BUCKETS)).astype(np.int64)]))[:room]
                    names.append(np.full(len(first), name, np.int64))
                    shingles.append(x[first].view(np.int64))
                    places.append(np.arange(len(first), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (names, shingles, places)], names=["class", "shingle", "at"])

    return sets.mapInArrow(post, "class long, shingle long, at int").join(members, "class").select("shingle", *members.columns, "at")


def prefixes_meet(percent: int, x: str = "x", y: str = "y") -> str:
    """SQL: whether a common shingle lies in both prefixes of a pair of these sizes."""
    least = f"ceil({percent} * ({x}.size + {y}.size) / {100 + percent})"
    return f"{x}.at <= {x}.size - {least} and {y}.at <= {y}.size - {least}"


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have an intersection of ``percent`` of the union."""

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable, for each node of the edges (a, b) between different nodes.

    In each round every node follows the one with the most neighbours among its
    neighbours and itself, and so twice; the edges are then moved to where their
    ends came, and those within one node go. A star is done in one round.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left, steps = written(edges.select(*ends).where("a <> b").distinct()), []
    while not left.isEmpty():
        if len(steps) == most_rounds:
            raise RuntimeError("components did not settle")
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the number of neighbours, then an order drawn anew in each round
        rank = F.least(F.count("*"), F.lit((1 << 20) - 1)) * (1 << 42) + F.pmod(F.xxhash64("a", F.lit(len(steps))), F.lit(1 << 42))
        ranks = both.groupBy("a").agg(rank.alias("r"))
        reach = both.join(ranks.withColumnRenamed("a", "b"), "b").select("a", "r", "b").union(ranks.select("a", "r", F.col("a").alias("b")))
        up = written(reach.groupBy(F.col("a").alias("node")).agg(F.max_by("b", "r").alias("up")))
        step = written(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("to")), "up").select("node", "to"))
        steps.append(step)
        moved = left.join(step.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(step.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        left = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = steps.pop()
    while steps:
        later = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = steps.pop().join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    found = written(found)
    return found.join(found.groupBy("to").agg(F.min("node").alias("label")), "to").select("node", "label")


def pairs_of(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def with_heads(lists: DataFrame, key: str, alike: str) -> DataFrame:
    """The pairs (a, b) of each list's member of the highest rank and the members that may be like it."""
    columns = ["rank", "class", *(c for c in lists.columns if c not in (key, "rank", "class"))]
    heads = lists.groupBy(key).agg(F.max(F.struct(*columns)).alias("y"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return pairs_of(lists.alias("x").join(heads, key).where(F.expr(f"x.class <> y.class and {alike}")))


def with_main(lists: DataFrame, key: str) -> DataFrame:
    """The lists of several labels, written, with their number of members and whether each is ``outside`` of the list's most frequent label."""
    counts = lists.groupBy(key, "label").agg(F.count("*").alias("n"))
    main = counts.groupBy(key).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("members"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    return written(lists.join(main, key).withColumn("outside", F.col("label") != F.col("main")).drop("main"))


def across(rest: DataFrame, key: str, alike: str) -> DataFrame:
    """The pairs (a, b) of classes of different labels in the same list, with what ``with_main`` adds, that may be alike.

    Members of the list's most frequent label meet the others only.
    """
    apart = (F.col("x.label") != F.col("y.label")) & (~F.col("y.outside") | (F.col("x.class") < F.col("y.class")))
    return pairs_of(rest.where("outside").alias("x").join(rest.alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}")) & apart & F.expr(alike)))


def with_bands(rest: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of lists of rare shingles as the larger and as the smaller set of a pair, with keys under which only pairs with room meet.

    A pair has ``percent`` of its union in common only if its sizes together are at most (100 + percent) / percent times what
    either set has from the shingle on, so each set has a largest partner. The larger set is posted for the bands of
    partners no larger than itself, the smaller one for those no smaller. Members of the main label are
    posted as the smaller set for partners outside of it only.
    """
    most = F.expr(f"((size - at) * {100 + percent}) div {percent} - size")
    band = lambda c: F.floor(F.log(c) * BANDS).cast("int")
    ranged = lambda lo, hi: F.when(lo <= hi, F.sequence(band(lo), band(hi)))
    size, own = F.col("size"), band(F.col("size"))
    below = F.explode(ranged(F.ceil(size * percent / 100), F.least(size, most)))
    above = F.explode(ranged(size, F.least(F.floor(size * 100 / percent), most)))
    larger = rest.withColumn("small", below).withColumn("large", own).withColumn("meets", F.col("outside"))
    smaller = rest.withColumn("large", above).withColumn("small", own).withColumn("meets", F.explode(F.when(F.col("outside"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    return larger, smaller


BAND_KEY = ["shingle", "small", "large", "meets"]


def across_bands(rest: DataFrame, percent: int, alike: str) -> DataFrame:
    """What ``across`` gives for lists of rare shingles, whose rows have size and at, by the keys of ``with_bands``."""
    larger, smaller = with_bands(rest, percent)
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in BAND_KEY]
    once = F.expr("x.size > y.size or (x.size = y.size and x.class < y.class)")  # both of a size are posted as either
    met = (F.col("x.label") != F.col("y.label")) & once & F.expr(alike)
    return pairs_of(larger.alias("x").join(smaller.alias("y"), [*on, met]))


def labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists with each class's label, its own class where it has none."""
    named = labels.withColumnRenamed("node", "class").withColumnRenamed("label", "_label")
    return lists.join(named, "class", "left").withColumn("label", F.coalesce("_label", "class")).drop("_label")


def near_duplicates(docs: DataFrame, shingle_words: int = 2, percent: int = 80, matches: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs; see the module's head.

    ``matches`` defaults to the agreements of COORDINATES that MISS allows for ``percent``.
    """
    matches = matches or needed(COORDINATES, percent / 100)
    alike = likely(percent)
    rows = written(sketches(docs, shingle_words))
    least = [F.min(c).alias(c) for c in ("doc_id", "signature", *LANES)]
    classes = written(rows.where("class is not null").groupBy("class").agg(*least, F.min("n_shingles").alias("size")))
    posted = written(postings(classes, matches))

    def join_up(labels: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """The components with those of the pairs that are links; what is known of the components stands for its links."""
        sets = full_sets(docs, classes, ends_of(pairs), shingle_words)
        with small_batches(docs.sparkSession):
            links = written(confirmed(pairs, sets, percent))
        if labels is not None:
            links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links)
        return written(components(links))

    # 1. the head of each list against all of its members
    tried = written(with_heads(posted, "place", alike))
    labels = join_up(None, tried)

    # 2. the crowds: lists that are long and still hold several components
    named = labelled(posted, labels)
    still = named.groupBy("place").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("place", "n")
    rest = written(named.join(still, "place"))
    crowd = written(rest.where(F.col("n") > SHORT_LIST).select("class", "rank", "size", *LANES).distinct())
    rare, within = None, f"{alike} and {prefixes_meet(percent)}"
    if not crowd.isEmpty():
        rare = written(labelled(rare_postings(crowd, full_sets(docs, classes, crowd, shingle_words), percent), labels))
        second = written(with_heads(rare, "shingle", f"x.label <> y.label and {within}").join(tried, ["a", "b"], "left_anti"))
        labels, tried = join_up(labels, second), tried.union(second)

    # 3. what is left across components
    more = across(with_main(labelled(rest.where(F.col("n") <= SHORT_LIST).drop("n", "rank", "label"), labels), "place"), "place", alike)
    if rare is not None:
        lists = with_main(labelled(rare.drop("label"), labels), "shingle")
        long = F.col("members") > SHORT_LIST
        more = more.union(across(lists.where(~long), "shingle", within)).union(across_bands(lists.where(long), percent, within)).distinct()
    more = written(more.join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        labels = join_up(labels, more)

    grouped = classes.select("class", "doc_id").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    smallest = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = grouped.join(smallest, "label").select(F.col("class").alias("_class"), "component_id")
    out = rows.select("doc_id", "n_shingles", "class").join(by_class, F.col("class") == F.col("_class"), "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
