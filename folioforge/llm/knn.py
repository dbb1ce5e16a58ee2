"""Exact top-k by inner product as a Voronoi kNN join.

Pivots split the space into cells; a vector x goes to the cell of its nearest pivot
p and keeps its distance d to it. The queries of a cell, in parts of bounded size,
are summed up by their centre m, their radius r about it, and the lowest score that
all of them reach k times in a sample of their own cell or among the pivots. As

    q.x = m.x + (q - m).p + (q - m).(x - p) <= m.x + max (q - m).p + r * d,

a vector whose bound stays below that score is no answer to any of them. A coarser
bound, q.p + |q| * max d, first leaves out whole cells. Parts of neighbouring cells
form query blocks; a vector is sent once to each block with a part that needs it.
Each block is solved locally, split by salt, and the partial answers are merged.

Neighbouring cells also form regions. What a region would send is counted first: where
its bounds prune so little that fewer rows move the other way, the queries whose part
may have an answer there go to fixed shares of the region's vectors instead. A share is
held by one task, its queries pass by as a stream. Both ways give the same answers.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part; shorter vectors count as padded with zeros; only a query's own row is no
candidate of its own, other rows with its id are; rows without an id are candidates,
not queries; ties go to the smaller id, null last; repeated rows are rows of their own.
Scores are exact; a component or score that no long can hold raises an error.
"""

from __future__ import annotations

from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import written

#: Pivots at most: their number is the root of the number of rows; they are held by every task.
MOST_PIVOTS = 2048
BLOCK_QUERIES = 512
SALT_ROWS = 16_384
#: Rows of a cell's sample: so many of each of as many hash buckets.
SAMPLE = 48
#: Components of the vectors that a tile holds, and scores that it computes at once.
TILE_CELLS = 1 << 23
#: Queries that pass one copy of a tile's vectors.
SLAB_QUERIES = 1 << 18
#: Tasks at most among which the tiles are dealt.
MOST_TASKS = 20_000
#: Query parts that a share of a cell is compared with at once.
PARTS = 256

VECTOR = "row long, vec_id long, v binary, wide int"
VECTOR_COLUMNS = ["row", "vec_id", "v", "wide"]
TILE = ["region", "piece", "slab", "asks"]


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id and floor(scale * x) of every vector that takes part, as whole numbers of ``wide`` bytes."""
    ok = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double))"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.expr(ok))

    def run(batches):
        for b in batches:
            column = b.column("embedding")
            at = column.offsets.to_numpy()
            with np.errstate(over="ignore"):
                flat = np.floor(column.values.to_numpy() * scale)
            if len(flat) and not np.abs(flat).max() < 2.0**63:
                raise OverflowError("a component is too large for a long")
            raw, wide = [], []
            for s, e in zip(at[:-1], at[1:], strict=True):
                v = flat[s:e]
                wide.append(next((w for w in (2, 4) if np.abs(v).max() < 1 << (8 * w - 1)), 8))
                raw.append(v.astype(f"<i{wide[-1]}").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array(raw, pa.binary()), pa.array(wide, pa.int32())], names=VECTOR_COLUMNS)

    return rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "embedding").mapInArrow(run, VECTOR)


def matrix(table: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a table as rows of 64-bit whole numbers."""
    out = np.zeros((table.num_rows, width), np.int64)
    for i, (raw, wide) in enumerate(zip(table.column("v").to_pylist(), table.column("wide").to_pylist(), strict=True)):
        v = np.frombuffer(raw, f"<i{wide}")
        out[i, : len(v)] = v
    return out


class Vectors(NamedTuple):
    rows: np.ndarray
    ids: list
    x: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, width: int) -> Vectors:
        return cls(table.column("row").to_numpy(), table.column("vec_id").to_pylist(), matrix(table, width))

    @classmethod
    def by_id(cls, table: pa.Table, width: int) -> Vectors:
        return cls.of(table.sort_by([("vec_id", "ascending"), ("row", "ascending")]), width)  # null ids last


def products(queries: Vectors, data: Vectors) -> np.ndarray:
    """All inner products, exact: by doubles where these hold every sum, else by Python's whole numbers. A row's own is the lowest long."""
    q, x = queries.x, data.x
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    own = queries.rows[:, None] == data.rows[None, :]
    most = max(int(q.max()), -int(q.min())) * max(int(x.max()), -int(x.min())) * q.shape[1]
    if most < 1 << 53:
        exact = (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    else:
        exact = q.astype(object) @ x.astype(object).T
        exact[own] = 0
        if max(abs(s) for s in exact.ravel()) >= 1 << 63:
            raise OverflowError("a score is too large for a long")
        exact = exact.astype(np.int64)
    exact[own] = np.iinfo(np.int64).min
    return exact


def _assign(pivots: np.ndarray):
    norms = (pivots**2).sum(axis=1)

    def run(batches):
        for b in batches:
            x = matrix(b, pivots.shape[1]).astype(np.float64)
            cell = np.argmin(norms - 2 * x @ pivots.T, axis=1) if len(x) else np.zeros(0, int)
            d = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d)], names=[*b.schema.names, "cell", "d"])

    return run


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row of scores, its k largest and those equal to the last, by place."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    return scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]


def _answers(queries: Vectors, data: Vectors, k: int) -> pa.Table:
    """The k best of ``data``, which is in order of id, for each query."""
    names, ids, scores = [], [], []
    if len(queries.rows) and len(data.rows):
        s = products(queries, data)
        for i, (own, likely) in enumerate(zip(queries.rows.tolist(), _best(s, k + 1), strict=True)):
            at = np.flatnonzero(likely)
            at = at[data.rows[at] != own]
            at = at[np.argsort(-s[i, at], kind="stable")[:k]]
            names += [own] * len(at)
            ids += [data.ids[j] for j in at]
            scores += s[i, at].tolist()
    return pa.Table.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["row", "vec_id", "score"])


def _solve(k: int, width: int):
    """One query block with one share of its candidates: the k best of that share for each query."""

    def one(key, queries, data):
        return _answers(Vectors.of(queries, width), Vectors.by_id(data, width), k)

    return one


def _stream(k: int, width: int):
    """Tiles one after another, each its vectors first: these are held, the queries after them are answered a few at a time."""

    def run(batches):
        tile, held, data = None, [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            names = np.stack([t.column(c).to_numpy() for c in TILE])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
            for lo, hi in pairwise(cuts):
                if lo == hi:
                    continue
                *name, asks = names[:, lo].tolist()
                if name != tile:
                    tile, held, data = name, [], None
                piece = t.slice(lo, hi - lo)
                if not asks:
                    held.append(piece)
                    continue
                if data is None:
                    data = Vectors.by_id(pa.concat_tables(held or [piece.slice(0, 0)]), width)
                    held = []
                step = max(1, TILE_CELLS // max(1, len(data.rows)))
                for at in range(0, piece.num_rows, step):
                    yield from _answers(Vectors.of(piece.slice(at, step), width), data, k).to_batches()

    return run


def _passed(queries: DataFrame, summaries: DataFrame, placed: DataFrame, turned: DataFrame, tiles: int, k: int, width: int) -> DataFrame:
    """Solve the regions in ``turned`` (cell, region, pieces, slabs): each share of their vectors with the queries that may need it."""
    every = F.broadcast(turned)
    data = placed.join(every, "cell").withColumn("piece", F.pmod(F.xxhash64("row", F.lit(3)), F.col("pieces")).cast("int"))
    data = data.withColumn("slab", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1))).withColumn("asks", F.lit(0))
    parts = summaries.join(every, "cell").select(F.col("own").alias("cell"), "part", "region", "pieces", "slabs").distinct()
    asked = queries.join(parts, ["cell", "part"]).withColumn("slab", F.pmod(F.xxhash64("row", F.lit(4)), F.col("slabs")).cast("int"))
    asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("asks", F.lit(1))
    both = data.select(*TILE, *VECTOR_COLUMNS).unionByName(asked.select(*TILE, *VECTOR_COLUMNS))
    dealt = both.repartition(min(tiles, MOST_TASKS), *TILE[:-1]).sortWithinPartitions(*TILE)
    return dealt.mapInArrow(_stream(k, width), "row long, vec_id long, score long")


def _joined(queries: DataFrame, data: DataFrame, k: int, width: int) -> DataFrame:
    """Solve per (block, salt); a block's candidates are split into shares of about SALT_ROWS."""
    shares = data.groupBy("block").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("shares"))
    named = [F.col(c).alias(c) for c in ("block", "salt")]  # new columns: both sides come from the same shares
    salted = data.join(shares, "block").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int")).select(*named, *VECTOR_COLUMNS)
    spread = queries.join(shares, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(*named, *VECTOR_COLUMNS)
    return spread.groupBy("block", "salt").cogroup(salted.groupBy("block", "salt")).applyInArrow(_solve(k, width), "row long, vec_id long, score long")


def grouped_cells(centres: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """A group for each cell: about one for ``most`` of its ``rows``, of cells that lie together."""
    groups = max(1, -(-int(rows.sum()) // most))
    seeds, far = [int(np.argmax(rows))], np.full(len(centres), np.inf)
    while len(seeds) < min(groups, len(centres)):
        far = np.minimum(far, ((centres - centres[seeds[-1]]) ** 2).sum(axis=1))
        seeds.append(int(np.argmax(far)))
    return np.argmin((centres[seeds] ** 2).sum(axis=1) - 2 * centres @ centres[seeds].T, axis=1)


def _summarise(k: int, centres: np.ndarray, widest: np.ndarray):
    """One part of a cell's queries with a sample of its cell: a row for each cell that may hold an answer."""
    width, names = centres.shape[1], ["cell", "block", "own", "part", "asked", "m", "top", "r", "least"]

    def one(key, queries, near):
        rows = []
        if queries.num_rows:
            own_cell, part = (queries.column(c)[0].as_py() for c in ("cell", "part"))
            asking = Vectors.of(queries, width)
            q = asking.x
            s, p = products(asking, Vectors.of(near, width)), q.astype(np.float64) @ centres.T
            reached = np.full(len(q), -np.inf)
            if s.shape[1] > k:
                reached = np.sort(s, axis=1)[:, -k].astype(np.float64)
            own = ((q[:, None, :] == centres[None]).all(axis=2) if len(centres) * q.size < 1 << 24 else np.array([(centres == x).all(axis=1) for x in q]))
            others = np.sort(np.where(own, -np.inf, p), axis=1)  # pivots are rows too
            if p.shape[1] >= k:
                reached = np.maximum(reached, others[:, -k])
            m, least = q.mean(axis=0), reached.min()
            r, norm = np.sqrt(((q - m) ** 2).sum(axis=1).max()), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max())
            slack = 1e-3 + 1e-9 * (norm * (widest + np.sqrt((centres**2).sum(axis=1))) + np.abs(least if np.isfinite(least) else 0))
            top = (p - m @ centres.T).max(axis=0)
            for c in np.flatnonzero(p.max(axis=0) + norm * widest + slack >= least).tolist():
                rows.append((c, queries.column("block")[0].as_py(), own_cell, part, len(q), m.tobytes(), float(top[c] + slack[c]), float(r), float(least)))
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return one


def _wanted(data: pa.Table, parts: pa.Table, width: int) -> dict[int, np.ndarray]:
    """For each block, which of a share's vectors reach the bound of one of its parts."""
    wanted: dict[int, np.ndarray] = {}
    if data.num_rows and parts.num_rows:
        x, d = matrix(data, width).astype(np.float64), data.column("d").to_numpy()
        parts = parts.sort_by("block")
        block = parts.column("block").to_numpy()
        top, r, least = (parts.column(c).to_numpy() for c in ("top", "r", "least"))
        for lo in range(0, len(block), PARTS):
            m = np.array([np.frombuffer(v) for v in parts.column("m").slice(lo, PARTS).to_pylist()])
            reach = x @ m.T + top[lo : lo + PARTS] + np.outer(d, r[lo : lo + PARTS]) >= least[lo : lo + PARTS]
            for b in np.unique(block[lo : lo + PARTS]).tolist():
                hit = reach[:, block[lo : lo + PARTS] == b].any(axis=1)
                wanted[b] = wanted[b] | hit if b in wanted else hit
    return wanted


def _needed(width: int):
    """A share of a cell with the parts that may need it: its vectors, once for each block with a part whose bound they reach."""

    def one(key, data, parts):
        none = data.select(VECTOR_COLUMNS).slice(0, 0).append_column("block", pa.array([], pa.int64()))
        return pa.concat_tables([none, *(data.select(VECTOR_COLUMNS).filter(pa.array(hit)).append_column("block", pa.array([b] * int(hit.sum()), pa.int64())) for b, hit in _wanted(data, parts, width).items())])

    return one


def _counted(width: int):
    """How many rows ``_needed`` gives for a share of a cell."""

    def one(key, data, parts):
        pairs = sum(int(hit.sum()) for hit in _wanted(data, parts, width).values())
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pairs], pa.int64())], names=["cell", "pairs"])

    return one


class Exchange(NamedTuple):
    """The queries with their blocks, the vectors sent to blocks that need them, the answers of regions to which the
    queries went instead (None: no such region), and for each region the rows that move either way."""

    queries: DataFrame
    needed: DataFrame
    passed: DataFrame | None
    moved: dict[int, tuple[int, int]]
    width: int


def exchange(embeddings: DataFrame, every: int = 50, k: int = 5, pivots: int | None = None) -> Exchange:
    vectors = written(quantised(embeddings))
    found = vectors.agg(F.count("*").alias("n"), F.max(F.length("v") / F.col("wide")).alias("width")).first()
    width, pivots = int(found.width or 1), pivots or min(MOST_PIVOTS, max(8, int(found.n**0.5)))
    chosen = vectors.select(F.xxhash64("v").alias("h"), "v", "wide").groupBy("h").agg(F.min(F.struct("v", "wide")).alias("x")).orderBy("h").limit(pivots).select("x.*").toArrow()
    centres = matrix(chosen, width).astype(np.float64) if chosen.num_rows else np.zeros((1, width))
    placed = written(vectors.mapInArrow(_assign(centres), f"{VECTOR}, cell int, d double"))
    asks = F.coalesce(F.pmod("vec_id", F.lit(every)) == 0, F.lit(False))

    # one row for each pivot comes to the driver and goes out again
    cells = placed.groupBy("cell").agg(F.count_if(asks).alias("asked"), F.count("*").alias("n"), F.max("d").alias("widest")).collect()
    asked, size, widest = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf)
    for c in cells:
        asked[c.cell], size[c.cell], widest[c.cell] = c.asked, c.n, c.widest
    group = grouped_cells(centres, asked, BLOCK_QUERIES)
    inside = np.bincount(group, weights=asked)
    rows = [(c.cell, int(group[c.cell]), max(1, -(-int(inside[group[c.cell]]) // BLOCK_QUERIES)), -(-c.n // SALT_ROWS)) for c in cells]
    table = F.broadcast(embeddings.sparkSession.createDataFrame(rows, "cell int, group long, parts int, shares int"))
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    queries = written(placed.where(asks).join(table, "cell").withColumn("part", part).withColumn("block", F.col("group") * (1 << 32) + F.col("part")).select("block", "cell", "part", *VECTOR_COLUMNS))

    # the sample of each cell, drawn once, beside each part of its queries
    bucket = Window.partitionBy("cell", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(SAMPLE))).orderBy("row")
    sample = placed.withColumn("_n", F.row_number().over(bucket)).where(F.col("_n") <= SAMPLE).select("cell", *VECTOR_COLUMNS)
    near = queries.select("cell", "part").distinct().join(sample, "cell").select(F.col("cell").alias("cell"), F.col("part").alias("part"), *VECTOR_COLUMNS)
    summaries = queries.groupBy("cell", "part").cogroup(near.groupBy("cell", "part")).applyInArrow(_summarise(k, centres, widest), "cell int, block long, own int, part int, asked long, m binary, top double, r double, least double")
    summaries = written(summaries)

    share = F.pmod(F.xxhash64("row", F.lit(2)), F.col("shares")).cast("int")
    shared = placed.join(table, "cell").select(F.col("cell").alias("cell"), share.alias("share"), *VECTOR_COLUMNS, "d")
    bounds = ("block", "m", "top", "r", "least")
    spread = summaries.join(table, "cell").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(F.col("cell").alias("cell"), F.col("share").alias("share"), *bounds)

    # rows that move either way, one for each region, decide where its vectors and its queries meet
    most = max(1, TILE_CELLS // width)
    region = grouped_cells(centres, size, most)
    regions = embeddings.sparkSession.createDataFrame([(c.cell, int(region[c.cell])) for c in cells], "cell int, region int")
    pairs = shared.groupBy("cell", "share").cogroup(spread.groupBy("cell", "share")).applyInArrow(_counted(width), "cell int, pairs long").join(F.broadcast(regions), "cell").groupBy("region").agg(F.sum("pairs").alias("rows")).collect()
    asking = summaries.join(F.broadcast(regions), "cell").select("region", "own", "part", "asked").distinct().groupBy("region").agg(F.sum("asked").alias("rows")).collect()
    sent, asks = {r.region: r.rows for r in pairs}, {r.region: r.rows for r in asking}
    held = np.bincount(region, weights=size)
    pieces, slabs = {r: -(-int(held[r]) // most) for r in sent}, {r: max(1, -(-asks.get(r, 0) // SLAB_QUERIES)) for r in sent}
    moved = {r: (sent[r], asks.get(r, 0) * pieces[r] + int(held[r]) * slabs[r]) for r in sent}
    turned = {r for r, (there, back) in moved.items() if back < there}

    stay = F.broadcast(regions.where(~F.col("region").isin(*turned)).select("cell"))
    needed = written(shared.join(stay, "cell").groupBy("cell", "share").cogroup(spread.join(stay, "cell").groupBy("cell", "share")).applyInArrow(_needed(width), f"{VECTOR}, block long"))
    passed = None
    if turned:
        sizes = embeddings.sparkSession.createDataFrame([(c.cell, r, pieces[r], slabs[r]) for c in cells if (r := int(region[c.cell])) in turned], "cell int, region int, pieces int, slabs int")
        passed = _passed(queries, summaries, placed, sizes, sum(pieces[r] * slabs[r] for r in turned), k, width)
    return Exchange(queries, needed, passed, moved, width)


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``embeddings`` for each row whose vec_id is divisible by ``every``."""
    queries, needed, passed, _, width = exchange(embeddings, every, k, pivots)
    solved = _joined(queries, needed, k, width)
    solved = solved if passed is None else solved.unionByName(passed)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = queries.select("row", F.col("vec_id").alias("query_id"))
    return ranked.join(named, "row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
