"""Exact top-k inner products by a pivot-distance index.

Vectors become integers, floor(64 x); equal ones are indexed once, with the smallest ids that have them. One more
coordinate, sqrt(M - |x|^2) with M the largest squared length, turns the largest inner product into the least distance:
|q - x|^2 = |q|^2 + M - 2 q.x. Each vector is keyed by its nearest pivot and its distance from it, sorted by that key and
cut into blocks: annuli around a pivot. A query's first bound is its k-th best score within its own block. From then on an
annulus [a, b] around pivot p can hold a better vector only if d(q, p) - r <= b and d(q, p) + r >= a, where r is the bound
as a distance (triangle inequality); the other annuli are never read. Pivots come from a bounded sample; every vector is
indexed and results are exact whatever the pivots.

Distances are of vectors scaled to components of one at most, with a slack above what rounding can do to them. Scores are
exact integers: where products of such size can't be summed exactly as floats, floats choose with their error as a margin
and the chosen are scored with integers of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

#: Fit parameters: pivots at least and at most (one for a block between), and vectors sampled (by a hash) to place them.
PIVOTS, SAMPLE = (64, 512), 4096
#: Vectors of a block at most, and components.
BLOCK, COMPONENTS = 2048, 1 << 20
#: A sortable score takes so many bytes (products of doubles' largest integers, summed).
WIDE_BYTES = 280


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and z, integers as doubles. Null ids and vectors, and vectors that hold a null or non-finite component (or one
    that 64 times is beyond a double), are left out."""
    v = F.transform("embedding", lambda x: x.cast("double") * 64)
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))  # NaN is greater than all numbers
    # doubles of 2**52 and more are integers
    z = F.transform(v, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), z.alias("z"))


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows, padded with zeros to dim."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == dim).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(lengths), dim))
    for k, (a, n) in enumerate(zip(offsets[:-1], lengths, strict=True)):
        out[k, :n] = values[a : a + n]
    return out


def place_pivots(sample: np.ndarray, top: float, pivots: int) -> np.ndarray:
    """Centres of the sample in the lengthened space: farthest-point starts, then three rounds of means."""
    if not len(sample):
        return np.zeros((1, sample.shape[1] + 1))
    x = np.hstack([sample, np.sqrt(np.maximum(0, top - (sample**2).sum(1)))[:, None]])
    centres = [x[0]]
    near = ((x - x[0]) ** 2).sum(1)
    while len(centres) < min(pivots, len(x)) and near.max() > 0:
        centres.append(x[near.argmax()])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(3):
        own = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        c = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
    return c


def distances(x: np.ndarray, tail: np.ndarray, c: np.ndarray) -> np.ndarray:
    """From each row of x, with one more coordinate tail, to each pivot."""
    d2 = ((x**2).sum(1) + tail**2)[:, None] - 2 * (x @ c[:, :-1].T + tail[:, None] * c[:, -1]) + (c**2).sum(1)
    return np.sqrt(np.maximum(0, d2))


class Space:
    """The scaled, lengthened space of a table of vectors: what tasks need to know of it."""

    def __init__(self, largest: float, dim: int):
        self.dim = dim
        self.exponent = math.frexp(largest)[1] if largest else 0  # components are under 2**exponent
        self.exact = 2 * self.exponent + math.ceil(math.log2(max(1, dim))) <= 53
        self.kind = np.int32 if self.exponent <= 31 else np.float64  # as it is stored
        self.top, self.error, self.slack, self.pivots = 0.0, 0.0, 0.0, np.zeros((1, dim + 1))

    def measure(self, top: float) -> None:
        """``top``: the largest squared length of a scaled vector."""
        rounding = (self.dim + 8) * 2.0**-52
        self.top = top
        self.error = 0.0 if self.exact else 2 * rounding * top  # of a scaled score
        self.slack = 4 * math.sqrt(4 * rounding * top)  # of a distance: of the root of a sum that may cancel out

    def scaled(self, z: np.ndarray) -> np.ndarray:
        return np.ldexp(z.astype(np.float64), -self.exponent)

    def pack(self, z: np.ndarray) -> bytes:
        return z.astype(self.kind).tobytes()

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.dim).astype(np.float64)

    def reach(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The bounds on scaled scores, as distances."""
        return np.sqrt(np.maximum(0, (x**2).sum(1) + self.top - 2 * bounds))

    def best(self, z: np.ndarray, others: np.ndarray, scores: np.ndarray, ids: list[np.ndarray], least: float, k: int) -> list[tuple]:
        """Of the rows of ``others`` (with several ids each) the k best for z, ties to smaller ids: (score, id, row).
        ``scores``: the scaled ones. None that must be under ``least``."""
        near = np.flatnonzero(scores >= least - self.error)
        if len(near) > k:
            cut = np.partition(scores[near], len(near) - k)[len(near) - k]
            near = near[scores[near] >= cut - 2 * self.error]
        if self.exact:
            exact = np.rint(np.ldexp(scores[near], 2 * self.exponent)).astype(np.int64).tolist()
        else:
            q = [int(v) for v in z]
            exact = [sum(a * int(b) for a, b in zip(q, others[r].tolist(), strict=True)) for r in near.tolist()]
        found = [(-s, i, r) for s, r in zip(exact, near.tolist(), strict=True) for i in ids[r].tolist()]
        return [(-s, i, r) for s, i, r in sorted(found)[:k]]


def sortable(score: int) -> bytes:
    return (score + (1 << (8 * WIDE_BYTES - 1))).to_bytes(WIDE_BYTES, "big")


def distinct_vectors(rows: DataFrame, k: int, every: int) -> DataFrame:
    """k1 and k2 (a hash), z, the k smallest ids (no more can be results of one query) and ``asks``, whether a query has it."""
    own = [F.xxhash64("z").alias("k1"), F.xxhash64("z", F.lit(1)).alias("k2")]
    turn = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    some = rows.select("*", *own).withColumn("turn", turn).where(F.col("turn") <= k)
    one = some.groupBy("k1", "k2").agg(F.first("z").alias("z"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(F.col("vec_id") % every == 0).select(*own).distinct().withColumn("asks", F.lit(True))
    return one.join(asked, ["k1", "k2"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))


BLOCKS = "block long, pivot int, a double, b double, n int, x binary, ids binary, counts binary, k1 binary, k2 binary, q binary, bounds binary"


def blocks_of(ordered: DataFrame, space: Space, k: int, block: int) -> DataFrame:
    """Blocks of vectors in order of pivot and distance; ``q``: the places of those that ask, and their bounds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, ended = TaskContext.get().partitionId() << 32, 0, None, False
        batches = iter(batches)
        while not ended:
            b = next(batches, None)
            ended = b is None
            if b is not None:
                lists = b.column("ids")
                new = [b.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "dist", "k1", "k2", "asks")]
                new += [matrix(b.column("z"), space.dim), np.array([np.array(x, np.int64) for x in lists.to_pylist()] + [None], object)[:-1]]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            while held is not None and len(held[0]):
                n = min(block, int(np.searchsorted(held[0], held[0][0], "right")))
                if n == len(held[0]) < block and not ended:
                    break  # more of this pivot may follow
                pivot, dist, k1, k2, asks, z, ids = (x[:n] for x in held)
                q, x, counts = np.flatnonzero(asks), space.scaled(z), np.array([len(i) for i in ids])
                bounds = []
                for at in q:
                    s = np.repeat(x @ x[at], counts)
                    bounds.append(np.partition(s, len(s) - k)[len(s) - k] - space.error if len(s) >= k else -np.inf)
                row = [
                    part + made, pivot[0], dist[0], dist[-1], n, space.pack(z), np.concatenate(ids).tobytes(), counts.astype(np.int64).tobytes(),
                    k1.tobytes(), k2.tobytes(), q.astype(np.int64).tobytes(), np.array(bounds, np.float64).tobytes(),
                ]
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32()] + [pa.binary()] * 7
                names = [c.split()[0] for c in BLOCKS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)
                made += 1
                held = [x[n:] for x in held]

    return ordered.mapInArrow(pack, BLOCKS)


def meetings(blocks: DataFrame, space: Space) -> DataFrame:
    """home and block: the blocks that queries of a home block must look into. No vector is in this table."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(space.pivots)
        for b in batches:
            for row in b.to_pylist():
                q, bounds = np.frombuffer(row["q"], np.int64), np.frombuffer(row["bounds"])
                if len(q):
                    x = space.scaled(space.unpack(row["x"])[q])
                    d, r = distances(x, np.zeros(len(q)), space.pivots), space.reach(x, bounds)[:, None]
                    columns = [np.full(m, row["block"], np.int64), np.arange(m, dtype=np.int32), (d - r).min(0) - space.slack, (d + r).max(0) + space.slack]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["home", "pivot", "lo", "hi"])

    asked = blocks.select("block", "x", "q", "bounds").mapInArrow(plan, "home long, pivot int, lo double, hi double")
    annuli = blocks.select("block", "pivot", "a", "b")
    return asked.join(annuli, "pivot").where((F.col("b") >= F.col("lo")) & (F.col("a") <= F.col("hi"))).select("home", "block")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by ``every``, its k best other rows.

    A row is never its own result, but another row of the same id can be. Vectors of unequal length are compared as if
    the shorter ended in zeros. Fewer rows than k + 1 give fewer results; an empty table gives none. A score beyond a
    long is the nearest long; ranks follow the true one. Other columns are not looked at.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = integers(vectors)
    distinct = scratch.keep(distinct_vectors(rows, k + 1, every))
    stats = distinct.agg(F.max(F.array_max(F.transform("z", F.abs))), F.max(F.size("z")), F.count("*")).first()
    space = Space(float(stats[0] or 0), int(stats[1] or 0))
    block = max(1, min(block, COMPONENTS // max(1, space.dim)))
    factor = math.ldexp(1.0, -space.exponent) if space.exponent < 1000 else 0.0
    scaled = lambda x: x * factor if factor else x * math.ldexp(1.0, -500) * math.ldexp(1.0, 500 - space.exponent)
    norm2 = F.aggregate("z", F.lit(0.0), lambda acc, x: acc + scaled(x) * scaled(x))
    space.measure(float(distinct.agg(F.max(norm2)).first()[0] or 0) * (1 + (space.dim + 8) * 2.0**-50))
    sample = distinct.orderBy("k1", "k2").limit(SAMPLE).select("z").toArrow()["z"].combine_chunks()
    many = pivots or max(PIVOTS[0], min(PIVOTS[1], int(stats[2]) // block))
    space.pivots = place_pivots(space.scaled(matrix(sample, space.dim)), space.top, many)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = space.scaled(matrix(b.column("z"), space.dim))
            d = distances(x, np.sqrt(np.maximum(0, space.top - (x**2).sum(1))), space.pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])], names=[*b.schema.names, "pivot", "dist"]
            )

    schema = "k1 long, k2 long, z array<double>, ids array<long>, asks boolean"
    keyed = distinct.select("k1", "k2", "z", "ids", "asks").mapInArrow(keys, f"{schema}, pivot int, dist double")
    order = ("pivot", "dist", "k1", "k2")
    ordered = keyed.repartitionByRange(max(1, math.ceil(int(stats[2]) / (4 * block))), *order).sortWithinPartitions(*order)
    blocks = scratch.keep(blocks_of(ordered, space, k + 1, block))
    asks = blocks.where("length(q) > 0").select(F.col("block").alias("home"), "x", "k1", "k2", "q", "bounds")

    def only_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            take = [np.frombuffer(r["q"], np.int64) for r in rows]
            columns = [
                b.column("home"),
                pa.array([space.pack(space.unpack(r["x"])[q]) for r, q in zip(rows, take, strict=True)], pa.binary()),
                *(pa.array([np.frombuffer(r[c], np.int64)[q].tobytes() for r, q in zip(rows, take, strict=True)], pa.binary()) for c in ("k1", "k2")),
                b.column("bounds"),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["home", "x", "k1", "k2", "bounds"])

    asks = asks.mapInArrow(only_queries, "home long, x binary, k1 binary, k2 binary, bounds binary")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    work = meetings(blocks, space).join(asks, "home").select(
        "block", F.lit(1).alias("kind"), "x", "k1", "k2", "bounds", none("ids", "binary"), none("counts", "binary"), none("pivot", "int"),
        none("a", "double"), none("b", "double"),
    ).unionByName(
        blocks.select("block", F.lit(0).alias("kind"), "x", "k1", "k2", none("bounds", "binary"), "ids", "counts", "pivot", "a", "b")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = z = y = ids = own = None
        for b in batches:
            for row in b.to_pylist():
                k1, k2 = np.frombuffer(row["k1"], np.int64), np.frombuffer(row["k2"], np.int64)
                if row["kind"] == 0:  # the block itself comes first, then the queries that need it
                    here, z, own = row, space.unpack(row["x"]), (k1, k2)
                    y = space.scaled(z)
                    ids = np.split(np.frombuffer(row["ids"], np.int64), np.cumsum(np.frombuffer(row["counts"], np.int64))[:-1])
                    continue
                q, bounds = space.unpack(row["x"]), np.frombuffer(row["bounds"])
                x = space.scaled(q)
                d, r = distances(x, np.zeros(len(x)), space.pivots[here["pivot"]][None])[:, 0], space.reach(x, bounds)
                near = np.flatnonzero((d - r - space.slack <= here["b"]) & (d + r + space.slack >= here["a"]))
                out = []
                for s, at in zip(x[near] @ y.T, near, strict=True):
                    for score, i, other in space.best(q[at], z, s, ids, bounds[at], k + 1):
                        out.append((k1[at], k2[at], i, score, own[0][other] == k1[at] and own[1][other] == k2[at]))
                if out:
                    a, c, found, score, same = zip(*out, strict=True)
                    longs = [min(max(v, -(1 << 63)), (1 << 63) - 1) for v in score]
                    wide = [None] * len(score) if space.exact else [sortable(v) for v in score]
                    columns = [(a, pa.int64()), (c, pa.int64()), (found, pa.int64()), (longs, pa.int64()), (wide, pa.binary()), (same, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["k1", "k2", "vec_id", "score", "wide", "own"])

    laid = work.repartition("block").sortWithinPartitions("block", "kind")
    found = laid.mapInArrow(search, "k1 long, k2 long, vec_id long, score long, wide binary, own boolean")
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("wide"), F.desc("score"), "vec_id")
    # k + 1 of them: a query is among the best of its own vector, or is not
    found = found.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= k + 1)
    asking = rows.where(F.col("vec_id") % every == 0).groupBy(F.xxhash64("z").alias("k1"), F.xxhash64("z", F.lit(1)).alias("k2"), F.col("vec_id").alias("query_id"))
    met = asking.agg(F.count("*").alias("times")).join(found, ["k1", "k2"])
    itself = F.col("own") & (F.col("vec_id") == F.col("query_id"))
    mine = F.row_number().over(Window.partitionBy("k1", "k2", "query_id", itself).orderBy("turn"))
    met = met.withColumn("mine", F.when(itself, mine)).where("mine IS NULL OR mine > 1")
    rank = F.row_number().over(Window.partitionBy("k1", "k2", "query_id").orderBy("turn"))
    ranked = met.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS z
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.z, c.z), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20
"""
