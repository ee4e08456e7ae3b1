"""Near-duplicate documents by min-max hashing.

A text's set of word shingles is hashed once under each of PERMUTATIONS permutations, of which both the smallest and the
largest value are kept: two signature values from one evaluation. Bands of ROWS values make buckets. Texts with the
same set form one class, of which one member stands for all. Buckets of the same members count as one.

Links are confirmed on full sets. First every class meets the most connected member of its buckets. What the links found
so far leave apart in a bucket is then compared in blocks of BLOCK members: each class has a bitmap of its shingles,
and as different bits count different shingles, most pairs under the threshold are ruled out without their sets. Pairs
that may link go on, of each class the nearest few at first and more in each further pass, until no pair of a bucket that
could join two components is left. So no link between texts that share a bucket is lost, however large the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bloom
from millrace.llm.common import Scratch, parts, space_words
from millrace.llm.graph import components

#: 2 * PERMUTATIONS values make BANDS bands of ROWS. At similarity 0.8, 3 in a million pairs share no bucket.
PERMUTATIONS, ROWS = 80, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Comparisons of one text that stand in one group.
GROUP = 2000
#: Members of a bucket that are compared in one go, and how many pairs of a member pass on in the first pass.
BLOCK, FIRST = 256, 4
#: Bits of the smallest bitmap, for LEAST_BITS / 4 shingles; it doubles with the shingles up to the largest.
LEAST_BITS, MOST_BITS = 1 << 11, 1 << 17

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BAND_ORDER = _rng.permutation(2 * PERMUTATIONS)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than a shingle are one, none give none."""
    tokens = space_words(text) if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _FACTOR
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least and the greatest value under every permutation."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096, None] * _MULTIPLY + _ADD
        low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
    return np.concatenate([low, high])


def bands(sig: np.ndarray) -> np.ndarray:
    """A hash of each band, different for different bands."""
    rows = sig[_BAND_ORDER].reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ rows[:, k]) * _FACTOR
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of the shingles' hashes, as 64-bit words."""
    bits = LEAST_BITS
    while bits < 4 * len(shingles) and bits < MOST_BITS:
        bits *= 2
    on = np.zeros(bits, np.uint8)
    on[(shingles % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").view(np.uint64)


def halved(maps: np.ndarray) -> np.ndarray:
    """Bitmaps of half the bits."""
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, node (a 128-bit hash of the set, null for none) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in parts(batches):
            n, node, keys = [], [], []
            for t in texts:
                x = shingles(t, words)
                n.append(len(x))
                node.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                keys.append(bands(signature(x)) if len(x) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("th"),
                    pa.array(n, pa.int64()),
                    pa.array(node, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))),
                ],
                names=["doc_id", "th", "n_shingles", "node", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, n_shingles long, node binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, n, bits (the bitmap) and set (sorted hashes) of the wanted nodes (doc_id, th, node: one document of each).

    Texts are read where they lie; a Bloom filter leaves out most that are not wanted, and only sets are shuffled.
    """
    own = F.xxhash64("doc_id", "th")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").withColumn("own", own)
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted.select(own.alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in parts(bloom.kept(batches, "own", filter_.value)):
            sets = [shingles(t, words) for t in texts]
            columns = [
                piece.column("doc_id"),
                piece.column("th"),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([bitmap(x).tobytes() for x in sets], pa.binary()),
                pa.array([x.tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "bits", "set"])

    made = rows.mapInArrow(run, "doc_id long, th long, n long, bits binary, set binary")
    met = made.join(wanted, ["doc_id", "th"]).select("node", "n", "bits", "set")
    return met.dropDuplicates(["node"])  # a document that stands twice in the table


def may_link(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of two blocks of bitmaps (of one width) can have 100 * |intersection| >= percent * |union|, and for each
    pair the least number of shingles that only one of the two has, as a share of both sizes.

    A bit that is set in one map only is a shingle of one set only: if d of them differ and s is the sizes' sum, the
    intersection is (s - d) / 2 at most and the union (s + d) / 2 at least.
    """
    differ = np.empty((len(x), len(y)), np.int64)
    step = max(1, (1 << 20) // max(1, y.size))
    for at in range(0, len(x), step):
        differ[at : at + step] = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(-1)
    differ = np.maximum(differ, np.abs(nx[:, None] - ny[None, :]))
    sizes = nx[:, None] + ny[None, :]
    return differ * (100 + percent) <= sizes * (100 - percent), differ / sizes


def meet_before(bucket: int, buckets: list[list[int]]) -> np.ndarray:
    """Which pairs of members (with their lists of buckets) share a bucket before this one."""
    owner = np.repeat(np.arange(len(buckets)), [len(x) for x in buckets])
    every = np.concatenate([np.array(x, np.int64) for x in buckets])
    _, at, times = np.unique(every, return_inverse=True, return_counts=True)
    there = (every < bucket) & (times[at] > 1)
    _, at = np.unique(at[there], return_inverse=True)
    held = np.zeros((len(buckets), at.max() + 1 if len(at) else 0), np.float32)
    held[owner[there], at] = 1
    return held @ held.T > 0


def block_pairs(key: tuple[int, int, int], block, comp, n, bits: list[bytes], buckets: list[list[int]], percent: int, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions (a, b) of pairs between blocks i and j of a bucket (key: bucket, i, j) whose components differ, that share no
    bucket before and may link; of each a the ``most`` nearest, and whether any was left out."""
    bucket, i, j = key
    before = meet_before(bucket, buckets)
    words = np.array([len(x) // 8 for x in bits])
    maps = {w: np.array([np.frombuffer(bits[k], np.uint64) for k in np.flatnonzero(words == w)]) for w in set(words.tolist())}
    first, second, far = [], [], []
    for w, x in maps.items():
        px = np.flatnonzero(words == w)
        for v in (w, 2 * w):  # texts of sizes further apart can't link
            if v not in maps:
                continue
            py, y = np.flatnonzero(words == v), maps[v] if v == w else halved(maps[v])
            ok, share = may_link(x, n[px], y, n[py], percent)
            ok &= (comp[px][:, None] != comp[py][None, :]) & ~before[np.ix_(px, py)]
            if i != j:
                ok &= block[px][:, None] != block[py][None, :]
            if v == w:
                ok &= px[:, None] < py[None, :]
            a, b = np.nonzero(ok)
            first.append(px[a])
            second.append(py[b])
            far.append(share[a, b])
    a, b, far = np.concatenate(first), np.concatenate(second), np.concatenate(far)
    order = np.lexsort((far, a))
    a, b = a[order], b[order]
    turn = np.arange(len(a)) - np.searchsorted(a, a)
    return a[turn < most], b[turn < most], bool((turn >= most).any())


def dealt_blocks(held: DataFrame) -> DataFrame:
    """The rows with block and other: a row for each block that theirs meets. crowd: of the bucket's largest component, of ``size``
    members; m: the bucket's members."""
    count = lambda c: F.ceil(c / BLOCK).cast("int")
    rest, many = count(F.col("m") - F.col("size")), F.col("m") > BLOCK
    crowd = count(F.col("size"))
    hashed = F.xxhash64("node", F.lit(5))
    block = F.when(~many, 0).when(F.col("crowd"), rest + F.pmod(hashed, crowd)).otherwise(F.pmod(hashed, rest)).cast("int")
    last = F.when(~many, 0).when(F.col("crowd"), rest - 1).otherwise(rest + crowd - 1).cast("int")
    return held.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))


def apart_pairs(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """a, b: pairs of nodes that share a bucket, lie in two components and may link, each from the least bucket they share;
    and a null row if there are more.

    Members of a bucket's largest component (the crowd) do not meet each other. Above BLOCK members they are dealt into blocks of
    their own by a hash, and so are the others; blocks of others meet each other and the crowd's, every two in one task. So a row of
    the crowd is sent once for every BLOCK others, however large the crowd.
    """
    label = members.join(comp, "node", "left").select("bucket", "m", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = label.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    apart = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    held = label.join(apart.select("bucket", "top"), "bucket").join(sets.select("node", "n", "bits", "own"), "node")
    held = dealt_blocks(held.select("bucket", "m", "node", "comp", "n", "bits", "own", (F.col("comp") == F.col("top.comp")).alias("crowd"), F.col("top.n").alias("size")))
    held = held.select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node",
        F.xxhash64("comp").alias("comp"), "n", "bits", "own",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], []]
        more = False

        def work(key: tuple, rows: list[tuple]) -> bool:
            block, node, comp, n, own, bits = zip(*rows, strict=True)
            a, b, cut = block_pairs(key, np.array(block), np.array(comp), np.array(n), bits, own, percent, most)
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                out[0].append(max(node[p], node[q]))
                out[1].append(min(node[p], node[q]))
            return cut

        key, rows = None, []
        for piece, bits in parts(batches, "bits"):
            columns = [piece.column(c).to_pylist() for c in ("bucket", "i", "j", "block", "node", "comp", "n", "own")]
            for row in zip(*columns, bits, strict=True):
                if row[:3] != key:
                    if len(rows) > 1:
                        more |= work(key, rows)
                    key, rows = row[:3], []
                rows.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], names=["a", "b"])
            out[0].clear()
            out[1].clear()
        if len(rows) > 1:
            more |= work(key, rows)
        if more:
            out[0].append(None)
            out[1].append(None)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], names=["a", "b"])

    laid = held.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return laid.mapInArrow(run, "a binary, b binary").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with 100 * |intersection| >= percent * |union|.

    b's set is sent once for every GROUP pairs of b; each pair sends a's set. A text with many pairs is so spread over
    many groups.
    """
    salt = F.pmod(F.xxhash64("a"), F.floor(F.col("m") / GROUP) + 1)
    many = pairs.groupBy("b").agg(F.count("*").alias("m"))
    salted = pairs.join(many, "b").select("a", "b", salt.alias("salt"))
    left = salted.join(sets, salted.a == sets.node).select("b", "salt", F.lit(1).alias("kind"), "a", "set")
    heads = salted.select("b", "salt").distinct()
    right = heads.join(sets, heads.b == sets.node).select("b", "salt", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("a"), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for b, kind, a, own in zip(*(batch.column(c) for c in ("b", "kind", "a", "set")), strict=True):
                x = np.frombuffer(own.as_py(), np.uint64)
                if kind.as_py() == 0:
                    head = x
                    continue
                both = len(np.intersect1d(x, head, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(head) - both):
                    found[0].append(a.as_py())
                    found[1].append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in found], names=["a", "b"])

    laid = left.unionByName(right).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")
    return laid.mapInArrow(run, "a binary, b binary")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node and m (members) of the buckets that hold several nodes; of buckets of the same members, one."""
    places = nodes.select("node", F.explode("bands").alias("bucket"))
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    shared = places.groupBy("bucket").agg(F.count("*").alias("m"), *same).where("m > 1")
    one = shared.groupBy("m", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    return places.join(one, "bucket").select("bucket", "node", "m")


def first_pairs(members: DataFrame) -> DataFrame:
    """a, b: each node and, of the most connected members of its buckets, the most connected one."""
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    heads = members.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("head"))
    best = members.join(heads, "bucket").groupBy("node").agg(F.max("head").alias("head"))
    return best.select(F.col("node").alias("a"), F.col("head.node").alias("b")).where("a <> b")


def cluster(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, th, n_shingles, component_id and kept of every document row.

    A null or empty text has no shingles and is linked with nothing. A row without an id is never linked: its
    component_id is null and it is kept. Rows that repeat an id and text have the same result. An empty table gives none.
    Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    base = scratch.keep(signed(docs, words))
    linked = base.where("doc_id IS NOT NULL AND node IS NOT NULL")
    nodes = linked.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.first("bands").alias("bands"))
    members = scratch.keep(shared_buckets(nodes))
    wanted = linked.select("node", "doc_id", "th").join(members.select("node").distinct(), "node")
    wanted = wanted.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("one")).select("node", "one.*")
    wanted = scratch.keep(wanted)
    buckets = members.groupBy("node").agg(F.collect_list("bucket").alias("own"))  # BANDS at most
    sets = scratch.keep(shingle_sets(docs, wanted, words).join(buckets, "node"))

    tried = scratch.keep(first_pairs(members))
    links = scratch.keep(confirm(tried, sets, percent))
    comp = components(links, scratch)
    most = FIRST
    while True:
        found = scratch.keep(apart_pairs(members, comp, sets, percent, most))
        fresh = scratch.keep(found.where("a IS NOT NULL").join(tried, ["a", "b"], "left_anti"))
        more = not found.where("a IS NULL").isEmpty()
        scratch.drop(found)
        if not fresh.isEmpty():
            ends = fresh.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(F.xxhash64("node").alias("h"))
            near = sets.where(bloom.may_hold(ends, "h", F.xxhash64("node")))  # few sets are wanted again, and only these are shuffled
            new = scratch.keep(confirm(fresh, near, percent))
            tried = tried.unionByName(fresh)
            if not new.isEmpty():
                links = links.unionByName(new)
                scratch.drop(comp)
                comp = components(links, scratch)
        if not more:
            break
        most *= 8
    scratch.drop(sets, wanted, members)
    named = linked.select("doc_id", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    member = named.select("node", "comp").distinct().join(least, "comp").select("node", "component_id")
    out = base.select("doc_id", "th", "n_shingles", "node").join(member, "node", "left")
    component = F.when(F.col("node").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "th", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (see ``cluster``), with shingles of four words at 0.8."""
    return cluster(docs).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their columns, without those that link to one of a smaller id.

    Rows that repeat an id and text stay or go together.
    """
    gone = cluster(docs, words, percent).where(~F.col("kept")).select(F.xxhash64("doc_id", "th").alias("gone"))
    gone = Scratch(docs.sparkSession).keep(gone)
    return bloom.without(docs, gone, "gone", F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
