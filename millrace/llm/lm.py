"""Language-model scoring by context-tree weighting.

A text is a sequence of tokens, its words and one end, coded as bytes: a word's own bytes and a space, a line break for
the end. Each byte is eight binary decisions. A decision's contexts are the last 0 to DEPTH bytes; every context holds a
Krichevsky-Trofimov estimate of each decision, and context-tree weighting mixes the estimates of all
depths: a node weighs its own estimate, one half, against the product of its children's weighted probabilities. The
mixture weights follow from counts alone.

Contexts of a token's first HEAD bytes reach over the space into the last two bytes of the token before; those of its
later bytes stay within the token. So all that the corpus says is in two tables, how often each head (two bytes before
and the first bytes) and each word occurs, and a text's code length is the sum of its heads' and of its words' rests:
each distinct one is coded once.

Every context that training texts hold is kept, so the tree grows with the corpus and stays a table. Each coded byte has
a context of NEAR bytes at least: the subtrees of the contexts that share their nearest NEAR bytes lie in one bucket, and
buckets are as many as the coded bytes ask for. Heads and words go in chunks, a row each: a chunk sends each bucket its
distinct places as one packed row and gets a row of as many code lengths back, so neither an item's name nor a place that
the chunk holds already travels twice. Only what the subtrees sum up to for the last two bytes goes to the driver and
back: the number of pairs of bytes bounds it, not the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fold, parts, space_words

DEPTH = 6
#: Nearest bytes of a context that say where its subtree lies.
NEAR = 3
#: Bytes of a token whose contexts reach into the token before.
HEAD = 4
#: Words and heads that are looked up beside the text; the others meet their counts by a join.
FREQUENT, FREQUENT_HEADS = 100_000, 500_000

EIGHT = np.uint64(8)


class Places:
    """Coded bytes: the number of the item they belong to, the byte, its context of depth DEPTH (nearest byte lowest), and
    how deep that reaches."""

    def __init__(self, item, byte, full, deep):
        self.item, self.byte, self.full, self.deep = item, byte, full, deep

    def code(self, d: int) -> np.ndarray:
        return self.full & np.uint64((1 << (8 * d)) - 1)


def text_heads(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each token of each text, its end included: the text's number, and the token's head as six bytes in one number:
    the two before the space (line breaks at a text's start), then HEAD bytes of the token and its space, filled up
    with line breaks."""
    parts = [b"\n\n " + b" ".join(w) + (b" \n" if w else b"\n") + b"\n" * HEAD for w in words]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    start = np.flatnonzero(raw == 32) + 1
    text = np.searchsorted(np.cumsum([len(x) for x in parts]), start, side="right")
    head = raw[start - 3].astype(np.uint64) << EIGHT | raw[start - 2]
    over = np.zeros(len(start), bool)
    for k in range(HEAD):
        b = np.where(over, np.uint8(10), raw[start + k])
        head = head << EIGHT | b
        over |= (b == 32) | (b == 10)
    return text, head


def head_places(heads: np.ndarray) -> Places:
    """The coded bytes of heads."""
    bytes_ = [heads >> np.uint64(8 * (HEAD - 1 - k)) & np.uint64(255) for k in range(HEAD)]
    context = heads >> np.uint64(8 * HEAD) << EIGHT | np.uint64(32)
    on, rows = np.ones(len(heads), bool), []
    for k, b in enumerate(bytes_):
        at = np.flatnonzero(on)
        rows.append((at, b[at], context[at], np.full(len(at), min(DEPTH, 3 + k))))
        context = (context << EIGHT | b) & np.uint64((1 << (8 * DEPTH)) - 1)
        on &= (b != 32) & (b != 10)
    item, byte, full, deep = (np.concatenate(x) for x in zip(*rows, strict=True))
    return Places(item, byte, full, deep)


def rest_places(words: list[bytes]) -> Places:
    """The coded bytes of words (and their spaces) after the first HEAD."""
    raw = np.frombuffer(b"".join([b" " + w + b" " for w in words]), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    full = np.zeros(len(raw), np.uint64)
    for d in range(1, min(DEPTH, len(raw)) + 1):
        back = np.concatenate([np.zeros(d, np.uint64), raw[:-d]])
        full |= np.where(place >= d, back, np.uint64(0)) << np.uint64(8 * (d - 1))
    coded = place > HEAD
    item = np.repeat(np.arange(len(words)), lengths)
    return Places(item[coded], raw[coded], full[coded], np.minimum(place, DEPTH)[coded])


def runs(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys of sorted ones, and each weight summed over them."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(w, first) if len(first) else w for w in weights)


def summed(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and each weight summed over them."""
    order = np.argsort(keys, kind="stable")
    return runs(keys[order], *(w[order] for w in weights))


def context_counts(at: Places, counts: np.ndarray, least: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth from ``least``: keys (context << 8 | byte), and how often the byte followed the context. ``counts``:
    of the items."""
    weight = counts[at.item]
    out = []
    for d in range(least, DEPTH + 1):
        there = at.deep >= d
        out.append(summed(at.code(d)[there] << EIGHT | at.byte[there], weight[there]))
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    """log(gamma(x)) for x > 0 by Stirling's series, after raising x by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: lgamma(n + 1/2) and lgamma(n + 1) for small n.
HALVES, WHOLES = (lgamma(np.arange(4096) + x) for x in (0.5, 1.0))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    out = np.empty(len(a))
    few = a + b < len(WHOLES)
    i, j = a[few].astype(np.int64), b[few].astype(np.int64)
    out[few] = HALVES[i] + HALVES[j] - WHOLES[i + j]
    x, y = a[~few], b[~few]
    out[~few] = lgamma(x + 0.5) + lgamma(y + 0.5) - lgamma(x + y + 1)
    return out - np.log(np.pi)


def decisions(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From sorted keys (context << 8 | byte) and their counts: nodes (context << 8 | decision), and how often each was 0 and
    1."""
    context, byte = keys & ~np.uint64(255), keys & np.uint64(255)
    levels = []
    for k in range(8):
        bit = (byte >> np.uint64(7 - k)) & np.uint64(1)
        zeros, ones = (np.where(bit == x, n, 0).astype(np.float64) for x in (0, 1))
        levels.append(runs(context | np.uint64(1 << k) | byte >> np.uint64(8 - k), zeros, ones))
    nodes, zeros, ones = (np.concatenate(x) for x in zip(*levels, strict=True))
    order = np.argsort(nodes, kind="stable")
    return nodes[order], zeros[order], ones[order]


def shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """The nodes of ``depth`` above nodes."""
    return (keys >> EIGHT & np.uint64((1 << (8 * depth)) - 1)) << EIGHT | keys & np.uint64(255)


class Tree:
    """Per depth from ``least``: sorted node keys (context << 8 | decision), the logarithm of their weighted probability and,
    once ``spread``, the probability that the decision is 1 when the node is the deepest known of its path.

    ``below``: of the deepest nodes, the sum of their children's logarithms, where the children are kept elsewhere.
    """

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int = 0, below: np.ndarray | None = None):
        self.least, self.keys, self.roots = least, [k for k, _, _ in nodes], nodes[0]
        n = len(nodes)
        self.weighted: list[np.ndarray] = [np.zeros(0)] * n
        self.kt = [(b + 0.5) / (a + b + 1) for _, a, b in nodes]
        self.stop: list[np.ndarray] = [np.zeros(0)] * n  # weight of the node's own estimate
        self.other: list[np.ndarray] = [np.zeros(0)] * n  # estimate of what no known child holds
        self.parent: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        for i in range(n - 1, -1, -1):
            keys, a, b = nodes[i]
            own = log_kt(a, b)
            under, ra, rb, has = np.zeros(len(keys)), a, b, np.zeros(len(keys), bool)
            if i < n - 1 and len(nodes[i + 1][0]):
                up, ca, cb = nodes[i + 1]
                p = self.parent[i + 1] = np.searchsorted(keys, shorter(up, least + i))
                count = lambda w, p=p, m=len(keys): np.bincount(p, weights=w, minlength=m)
                under, ra, rb = count(self.weighted[i + 1]), a - count(ca), b - count(cb)
                has[p] = True
            elif i == n - 1 and below is not None:
                under, ra, rb, has = below, np.zeros(len(keys)), np.zeros(len(keys)), np.ones(len(keys), bool)
            under = under + np.where(ra + rb > 0, log_kt(np.maximum(ra, 0), np.maximum(rb, 0)), 0.0)
            self.weighted[i] = np.where(has, np.logaddexp(own, under) + np.log(0.5), own)
            self.stop[i] = np.where(has, 1 / (1 + np.exp(np.clip(under - own, -700, 700))), 1.0)
            self.other[i] = np.where(ra + rb > 0, (rb + 0.5) / (ra + rb + 1), self.kt[i])

    def spread(self, done: np.ndarray | None = None, left: np.ndarray | None = None) -> Tree:
        """Sets ``ones``. ``done`` and ``left``: what the nodes above those of depth ``least`` make of the probability, and
        what they leave to them."""
        self.ones = []
        for i, keys in enumerate(self.keys):
            if i:
                before, rest = self.done[self.parent[i]], self.left[self.parent[i]]
            else:
                before = np.zeros(len(keys)) if done is None else done
                rest = np.ones(len(keys)) if left is None else left
            self.done = before + rest * self.stop[i] * self.kt[i]
            self.left = rest * (1 - self.stop[i])
            self.ones.append(self.done + self.left * self.other[i])
        return self

    @classmethod
    def fit(cls, levels: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
        """levels: as from ``context_counts``."""
        return cls([decisions(*x) for x in levels]).spread()

    def log10(self, at: Places, items: int, above: Tree | None = None) -> np.ndarray:
        """log10 probability of the coded bytes of each item. ``above``: the tree of the depths before ``least``."""
        sign = at.deep.astype(np.uint64) << np.uint64(61) | at.full << EIGHT | at.byte
        _, first, back = np.unique(sign, return_index=True, return_inverse=True)
        byte, deep = at.byte[first], at.deep[first]
        levels = [x for t in (above, self) if t is not None for x in zip(t.keys, t.ones, strict=True)]
        out = np.zeros(len(first))
        for k in range(8):
            decision = np.uint64(1 << k) | byte >> np.uint64(8 - k)
            bit = (byte >> np.uint64(7 - k)) & np.uint64(1)
            one = np.full(len(first), 0.5)
            unmet = np.ones(len(first), bool)
            for d in range(DEPTH, -1, -1):
                keys, ones = levels[d]
                here = np.flatnonzero(unmet & (deep >= d))
                if len(here) and len(keys):
                    key = at.code(d)[first[here]] << EIGHT | decision[here]
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    met = keys[place] == key
                    one[here[met]] = ones[place[met]]
                    unmet[here[met]] = False
            out += np.log10(np.where(bit == 1, one, 1 - one))
        return np.bincount(at.item, weights=out[back], minlength=items).astype(np.float64)


#: Entries that a task keeps before it passes sums on.
KEPT = 400_000
COUNTS = "kind int, word string, head long, n long"


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, train): kind 0, a word (END for the ends) and how often training texts hold it, 0 for words of other
    texts; kind 1, a head, the same."""

    def flush(words: Counter, heads: tuple) -> Iterator[pa.RecordBatch]:
        names = ["kind", "word", "head", "n"]
        if words:
            m = len(words)
            word = pa.array([w.decode() for w in words], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), word, pa.nulls(m, pa.int64()), pa.array(list(words.values()), pa.int64())], names
            )
        if len(heads[0]):
            m = len(heads[0])
            head = pa.array(heads[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.string()), head, pa.array(heads[1])], names
            )

    words: Counter = Counter()
    heads = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for piece, texts in parts(batches):
        split = [space_words(t or "") for t in texts]
        train = piece.column("train").to_pylist()
        learned = [w for w, t in zip(split, train, strict=True) if t]
        other = [w for w, t in zip(split, train, strict=True) if not t]
        for w in learned:
            words.update(w)
        if learned:
            words[b""] += len(learned)
        for some, counted in ((learned, 1), (other, 0)):
            if some:
                h, n = np.unique(text_heads(some)[1], return_counts=True)
                heads = summed(np.concatenate([heads[0], h]), np.concatenate([heads[1], n * counted]))
        for w in other:
            for x in w:
                if x not in words:
                    words[x] = 0
        if len(words) + len(heads[0]) > KEPT:
            yield from flush(words, heads)
            words, heads = Counter(), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    yield from flush(words, heads)


#: Coded bytes of a chunk, places of a bucket (if no NEAR bytes have more), and places whose trees stand in memory at once.
CODED, BUCKET, PIECE = 1 << 20, 1 << 20, 1 << 18

CHUNKS = "words array<string>, times array<long>, heads array<long>, uses array<long>, tokens long, known long, coded long"


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (word, head, n): rows of words and heads that have about CODED coded bytes together, with their counts, the sum of
    the words', how many words have one, and the coded bytes at most."""

    def chunk(held: list[pa.RecordBatch], coded: int) -> pa.RecordBatch:
        items = pa.Table.from_batches(held)
        words, heads = items.filter(pc.is_null(items["head"])), items.filter(pc.is_valid(items["head"]))
        lists = [words["word"], words["n"], heads["head"], heads["n"]]
        n = words["n"].to_numpy()
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.combine_chunks()) for x in lists]
        columns += [pa.array([int(x)], pa.int64()) for x in (n.sum(), np.count_nonzero(n), coded)]
        return pa.RecordBatch.from_arrays(columns, ["words", "times", "heads", "uses", "tokens", "known", "coded"])

    held, coded = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rests = pc.max_element_wise(pc.subtract(pc.binary_length(batch.column("word")), HEAD - 1), 0)
            coded += (pc.sum(rests).as_py() or 0) + HEAD * (batch.num_rows - batch.column("head").null_count)
            if coded > CODED:
                yield chunk(held, coded)
                held, coded = [], 0
    if held:
        yield chunk(held, coded)


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Values of 8 bytes, first bytes first, compressed; of rising ones, the steps."""
    if rising:
        x = np.diff(x, prepend=x[:1] * 0)
    return pa.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, m: int, kind: type, rising: bool = False) -> np.ndarray:
    """The m values that ``pack`` was given."""
    raw = np.frombuffer(pa.decompress(data, 8 * m, "zstd", asbytes=True), np.uint8)
    x = np.ascontiguousarray(raw.reshape(8, m).T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if rising else x


class Chunk:
    """A chunk's items and places. ``keys``: the distinct places in order, the nearest NEAR bytes of the context first, then its
    depth, its other bytes and the coded byte; ``item`` and ``place``: of each coded byte; ``spots``: by bucket, its places."""

    def __init__(self, row: dict, buckets: int):
        self.words, self.heads, self.n = row["words"], row["heads"], np.array(row["times"] + row["uses"], np.int64)
        rest, head = rest_places([w.encode() for w in self.words]), head_places(np.array(self.heads, np.int64).astype(np.uint64))
        full, byte, deep = (np.concatenate([getattr(x, k) for x in (rest, head)]).astype(np.uint64) for k in ("full", "byte", "deep"))
        self.item = np.concatenate([rest.item, head.item + len(self.words)])
        other = full >> np.uint64(8 * NEAR) << EIGHT | byte
        near = full & np.uint64((1 << (8 * NEAR)) - 1)
        self.keys, self.place = np.unique(near << np.uint64(35) | deep << np.uint64(32) | other, return_inverse=True)
        mixed = (self.keys >> np.uint64(35)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)
        bucket = (mixed >> EIGHT) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        self.spots = {b: order[first[b] : first[b + 1]] for b in np.flatnonzero(np.diff(first)).tolist()}


PLACES = "bucket int, chunk long, m long, keys binary, n binary"


def placed(buckets: int):
    """From chunks: for each bucket the places of the chunk, and how often each was coded in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                c = Chunk(row, buckets)
                n = np.bincount(c.place, weights=c.n[c.item], minlength=len(c.keys)).astype(np.int64)
                out = [(b, row["chunk"], len(at), pack(c.keys[at], True), pack(n[at])) for b, at in c.spots.items()]
                if out:
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "m", "keys", "n"])

    return run


def pieces(keys: np.ndarray) -> Iterator[slice]:
    """Cuts a bucket's places about every PIECE; those of one ``near`` are never parted."""
    near = keys >> np.uint64(35)
    at = 0
    while at < len(keys):
        stop = int(np.searchsorted(near, near[min(at + PIECE, len(keys)) - 1], side="right"))
        yield slice(at, stop)
        at = stop


def subtree(keys: np.ndarray, n: np.ndarray) -> tuple[Tree, Places]:
    """The tree from depth NEAR of places that are distinct and in order, and the places."""
    far = keys & np.uint64((1 << 32) - 1)
    at = Places(np.arange(len(keys)), far & np.uint64(255), far >> EIGHT << np.uint64(8 * NEAR) | keys >> np.uint64(35), (keys >> np.uint64(32) & np.uint64(7)).astype(np.int64))
    known = Places(*(x[n > 0] for x in (at.item, at.byte, at.full, at.deep)))
    return Tree([decisions(*x) for x in context_counts(known, n, NEAR)], NEAR), at


BUCKETS = (
    "bucket int, m long, keys binary, n binary, chunks array<long>, sizes array<long>, spots binary, "
    "node array<long>, zeros array<double>, ones array<double>, below array<double>"
)


def gathered(group: pa.Table) -> pa.Table:
    """A bucket's distinct places and counts; for each chunk where its places stand among them, one chunk after the other; and the
    nodes of depth NEAR - 1: of their children how often they were 0 and 1, and their weighted logarithms' sum."""
    sizes = group["m"].to_numpy()
    got = [[unpack(data.as_py(), m, kind, rising) for data, m in zip(group[x], sizes, strict=True)] for x, kind, rising in (("keys", np.uint64, True), ("n", np.int64, False))]
    keys, back = np.unique(np.concatenate(got[0]), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate(got[1]), minlength=len(keys)).astype(np.int64)
    del got
    sums = []
    for cut in pieces(keys):
        tree = subtree(keys[cut], n[cut])[0]
        nodes, zeros, ones = tree.roots
        sums.append(summed(shorter(nodes, NEAR - 1), zeros, ones, tree.weighted[0]))
    node, *of = summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))
    own = [group["bucket"][0].as_py(), len(keys), pack(keys, True), pack(n), group["chunk"].to_numpy(), sizes, pack(back.astype(np.int64), True)]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 2, pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3]
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip([*own, node.astype(np.int64), *of], kinds, strict=True)], [x.split()[0] for x in BUCKETS.split(", ")])


def top_tree(buckets: DataFrame) -> Tree:
    """The tree before depth NEAR. Its nodes are as many as pairs of bytes and their decisions, whatever the corpus."""
    sums = buckets.select(F.inline(F.arrays_zip("node", "zeros", "ones", "below"))).groupBy("node")
    got = sums.agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "below"))).orderBy("node").toArrow()
    key, zeros, ones, below = (c.to_numpy() for c in got.columns)
    nodes = [(key.astype(np.uint64), zeros, ones)]
    for d in range(NEAR - 2, -1, -1):
        nodes.insert(0, summed(shorter(nodes[0][0], d), *nodes[0][1:]))
    return Tree(nodes, 0, below).spread()


def dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """By a key of so many values, into as many partitions where the session's number is smaller: none gets more groups as the
    corpus grows."""
    return df.repartition(groups, key) if groups > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def code_lengths(chunks: DataFrame, scratch: Scratch, many: int, buckets: int) -> DataFrame:
    """word or head, n and r (log10 probability of its coded bytes) of each item of the chunks, which are ``many``."""
    spark = chunks.sparkSession
    places = chunks.select("chunk", "words", "times", "heads", "uses").mapInArrow(placed(buckets), PLACES)
    trees = scratch.keep(dealt(places, "bucket", buckets).groupBy("bucket").applyInArrow(gathered, BUCKETS))
    top = spark.sparkContext.broadcast(top_tree(trees))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = top.value
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                keys, n = unpack(row["keys"], row["m"], np.uint64, True), unpack(row["n"], row["m"], np.int64)
                r = np.empty(len(keys))
                for cut in pieces(keys):
                    tree, at = subtree(keys[cut], n[cut])
                    up = np.searchsorted(above.keys[-1], shorter(tree.keys[0], NEAR - 1))
                    tree.spread(above.done[up], above.left[up])
                    r[cut] = tree.log10(at, len(at.byte), above)
                r = r[unpack(row["spots"], sum(row["sizes"]), np.int64, True)]
                own = [pack(x) for x in np.split(r, np.cumsum(row["sizes"])[:-1])]
                columns = [pa.array([row["bucket"]] * len(own), pa.int32()), pa.array(row["chunks"], pa.int64()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "r"])

    def resolved(chunk: pa.Table, coded: pa.Table) -> pa.Table:
        c = Chunk(chunk.to_pylist()[0], buckets)
        r = np.zeros(len(c.keys))
        for b, data in zip(coded["bucket"].to_pylist(), coded["r"], strict=True):
            r[c.spots[b]] = unpack(data.as_py(), len(c.spots[b]), np.float64)
        r = np.bincount(c.item, weights=r[c.place], minlength=len(c.n)).astype(np.float64)
        word = pa.concat_arrays([pa.array(c.words, pa.string()), pa.nulls(len(c.heads), pa.string())])
        head = pa.concat_arrays([pa.nulls(len(c.words), pa.int64()), pa.array(c.heads, pa.int64())])
        return pa.Table.from_arrays([word, head, pa.array(c.n), pa.array(r)], ["word", "head", "n", "r"])

    coded = trees.select("bucket", "m", "keys", "n", "chunks", "sizes", "spots").mapInArrow(code, "bucket int, chunk long, r binary")
    own = chunks.select("chunk", "words", "times", "heads", "uses")
    own, coded = (dealt(x, "chunk", many).groupBy("chunk") for x in (own, coded))
    items = scratch.keep(own.cogroup(coded).applyInArrow(resolved, "word string, head long, n long, r double"))
    scratch.drop(trees)
    return items


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (coded ones) and bits_per_byte (the code
    length) of every document row.

    Null counts as the empty text: one token, the end. With no training rows train_tokens is 0, every base term is 0 and
    every decision has probability one half. A null id counts as the empty text for the fold.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    held = fold(F.col("doc_id"), 7) == 2
    seen = docs.select("text", (~held).alias("train")).mapInArrow(count_tokens, COUNTS)
    counts = seen.groupBy("word", "head").agg(F.sum("n").alias("n"))
    chunks = counts.mapInArrow(chunked, CHUNKS).withColumn("chunk", F.monotonically_increasing_id())
    chunks = scratch.keep(chunks)
    sums = chunks.agg(F.count("*"), *(F.coalesce(F.sum(x), F.lit(0)) for x in ("tokens", "known", "coded"))).first()
    many, total, distinct, coded = map(int, sums)
    floor = F.log10(F.lit(total + distinct + 1.0))
    items = code_lengths(chunks, scratch, many, coded // BUCKET + 1)
    scratch.drop(chunks)
    is_word = F.col("head").isNull()
    # A head stands under two tabs and its number, which no word can be.
    named = items.select(
        "head",
        F.when(is_word, F.col("word")).otherwise(F.concat(F.lit("\t\t"), F.col("head").cast("string"))).alias("word"),
        F.when(is_word, F.col("n")).otherwise(0).alias("c"),
        F.when(is_word, F.log10(F.col("n") + 1.0) - floor).otherwise(0.0).alias("b"),
        "r",
    )
    words = named.drop("head")
    top = named.where(is_word).orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow().combine_chunks()
    often = items.where(~is_word).orderBy(F.desc("n"), "head").limit(FREQUENT_HEADS).select("head", "r").toArrow()
    often = often.sort_by("head").combine_chunks()
    frequent = spark.sparkContext.broadcast(
        (
            [w.encode() for w in top["word"].to_pylist()],
            *(top[x].to_numpy() for x in ("c", "b", "r")),
            *(often[x].to_numpy() for x in ("head", "r")),
        )
    )
    row = "rid long, doc_id long, held_out boolean, word string, n long, tokens long, bytes long, known long, base double, coded double"

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, base, coded, met, value = frequent.value
        c, base, coded = (np.append(x, 0) for x in (c, base, coded))  # the last place is of words not among them
        place = {w: k for k, w in enumerate(names)}
        none = len(names)
        met, value = np.append(met, -1), np.append(value, 0.0)  # the last place is of no head
        for b, own_texts in parts(batches):
            ids, rid = b.column("doc_id"), b.column("rid").to_numpy()
            split = [space_words(t or "") for t in own_texts]
            of, head = text_heads(split)
            head = head.astype(np.int64)
            at = np.searchsorted(met[:-1], head)
            at[met[at] != head] = len(met) - 1
            heads = np.bincount(of, weights=value[at], minlength=len(split))
            of, head = of[at == len(met) - 1], head[at == len(met) - 1]
            order = np.lexsort((head, of))
            of, head = of[order], head[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (head[1:] != head[:-1])])[: len(of)])
            times = np.diff(np.append(first, len(of)))
            of, head = of[first], head[first]
            out: list[list] = [[] for _ in range(8)]
            for k, w in enumerate(split):
                w.append(b"")
                at = np.fromiter((place.get(x, none) for x in w), np.int64, len(w))
                rare = Counter(x for x, p in zip(w, at.tolist(), strict=True) if p == none) if (at == none).any() else {}
                size = sum(map(len, w)) + len(w)  # a space after each word, a line break at the end
                own = (f"\t{rid[k]}", 1, len(w), size, int((c[at] > 0).sum()), base[at].sum(), coded[at].sum() + heads[k])
                for x, v in zip(out, (k, *own), strict=True):
                    x.append(v)
                for word, m in rare.items():
                    for x, v in zip(out, (k, word.decode(), m, 0, 0, 0, 0.0, 0.0), strict=True):
                        x.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            zeros = np.zeros(len(of), np.int64)
            keys = pc.binary_join_element_wise("\t\t", pa.array(head).cast(pa.string()), "")
            rare_heads = (keys, times, zeros, zeros, zeros, zeros.astype(float), zeros.astype(float))
            for take, columns in ((out[0], out[1:]), (of, rare_heads)):
                take = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid").take(take), ids.take(take), b.column("held_out").take(take)]
                    + [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(columns, kinds, strict=True)],
                    ["rid", "doc_id", "held_out", "word", "n", "tokens", "bytes", "known", "base", "coded"],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"
    )
    # A text's own sums stand under a word that no text has (a tab and the row), so that they spread like words do.
    terms = rows.mapInArrow(texts, row).join(words, "word", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    sums = terms.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("tokens").alias("n_tokens"),
        F.sum("bytes").alias("n_bytes"),
        F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("n") * zero(F.col("b"))).alias("base_score"),
        F.sum(F.col("coded") + F.col("n") * zero(F.col("r"))).alias("score"),
    )
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        "n_bytes", bits.alias("bits_per_byte"),
    )
