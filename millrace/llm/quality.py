"""Quality of a text by random-indexing word vectors and a small network.

Every token has a sparse ternary index vector, made from a hash of it. A word's context vector is the sum of its
neighbours' index vectors over the fit sample, each rotated by where the neighbour stands; a word's vector is its own
index vector beside its context's direction. Words that the sample shows seldom stand as their shape (case, digits, the
mark that repeats), which has a vector like any word. A word that stands again right after itself adds the token AGAIN.

A text is pooled as the mean over its tokens and the mean over its distinct tokens. A network of two layers, trained with
numpy on the driver over the pooled sample, turns that into a logit; a temperature fitted on a part of the sample that
training does not see makes it a probability.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import Recent
from millrace.llm.common import Scratch, fold, parts, text_function

#: Fit parameters: about so many labelled texts of each class, none of them longer than so many characters, and so many
#: words (those in the most sample texts, five at least). What is learned and what reaches the driver is bounded by them.
FIT_EACH, FIT_LONGEST, VOCABULARY, LEAST_TEXTS = 4000, 100_000, 20_000, 5
#: Components of an index vector, how many of them are not zero, and neighbours to each side.
SIZE, NONZERO, WINDOW = 64, 6, 2
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 32, 60, 3e-3, 1e-4, 128
#: The share of the sample that fits the temperature.
CALIBRATION = 0.2
AGAIN = "<again>"
TOKEN = re.compile(r"[^\W\d_]+|\d+|([^\w\s])\1*|_+")
WORD = re.compile(r"[^\W\d_]+|\d+")
MARKS = re.compile(r"(([^\w\s])\2*|_+)")


def shape(token: str) -> str:
    """What stands for a token outside the vocabulary."""
    first = token[0]
    if first.isdigit():
        return "<9>" if len(token) < 5 else "<99999>"
    if not first.isalpha():
        return f"<{first}>" if len(token) == 1 else f"<{first}+>"
    size = "" if len(token) < 16 else "+"
    if token.isupper() and len(token) > 1:
        return f"<XX{size}>"
    return f"<Xx{size}>" if token[1:].islower() or len(token) == 1 and token.isupper() else f"<xx{size}>" if token.islower() else f"<xX{size}>"


def index_vector(token: str) -> np.ndarray:
    """NONZERO components of plus or minus one, at places that follow from the token alone."""
    draw = np.random.default_rng(zlib.crc32(token.encode("utf-8", "replace")))
    out = np.zeros(SIZE, np.float32)
    out[draw.choice(SIZE, NONZERO, replace=False)] = draw.choice((-1.0, 1.0), NONZERO)
    return out


def stream(text: str | None) -> list[str]:
    """The tokens of a text in order, with AGAIN behind a word that repeats the word before it."""
    out, last = [], None
    for m in TOKEN.finditer(text or ""):
        token = m.group()
        out.append(token)
        if token[0].isalnum():
            if token == last:
                out.append(AGAIN)
            last = token
    return out


def bag(text: str) -> Counter:
    """The same tokens counted, without their order."""
    words = WORD.findall(text)
    out = Counter(words)
    out.update(m[0] for m in MARKS.findall(text))
    if again := sum(map(operator.eq, words, islice(words, 1, None))):
        out[AGAIN] += again
    return out


def seen_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token and n: in how many of the texts it stands."""
    for _, texts in parts(batches):
        n = Counter(t for text in texts for t in set(stream(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array of lists."""
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def contexts(vocabulary: frozenset[str]):
    """token and context: the sum of the rotated index vectors beside it, a row a token and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        turned = {d: np.zeros((1024, SIZE), np.float32) for k in range(1, WINDOW + 1) for d in (k, -k)}
        sums = np.zeros((1024, SIZE), np.float32)
        for _, texts in parts(batches):
            for text in texts:
                ids = []
                for t in stream(text):
                    key = t if t in vocabulary else shape(t)
                    if (k := number.get(key)) is None:
                        k = number[key] = len(number)
                        if k == len(sums):
                            sums = np.vstack([sums, np.zeros_like(sums)])
                            turned = {d: np.vstack([x, np.zeros_like(x)]) for d, x in turned.items()}
                        for d, x in turned.items():
                            x[k] = np.roll(index_vector(key), d)
                    ids.append(k)
                if len(ids) < 2:
                    continue
                at = np.array(ids, np.int64)
                beside = np.zeros((len(at), SIZE), np.float32)
                for d in range(1, WINDOW + 1):
                    if len(at) > d:
                        beside[d:] += turned[d][at[:-d]]
                        beside[:-d] += turned[-d][at[d:]]
                order = np.argsort(at, kind="stable")
                own, starts = np.unique(at[order], return_index=True)
                sums[own] += np.add.reduceat(beside[order], starts, axis=0)
        if number:
            yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), lists(sums[: len(number)])], names=["token", "context"])

    return run


class Vectors:
    """Vectors of the words and shapes that the sample has; others have their index vector only."""

    def __init__(self, learned: dict[str, np.ndarray]):
        self.learned = learned
        self.rows, self.number = np.zeros((1024, 2 * SIZE), np.float32), {}
        self.of = Recent(self.row, 200_000)

    def vector(self, key: str) -> np.ndarray:
        context = self.learned.get(key)
        if context is None:
            context = np.zeros(SIZE, np.float32)
        return np.concatenate([index_vector(key) / np.sqrt(NONZERO), context / (np.linalg.norm(context) or 1.0)])

    def row(self, token: str) -> int:
        """Where a token's vector stands. There are as many rows as learned words and shapes."""
        key = token if token in self.learned else shape(token)
        if (k := self.number.get(key)) is None:
            k = self.number[key] = len(self.number)
            if k == len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[k] = self.vector(key)
        return k

    def pool(self, text: str | None) -> np.ndarray:
        """The mean over tokens, the mean over distinct tokens, and two sizes: of the text and of its variety."""
        n = bag(text or "")
        if not n:
            return np.zeros(4 * SIZE + 2, np.float32)
        of = self.of
        at = [of[t] for t in n]  # may add rows
        each = self.rows[at]
        weight = np.fromiter(n.values(), np.float32, len(n))
        total = float(weight.sum())
        sizes = np.array([np.log1p(total), np.log(len(n) / total)], np.float32)
        return np.concatenate([weight @ each / total, each.mean(axis=0), sizes])


class Network:
    """tanh over HIDDEN units, then one logit. ``a`` and ``b`` scale the inputs; ``heat`` is the temperature."""

    def __init__(self, prior: float):
        self.prior, self.heat, self.layers = prior, 1.0, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, c1, w2, c2 = self.layers
        return np.tanh(np.clip((x - self.a) / self.b, -6, 6) @ w1 + c1) @ w2 + c2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.heat, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Adam over shuffled batches with a fixed seed. ``weight`` undoes what the sample takes more of."""
        self.a, self.b = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.clip((x - self.a) / self.b, -6, 6).astype(np.float64)
        rng = np.random.default_rng(1)
        self.layers = [rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), np.zeros(HIDDEN), np.float64(0.0)]
        first, second, step = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for at in range(0, len(order), BATCH):
                k = order[at : at + BATCH]
                w1, c1, w2, c2 = self.layers
                h = np.tanh(z[k] @ w1 + c1)
                g = weight[k] * (1 / (1 + np.exp(-np.clip(h @ w2 + c2, -30, 30))) - y[k]) / len(k)
                back = np.outer(g, w2) * (1 - h * h)
                grads = [z[k].T @ back + DECAY * w1, back.sum(axis=0), h.T @ g + DECAY * w2, g.sum()]
                step += 1
                for j, d in enumerate(grads):
                    first[j] = 0.9 * first[j] + 0.1 * d
                    second[j] = 0.999 * second[j] + 0.001 * d * d
                    self.layers[j] = self.layers[j] - RATE * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature of least weighted log loss, on a grid of powers."""
        if len(set(y.tolist())) < 2:
            return
        z = self.logits(x)

        def loss(heat: float) -> float:
            p = np.clip(1 / (1 + np.exp(-np.clip(z / heat, -30, 30))), 1e-9, 1 - 1e-9)
            return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

        self.heat = min((1.1**k for k in range(-10, 31)), key=loss)


class Model:
    def __init__(self, vectors: Vectors, network: Network):
        self.vectors, self.network = vectors, network


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Texts of the fit with good (0 or 1), from rows outside the held-out fold, and how many labelled ids each class has.

    About FIT_EACH ids a class are taken by a hash of the id. An id labelled twice is good only if all its labels say so;
    a labelled row without text, and one longer than FIT_LONGEST, takes no part.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).cast("int").alias("good"))
    )
    n = {r.good: r["count"] for r in marked.groupBy("good").count().collect()}
    keep = F.when(F.col("good") == 1, FIT_EACH / max(1, n.get(1, 0))).otherwise(FIT_EACH / max(1, n.get(0, 0)))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < keep * (1 << 30))
    texts = docs.where(F.length("text") <= FIT_LONGEST).select("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id"), n


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model. Without labels of both classes every text scores the share of good ones (0.5 without any)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts, n = sample(docs, labels)
    prior = n[1] / (n.get(0, 0) + n[1]) if n.get(1) else 0.0 if n.get(0) else 0.5
    network = Network(prior)
    if not (n.get(0) and n.get(1)):
        return Model(Vectors({}), network)
    kept = scratch.keep(texts.repartition(max(2, spark.sparkContext.defaultParallelism), "doc_id"))
    tokens = kept.select("text").mapInArrow(seen_in, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    words = tokens.where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "token").limit(VOCABULARY).select("token").collect()
    found = kept.select("text").mapInArrow(contexts(frozenset(r.token for r in words)), "token string, context array<float>")
    sums = found.groupBy("token").agg(F.array(*(F.sum(F.col("context")[k]) for k in range(SIZE))).alias("context"))
    vectors = Vectors({r.token: np.array(r.context, np.float32) for r in sums.collect()})
    sent = spark.sparkContext.broadcast(vectors.learned)
    pooled = kept.select("doc_id", "good", pooling(sent)(F.col("text")).alias("x")).collect()
    scratch.drop(kept)
    rows = sorted((zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.good, r.x) for r in pooled)
    if len({r[2] for r in rows}) < 2:
        return Model(vectors, network)
    x, y = np.array([r[3] for r in rows], np.float64), np.array([r[2] for r in rows], np.float64)
    counts = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, n[1] / counts[1], n[0] / counts[0])
    weight *= len(weight) / weight.sum()
    tune = np.array([r[0] // 7 % 100 < 100 * CALIBRATION for r in rows])
    if len(set(y[~tune].tolist())) < 2:
        tune[:] = False
    network.train(x[~tune], y[~tune], weight[~tune])
    network.calibrate(x[tune], y[tune], weight[tune])
    return Model(vectors, network)


def pooling(sent):
    """A column function: the pooled vector of a text."""
    made: list[Vectors] = []

    def work(texts: list[str | None]) -> pa.Array:
        if not made:
            made.append(Vectors(sent.value))
        return lists(np.stack([made[0].pool(t) for t in texts])) if texts else pa.array([], pa.list_(pa.float32()))

    return text_function("array<float>", work)


def scorer(model: Model, docs: DataFrame):
    """A column function: the probability that a text is good. Word vectors (VOCABULARY and the shapes) go by broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model.vectors.learned)
    network, made = model.network, []

    def work(texts: list[str | None]) -> pa.Array:
        if not made:
            made.append(Vectors(sent.value))
        if not texts:
            return pa.array([], pa.float64())
        return pa.array(network.score(np.stack([made[0].pool(t) for t in texts]).astype(np.float64)), pa.float64())

    return text_function("double", work)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Null and empty texts, and those without any token, are
    pooled as zeros and get the network's answer to that. Repeated rows score alike; other columns play no part; an empty
    table gives no rows. Map-only but for the fit."""
    score = scorer(fit(docs, labels), docs)(F.col("text"))
    return docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents, with their columns, that score the threshold or more."""
    score: Column = scorer(fit(docs, labels), docs)(F.col("text"))
    held = docs.select(F.struct(*docs.columns).alias("row"), score.alias("score"))
    return held.where(F.col("score") >= threshold).select("row.*")
