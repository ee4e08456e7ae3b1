"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns tokens into classes (insult, threat, addressed target, object, negation, reported speech, clause
and sentence end). Three small transducers over the classes, for negation, reported speech and targets, are composed into one
deterministic machine whose output weighs each insult or threat by its clause: negated and reported ones count less, and a
threat counts in full only if the clause says "you", or if an object follows it directly or behind "all of the" and its like.
A text's score joins its matched clauses: 1 minus the product of (1 - clause weight). What is reported never adds up.

The lexicon has hand-written entries, and words and word stems learned from labelled texts; learned weights replace the
written ones where there is evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm.bpe import Recent
from millrace.llm.common import fold, parts, text_function

# The written lexicon.
INSULTS = (
    "idiot idiots idiotic moron morons moronic imbecile imbeciles stupid dumb dumbass fool loser losers pathetic "
    "worthless scum scumbag trash garbage disgusting clown clowns pig pigs vermin filth filthy parasite parasites "
    "bastard bastards bitch whore slut asshole arsehole retard retarded degenerate cretin dimwit halfwit subhuman "
    "coward creep freak jerk lowlife maggot"
).split()
THREATS = "kill murder hurt destroy beat stab shoot strangle burn hang smash punish exterminate slaughter".split()
TARGETS = "you your yours you're u ur".split()
OBJECTS = "them him her us me everyone everybody people".split()
FILLERS = "all of the these those every each both such".split()
WRITTEN = frozenset(INSULTS + THREATS)
NEGATIONS = "not no never none neither nor without isn't aren't wasn't don't doesn't didn't won't cannot can't".split()
REPORTS = (
    "said says saying say told tells wrote writes written called calls calling quoted quotes quote claimed claims "
    "alleged reportedly stated according"
).split()

#: Fit parameters: about so many labelled texts of each class. What is learned is bounded by them.
FIT_TOXIC, FIT_CLEAN = 4000, 8000
STEMS = (4, 5, 6)
#: The share of toxic texts from which a word or stem is learned. Its evidence (log-likelihood ratio) must reach the logarithm
#: of how many words and stems are asked, FALSE being how many of them may pass by chance: by Chernoff's bound one of evidence
#: e passes by chance with a probability of exp(-e) at most. So a language of few texts can teach words too.
FALSE, PRECISION = 1.0, 0.9
#: What a reported insult or threat counts: under the threshold, whatever was learned.
REPORTED = 0.3
#: The score of a text with no matched clause.
BASE = 0.01

OTHER, END, STOP, TARGET, OBJECT, FILLER, NEGATION, REPORT, THREAT, INSULT = range(10)
CLASSES = 10
NEITHER = (OTHER, 0.0)
TOKENS = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[.!?\n,;:]")
WORDS = re.compile(r"[^\W\d_]+")


def negation() -> tuple[int, dict]:
    """State: tokens for which a negation still holds (3 after it). A negated match counts 0.15."""
    step = {}
    for s in range(4):
        for c in range(CLASSES):
            to = 3 if c == NEGATION else 0 if c in (END, STOP) else max(0, s - 1)
            step[s, c] = (to, 0.15 if s and c in (INSULT, THREAT) else 1.0)
    return 0, step


def reported() -> tuple[int, dict]:
    """State: whether reported speech began in this sentence. A match within it counts REPORTED."""
    step = {}
    for s in range(2):
        for c in range(CLASSES):
            to = 0 if c == STOP else 1 if c == REPORT else s
            step[s, c] = (to, REPORTED if s and c in (INSULT, THREAT) else 1.0)
    return 0, step


#: States of ``aimed``: what of them says that the clause has named "you", and that a threat waits for its object.
NAMED, WAITS = 1, 2


def aimed() -> tuple[int, dict]:
    """State: NAMED and WAITS. An insult counts 0.9 without "you" before it; a threat needs a target (0.1), and counts in full
    once "you" follows in the clause, or its object right behind it."""
    step = {}
    for s in range(4):
        for c in range(CLASSES):
            named = 0 if c in (END, STOP) else NAMED if c == TARGET else s & NAMED
            waits = WAITS if c == THREAT else s & WAITS if c == FILLER else 0
            now = 1.0 if s & NAMED or c not in (INSULT, THREAT) else 0.9 if c == INSULT else 0.1
            step[s, c] = (named | waits, now, 1.0 if c == THREAT else now)
    return 0, step


def compose(*machines: tuple[int, dict]) -> tuple[list[list[int]], list[list[float]], list[list[float]], list[tuple]]:
    """The product machine: next[state][class], weight[state][class], the weight once a target follows, and what each state
    is made of. States are numbered as they are reached. A machine that gives one weight gives it for both."""
    start = tuple(m[0] for m in machines)
    number, queue, move, weight, later = {start: 0}, [start], [], [], []
    for state in queue:
        row, out, then = [], [], []
        for c in range(CLASSES):
            steps = [m[1][s, c] for m, s in zip(machines, state, strict=True)]
            to = tuple(x[0] for x in steps)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
            out.append(math.prod(x[1] for x in steps))
            then.append(math.prod(x[-1] for x in steps))
        move.append(row)
        weight.append(out)
        later.append(then)
    return move, weight, later, queue


class Grammar:
    """The composed machine with a lexicon."""

    def __init__(self, learned: dict[str, float], stems: dict[str, float]):
        self.words: dict[str, tuple[int, float]] = {w: (INSULT, 0.6) for w in INSULTS}
        self.words |= {w: (THREAT, 0.6) for w in THREATS}
        for names, c in ((FILLERS, FILLER), (OBJECTS, OBJECT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            self.words |= {w: (c, 0.0) for w in names}
        self.words |= {c: (STOP, 0.0) for c in ".!?\n"} | {c: (END, 0.0) for c in ",;:"}
        for w, p in learned.items():
            self.words[w] = (self.words.get(w, (INSULT,))[0] if w in THREATS else INSULT, p)
        self.stems = stems
        self.move, self.weight, self.later, states = compose(negation(), reported(), aimed())
        self.quoted, self.waits = [bool(s[1]) for s in states], [bool(s[2] & WAITS) for s in states]
        self.read = Recent(self.lookup, 20_000)

    def lookup(self, token: str) -> tuple[int, float]:
        found = self.words.get(token)
        if found is None:
            for n in reversed(STEMS):
                if len(token) > n and (p := self.stems.get(token[:n])) is not None:
                    return INSULT, p
        return found or NEITHER

    def score(self, text: str | None) -> float:
        if not text:
            return BASE
        read, tokens = self.read, TOKENS.findall(text.lower().replace("’", "'"))
        if not any(read[w][0] >= THREAT for w in set(tokens)):
            return BASE
        state, clean = 0, 1.0
        best = [0.0, 0.0]  # what is said in the clause, and what is reported in the text
        pending, last = [0.0, 0.0], (0.0, False)  # the same of threats, once "you" follows, and of the last one, once its object does
        for token in tokens:
            c, p = read[token]
            if c >= THREAT:
                q = self.quoted[state]
                best[q] = max(best[q], p * self.weight[state][c])
                then = p * self.later[state][c]
                pending[q] = max(pending[q], then)
                last = (then, q) if c == THREAT else last
            elif c == TARGET:
                best = [max(b, t) for b, t in zip(best, pending, strict=True)]
            elif c == OBJECT and self.waits[state]:
                best[last[1]] = max(best[last[1]], last[0])
            elif c in (END, STOP):
                clean, best[0], pending = clean * (1 - best[0]), 0.0, [0.0, 0.0]
            state = self.move[state][c]
        return max(BASE, best[1], 1 - clean * (1 - best[0]))


#: Words and stems that a task counts before it passes them on.
HELD = 50_000


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind (0: word, else a stem's length), feature, toxic and clean: in how many of some texts it stands."""

    def out(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(counts[0] | counts[1])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int32()),
                pa.array([k[1] for k in keys], pa.string()),
                pa.array([counts[1][k] for k in keys], pa.int64()),
                pa.array([counts[0][k] for k in keys], pa.int64()),
            ],
            names=["kind", "feature", "toxic", "clean"],
        )

    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for piece, texts in parts(batches):
        for text, toxic in zip(texts, piece.column("toxic").to_pylist(), strict=True):
            words = set(WORDS.findall((text or "").lower()))
            counts[toxic].update((0, w) for w in words)
            counts[toxic].update({(n, w[:n]) for w in words for n in STEMS if len(w) > n})
            if len(counts[0]) + len(counts[1]) > HELD:
                yield out(counts)
                counts = (Counter(), Counter())
    yield out(counts)


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar with what labelled texts show, from rows outside the held-out fold.

    Of each class about FIT_TOXIC or FIT_CLEAN labelled ids are taken, by a hash of the id, so what is read, shuffled
    and kept is bounded whatever the corpus. An id labelled twice counts as toxic if any label says so. Without
    labels the written lexicon stands alone.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    n = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    keep = F.when(F.col("toxic") == 1, FIT_TOXIC / max(1, n.get(1, 0))).otherwise(FIT_CLEAN / max(1, n.get(0, 0)))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < keep * (1 << 30))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    seen = texts.mapInArrow(features, "kind int, feature string, toxic long, clean long").groupBy("kind", "feature")
    sums = seen.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t >= 4")
    t, c = F.col("t"), F.col("c")
    ratio_t, ratio_c = (min(FIT_TOXIC, n.get(1, 0)) or 1), (min(FIT_CLEAN, n.get(0, 0)) or 1)
    prior = ratio_t / (ratio_t + ratio_c)
    share = t / (t + c)
    gain = t * F.log(share / prior) + F.when(c > 0, c * F.log((1 - share) / (1 - prior))).otherwise(0.0)
    written = F.col("feature").isin(INSULTS + THREATS) & (F.col("kind") == 0)
    asked = Observation()
    good = sums.observe(asked, F.count("*").alias("n")).withColumn("gain", gain).where(((F.col("gain") > 0) & (share >= PRECISION)) | written)
    rows = good.collect()  # each stands in several texts of the bounded sample
    least = math.log(max(1, asked.get["n"]) / FALSE)
    rows = [r for r in rows if (r.gain >= least and r.t >= PRECISION * (r.t + r.c)) or (r.kind == 0 and r.feature in WRITTEN)]
    weight = {(r.kind, r.feature): (r.t + 0.5) / (r.t + r.c + 1.0) for r in rows}
    return Grammar(
        {w: p for (kind, w), p in weight.items() if kind == 0}, {w: p for (kind, w), p in weight.items() if kind}
    )


def scorer(grammar: Grammar):
    """A column function: the score of a text. The grammar (some thousand entries) goes with the function."""
    learned = {w: p for w, (c, p) in grammar.words.items() if c >= THREAT}
    stems, made = grammar.stems, []

    def work(texts: list[str | None]) -> pa.Array:
        if not made:
            made.append(Grammar(learned, stems))
        return pa.array([made[0].score(t) for t in texts], pa.float64())

    return text_function("double", work)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Null and empty texts score BASE. Map-only but for the
    fit."""
    score = scorer(fit(docs, labels))(F.col("text"))
    return docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents, with their columns, that score below the threshold."""
    score = scorer(fit(docs, labels))(F.col("text"))
    held = docs.select(F.struct(*docs.columns).alias("row"), score.alias("score"))
    return held.where(F.col("score") < threshold).select("row.*")
