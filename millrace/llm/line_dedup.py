"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where a token that holds a
digit or is an address is a wildcard. A leaf holds lines of one length and one beginning. What of them is fixed and what
varies follows from the leaf's own counts: a position whose commonest token stands in most of the leaf's documents is
fixed, the others are wildcards; where enough positions are fixed, the lines that agree in all of them share the
leaf's template. A leaf of several templates is split, SPLITS times at most: by the tokens of its most uneven position, and
lines that a template leaves out go on by themselves. What shares no template is its own, with wildcards as above. A
template that recurs across documents is kept where it first stands and dropped everywhere else.

The tree's parsing is sequential only in appearance: counts make it independent of the order of lines, so each level is
one aggregation. Equal lines are counted before anything else, so a line that fills a third of the corpus is one row for
each task from then on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import bloom
from millrace.llm.common import Scratch, parts

#: Leading tokens on the way to a leaf; further splits of a leaf; documents that make a template recur.
LEADING, SPLITS, DOCUMENTS = 3, 3, 2
#: Lines of fewer tokens (in scripts without spaces: characters) than this recur from GENERAL documents only.
LEAST_TOKENS, LEAST_CHARACTERS = 4, 8
#: A position is fixed if its commonest token has this share of the leaf; a template needs this share of fixed positions.
FIXED, SIMILAR = 0.8, 0.7
WILD = "<*>"
#: Documents that make a shared template recur, and a token worth a split: what varies does not show in two lines.
GENERAL = 3
VARIES = re.compile(r"\d|://|.@.")
#: Letters of scripts that put no spaces between words (Thai to Tibetan, Burmese, Khmer, kana, Han): each is a token.
SPACELESS = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED, CHARACTERS = re.compile(f"[{SPACELESS}]"), re.compile(rf"[{SPACELESS}]|[^\s{SPACELESS}]+")


def masked(tokens: list[str]) -> list[str]:
    """Tokens with variable fields as wildcards; a line that is mostly such fields is left as it is."""
    out = [WILD if VARIES.search(t) else t for t in tokens]
    return tokens if 2 * out.count(WILD) > len(out) else out


def _hash(tokens: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(tokens)) - (1 << 63)


def line_keys(line: str) -> tuple[list[str], bool, int, int] | None:
    """Masked tokens, whether they are few, leaf and template of a line; None for a blank one. A leaf's hash and a
    template's together name a line's tokens by 128 bits."""
    tokens, least = line.split(), LEAST_TOKENS
    if not tokens:
        return None
    if not line.isascii() and UNSPACED.search(line):
        tokens, least = CHARACTERS.findall(line), LEAST_CHARACTERS
    tokens = masked(tokens) if VARIES.search(line) else tokens
    return tokens, len(tokens) < least, _hash([str(len(tokens)), *tokens[:LEADING]]), _hash(tokens)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text) and text, once for rows that repeat an id and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    own = F.xxhash64("doc_id", "th")
    again = rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select(own.alias("h"))
    if again.isEmpty():
        return rows
    rows = rows.withColumn("may", bloom.may_hold(again, "h", own))
    once = rows.where("may").dropDuplicates(["doc_id", "th"])
    return once.unionByName(rows.where("NOT may")).drop("may")


def parsed(rows: DataFrame) -> DataFrame:
    """doc_id, th, line (from 0), short, leaf and template (hashes) of every line that is not blank; ``first`` where the
    row's text has the template for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in parts(batches):
            of, line, short, leaf, template, first = [], [], [], [], [], []
            for k, text in enumerate(texts):
                own: set[int] = set()
                for j, x in enumerate(text.split("\n") if text else ()):
                    if (found := line_keys(x)) is not None:
                        of.append(k)
                        line.append(j)
                        short.append(found[1])
                        leaf.append(found[2])
                        template.append(found[3])
                        first.append(found[3] not in own)
                        own.add(found[3])
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").take(take),
                    piece.column("th").take(take),
                    pa.array(line, pa.int32()),
                    pa.array(short, pa.bool_()),
                    pa.array(leaf, pa.int64()),
                    pa.array(template, pa.int64()),
                    pa.array(first, pa.bool_()),
                ],
                names=["doc_id", "th", "line", "short", "leaf", "template", "first"],
            )

    return rows.mapInArrow(run, "doc_id long, th long, line int, short boolean, leaf long, template long, first boolean")


def tokens_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """leaf, template, docs and tokens (a hash of each, 0 for a wildcard) of the wanted templates (leaf, template, docs, own:
    a hash of a document that holds it).

    Only those documents are parsed again. Bloom filters keep other lines out of the shuffle.
    """
    held = rows.select(F.xxhash64("doc_id", "th").alias("own"), "text")
    mark = F.col("leaf").bitwiseXOR(F.col("template"))
    made = (bloom.build(wanted, "own"), bloom.build(wanted.select(mark.alias("h")), "h"))
    filters = rows.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda t: 0 if t == WILD else xxhash.xxh3_64_intdigest(t) - (1 << 63)
        of_text, of_line = filters.value
        for piece, texts in parts(bloom.kept(batches, "own", of_text)):
            found = [(k, *f) for k, t in enumerate(texts) if t for x in t.split("\n") if (f := line_keys(x)) is not None]
            if of_line is not None and found:
                near = bloom.hits(of_line, np.array([f[3] ^ f[4] for f in found], np.int64))
                found = [f for f, ok in zip(found, near, strict=True) if ok]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("own").take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([f[3] for f in found], pa.int64()),
                    pa.array([f[4] for f in found], pa.int64()),
                    pa.array([[number(t) for t in f[1]] for f in found], pa.list_(pa.int64())),
                ],
                names=["own", "leaf", "template", "tokens"],
            )

    lines = held.mapInArrow(run, "own long, leaf long, template long, tokens array<long>")
    met = lines.join(wanted, ["own", "leaf", "template"]).select("leaf", "template", "docs", "tokens")
    return met.dropDuplicates(["leaf", "template"])  # a line that stands twice in its document


def general(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """leaf, template and final (the template they share) of the lines (leaf, template, docs, tokens) that share one.

    Aggregations by (group, position, token), and a join of each line with what its group has fixed: no group's lines are
    ever brought together.
    """
    open_, found = lines.withColumn("g", F.col("leaf")), []
    for depth in range(SPLITS + 1):
        votes = open_.select("g", "docs", F.posexplode("tokens").alias("pos", "token"))
        votes = votes.groupBy("g", "pos", "token").agg(F.sum("docs").alias("n"), F.count("*").alias("kinds"))
        counted = F.when(F.col("token") != 0, F.col("n").cast("double"))
        places = votes.groupBy("g", "pos").agg(
            F.sum("n").alias("all"), F.sum("kinds").alias("kinds"), F.max(F.struct("n", "token")).alias("top"),
            F.sum(counted * counted).alias("squares"), F.max(counted).alias("most"),
        )
        fixed = (F.col("top.n") >= FIXED * F.col("all")) & (F.col("top.token") != 0)
        worth = ~fixed & (F.col("most") >= GENERAL)
        groups = places.groupBy("g").agg(
            F.count("*").alias("size"),
            F.max("all").alias("all"),
            F.max("kinds").alias("kinds"),
            F.collect_list(F.when(fixed, F.struct("pos", F.col("top.token").alias("token")))).alias("fixed"),
            F.max(F.when(worth, F.struct("squares", (-F.col("pos")).alias("back")))).alias("split"),
        )
        groups = groups.where((F.col("kinds") > 1) & (F.col("all") >= GENERAL)).drop("all", "kinds")
        joined = open_.join(groups, "g")
        good = F.size("fixed") >= SIMILAR * F.col("size")
        agrees = F.forall("fixed", lambda x: F.get("tokens", x["pos"]) == x["token"])
        own = F.get("tokens", (-F.col("split.back")).cast("int"))
        then = F.when(good, F.when(~agrees, F.xxhash64("g", F.lit("rest")))).when(F.col("split").isNotNull(), F.xxhash64("g", "split.back", own))
        state = joined.select("leaf", "template", "docs", "tokens", "g", (good & agrees).alias("shares"), then.alias("then"))
        state = scratch.keep(state)
        found.append(state.where("shares").select("leaf", "template", F.xxhash64("g", F.lit(depth)).alias("final")))
        open_ = state.where("then IS NOT NULL").select("leaf", "template", "docs", "tokens", F.col("then").alias("g"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated_lines(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, th and lines (numbers from 0) of all lines to drop."""
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs)
    lines = scratch.keep(parsed(rows))
    equal = scratch.keep(
        lines.where("first").groupBy("leaf", "template").agg(
            F.count("*").alias("docs"), F.max("short").alias("short"), F.min(F.xxhash64("doc_id", "th")).alias("own")
        )
    )
    several = max(documents, GENERAL)
    mixed = equal.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("all"))
    mixed = mixed.where((F.col("kinds") > 1) & (F.col("all") >= several)).select("leaf")
    wanted = scratch.keep(equal.join(mixed, "leaf").select("leaf", "template", "docs", "own"))
    shared = general(scratch.keep(tokens_of(rows, wanted)), scratch).withColumn("shared", F.lit(True))
    # Also lines that share a template, which may not recur. If it does, it drops what they drop.
    enough = F.col("docs") >= F.when(F.col("short"), several).otherwise(documents)
    alone = equal.where(enough).select("leaf", "template", F.col("template").alias("final"), F.lit(False).alias("shared"))
    finals = scratch.keep(shared.unionByName(alone))
    mark = F.col("leaf").bitwiseXOR(F.col("template"))
    near = lines.where(bloom.may_hold(finals.select(mark.alias("h")), "h", mark))
    met = scratch.keep(near.join(finals, ["leaf", "template"]).select("doc_id", "th", "line", "leaf", "final", "shared"))
    scratch.drop(lines, equal, wanted)
    rare = met.where("shared").select("leaf", "final", "doc_id", "th").distinct().groupBy("leaf", "final").agg(F.count("*").alias("docs"))
    rare = rare.where(F.col("docs") < several).select("leaf", "final")
    met = met.where("NOT shared").unionByName(met.where("shared").join(rare, ["leaf", "final"], "left_anti"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th", "line")
    first = met.groupBy("leaf", "final").agg(F.min(place).alias("at"))
    first = first.select(*(F.col(c).alias(f"first_{c}") for c in ("leaf", "final")), *(F.col(f"at.{c}").alias(f"first_{c}") for c in ("doc_id", "th", "line")))
    # by place as well as by template, so that the lines of a hot template lie in many tasks
    same = [F.col(c) == F.col(f"first_{c}") for c in ("leaf", "final", "th", "line")] + [F.col("doc_id").eqNullSafe(F.col("first_doc_id"))]
    extra = met.join(first, same, "left_anti")
    return extra.groupBy("doc_id", "th").agg(F.collect_set("line").alias("lines"))


def _left(text: Column, lines: Column) -> Column:
    all_ = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), lines)
    return F.array_join(F.transform(kept, lambda i: F.get(all_, i)), "\n")


def without_repeats(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """The rows as struct ``row``, with n_dropped and ``left``, the text without its repeated lines.

    Null text stays null, empty text empty. Blank lines always stay. A template's first place is that of the smallest id
    (rows without one come last), then of the first line. Rows that repeat an id and text are one document: they lose
    the same lines.
    """
    gone = repeated_lines(docs, documents)
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), F.col("lines").alias("gone_lines"))
    gone = Scratch(docs.sparkSession).keep(gone)
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("own"))
    # only documents that may lose lines are shuffled
    mark = lambda i, t: F.xxhash64(i, t)
    keys = gone.select(mark("gone_id", "gone_th").alias("h"))
    held = held.withColumn("may", bloom.may_hold(keys, "h", mark("id", "own")))
    some, rest = held.where("may"), held.where("NOT may")
    met = some.join(gone, some.id.eqNullSafe(gone.gone_id) & (some.own == gone.gone_th), "left")
    text = F.col("row.text")
    changed = met.select(
        "row",
        F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone_lines").isNull(), text).otherwise(_left(text, F.col("gone_lines"))).alias("left"),
    )
    return changed.unionByName(rest.select("row", F.lit(0).cast("long").alias("n_dropped"), text.alias("left")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (what is left) of every document row."""
    found = without_repeats(docs.select("doc_id", "text"))
    n = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n", -1))).cast("long")
    return found.select("row.doc_id", n.alias("n_lines"), "n_dropped", F.col("left").alias("text"))


def drop_lines(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """The documents, with their columns, without repeated lines. Those of which nothing but white space is left go."""
    found = without_repeats(docs, documents).where((F.col("n_dropped") == 0) | F.col("left").rlike(r"\S"))
    columns = [F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_dropped") > 0, F.length("left").cast("long")).otherwise(F.col("row.n_chars"))
        columns = [chars.alias("n_chars") if c == "n_chars" else x for c, x in zip(docs.columns, columns, strict=True)]
    return found.select(*columns)
