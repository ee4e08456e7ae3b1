"""Spelling variants: words of a corpus that one inserted, deleted or replaced character tells apart.

If one edit makes a word of another, the first or the second half of either stands in the other unchanged, at its start or
at its end. Shards hold an Aho-Corasick automaton of the halves of their words; words are scanned by the automaton of each
shard that their own starts and ends lead to, and a half that is found counts if it stands at the right end and the
lengths differ by one at most. What is left of both words then meets in an index of its deletions, and the distance of
whole words is verified.

A half that many words share is dealt out further by the deletions of what is left, so that no shard grows with it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, parts

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many is misspelt on purpose; words have so many code points and so many occurrences at least.
VARIED, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: A form stands so many times as often as its variant.
TIMES = 2
#: Counts that a task holds before it passes them on; rows of a shard; rows of a half from which it is dealt out.
HELD, SHARD, HOT = 200_000, 20_000, 1000
PREFIX, SUFFIX = 0, 1


def varied(doc_id: str, text: str | None) -> Iterator[tuple[str, int]]:
    """Each distinct run of a text, as it counts, and how often it stands."""
    if not text:
        return
    lowered = text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode()
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUNS.findall(lowered)).items():
        h = zlib.crc32(run.encode(), start)
        if h % VARIED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word and n: sums of a task so far, passed on whenever there are HELD words."""

    def out(sums: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])

    sums: dict[str, int] = {}
    for piece, texts in parts(batches):
        for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts, strict=True):
            for word, n in varied("" if doc_id is None else str(doc_id), text):
                if len(word) >= LEAST_LENGTH:
                    sums[word] = sums.get(word, 0) + n
            if len(sums) >= HELD:
                yield out(sums)
                sums = {}
    if sums:
        yield out(sums)


def words(docs: DataFrame) -> DataFrame:
    """word and n of all words. A null id counts as the empty text, a null text has no runs, a repeated row counts again."""
    sums = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= LEAST_COUNT)


def halves(known: DataFrame) -> DataFrame:
    """kind, half, word, n, holds: starts and ends of a word by which a word of near length may hold a half, its own ones
    among them (holds)."""
    size = F.length("word")
    whole = known.select("word", "n", size.alias("size"))
    own, rows = F.floor(F.col("size") / 2).cast("int"), []
    lengths = F.array_distinct(F.array(*(F.floor((F.col("size") + d) / 2).cast("int") for d in (-1, 0, 1))))
    rest = F.array_distinct(F.array(*((F.col("size") + d - F.floor((F.col("size") + d) / 2)).cast("int") for d in (-1, 0, 1))))

    def struct(kind: int, n: Column) -> Column:
        cut = F.substring("word", F.lit(1), n) if kind == PREFIX else F.substring("word", F.col("size") - n + 1, n)
        return F.struct(F.lit(kind).alias("kind"), cut.alias("half"), (n == (own if kind == PREFIX else F.col("size") - own)).alias("holds"))

    rows = F.concat(F.transform(lengths, lambda n: struct(PREFIX, n)), F.transform(rest, lambda n: struct(SUFFIX, n)))
    return whole.select("word", "n", F.explode(rows).alias("r")).select("word", "n", "r.*")


def left_over(kind: Column, half: Column, word: Column) -> Column:
    n = F.length(half)
    return F.when(kind == PREFIX, F.substring(word, n + 1, F.length(word))).otherwise(F.substring(word, F.lit(1), F.length(word) - n))


def deletions(rest: str) -> set[str]:
    """The text and what each single deletion makes of it: texts of distance one have one of these in common."""
    return {rest} | {rest[:i] + rest[i + 1 :] for i in range(len(rest))}


def dealt(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with ``shard`` and ``salts`` (0: the half is not dealt out; else by how many) and ``salt``.

    A half of more than HOT rows is dealt out by hashes of the deletions of what is left, at most one row each. The table
    of such halves is written first, so it is broadcast only where its known size allows.
    """
    total = rows.count()
    hot = rows.groupBy("kind", "half").count().where(F.col("count") > HOT)
    hot = scratch.keep(hot.select("kind", "half", F.ceil(F.col("count") / HOT).cast("int").alias("salts")))
    over = rows.join(hot, ["kind", "half"], "left").withColumn("salts", F.coalesce("salts", F.lit(0)))
    rest = left_over(F.col("kind"), F.col("half"), F.col("word"))
    cut = F.transform(
        F.sequence(F.lit(0), F.length(rest)),
        lambda i: F.pmod(F.crc32(F.concat(F.substring(rest, F.lit(1), i), F.substring(rest, i + 2, F.length(rest))).cast("binary")), F.col("salts")).cast("int"),
    )
    salt = F.explode(F.when(F.col("salts") > 0, F.array_distinct(cut)).otherwise(F.array(F.lit(0))))
    shards = max(1, -(-total // SHARD))
    return over.withColumn("salt", salt).withColumn("shard", F.pmod(F.xxhash64("kind", "half", "salt"), F.lit(shards)))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells a from b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def shard_pairs(table: pa.Table) -> pa.Table:
    """word, near, near_n: every word of the shard with each near word whose half it holds, once over all shards.

    A pair counts by the first half if that stands, else by the second; where a half is dealt out, in the shard of the
    least salt that both have.
    """
    kinds, all_halves, salts, salt, texts, sums, holds = (table.column(c).to_pylist() for c in ("kind", "half", "salts", "salt", "word", "n", "holds"))
    machine, held = ahocorasick.Automaton(), {}
    for k, half in enumerate(all_halves):
        if holds[k]:
            index = held.setdefault((kinds[k], half, salt[k]), {})
            rest = texts[k][len(half) :] if kinds[k] == PREFIX else texts[k][: len(texts[k]) - len(half)]
            for x in deletions(rest):
                index.setdefault(x, []).append(k)
            machine.add_word(half, half)
    out: tuple[list, list, list] = ([], [], [])
    if held:
        machine.make_automaton()
        routes: dict[str, dict[tuple[int, str], list[tuple[int, int]]]] = {}
        for k, word in enumerate(texts):
            routes.setdefault(word, {}).setdefault((kinds[k], all_halves[k]), []).append((salt[k], salts[k]))
        for word, own in routes.items():
            for end, half in machine.iter(word):
                for kind in (PREFIX, SUFFIX):
                    stands = end + 1 == len(half) if kind == PREFIX else end + 1 == len(word)
                    if not stands or (kind, half) not in own:
                        continue
                    rest = word[len(half) :] if kind == PREFIX else word[: len(word) - len(half)]
                    mine = deletions(rest)
                    for s, of in own[kind, half]:
                        index = held.get((kind, half, s))
                        for k in {k for x in mine for k in index.get(x, ())} if index else ():
                            other = texts[k]
                            if not one_edit(word, other) or kind == SUFFIX and word.startswith(other[: len(other) // 2]):
                                continue
                            if of:
                                left = other[len(half) :] if kind == PREFIX else other[: len(other) - len(half)]
                                if s != min(zlib.crc32(x.encode()) % of for x in mine & deletions(left)):
                                    continue
                            out[0].append(word)
                            out[1].append(other)
                            out[2].append(sums[k])
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])


def near_pairs(known: DataFrame, scratch: Scratch) -> DataFrame:
    """word, near, near_n of all ordered pairs of near words, each once."""
    rows = dealt(halves(known), scratch)
    return rows.groupBy("shard").applyInArrow(shard_pairs, "word string, near string, near_n long")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words.

    ``form``: the near word of largest n (ties: the smallest by code points), if it stands at least TIMES as often; null
    else. ``root``: where forms end. n doubles with each form, so that the ways are short, and halving them in each round
    ends soon. An empty table, or one without words, gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    known = scratch.keep(words(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    seen = near_pairs(known, scratch).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = known.join(seen, "word", "left")
    frequent = -F.col("best.less") >= TIMES * F.col("n")
    told = scratch.keep(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")
        )
    )
    ways = scratch.keep(told.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.keep(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = step.where("moved").limit(1).count()
        scratch.drop(ways)
        ways = step.drop("moved")
        ways._scratch = step._scratch
        if not moved:
            break
    whole = told.join(ways, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 by bits over UTF-8 bytes, as SQL has none.
_BYTES = "list_transform(range(0, length(hex(encode({0}))) // 2), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""
ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), counts AS (
  SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, c, {_CRC.format("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM counts
), results AS (
  SELECT CASE WHEN h % {VARIED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM results WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}
), cuts AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM words, unnest(range(0, length(word))) AS t(i)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
), best AS (
  SELECT word, count(*) AS n_near, (array_agg(other ORDER BY n DESC, other))[1] AS other, max(n) AS top FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= {TIMES} * w.n THEN b.other END AS form,
         CASE WHEN b.top >= {TIMES} * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), ways AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ways w ON w.word = f.word
JOIN forms e ON e.word = w.at AND e.form IS NULL
"""
