"""Benchmark decontamination by a broadcast set of n-gram hashes.

The benchmark's windows are hashed; every document's windows are hashed and looked up in the set; a hit is verified word
by word before it counts. Only DataFrame and SQL functions run: a document's windows are hashed in one pass over its
word array and exploded as numbers beside it; the join drops all but the hits, and the hit's own words are compared,
before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD_PATTERN, Scratch, ascii_lower

WINDOW = 10
#: Windows up to which the set is broadcast (some 100 MB with their words); beyond, the join shuffles.
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null has none."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD_PATTERN), F.lit(0)), none)


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """n, gram, h and item_ids: every distinct window with the items that hold it. An item of fewer words is one window.

    Items without words give nothing. An item whose id is null marks words, but has no id to report.
    """
    w = bench.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(window)))
    each = F.explode_outer(F.expr("transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))"))
    grams = w.select("item_id", "n", each.alias("gram"))
    sets = grams.groupBy("n", "gram").agg(F.collect_set("item_id").alias("item_ids"))
    return sets.withColumn("h", F.xxhash64("n", "gram"))


def windows_in(n: int) -> str:
    return f"greatest(size(w) - {n} + 1, 0)"


def _hashes(n: int) -> str:
    """SQL for the hash of every window of n words of w, in order."""
    return (
        f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n} + 1), i -> xxhash64({n}, slice(w, i, {n})))"
        " ELSE CAST(array() AS array<bigint>) END"
    )


def find_hits(docs: DataFrame, bench: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """keys, at, n, item_ids: every place (from word 0) where a window of n words occurs in a document.

    Windows shorter than ``window`` exist only for short items; document windows of a length are hashed only where some
    item has that length.
    """
    grams = benchmark_windows(bench, window)
    sizes = sorted(r.n for r in grams.select("n").distinct().collect()) or [window]  # at most ``window`` numbers
    few = grams.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    w = docs.select(*keys, words(F.col("text")).alias("w"))
    # The hashes stand in a projection of their own, so that explode, join and comparison compile into one stage. A
    # plain explode would add a filter on the array's size, pushed below the projections: it would match the pattern
    # anew for every window.
    hashed = w.withColumn("hashes", F.expr("concat(" + ", ".join(map(_hashes, sizes)) + ")"))
    at, length, before = F.lit(None).cast("int"), F.lit(None).cast("int"), "0"
    for n in sizes:  # windows of the lengths before n come first
        here = F.expr(f"p >= {before} AND p < {before} + {windows_in(n)}")
        at, length = F.when(here, F.expr(f"p - ({before})")).otherwise(at), F.when(here, F.lit(n)).otherwise(length)
        before += f" + {windows_in(n)}"
    if few:
        met = hashed.select(*keys, "w", F.posexplode_outer("hashes").alias("p", "h")).join(F.broadcast(grams), "h")
        met = met.withColumn("at", at).where((F.col("n") == length) & (F.slice("w", F.col("at") + 1, F.col("n")) == F.col("gram")))
        return met.select(*keys, "at", "n", "item_ids")
    # Only numbers are shuffled to find where a hash is known; then each such place gets its own few words.
    starts = hashed.select(*keys, F.posexplode_outer("hashes").alias("p", "h")).join(grams.select("h").distinct(), "h", "left_semi")
    places = starts.groupBy(*keys).agg(F.collect_set(F.struct("p", "h")).alias("places"))
    near = w.join(places, keys).select(*keys, "w", F.explode("places").alias("x")).select(*keys, "w", "x.p", "x.h")
    near = near.select(*keys, "h", at.alias("at"), F.slice("w", at + 1, length).alias("own"))
    met = near.join(grams, "h").where(F.col("own") == F.col("gram"))
    return met.select(*keys, "at", "n", "item_ids")


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, hits (sorted word positions, empty for none) and items (sorted ids).

    A row is told by its id and a 128-bit hash of id and text, so repeated rows and null ids each keep their own
    result; equal rows have equal results. Other columns of ``docs`` are not touched.
    """
    text, name = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))
    rows = docs.select("doc_id", "text", F.xxhash64(name, text).alias("k1"), F.xxhash64(text, F.lit(1), name).alias("k2"))
    hits = find_hits(rows, bench, ["k1", "k2"], window)
    spans = hits.groupBy("k1", "k2").agg(
        F.collect_set(F.struct("at", "n")).alias("spans"), F.collect_set("item_ids").alias("sets")
    )
    marked = spans.select(
        "k1",
        "k2",
        F.expr("array_sort(array_distinct(flatten(transform(spans, x -> sequence(x.at, x.at + x.n - 1)))))").alias("hits"),
        F.expr("array_sort(transform(array_distinct(flatten(sets)), x -> CAST(x AS string)))").alias("items"),
    )
    counted = rows.select("doc_id", "k1", "k2", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(marked, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("hits", F.array().cast("array<int>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document (see ``scan``)."""
    found = scan(docs, bench, window)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with their columns, in which no window of the benchmark occurs: an anti join by a 128-bit hash of id
    and text. DataFrame functions only. Hit keys are broadcast where a count proves them few; else the join shuffles."""
    text, name = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))
    k1, k2 = F.xxhash64(name, text), F.xxhash64(text, F.lit(1), name)
    hits = find_hits(docs.select("text", k1.alias("k1"), k2.alias("k2")), bench, ["k1", "k2"], window)
    bad = hits.select(F.struct(F.col("k1"), F.col("k2")).alias("bad")).distinct()
    bad = Scratch(docs.sparkSession).keep(bad)
    bad = F.broadcast(bad) if bad.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS else bad
    return docs.join(bad, F.struct(k1.alias("k1"), k2.alias("k2")) == F.col("bad"), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
windows AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
hits AS (SELECT rid, item_id, i, n FROM windows JOIN grams USING (n, g)),
marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN items USING (rid)
"""
