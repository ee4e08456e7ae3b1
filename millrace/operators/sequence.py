"""Operators over ordered leaves of a container. Every window is keyed by its container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], index: str, least: int = 2) -> DataFrame:
    """keys, lo, hi, n: maximal runs of consecutive indices, of ``least`` members at least."""
    order = Window.partitionBy(*keys).orderBy(index)
    island = F.col(index) - F.row_number().over(order)
    grouped = df.select(*keys, index).distinct().withColumn("__i", island).groupBy(*keys, "__i")
    return grouped.agg(F.min(index).alias("lo"), F.max(index).alias("hi"), F.count("*").alias("n")).where(F.col("n") >= least).drop("__i")


def islands(df: DataFrame, keys: list[str], order: str, breaks: Column, name: str = "island") -> DataFrame:
    """The island of each row: it grows by one where ``breaks`` holds (null counts as no break)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def chains(df: DataFrame, keys: list[str], order: str, joins: Column) -> DataFrame:
    """keys, lo, hi, n: neighbours joined while ``joins`` (over the row and ``prev_`` columns of the one before) holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = df.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in df.columns if c not in keys))
    cut = islands(prev.withColumn("__b", F.col(f"prev_{order}").isNotNull() & ~F.coalesce(joins, F.lit(False))), keys, order, F.col("__b"))
    return cut.groupBy(*keys, "island").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("n"))


def sibling_index(df: DataFrame, path: list[str], order: str) -> DataFrame:
    """0-based place among rows of the same path."""
    return df.withColumn("sibling", F.row_number().over(Window.partitionBy(*path).orderBy(order)) - 1)


def neighbours(df: DataFrame, keys: list[str], page: str, text: str, reach: int = 1) -> DataFrame:
    """``around``: the texts of pages within ``reach``, in order."""
    w = Window.partitionBy(*keys).orderBy(page).rangeBetween(-reach, reach)
    parts = F.array_sort(F.collect_list(F.struct(page, text)).over(w))
    return df.withColumn("around", F.array_join(F.transform(parts, lambda x: x[text]), " "))


def running_prefix(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """``prefix_chars`` and ``prefix_tail``: length and last 20 characters of all text before each fragment.

    Only lengths and tails are carried along: the text itself would grow with the square of a container's leaves.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(-20, -1)
    tail = F.array_join(F.collect_list(F.right(F.col(text), F.lit(20))).over(near), "")
    return df.withColumn("prefix_chars", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))).withColumn(
        "prefix_tail", F.right(tail, F.lit(20))
    )


def lag_flags(df: DataFrame, keys: list[str], order: str, clickable: Column, furniture: Column) -> DataFrame:
    """``after_furniture``: the leaf before is furniture; ``before_last_click``: it stands before the last clickable one."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.max(F.when(clickable, F.col(order))).over(Window.partitionBy(*keys))
    before = F.coalesce(F.lag(furniture).over(w), F.lit(False))
    return df.withColumn("after_furniture", before).withColumn("before_last_click", F.coalesce(F.col(order) < last, F.lit(False)))


def counter_delta(df: DataFrame, keys: list[str], order: str, value: str, most: int = 10) -> DataFrame:
    """keys, order and delta: what a cumulative counter rose by, as ``most`` rows a frame at most (``nth`` from 1)."""
    w = Window.partitionBy(*keys).orderBy(order)
    rise = F.col(value) - F.lag(F.col(value), 1, 0).over(w)
    some = df.select(*keys, order, rise.alias("delta")).where("delta > 0")
    return some.withColumn("nth", F.explode(F.sequence(F.lit(1), F.least(F.col("delta"), F.lit(most)).cast("int"))))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start, end: unions of overlapping or touching intervals."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = df.withColumn("__b", F.coalesce(F.col(start) > far, F.lit(True)).cast("int"))
    named = cut.withColumn("__i", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(*keys, "__i").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__i")


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows by ``order`` (which must be unique): a top-n, so each task passes on n rows at most."""
    return df.orderBy(F.desc(order)).limit(n)


def span_lookup(points: DataFrame, spans: DataFrame, keys: list[str], bucket: int = 1000) -> DataFrame:
    """points with the span (start <= at <= end, both inclusive) that holds them.

    Spans are laid into buckets of ``bucket`` positions, so the join is on (keys, bucket), not on all pairs of a key.
    """
    b = lambda c: F.floor(F.col(c) / bucket)
    laid = spans.withColumn("__b", F.explode(F.sequence(b("start"), b("end"))))
    return points.withColumn("__b", b("at")).join(laid, [*keys, "__b"]).where("start <= at AND at <= end").drop("__b")


def nearest_p90(df: DataFrame, keys: list[str], value: str, least: int = 20) -> DataFrame:
    """keys, n, p90: the value at index floor(0.9 n) of the sorted values (from 0); null below ``least`` rows.

    Ranks come from a cumulative count over distinct values, so a group is one row for each value it holds.
    """
    n = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = n.withColumn("cum", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    place = F.floor(F.col("n") * 9 / 10)
    picked = cum.groupBy(*keys, "n").agg(F.min(F.when(F.col("cum") > place, F.col(value))).alias("p90"))
    return picked.withColumn("p90", F.when(F.col("n") >= least, F.col("p90")))


def neighbour_chains(df: DataFrame, keys: list[str], x: str, y: str, node: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """a, b: edges between positions an offset apart (to the larger of each pair), kept where unique both ways."""
    laid = df.select(*keys, F.col(node).alias("a"), F.explode(F.array(*(F.struct(F.lit(p).alias("dx"), F.lit(q).alias("dy")) for p, q in offsets))).alias("o"), x, y)
    aim = laid.select(*keys, "a", (F.col(x) + F.col("o.dx")).alias(x), (F.col(y) + F.col("o.dy")).alias(y))
    met = aim.join(df.select(*keys, x, y, F.col(node).alias("b")), [*keys, x, y])
    out, into = F.count("*").over(Window.partitionBy("a")), F.count("*").over(Window.partitionBy("b"))
    return met.select("a", "b", out.alias("o"), into.alias("i")).where("o = 1 AND i = 1").select("a", "b")
