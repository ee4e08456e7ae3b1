"""Sharing and consistency inside groups of equal sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.operators.lookup import first_by


def canonical_key(layout: Column, obj: Column, role: Column, source: Column) -> Column:
    return (
        F.when(layout.isNotNull(), F.concat(F.lit("layout:"), layout))
        .when(obj.isNotNull(), F.concat(F.lit("object:"), obj))
        .otherwise(F.concat(F.lit("display:"), role, F.lit(":"), source))
    )


def leaders(units: DataFrame, key: str, seq: str, shareable: Column) -> DataFrame:
    """``leader``: the first shareable unit of each key; a unit that can't be shared leads itself."""
    least = units.where(shareable).groupBy(key).agg(F.min(seq).alias("leader"))
    return units.join(least, key, "left").withColumn("leader", F.when(shareable, F.col("leader")).otherwise(F.col(seq)))


def share_targets(units: DataFrame, key: str, target: str) -> DataFrame:
    """``shared`` and ``conflict``: the group's only distinct target for units without one; several are a conflict.

    Counted by key first: the group of a frequent key is one row, never a window over all its units.
    """
    filled = units.where(F.col(target).isNotNull() & (F.col(target) != ""))
    per = filled.groupBy(key).agg(F.min(target).alias("lo"), F.max(target).alias("hi"))
    met = units.join(per, key, "left")
    same = F.col("lo") == F.col("hi")
    value = F.coalesce(F.when(F.col(target) != "", F.col(target)), F.when(same, F.col("lo")))
    return met.withColumn("shared", value).withColumn("conflict", F.coalesce(~same, F.lit(False))).drop("lo", "hi")


def majority(units: DataFrame, key: str, target: str, seq: str) -> DataFrame:
    """key, winner, votes: the commonest target; a tie goes to the one that comes first."""
    n = units.groupBy(key, target).agg(F.count("*").alias("votes"), F.min(seq).alias("__first"))
    return first_by(n, [key], F.desc("votes"), F.asc("__first")).select(key, F.col(target).alias("winner"), "votes")


def conflicts(units: DataFrame, source: str, target: str, seq: str, top: int = 8, samples: int = 3) -> DataFrame:
    """norm, target, n, samples, rank: the ``top`` targets of every source that has several, with the first places."""
    norm = units.withColumn("norm", F.lower(strip(F.col(source))))
    n = norm.groupBy("norm", target).agg(F.count("*").alias("n"))
    several = n.groupBy("norm").agg(F.count("*").alias("kinds")).where("kinds > 1").select("norm")
    rank = F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("n"), target))
    ranked = n.join(several, "norm").withColumn("rank", rank).where(F.col("rank") <= top)
    # of each pair's places every task passes on ``samples`` at most
    turn = F.row_number().over(Window.partitionBy("norm", target).orderBy(seq))
    places = norm.select("norm", target, seq).withColumn("__turn", turn).where(F.col("__turn") <= samples)
    places = places.groupBy("norm", target).agg(F.array_sort(F.collect_set(seq)).alias("samples"))
    return ranked.join(places, ["norm", target]).select("norm", target, "n", "samples", "rank")


def merge_conflicts(frames: list[DataFrame], key: str, target: str) -> DataFrame:
    """key, first and targets: the first list that has a key gives ``first``; all its targets are kept in order."""
    tagged = [f.select(key, target, F.lit(k).alias("list"), "ord") for k, f in enumerate(frames)]
    both = tagged[0]
    for f in tagged[1:]:
        both = both.unionByName(f)
    ordered = F.array_sort(F.collect_list(F.struct("list", "ord", target)))
    return both.groupBy(key).agg(ordered.alias("x")).select(
        key, F.col("x")[0]["list"].alias("first"), F.array_distinct(F.transform("x", lambda v: v[target])).alias("targets")
    )


def duplicate_names(files: DataFrame, path: str, most: int = 20) -> DataFrame:
    """name, n, paths: base names, without case, that several files have, and the first ``most`` of these (a report's cap)."""
    named = files.select(F.lower(F.element_at(F.split(F.col(path), "/"), -1)).alias("name"), path)
    n = named.groupBy("name").agg(F.count("*").alias("n")).where("n >= 2")
    turn = F.row_number().over(Window.partitionBy("name").orderBy(path))
    first = named.withColumn("__turn", turn).where(F.col("__turn") <= most).groupBy("name").agg(F.array_sort(F.collect_list(path)).alias("paths"))
    return n.join(first, "name")


def content_fingerprint(files: DataFrame, folder: str, path: str, digest: str) -> DataFrame:
    """folder and fingerprint: sha256 over ``path NUL digest LF`` of a folder's files in order of their paths.

    The value is defined over all of a folder's files in one sequence, so their paths and digests (not their contents)
    meet in one row: some 100 bytes a file."""
    lines = F.array_sort(F.collect_list(F.struct(path, digest)))
    joined = F.array_join(F.transform(lines, lambda x: F.concat(x[path], F.lit("\x00"), x[digest], F.lit("\n"))), "")
    return files.groupBy(folder).agg(F.sha2(joined, 256).alias("fingerprint"))
