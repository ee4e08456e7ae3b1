"""Checks of an output against its baseline. Each gives rows (level, category, key, message); an output is blocked by an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import count, tokens
from millrace.operators.lookup import hashes, union_all


def issues(df: DataFrame, bad: Column, level: Column | str, category: str, key: str, message: Column | str) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.where(bad).select(
        as_col(level).alias("level"), F.lit(category).alias("category"), F.col(key).cast("string").alias("key"), as_col(message).alias("message")
    )


def parse_regression(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """A document that parsed before and does not now is an error; one that parsed neither time a warning."""
    both = before.select(key, F.col(text).alias("__b")).join(after.select(key, F.col(text).alias("__a")), key)
    bad_a, bad_b = F.try_parse_json("__a").isNull(), F.try_parse_json("__b").isNull()
    return issues(both, bad_a, F.when(bad_b, "warning").otherwise("error"), "json", key, "unparseable")


def immutable_changed(df: DataFrame, key: str, locked: Column, source: str, output: str, official: DataFrame) -> DataFrame:
    """Locked values that changed, unless to their official translation."""
    changed = df.where(locked & ~F.col(output).eqNullSafe(F.col(source))).select(key, *hashes(source, output), F.col(output).isNull().alias("__none"))
    exempt = official.where("source IS NOT NULL AND target IS NOT NULL").select(*hashes("source", "target"), F.lit(False).alias("__none"))
    # few rows of either side, and these as hashes
    return issues(changed.join(exempt, ["__h1", "__h2", "__none"], "left_anti"), F.lit(True), "error", "immutable", key, "changed")


def book_layout(df: DataFrame, key: str, source: str, output: str) -> DataFrame:
    """Line break count and edges of a page must survive."""
    s, t = F.col(source), F.col(output)
    moved = count(s, "\n") != count(t, "\n")
    edge = (s.startswith("\n") != t.startswith("\n")) | (s.endswith("\n") != t.endswith("\n"))
    return issues(df, moved | edge, "error", "book", key, F.when(moved, "line_count").otherwise("edge_break"))


def token_issues(df: DataFrame, key: str, source: str, output: str, pattern: str, name: str) -> DataFrame:
    changed = F.array_sort(tokens(F.col(source), pattern)) != F.array_sort(tokens(F.col(output), pattern))
    return issues(df, changed, "error", "tokens", key, name)


def read_back(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reason: what was to be written and does not stand there."""
    met = expected.join(actual.withColumnRenamed("value", "got"), keys, "left")
    reason = F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("value"), "differs")
    return met.select(*keys, reason.alias("reason")).where("reason IS NOT NULL")


def content_changed(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """Documents whose hash changed, gone and new ones: hashes meet, texts do not."""
    a = before.select(key, F.sha2(F.col(text), 256).alias("ha"))
    b = after.select(key, F.sha2(F.col(text), 256).alias("hb"))
    met = a.join(b, key, "full")
    state = F.when(F.col("ha").isNull(), "new").when(F.col("hb").isNull(), "gone").when(F.col("ha") != F.col("hb"), "changed")
    return met.select(key, state.alias("state")).where("state IS NOT NULL")


def arguments_changed(before: DataFrame, after: DataFrame, keys: list[str], allowed: DataFrame) -> DataFrame:
    """keys of arguments that changed and have no row in the allow-list."""
    was, now = F.col("value").alias("__was"), F.col("value").alias("__now")
    met = before.select(*keys, was).join(after.select(*keys, now), keys, "full")
    return met.where(~F.col("__was").eqNullSafe(F.col("__now"))).join(allowed.select(*keys).distinct(), keys, "left_anti").select(*keys)


def summary(checks: list[DataFrame]) -> DataFrame:
    """errors, warnings, blocked over all checks."""
    level = F.col("level")
    return union_all(checks).agg(
        F.count_if(level == "error").alias("errors"),
        F.count_if(level == "warning").alias("warnings"),
        (F.count_if(level == "error") > 0).alias("blocked"),
    )
