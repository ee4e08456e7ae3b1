"""Outcome accounts, counters and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import CJK


def outcome(writeback: Column, rejected: Column, policy: Column, target: Column, source: Column, keep: Column) -> Column:
    """The one outcome of a unit; the first rule that holds decides."""
    unchanged = target.isNull() | (target == source)
    return (
        F.when(writeback == "failed", "writeback_failed")
        .when(rejected, "candidate_rejected")
        .when(writeback == "blocked", "source_preserved")
        .when((policy != "TRANSLATABLE_DISPLAY") & unchanged, "mechanism_locked")
        .when(target.isNull() & keep, "intentional_keep")
        .when(target.isNull(), "pending")
        .when(target == source, "source_preserved")
        .when(writeback.isin("changed", "unchanged") | target.rlike(CJK), "written")
        .otherwise("pending")
    )


def unfinished(outcome: Column) -> Column:
    return outcome.isin("pending", "candidate_rejected", "writeback_failed")


def counter_merge(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy(key).agg(F.sum(value).alias(value))


def latest_state(events: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """key and state of the last observation; seq must be unique within a key."""
    return events.groupBy(key).agg(F.max(F.struct(seq, state))[state].alias(state))


def latency(events: DataFrame, ok: Column, value: str) -> DataFrame:
    """calls, ok, avg_ms: the mean over successful calls, cut to a whole number."""
    return events.agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("ok"), F.floor(F.avg(F.when(ok, F.col(value)))).alias("avg_ms")
    )


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price of a call per million tokens; null without a price or without tokens."""
    amount = (tokens_in * price_in + tokens_out * price_out) / 1e6
    return F.when(price_in.isNotNull() & price_out.isNotNull() & (tokens_in + tokens_out > 0), amount)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page with ``total``, the number of all rows. The total is a second, small aggregate, not a window over all rows
    in one task."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def capped_details(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key, with the key's exact total."""
    total = df.groupBy(key).agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("rank", rank).where(F.col("rank") <= most).join(total, key)


def before_after(source: Column, target: Column) -> list[Column]:
    """Counts of what happened to each text."""
    return [
        F.count("*").alias("total"),
        F.count_if(target.isNull()).alias("untouched"),
        F.count_if(target == source).alias("same"),
        F.count_if(target != source).alias("changed"),
        F.count_if(target == "").alias("emptied"),
        F.count_if(F.length(target) > F.length(source)).alias("longer"),
        F.count_if(F.length(target) < F.length(source)).alias("shorter"),
    ]


def container_risk(df: DataFrame, keys: list[str], source: str, target: str, limit: int = 400) -> DataFrame:
    """keys, chars: containers whose joined visible text passes ``limit`` characters (lengths add up: nothing is joined)."""
    shown = F.length(F.coalesce(F.col(target), F.col(source)))
    return df.groupBy(*keys).agg(F.sum(shown).alias("chars")).where(F.col("chars") > limit)


def verdict(sinks: DataFrame, keys: list[str]) -> DataFrame:
    """Per parameter: mechanism if any sink is, display if all are, unused without sinks, else unknown."""
    kind = F.col("kind")
    return sinks.groupBy(*keys).agg(
        F.when(F.count_if(kind == "mechanism") > 0, "mechanism")
        .when(F.count(kind) == 0, "unused")
        .when(F.count_if(kind != "display") == 0, "display")
        .otherwise("unknown")
        .alias("verdict")
    )


def forward(edges: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """root, node, step: nodes that are reached within ``depth`` steps, by the shortest way; cycles end by themselves.

    edges (src, dst) joined level by level, each level without what was reached before.
    """
    seen = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("step"))
    level = seen
    for k in range(1, depth + 1):
        nxt = level.join(edges, level.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        level = nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("step", F.lit(k))
        seen = seen.unionByName(level)
    return seen


def resolved(passes: DataFrame, sinks: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """node and verdict of every root parameter, by what it is passed on to: ``mechanism`` if any sink it reaches is one,
    ``display`` if all are, else ``unknown``.

    passes: src and dst (parameters), sinks: node and kind. A parameter without a sink or anything it is passed to is
    unknown, and so is what lies beyond ``depth`` steps; cycles add nothing.
    """
    seen = forward(passes.select("src", "dst").distinct(), roots.select("node").distinct(), depth)
    kinds = sinks.groupBy("node").agg(F.bool_or(F.col("kind") == "mechanism").alias("bad"), F.bool_and(F.col("kind") == "display").alias("good"))
    on = passes.select(F.col("src").alias("node"), F.lit(True).alias("on")).distinct()
    met = seen.join(kinds, "node", "left").join(on, "node", "left")
    # what is neither a sink nor passed on, or is passed on at the last step, is not known
    open_ = (F.col("good").isNull() & F.col("on").isNull()) | (F.col("on") & (F.col("step") == depth))
    all_good = F.bool_and(F.coalesce("good", F.lit(True)) & ~F.coalesce(open_, F.lit(False))) & F.bool_or(F.coalesce("good", F.lit(False)))
    verdict = F.when(F.bool_or("bad"), "mechanism").when(all_good, "display").otherwise("unknown")
    return met.groupBy(F.col("root").alias("node")).agg(verdict.alias("verdict"))
