"""Rewriting of lines by spans, and proofs of what a rewritten line keeps. Offsets are characters, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import FORMAT_CODE, PLACEHOLDER, URL, same_tokens


def splice(line: Column, edits: Column) -> Column:
    """The line with its edits (array of start, end, text) put in from the last to the first, so that earlier offsets hold.
    Null where two edits overlap or one reaches beyond the line; a null or empty array gives the line."""
    order = F.array_sort(F.coalesce(edits, F.array().cast("array<struct<start:int,end:int,text:string>>")))
    ordered = F.transform(order, lambda e, i: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.coalesce(F.get(order, i + 1)["start"], F.length(line)).alias("next")))
    fine = F.forall(ordered, lambda e: (e["start"] >= 0) & (e["start"] <= e["end"]) & (e["end"] <= e["next"]))
    put = lambda acc, e: F.concat(F.left(acc, e["start"]), e["text"], F.substring(acc, e["end"] + 1, F.length(acc)))
    return F.when(fine, F.aggregate(F.reverse(order), line, put))


def outside(line: Column, spans: Column) -> Column:
    """The parts of a line outside its spans (array of start, end), spans that touch or overlap taken together."""
    order = F.array_sort(spans)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = s["start"] > acc["at"]
        part = F.substring(line, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], s["end"]).cast("int").alias("at"), F.when(gap, F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts")
        )

    rest = lambda acc: F.concat(acc["parts"], F.array(F.substring(line, acc["at"] + 1, F.length(line))))
    return F.aggregate(order, start, step, rest)


def same_mechanism(source: Column, target: Column) -> Column:
    """Whether a changed line keeps its placeholders, codes and addresses."""
    return same_tokens(source, target, PLACEHOLDER) & same_tokens(source, target, FORMAT_CODE) & same_tokens(source, target, URL)


def line_states(before: DataFrame, after: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and state of every line before: ``equal``, ``missing``, ``kept`` (changed, but no mechanism) or ``broken``."""
    met = before.select(*keys, F.col(text).alias("source")).join(after.select(*keys, F.col(text).alias("target")), keys, "left")
    source, target = F.col("source"), F.col("target")
    state = F.when(target.isNull(), "missing").when(target == source, "equal").when(same_mechanism(source, target), "kept").otherwise("broken")
    return met.select(*keys, state.alias("state"))


def adoption(passages: DataFrame, revisions: DataFrame, key: str) -> DataFrame:
    """key and reason of every revision (key, members, source_hash, blocked): why it may not be adopted, or null.

    passages: key, members (array of the members that can be written) and source_hash. The first reason that holds decides.
    """
    p = passages.select(key, F.array_sort("members").alias("writable"), F.col("source_hash").alias("now"))
    met = revisions.join(p, key, "left")
    members = F.array_sort("members")
    reason = (
        F.when(F.col("now").isNull(), "no such passage")
        .when(F.col("blocked"), "blocked")
        .when(F.col("now") != F.col("source_hash"), "source changed")
        .when(F.size("members") == 0, "no members")
        .when(F.size(F.array_distinct("members")) < F.size("members"), "repeated member")
        .when(F.size(F.array_except("members", "writable")) > 0, "member not writable")
        .when(members != F.col("writable"), "member missing")
    )
    return met.select(key, reason.alias("reason"))


def argument_locks(calls: DataFrame, verdicts: DataFrame, allowed: DataFrame) -> DataFrame:
    """function, argument and lock of distinct calls: locked where the verdict is not ``display`` (no verdict: ``unknown``),
    unless the allow-list names the pair and the verdict is ``unknown`` or ``unused``."""
    own = ["function", "argument"]
    met = calls.select(*own).distinct().join(verdicts.select(*own, "verdict"), own, "left")
    met = met.join(allowed.select(*own).distinct().withColumn("allowed", F.lit(True)), own, "left")
    verdict = F.coalesce("verdict", F.lit("unknown"))
    rescued = F.coalesce("allowed", F.lit(False)) & verdict.isin("unknown", "unused")
    return met.select(*own, verdict.alias("verdict"), ((verdict != "display") & ~rescued).alias("locked"))
