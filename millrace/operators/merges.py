"""Fragments that were dropped because a passage carries their sentence: each needs its proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip

KEY = ("file_path", "locator")


def merge_proofs(units: DataFrame, passages: DataFrame, written: DataFrame) -> DataFrame:
    """file_path, locator, reason and not_units of every dropped fragment; reason is null where all proofs hold.

    ``units``: file_path, locator, source_text, final_target. ``passages``: file_path, locator and passage, the locators of
    the sentence's members (a few, as a sentence has). ``written``: file_path, locator, text, as read back from the output.
    A file path and locator name one row in each. Dropped is what has a blank final_target; members of nested archives
    (``!/``) are not asked for, and a null target is not a drop.

    The proofs, the first that fails being the reason: the passage names members (``no_passage``); each is a unit, or stands in
    the output with text (``unproven_member``); the passage has any text (``no_text``); of its other units one at least was
    translated (``untranslated``); the fragment's word does not stand by itself in the passage (``word_left``); and the
    fragment's own line breaks are kept (``breaks_lost``). ``not_units`` counts members that only the output proves, which is
    a warning.
    """
    u = units.select(*KEY, "source_text", "final_target")
    blank = F.col("final_target").isNotNull() & (strip(F.col("final_target")) == "")
    dropped = u.where(blank & ~F.col("file_path").contains("!/")).join(passages.select(*KEY, F.col("passage").alias("passage_")), list(KEY))
    named = dropped.select(*KEY, F.posexplode("passage_").alias("place_", "member_")).where(F.col("member_").isNotNull())
    unit = u.select("file_path", F.col("locator").alias("member_"), F.lit(True).alias("unit_"), "source_text", "final_target")
    read = written.select("file_path", F.col("locator").alias("member_"), F.col("text").alias("read_"))
    m = named.join(unit, ["file_path", "member_"], "left").join(read, ["file_path", "member_"], "left")
    is_unit, shows = F.col("unit_").isNotNull(), F.coalesce(strip(F.col("read_")) != "", F.lit(False))
    other = is_unit & (F.col("member_") != F.col("locator"))
    text = F.when(is_unit, F.coalesce("final_target", "source_text")).when(shows, F.col("read_"))
    facts = m.groupBy(*KEY).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(is_unit.alias("a"), F.col("place_").alias("b"), text.alias("c")))), lambda x: x["c"]), "").alias("text_"),
        F.count("*").alias("members_"),
        F.count_if(~is_unit).alias("not_units"),
        F.count_if(~is_unit & ~shows).alias("unproven_"),
        F.count_if(other).alias("others_"),
        F.count_if(other & (F.coalesce("final_target", F.lit("")) != F.col("source_text"))).alias("translated_"),
    )
    word = strip(F.col("source_text"))
    alone = F.concat(F.lit(r"(?<![A-Za-z])\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z])"))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    reason = (
        F.when(F.coalesce("members_", F.lit(0)) == 0, "no_passage")
        .when(F.col("unproven_") > 0, "unproven_member")
        .when(strip(F.col("text_")) == "", "no_text")
        .when((F.col("others_") > 0) & (F.col("translated_") == 0), "untranslated")
        .when((word != "") & F.regexp_like(F.col("text_"), alone), "word_left")
        .when(breaks(F.col("source_text")) > breaks(F.col("final_target")), "breaks_lost")
    )
    held = dropped.join(facts, list(KEY), "left")
    return held.select(*KEY, reason.alias("reason"), F.coalesce("not_units", F.lit(0)).cast("long").alias("not_units"))
