"""Policies of text units: which may be translated, and why. A policy is an ordered list of rules, folded into one CASE."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import literal_lock, tokens

ID, MATCH, DISPLAY, REVIEW = "IMMUTABLE_ID", "IMMUTABLE_MATCH_VALUE", "TRANSLATABLE_DISPLAY", "UNKNOWN_REVIEW"
LANGUAGE_FORMATS = ("json-lang", "legacy-lang")
# JSON keys that hold display text, objects that hold mechanism, and parents under which ``name`` is display.
TEXT_KEYS = (
    "text title subtitle description name display summary tooltip body label message contents fallback item_name custom_name lore "
    "texts question answer reply options choices dialogue"
).split()
MECHANISM_OBJECTS = ("score", "custom_data", "clickevent", "click_event")
NAMED_PARENTS = ("display", "item", "entity", "dialog", "dialogue", "option", "choice")


@dataclass(frozen=True)
class Rule:
    when: Column
    policy: str
    reason: str


def decide(rules: list[Rule], policy: str, reason: str) -> Column:
    """struct<policy, reason> of the first rule that holds, else the given one."""
    pair = lambda p, r: F.struct(F.lit(p).alias("policy"), F.lit(r).alias("reason"))
    out = None
    for r in rules:
        out = F.when(r.when, pair(r.policy, r.reason)) if out is None else out.when(r.when, pair(r.policy, r.reason))
    return pair(policy, reason) if out is None else out.otherwise(pair(policy, reason))


def pointer_policy(pointer: Column, form: Column) -> Column:
    """Policy of a JSON pointer. An item of a list takes the role of the list's own key, and of no further ancestor."""
    part = lambda x: F.lower(F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    keys = F.transform(F.filter(F.split(pointer, "/"), lambda x: x != ""), part)
    n = F.size(keys)
    at = lambda k: F.coalesce(F.get(keys, n - k), F.lit(""))
    above = F.slice(keys, F.lit(1), F.greatest(n - 1, F.lit(0)))
    sealed = F.exists(above, lambda x: x.isin(*MECHANISM_OBJECTS) | (F.substring_index(x, ":", -1) == "custom_data"))
    item = at(1).rlike(r"^\d+$") & (n >= 2)
    rules = [
        Rule(form.isin(*LANGUAGE_FORMATS), DISPLAY, "language value"),
        Rule(n == 0, REVIEW, "empty pointer"),
        Rule(sealed, MATCH, "below a mechanism object"),
        Rule((at(1) == "name") & ~at(2).isin(*NAMED_PARENTS), REVIEW, "name of unknown role"),
        Rule(at(1).isin(*TEXT_KEYS), DISPLAY, "display key"),
        Rule(item & (at(2) == "name") & ~at(3).isin(*NAMED_PARENTS), REVIEW, "name of unknown role"),
        Rule(item & at(2).isin(*TEXT_KEYS), DISPLAY, "item of a display key"),
    ]
    return decide(rules, REVIEW, "unaudited key")


def unit_policy(form: Column, text: Column, preset: Column, suspected: Column, by_locator: Column) -> Column:
    """struct<policy, reason> of a unit: suspicion, presets, literals and then its locator's policy, in this order."""
    keep = lambda c: F.struct(c.alias("policy"), F.lit("preset").alias("reason"))
    fixed = lambda p, r: F.struct(F.lit(p).alias("policy"), F.lit(r).alias("reason"))
    locked, known = preset.isin(ID, MATCH), preset.isin(ID, MATCH, DISPLAY, REVIEW)
    return (
        F.when(suspected & ~F.coalesce(locked, F.lit(False)), fixed(REVIEW, "suspected cipher"))
        .when(locked, keep(preset))
        .when(~form.isin(*LANGUAGE_FORMATS) & literal_lock(text), fixed(MATCH, "literal"))
        .when(known, keep(preset))
        .when(form.isin(*LANGUAGE_FORMATS), fixed(DISPLAY, "language value"))
        .otherwise(by_locator)
    )


def suspected_containers(units: DataFrame, container: str, text: str) -> DataFrame:
    """The containers whose texts look like a cipher: eight texts or more, 160 letters, 95 % of them capitals, eight
    different words of six capitals, four of them with five consonants in a row.

    Every signal is a count, so a container's texts are never brought together; words are counted once by a distinct.
    Null texts count as none.
    """
    letters, capitals = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[A-Z]"))
    dense = units.groupBy(container).agg(F.count("*").alias("n"), F.sum(letters).alias("letters"), F.sum(capitals).alias("capitals"))
    dense = dense.where("n >= 8 AND letters >= 160 AND capitals >= 0.95 * letters").select(container)
    words = units.select(container, F.explode(tokens(F.col(text), r"\b[A-Z]{6,}\b")).alias("word")).join(dense, container, "left_semi").distinct()
    found = words.groupBy(container).agg(F.count("*").alias("words"), F.count_if(F.col("word").rlike("[BCDFGHJKLMNPQRSTVWXZ]{5,}")).alias("broken"))
    return found.where("words >= 8 AND broken >= 4").select(container)
