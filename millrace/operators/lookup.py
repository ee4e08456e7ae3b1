"""Prioritised lookups: equi joins on composite keys, with ties settled by declared order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip

#: Rows and bytes (as JSON) up to which a dimension is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def sized(dim: DataFrame) -> DataFrame:
    """The dimension with a broadcast hint if it is proven small."""
    size = dim.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(dim) if size.n <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES else dim


def hashes(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the columns, as ``__h1`` and ``__h2``: a join's key that is short whatever the texts."""
    return [F.xxhash64(*columns).alias("__h1"), F.xxhash64(*columns, F.lit(1)).alias("__h2")]


def first_by(df: DataFrame, keys: list[str | Column], *order: Column) -> DataFrame:
    """One row for each key: the first by the order given."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def seed_join(units: DataFrame, seeds: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """Units with the target of the seed that has the same keys; locked units and seeds that equal their source get none.

    Keys meet as 128 bits of hash, not as whole texts. A unit with a null key has no seed."""
    good = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col(target).isNotNull() & (F.col(target) != F.col("source_text")))
    wanted = seeds.where(good).select(*hashes(*keys), target)
    met = units.select("*", *hashes(*keys)).join(wanted, ["__h1", "__h2"], "left").drop("__h1", "__h2")
    whole = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col("policy") == "TRANSLATABLE_DISPLAY")
    return met.withColumn(target, F.when(whole, F.col(target)))


def memory_join(units: DataFrame, memory: DataFrame, fallback: bool = False) -> DataFrame:
    """Exact (namespace, source, context) hits; with ``fallback``, else the latest target of (namespace, source)."""
    keys = ["namespace", "source", "context"]
    out = units.join(memory.select(*keys, F.col("target").alias("exact")), keys, "left")
    hit = F.when(F.col("exact") != F.col("source"), F.col("exact"))
    if fallback:
        latest = first_by(memory, keys[:2], F.desc("updated_at"), F.asc("context"))
        out = out.join(latest.select(*keys[:2], F.col("target").alias("latest")), keys[:2], "left")
        return out.select(*units.columns, F.coalesce(hit, F.when(F.col("latest") != F.col("source"), F.col("latest"))).alias("target"))
    return out.select(*units.columns, hit.alias("target"))


def alias_join(units: DataFrame, memory: DataFrame, alias: Column) -> DataFrame:
    """A second chance by a derived context, where the exact one gave nothing."""
    first = units.join(memory.select("context", F.col("target").alias("t1")), "context", "left")
    other = memory.select(F.col("context").alias("__alias"), F.col("target").alias("t2"))
    return first.join(other, alias == F.col("__alias"), "left").select(*units.columns, F.coalesce("t1", "t2").alias("target"))


def cascade(units: DataFrame, stores: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """The first store that has the unit wins: ``target`` and ``origin``. Stores: name, table with target, keys."""
    for k, (_, store, keys) in enumerate(stores):
        units = units.join(store.select(*keys, F.col("target").alias(f"__t{k}")), keys, "left")
    names = [F.when(F.col(f"__t{k}").isNotNull(), F.lit(name)) for k, (name, _, _) in enumerate(stores)]
    hits = [F.col(f"__t{k}") for k in range(len(stores))]
    return units.withColumn("target", F.coalesce(*hits)).withColumn("origin", F.coalesce(*names)).drop(*(f"__t{k}" for k in range(len(stores))))


def glossary_exact(units: DataFrame, glossary: DataFrame, text: str) -> DataFrame:
    """The target of the entry whose source equals the text without case and edges: highest priority, then latest."""
    entry = glossary.withColumn("__key", F.lower(strip(F.col("source"))))
    best = first_by(entry, ["__key"], F.desc("priority"), F.desc("ord")).select("__key", "target")
    key = F.lower(strip(F.col(text)))
    return units.withColumn("__key", key).join(sized(best), "__key", "left").drop("__key")


def official_exact(terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target, conflict: the target if all entries of a key agree, else none and a conflict."""
    one = terms.groupBy(*keys).agg(F.min("target").alias("target"), (F.min("target") != F.max("target")).alias("conflict"))
    return one.withColumn("target", F.when(~F.col("conflict"), F.col("target")))


def term_containment(units: DataFrame, terms: DataFrame, cap: int = 16) -> DataFrame:
    """unit, source, target: terms whose words stand in the unit's text, best priority first, ``cap`` at most.

    Both sides meet on single words, not in a nested loop: a term is looked up by its first word and then compared as a
    whole. A unit that meets an ambiguous term (one source, several targets) gets none.
    """
    parts = F.split(F.lower(F.col("source")), " ")
    known = terms.groupBy("source").agg(
        F.min("target").alias("target"), F.max("priority").alias("priority"), (F.min("target") != F.max("target")).alias("ambiguous")
    )
    known = known.withColumn("__words", parts).withColumn("__head", F.element_at("__words", 1))
    words = units.select("unit", F.split(F.lower(F.col("text")), r"[^a-z0-9]+").alias("w"))
    heads = words.select("unit", "w", F.posexplode("w").alias("at", "__head"))
    met = heads.join(sized(known), "__head").where(F.slice("w", F.col("at") + 1, F.size("__words")) == F.col("__words"))
    met = met.select("unit", "source", "target", "priority", "ambiguous").distinct()
    per_unit = Window.partitionBy("unit")
    void = F.max("ambiguous").over(per_unit)
    rank = F.row_number().over(per_unit.orderBy(F.desc("priority"), "source"))
    return met.select("unit", "source", "target", void.alias("void"), rank.alias("rank")).where(~F.col("void") & (F.col("rank") <= cap)).drop("void")


def maximal_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (start, end) that no longer span of the same keys holds.

    Sorted by start and then by falling end, a span lies within an earlier one just if the furthest end so far reaches
    its own; of equal spans the first tells it for all. One shuffle by the keys.
    """
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(Window.partitionBy(*keys, "start", "end").orderBy("__row"))
    held = spans.withColumn("__far", before).withColumn("__row", F.row_number().over(order)).withColumn("__first", first)
    free = F.col("__far").isNull() | (F.col("__far") < F.col("end"))
    mine = F.bool_or((F.col("__first") == 1) & free).over(Window.partitionBy(*keys, "start", "end"))
    return held.withColumn("__free", mine).where("__free").select(*spans.columns)


def asset_full(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """For (modid, hash) the entry of the source ``local``, else of the first source by name."""
    best = first_by(entries, ["modid", "hash"], F.col("source") != "local", F.col("source"))
    return wanted.join(best, ["modid", "hash"], "left")


def asset_partial(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """For (modid, key, value) the target of the first source that has the same English value."""
    best = first_by(entries, ["modid", "key", "value"], F.col("source")).select("modid", "key", "value", "target")
    return wanted.join(best, ["modid", "key", "value"], "left")


def coverage_status(english: Column, target: Column, valid: Column) -> Column:
    """empty, same_as_english, valid, invalid or missing of one key's pair."""
    return (
        F.when(target.isNull(), "missing")
        .when(strip(target) == "", "empty")
        .when(target == english, "same_as_english")
        .when(valid, "valid")
        .otherwise("invalid")
    )


def user_choice(units: DataFrame, choices: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``choice``: the name of the first table that holds the unit, else automatic. choices: name, table, key."""
    out = units
    for k, (_, df, key) in enumerate(choices):
        out = out.join(df.select(key, F.lit(True).alias(f"__c{k}")).distinct(), key, "left")
    picked = [F.when(F.col(f"__c{k}"), F.lit(name)) for k, (name, _, _) in enumerate(choices)]
    return out.withColumn("choice", F.coalesce(*picked, F.lit("automatic"))).drop(*(f"__c{k}" for k in range(len(choices))))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def mod_coverage(entries: DataFrame, mods: DataFrame) -> DataFrame:
    """modid, state and source: full with its first entry's source if the mod has any, else none."""
    first = entries.groupBy("modid").agg(F.min(F.struct("ord", "source"))["source"].alias("source"))
    state = F.when(F.col("source").isNotNull(), "full").otherwise("none")
    return mods.select("modid").distinct().join(first, "modid", "left").select("modid", state.alias("state"), "source")


def newest_report(reports: DataFrame, keys: list[str], usable: Column | None = None) -> DataFrame:
    """The newest report of each key. With ``usable`` only such reports count; without, an empty newer one hides older ones."""
    return first_by(reports.where(usable) if usable is not None else reports, keys, F.desc("mtime"), F.desc("path"))


def allowed_fragments(units: DataFrame, allow: DataFrame, keys: list[str], file: str) -> DataFrame:
    """Units with an allow-list row of the same keys and source whose whole passage stands in the unit's file.

    The members of the passages are looked up one by one: no file's locators are ever brought together."""
    met = units.join(allow.withColumnRenamed("source", "__source"), keys).where(F.col("source") == F.col("__source"))
    met = met.withColumn("__want", F.array_distinct("passage")).withColumn("__unit", F.xxhash64(*keys, "locator", file, "__want"))
    want = met.select("__unit", file, F.explode("__want").alias("locator"), F.size("__want").alias("__n")).distinct()
    have = want.join(units.select(file, "locator").distinct(), [file, "locator"], "left_semi")
    whole = have.groupBy("__unit", "__n").agg(F.count("*").alias("__have")).where(F.col("__have") == F.col("__n")).select("__unit")
    return met.where(F.size("__want") == 0).select(*units.columns).unionByName(met.join(whole, "__unit", "left_semi").select(*units.columns))


def member_sets(members: DataFrame, stored: DataFrame) -> DataFrame:
    """group, chain, state: kept if the group's members are just the stored ones and so in all groups of its chain."""
    now = members.groupBy("group").agg(F.array_sort(F.collect_set("member")).alias("__now"))
    same = stored.join(now, "group", "left").withColumn("__ok", F.coalesce(F.array_sort("stored") == F.col("__now"), F.lit(False)))
    chain = same.groupBy("chain").agg(F.bool_and("__ok").alias("__all"))
    state = F.when(F.col("__all"), "kept").otherwise("rolled_back")
    return same.join(chain, "chain").select("group", "chain", state.alias("state"))


def new_glyphs(source: Column, target: Column, glyphs: list[str]) -> Column:
    """Overridden characters that the target has and the source has not, sorted."""
    chars = lambda c: F.split(c, "")
    known = F.array(*map(F.lit, glyphs))
    return F.array_sort(F.array_except(F.array_intersect(chars(target), known), chars(source)))
