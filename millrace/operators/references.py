"""The reference index and the locks that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip


def reference_index(refs: DataFrame, most: int = 12) -> DataFrame:
    """One row an object: kind of its first occurrence, exact counts of definitions and uses, and its first ``most`` uses.

    Each task passes on so many uses of an object at most, so no list grows with an object's uses. Rows without a role
    count as neither."""
    used = F.col("role") == "use"
    counts = refs.groupBy("object_key").agg(
        F.min(F.struct("seq", "kind"))["kind"].alias("kind"), F.count_if(~used).alias("definitions"), F.count_if(used).alias("uses")
    )
    turn = F.row_number().over(Window.partitionBy("object_key").orderBy("seq"))
    first = refs.where(used).select("object_key", "seq").withColumn("__turn", turn).where(F.col("__turn") <= most)
    first = first.groupBy("object_key").agg(F.array_sort(F.collect_list("seq")).alias("first_uses"))
    none = F.array().cast(first.schema["first_uses"].dataType)
    return counts.join(first, "object_key", "left").withColumn("first_uses", F.coalesce("first_uses", none))


def ambiguous_values(refs: DataFrame, most: int = 80) -> DataFrame:
    """Values that name more than one object: the first ``most`` by value, with their number of objects."""
    n = refs.groupBy("value").agg(F.count_distinct("object_key").alias("objects")).where("objects > 1")
    return n.orderBy("value").limit(most)


def unresolved(uses: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """Uses without a definition, counted by key."""
    return uses.join(definitions.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("uses"))


def lock_split(units: DataFrame, refs: DataFrame, key: str, spare: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, locked): units whose key is referenced are locked, unless ``spare``."""
    locked = units.join(refs.select(key).distinct(), key, "left_semi").where(~spare)
    kept = units.join(refs.select(key).distinct().withColumn("__r", F.lit(True)), key, "left")
    return kept.where(F.col("__r").isNull() | spare).drop("__r"), locked


def leftover(refs: DataFrame, names: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Keys that are both referenced and names, but no unit's."""
    return refs.select(key).intersect(names.select(key)).subtract(units.select(key))


def finalize_names(names: DataFrame, consumed: DataFrame, coverage: DataFrame, key: str) -> DataFrame:
    """``state`` of each name: locked if consumed, unknown while coverage is incomplete, else promoted.

    coverage is one row (complete); it is joined once, not asked for every partition.
    """
    met = names.join(consumed.select(key, F.lit(True).alias("__used")).distinct(), key, "left").crossJoin(F.broadcast(coverage.limit(1)))
    state = F.when(F.col("__used"), "locked").when(~F.col("complete"), "unknown").otherwise("promoted")
    return met.withColumn("state", state).drop("__used", "complete")


def bind(units: DataFrame, refs: DataFrame, value: str) -> DataFrame:
    """unit, object_key and status: bound to its only display key, else to its only match key, else ambiguous or free.

    Keys are counted for each distinct value before units join, so a value of many units is resolved once.
    """
    per = refs.groupBy(value).agg(
        F.collect_set(F.when(F.col("kind") == "display", F.col("object_key"))).alias("d"),
        F.collect_set(F.when(F.col("kind") == "match", F.col("object_key"))).alias("m"),
    )
    one = F.when(F.size("d") == 1, F.element_at("d", 1)).when((F.size("d") == 0) & (F.size("m") == 1), F.element_at("m", 1))
    named = per.select(value, one.alias("object_key"), (F.size("d") > 1).alias("many"))
    met = units.join(named, value, "left")
    status = F.when(F.col("many"), "ambiguous").when(F.col("object_key").isNotNull(), "bound").otherwise("free")
    return met.withColumn("status", status).drop("many")


def define_before_use(log: DataFrame, name: str, seq: str, op: Column) -> DataFrame:
    """Uses with no definition in force before them. op: add, remove or use; a remove undefines the name again."""
    before = Window.partitionBy(name).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(op != "use", op), ignorenulls=True).over(before)
    return log.withColumn("__state", state).where((op == "use") & (F.coalesce("__state", F.lit("remove")) == "remove")).drop("__state")


def set_difference(before: DataFrame, after: DataFrame, missing: int = 20, added: int = 10) -> DataFrame:
    """level, value: what is gone (errors, ``missing`` at most and then one overflow row) and new (warnings, ``added``)."""
    value = before.columns[0]
    # both sides at once, a row a value
    sides = before.select(F.col(value), F.lit(True).alias("__b"), F.lit(False).alias("__a")).unionByName(after.select(F.col(after.columns[0]).alias(value), F.lit(False).alias("__b"), F.lit(True).alias("__a")))
    once = sides.groupBy(value).agg(F.bool_or("__b").alias("__b"), F.bool_or("__a").alias("__a"))
    gone, new = once.where("__b AND NOT __a").select(value), once.where("__a AND NOT __b").select(value)
    shown = gone.orderBy(value).limit(missing).select(F.lit("error").alias("level"), F.col(value).cast("string").alias("value"))
    over = gone.agg(F.count("*").alias("n")).where(F.col("n") > missing)
    over = over.select(F.lit("error").alias("level"), F.concat(F.lit("and "), (F.col("n") - missing).cast("string"), F.lit(" more")).alias("value"))
    extra = new.orderBy(value).limit(added).select(F.lit("warning").alias("level"), F.col(value).cast("string").alias("value"))
    return shown.unionByName(over).unionByName(extra)


def multiset_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, n_a, n_b where the counts differ."""
    na = a.groupBy(key).agg(F.count("*").alias("n_a"))
    nb = b.groupBy(key).agg(F.count("*").alias("n_b"))
    both = na.join(nb, key, "full").select(key, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.where("n_a <> n_b")


def ambiguous_keys(refs: DataFrame, most: int = 80, each: int = 12) -> DataFrame:
    """value, n and keys: values, as they are and without white space at their edges, that name several ids or matched values:
    the first ``most`` by value, with the first ``each`` of their keys (a report's caps)."""
    own = refs.where(F.col("kind").isin("id", "match")).select("value", "object_key")
    both = own.unionByName(own.select(strip(F.col("value")).alias("value"), "object_key")).where("value <> ''").distinct()
    n = both.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").orderBy("value").limit(most)
    turn = F.row_number().over(Window.partitionBy("value").orderBy("object_key"))
    ranked = both.join(n, "value").withColumn("turn", turn).where(F.col("turn") <= each)
    return ranked.groupBy("value", "n").agg(F.array_sort(F.collect_list("object_key")).alias("keys"))


def reference_report(refs: DataFrame, objects: int = 400, values: int = 80) -> tuple[DataFrame, DataFrame]:
    """(entries, locked): a report's ``objects`` first objects with their uses, and its ``values`` first values that are matched.
    Both keep how many there are in all, as ``total``."""
    index = reference_index(refs)
    count = index.agg(F.count("*").alias("total"))
    locked = refs.where("kind = 'match'").select("value").distinct()
    n = locked.agg(F.count("*").alias("total"))
    return (
        index.orderBy("object_key").limit(objects).crossJoin(F.broadcast(count)),
        locked.orderBy("value").limit(values).crossJoin(F.broadcast(n)),
    )
