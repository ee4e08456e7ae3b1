"""Sharding by fixed virtual slots.

A record's id and text are hashed into one of a fixed number of slots, so that rows of one id spread like others; a record
that is repeated more than COPIES times goes on to another slot with every COPIES of its rows. Bytes are summed per slot, and a small table maps each slot to a shard so that the shards' bytes are near equal. The map is
stored, a folder for each version; rebalancing edits the newest version and stores the next, and records keep their
slot for good. All of it is DataFrame and SQL functions: the map is made by one ordered fold over the slots,
whose number is a parameter and does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch

SLOTS = 8192
#: So many equal records lie in one slot.
COPIES = 16
#: Bytes a record takes besides its text.
RECORD_BYTES = 16

MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("vslot", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("shard", T.IntegerType()),
    ]
)


def slot_of(key: Column, text_crc: Column, slots: int = SLOTS, part: Column | None = None) -> Column:
    """The record's slot: the first 32 bits of md5 of the key, of its text's crc32 and, of copies beyond the first COPIES, of
    their part, modulo the number of slots. A null key counts as empty."""
    parts = [F.coalesce(key.cast("string"), F.lit("")), text_crc.cast("string")]
    if part is not None:
        parts.append(F.when(part > 0, part.cast("string")))  # a null is left out
    digest = F.md5(F.concat_ws(" ", *parts).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("long")


def text_crc32(text: Column) -> Column:
    """crc32 of the text's UTF-8 bytes, of no bytes for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) and the record's own bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def slotted(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32, part, vslot and n: equal records together, in parts of COPIES at most.

    Equal records are counted before the shuffle, so one that is repeated without end is a row for each task there.
    """
    rows = docs.select(F.col(key).alias("key"), record_size(F.col(text)).alias("size"), text_crc32(F.col(text)).alias("text_crc32"))
    counts = rows.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("n"))
    last = F.floor((F.col("n") - 1) / COPIES)
    parts = counts.select("key", "size", "text_crc32", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    here = F.least(F.col("n") - F.col("part") * COPIES, F.lit(COPIES)).cast("long")
    return parts.select("key", "size", "text_crc32", "part", slot_of(F.col("key"), F.col("text_crc32"), slots, F.col("part")).alias("vslot"), here.alias("n"))


def slot_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """vslot, bytes, rows of every slot that has rows."""
    return sizes_of(slotted(docs, key, text, slots))


def sizes_of(parts: DataFrame) -> DataFrame:
    """The same of ``slotted`` records. Summed before the shuffle, which moves a row for each slot and task at most."""
    return parts.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))


def build_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """The first map: slots from the largest, each to the shard that has the fewest bytes (then the lowest number).

    One row holds all slots while the fold runs; there are at most as many as slots, whatever the data's size.
    An empty table gives an empty map.
    """
    entry = F.struct((-F.col("bytes")).alias("neg"), F.col("vslot"), F.col("rows"))
    ordered = sizes.agg(F.array_sort(F.collect_list(entry)).alias("slots"))
    start = F.struct(
        F.expr(f"transform(sequence(0, {shards - 1}), i -> struct(0L AS load, i AS shard))").alias("loads"),
        F.expr("CAST(array() AS array<int>)").alias("shards"),
    )
    folded = ordered.select(
        "slots",
        F.aggregate(
            "slots",
            start,
            lambda acc, s: F.struct(
                F.transform(
                    acc["loads"],
                    lambda x: F.when(
                        x["shard"] == F.array_min(acc["loads"])["shard"],
                        F.struct((x["load"] - s["neg"]).alias("load"), x["shard"].alias("shard")),
                    ).otherwise(x),
                ).alias("loads"),
                F.concat(acc["shards"], F.array(F.array_min(acc["loads"])["shard"])).alias("shards"),
            ),
            lambda acc: acc["shards"],
        ).alias("shards"),
    )
    pairs = folded.select(F.explode(F.arrays_zip("slots", "shards")).alias("z"))
    return pairs.select(
        F.lit(version).cast("long").alias("version"),
        F.col("z.slots.vslot").alias("vslot"),
        (-F.col("z.slots.neg")).alias("bytes"),
        F.col("z.slots.rows").alias("rows"),
        F.col("z.shards").cast("int").alias("shard"),
    )


def add_shard(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for one more shard: only moves into the new shard.

    Every old shard gives slots of middling size (those nearest its mean first), as many as come nearest its part of the new
    shard's share: about 1 / (shards + 1) of the bytes moves, and of the rows. Slots that stay keep their shard.
    """
    own = slot_map.withColumn("whole", F.expr("sum(bytes) OVER (PARTITION BY shard)")).withColumn("mean", F.expr("avg(bytes) OVER (PARTITION BY shard)"))
    order = "PARTITION BY shard ORDER BY abs(bytes - mean), vslot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    given = F.expr(f"sum(bytes) OVER ({order})") - F.col("bytes") / 2
    return own.select(
        (F.col("version") + 1).alias("version"),
        "vslot",
        "bytes",
        "rows",
        F.when(given * (shards + 1) <= F.col("whole"), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def refreshed(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map with the sizes that slots have now. A slot that had no rows before goes to the shard of its
    number; all others keep theirs."""
    version = slot_map.agg(F.max("version").alias("version"))  # one row
    met = sizes.join(slot_map.select("vslot", "shard"), "vslot", "left").crossJoin(F.broadcast(version))
    shard = F.coalesce("shard", F.pmod(F.col("vslot"), F.lit(shards))).cast("int")
    return met.select((F.col("version") + 1).alias("version"), "vslot", "bytes", "rows", shard.alias("shard"))


def assign(docs: DataFrame, slot_map: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32, vslot, shard, slot and map_version of every record, by a map with the sizes of these records."""
    return placed(slotted(docs, key, text, slots), slot_map).withColumnRenamed("key", key)


def placed(parts: DataFrame, slot_map: DataFrame) -> DataFrame:
    """The same of ``slotted`` records, one row a record again.

    ``slot`` is the record's place within its shard, gapless from 0: the rows of the shard's earlier slots, then its
    place among its own slot's rows (by key, size and hash; equal records in any order). The window runs per virtual
    slot, of which there are thousands, not per shard. Null text has size 16 and the crc32 of no bytes.
    """
    before = F.expr("sum(rows) OVER (PARTITION BY shard ORDER BY vslot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    own = slot_map.select("vslot", "shard", F.col("version").alias("map_version"), F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    earlier = F.expr("sum(n) OVER (PARTITION BY vslot ORDER BY key, size, text_crc32, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    ranked = parts.withColumn("place", F.coalesce(earlier, F.lit(0)))
    joined = ranked.join(F.broadcast(own), "vslot")  # a row for each slot: at most ``slots``
    start = F.col("before") + F.col("place")
    return joined.select("key", "size", "text_crc32", "vslot", "shard", F.explode(F.sequence(start, start + F.col("n") - 1)).alias("slot"), "map_version")


def store_map(slot_map: DataFrame, folder: str) -> int:
    """Writes a map into the folder of its version, which must not exist yet, and returns the version (0 for an empty map,
    which is version 0). The rows are a few thousand, whatever the data."""
    version = slot_map.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v
    slot_map.coalesce(1).write.parquet(f"{folder}/v{version}")
    return version


def stored_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{folder}/v{version}")


def newest_map(spark: SparkSession, folder: str) -> DataFrame | None:
    """The map of the highest version stored in a folder, or null."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    versions = [int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()]
    return stored_map(spark, folder, max(versions)) if versions and max(versions) else None


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, under the law ``bytes``.

    Where ``folder`` (by default one of the session's shared folder) holds no map, the first one is made and stored; else
    the newest is stored again with the sizes of now, and records keep their shards. Either is then edited for one more
    shard and that stored too, and both are read back. ``grown_shard`` is null, as law ``bytes`` has it; ``next_shard`` is
    the shard by the edited map. A folder's later runs go on from the edited map, so they pass its number of shards.

    Also returns vslot and map_version. A null id is a key of its own, rows that repeat an id and text lie in slots by
    COPIES of them, and an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    folder = folder or f"{scratch.base}/maps"
    parts = scratch.keep(slotted(docs, slots=slots))
    sizes, newest = sizes_of(parts), newest_map(spark, folder)
    first = store_map(build_map(sizes, shards) if newest is None else refreshed(newest, sizes, shards), folder)
    slot_map = stored_map(spark, folder, first)
    edited = stored_map(spark, folder, store_map(add_shard(slot_map, shards), folder) if first else first)
    after = edited.select("vslot", F.col("shard").alias("next_shard"))
    return placed(parts, slot_map).join(F.broadcast(after), "vslot").select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "map_version",
        "next_shard",
    )
