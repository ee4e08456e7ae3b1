"""Language files, command scripts and glossaries as unit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import risk, stable_id, translatable

#: Keys that stay as they are (fixed values).
KEPT_PREFIXES = ("argument.id.", "jukebox_song.")
SOURCE_FILE = r"(?i)(^|/)assets/[^/]+/lang/en_us\.(json|lang)$"


def text_of(content: Column) -> Column:
    """UTF-8 text without its byte order mark; null where the bytes are no UTF-8."""
    bare = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")
    return bare


def content_hash(content: Column) -> Column:
    """sha256 of the text with line feeds for line breaks and without byte order mark."""
    return F.sha2(F.regexp_replace(text_of(content), "\r\n", "\n"), 256)


def pairs(files: DataFrame) -> DataFrame:
    """path, key, value of the string entries of JSON language files; numbers and nested values are no text."""
    parsed = files.select("path", F.try_parse_json(text_of(F.col("content"))).alias("v")).where(F.col("v").isNotNull())
    entries = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    text = F.schema_of_variant("value") == "STRING"
    return entries.where(text & F.col("key").isNotNull()).select("path", "key", F.try_variant_get("value", "$", "string").alias("value"))


def json_units(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, filtered): entries of source language files that are language, and entries kept by their key's prefix."""
    p = pairs(files.where(F.col("path").rlike(SOURCE_FILE) & F.lower("path").endswith(".json")))
    kept = F.col("key").rlike("^(" + "|".join(x.replace(".", r"\.") for x in KEPT_PREFIXES) + ")")
    filtered = p.where(kept).select("path", F.col("key").alias("locator"), F.lit("keep_original_prefix").alias("reason"))
    return _units(p.where(~kept), "json-lang", F.col("key"), stable_id(F.col("path"), F.col("key"), F.col("value"))), filtered


def legacy_units(files: DataFrame) -> DataFrame:
    """Units of key=value files: split at the first sign of equality, comments and other lines skipped, lines from 0."""
    own = files.where(F.col("path").rlike(SOURCE_FILE) & F.lower("path").endswith(".lang"))
    lines = own.select("path", F.posexplode(F.split(text_of(F.col("content")), r"\r\n|\n|\r")).alias("n", "line"))
    some = lines.where(~F.ltrim("line").startswith("#") & F.col("line").contains("="))
    split = some.select(
        "path", "n", F.regexp_extract("line", "^([^=]*)=", 1).alias("key"), F.regexp_extract("line", "^[^=]*=([^\n]*)$", 1).alias("value")
    )
    n = F.col("n").cast("string")
    return _units(split, "legacy-lang", n, stable_id(F.col("path"), n, F.col("key"), F.col("value")))


def _units(rows: DataFrame, name: str, locator: Column, unit: Column) -> DataFrame:
    return rows.where(translatable(F.col("value"))).select(
        unit.alias("unit_id"),
        F.col("value").alias("source_text"),
        F.col("path").alias("file_path"),
        F.lit(name).alias("format"),
        locator.alias("locator"),
        F.col("key").alias("context"),
        risk(F.col("value"), F.col("key")).alias("risk"),
        F.lit("TRANSLATABLE_DISPLAY").alias("policy"),
    )


def script_lines(files: DataFrame) -> DataFrame:
    """path, line (from 0) and command of scripts, without blank lines and comments."""
    own = files.where(F.lower("path").endswith(".mcfunction"))
    lines = own.select("path", F.posexplode(F.split(text_of(F.col("content")), r"\r\n|\n|\r")).alias("line", "command"))
    return lines.where((F.trim("command") != "") & ~F.ltrim("command").startswith("#"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """source, target, note, priority (100 unless given) of a .json list, .csv or .tsv file with these columns."""
    suffix = path.rsplit(".", 1)[-1].lower()
    schema = "source string, target string, note string, priority int"
    if suffix == "json":
        rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    elif suffix in ("csv", "tsv"):
        rows = spark.read.option("header", "true").option("sep", "," if suffix == "csv" else "\t").csv(path)
        for c, kind in (("note", "string"), ("priority", "int")):
            rows = rows.withColumn(c, F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind))
    else:
        raise ValueError(f"not a glossary: {path}")
    return rows.select("source", "target", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("priority", F.lit(100)).alias("priority"))


def bilingual(files: DataFrame) -> DataFrame:
    """pack, key, source, target of keys that both languages of a pack fill."""
    p = pairs(files).where(F.col("value") != "")
    pack = F.regexp_extract("path", r"^(.*)/lang/[^/]+\.json$", 1)
    side = lambda name, c: p.where(F.lower("path").endswith(f"/{name}.json")).select(pack.alias("pack"), "key", F.col("value").alias(c))
    return side("en_us", "source").join(side("zh_cn", "target"), ["pack", "key"]).withColumn("priority", F.lit(30))
