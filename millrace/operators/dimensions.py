"""Small tables that units are judged by: term pairs, reviewed decisions, allow-lists, fonts, locales and glossaries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import CJK, strip


def term_pairs(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, source, target and fault of two languages' entries: ``left only`` or ``right only`` where one side is missing or
    blank, null for a pair. Keys blank on both sides, or null, are no entries."""
    side = lambda df, name: df.where(F.col(key).isNotNull() & (strip(F.col(text)) != "")).select(key, F.col(text).alias(name))
    met = side(left, "source").join(side(right, "target"), key, "full")
    fault = F.when(F.col("target").isNull(), "left only").when(F.col("source").isNull(), "right only")
    return met.select(key, "source", "target", fault.alias("fault"))


def newest_decisions(reports: DataFrame, scope: str, order: list[str], keep: Column) -> DataFrame:
    """The kept rows of each scope's newest report (by ``order``, which names a report). The newest counts even if nothing of
    it is kept: an empty newer report revokes an older one."""
    newest = reports.groupBy(scope).agg(F.max(F.struct(*order)).alias("newest"))
    return reports.join(newest, scope).where(F.struct(*order) == F.col("newest")).where(keep).drop("newest")


def allow_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reviewed table of JSON lines. A file that is missing grants nothing, and so does a line that does not parse or lacks
    a field."""
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return reduce(lambda df, c: df.where(F.col(c).isNotNull()), rows.columns, rows)


def name_config(spark: SparkSession, path: str, form: str, fingerprint: str) -> DataFrame:
    """source and target of a configuration of names; a ValueError if it is of another form or bound to another input."""
    row = spark.read.option("multiLine", "true").schema("format string, input_fingerprint string, names map<string,string>").json(path).first()
    if row is None or row.format != form:
        raise ValueError("no configuration of names")
    if row.input_fingerprint and row.input_fingerprint != fingerprint:
        raise ValueError("the names are bound to another input")
    return spark.createDataFrame(sorted((row.names or {}).items()), "source string, target string")


def without_files(units: DataFrame, covered: DataFrame, file: str) -> DataFrame:
    """Units of files that are not covered as a whole."""
    return units.join(covered.select(file).distinct(), file, "left_anti")


def display_candidates(units: DataFrame, object_: str, target: str, most: int = 80, each: int = 12) -> DataFrame:
    """Objects with several different targets: how many, and the first ``each`` in order. Of the objects the first ``most``:
    a report's cap. Targets are ranked before any list is made, so a list is never longer than ``each``."""
    pairs = units.where(F.col(target).isNotNull() & (F.col(target) != "")).select(object_, target).distinct()
    w = Window.partitionBy(object_)
    ranked = pairs.withColumn("k", F.row_number().over(w.orderBy(target)))
    listed = F.array_sort(F.collect_list(F.when(F.col("k") <= each, F.col(target))))
    return ranked.groupBy(object_).agg(F.count("*").alias("n"), listed.alias("targets")).where("n > 1").orderBy(object_).limit(most)


def font_overrides(fonts: DataFrame, font: str, text: str, restyle: int = 512) -> DataFrame:
    """font and character of what fonts draw themselves, from U+00A0 on. A font of more than ``restyle`` Chinese characters
    is a restyling and overrides nothing."""
    chars = fonts.select(font, F.explode(F.array_distinct(F.split(text, ""))).alias("character")).where(F.col("character") >= " ").distinct()
    heavy = chars.groupBy(font).agg(F.count_if(F.col("character").rlike(CJK)).alias("n")).where(F.col("n") > restyle).select(font)
    return chars.join(heavy, font, "left_anti")


def locale_counts(paths: DataFrame, path: str) -> DataFrame:
    """locale and files of the language files among paths, in any case."""
    locale = F.regexp_extract(F.lower(path), r"(?:^|/)lang/([a-z]{2,3}_[a-z]{2,4})\.(?:json|lang)$", 1)
    return paths.select(locale.alias("locale")).where("locale <> ''").groupBy("locale").agg(F.count("*").alias("files"))


def official_gate(candidates: DataFrame, official: DataFrame, key: str) -> DataFrame:
    """The candidates (key, source, target) with ``reason``: an official entry of the key must be met exactly where its source
    is the candidate's."""
    terms = official.select(key, F.col("source").alias("official_source"), F.col("target").alias("official_target"))
    met = candidates.join(terms, key, "left")
    own = F.col("official_source") == F.col("source")
    return met.withColumn("reason", F.when(own & (F.col("official_target") != F.col("target")), "official_term")).drop("official_source", "official_target")


def _in_order(terms: list[tuple]) -> list[tuple]:
    """(term, priority, ...) by falling priority, then length."""
    return sorted({t for t in terms if t[0]}, key=lambda t: (-t[1], -len(t[0]), t[0]))


def masked_terms(text: Column, terms: list[tuple[str, int]]) -> Column:
    """struct<text, first>: the text with each term (term, priority) as ``{termN}``, terms of the highest priority and then the
    longest first. Latin terms are whole words. N counts the terms in that order from ``first``: 1, or 1001 where the text
    has such marks itself.

    The terms are a reviewed glossary's, a plan of one replacement each: some hundreds at most."""
    first = F.when(text.rlike(r"\{term\d+\}"), 1001).otherwise(1)
    out = text
    for k, (term, _) in enumerate(_in_order(terms)):
        edge = r"(?<![A-Za-z0-9_{{])(?:{})(?![A-Za-z0-9_}}])" if re.fullmatch(r"[A-Za-z0-9_'\- ]+", term) else "(?:{})"
        pattern = edge.format(re.sub(r"([^\w\s])", r"\\\1", term))
        out = F.regexp_replace(out, F.lit(pattern), F.concat(F.lit("{term"), (first + k).cast("string"), F.lit("}")))
    return F.struct(out.alias("text"), first.alias("first"))


def unmasked_terms(masked: Column, terms: list[tuple[str, int, str]]) -> Column:
    """What ``masked_terms`` made, with the targets of terms (term, priority, target) in their places."""
    out = masked["text"]
    for k, (_, _, target) in enumerate(_in_order(terms)):
        out = F.replace(out, F.concat(F.lit("{term"), (masked["first"] + k).cast("string"), F.lit("}")), F.lit(target))
    return out
