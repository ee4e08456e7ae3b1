"""Sinks: stores that are upserted, reports and archives."""

from __future__ import annotations

import html
import json
import os
import re
import sys
import tempfile
import traceback
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import SECRET
from millrace.operators.lookup import first_by


def upsert(store: DataFrame, rows: DataFrame, keys: list[str], evict: DataFrame | None = None) -> DataFrame:
    """The store after rows replaced those of the same keys (the latest ``updated_at`` of equal ones), less ``evict``."""
    new = first_by(rows, list(keys), F.desc("updated_at"))
    out = store.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*store.columns))
    return out.join(evict.select(*keys).distinct(), keys, "left_anti") if evict is not None else out


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A whole table by Spark's commit protocol; readers see the old files or the new ones."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def language_map(existing: DataFrame, units: DataFrame) -> DataFrame:
    """path, key, value and changed: the target language's entries after units (path, key, target) were merged in."""
    new = units.where("target IS NOT NULL").groupBy("path", "key").agg(F.max(F.struct("seq", "target"))["target"].alias("target"))
    met = existing.join(new, ["path", "key"], "full")
    return met.select(
        "path", "key", F.coalesce("target", "value").alias("value"), F.coalesce(F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("value")), F.lit(False)).alias("changed")
    )


def report(units: DataFrame, path: str) -> None:
    """The units as JSON lines, a file for each task."""
    units.write.mode("overwrite").json(path)


def manual_edits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edits, errors) of a JSON lines file: lines that don't parse, or of another version, are errors."""
    schema = "schema_version int, unit_key string, target_text string, status string, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).cache()
    good = F.col("_corrupt_record").isNull() & (F.col("schema_version") == 1) & F.col("unit_key").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return rows.where(good).drop("_corrupt_record"), rows.where(~good).select(F.coalesce("_corrupt_record", F.lit("version")).alias("line"))


def repack(files: list[tuple[str, bytes]], path: str) -> None:
    """One archive from a pack's own files (a driver-side sink: a pack is one file in the end)."""
    skip = ("session.lock",)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in sorted(files):
            if name.rsplit("/", 1)[-1] not in skip and not name.endswith(".backup"):
                z.writestr(name, content)


def put_passages(store: DataFrame, passages: DataFrame, members: DataFrame) -> DataFrame:
    """The passage store after a run: a passage (passage_id, published and the store's columns) is kept if it is published and
    every member (passage_id, written) was written; otherwise it is forgotten. Passages without members count as unwritten."""
    whole = members.groupBy("passage_id").agg(F.bool_and(F.coalesce("written", F.lit(False))).alias("whole"))
    judged = passages.join(whole, "passage_id", "left").withColumn("good", F.col("published") & F.coalesce("whole", F.lit(False)))
    rest = store.join(judged.select("passage_id"), "passage_id", "left_anti")
    return rest.unionByName(judged.where("good").select(*store.columns).dropDuplicates(["passage_id"]))


def append_manual_edit(spark: SparkSession, path: str, edits: DataFrame) -> None:
    """Appends edits (unit_key, source_text, target_text, status) as JSON lines; a ValueError if any has no source text."""
    if not edits.where(F.coalesce(F.trim("source_text"), F.lit("")) == "").isEmpty():
        raise ValueError("an edit has no source text")
    edits.withColumn("schema_version", F.lit(1)).write.mode("append").json(path)


def write_workspace(units: DataFrame, path: str) -> None:
    """Result rows of archives, a partition for each archive, so that one can be republished alone."""
    units.write.mode("overwrite").partitionBy("archive_id").parquet(path)


def write_status(gated: Column, failed: Column, target: Column, source: Column) -> Column:
    """What becomes of a unit's candidate: ``blocked`` by its gate, ``failed`` to be written, ``unchanged`` or ``changed``."""
    return F.when(gated.isNotNull(), "blocked").when(failed.isNotNull(), "failed").when(target.isNull() | (target == source), "unchanged").otherwise("changed")


def routed(units: DataFrame, path: str = "path") -> DataFrame:
    """The units with ``writer``, the first that supports their file, or null."""
    p = F.lower(path)
    forms = (("language", r"(^|/)lang/[^/]+\.json$"), ("legacy", r"(^|/)lang/[^/]+\.lang$"), ("json", r"\.json$"), ("script", r"\.mcfunction$"), ("tags", r"\.(dat|nbt|mca)$"))
    writer = F.when(p.rlike(forms[0][1]), forms[0][0])
    for name, pattern in forms[1:]:
        writer = writer.when(p.rlike(pattern), name)
    return units.withColumn("writer", writer)


#: Rows that a page shows of a report's lists, and of its longest ones.
SHOWN, SHOWN_LONG = 20, 80


def html_report(title: str, tables: dict[str, DataFrame], long: tuple[str, ...] = ()) -> str:
    """A page of tables, each of SHOWN rows at most (SHOWN_LONG of those named ``long``) with the number of all: only these
    rows reach the driver. All texts are escaped."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        most = SHOWN_LONG if name in long else SHOWN
        cell = lambda v, t: f"<{t}>{'' if v is None else html.escape(str(v))}</{t}>"
        rows = "".join("<tr>" + "".join(cell(v, "td") for v in r) + "</tr>" for r in df.limit(most).collect())
        head = "".join(cell(c, "th") for c in df.columns)
        parts.append(f"<h2>{html.escape(name)} ({df.count()})</h2><table><tr>{head}</tr>{rows}</table>")
    return "\n".join(parts)


def write_json(path: str, payload: dict) -> None:
    """A small JSON file (a manifest or a header) that readers see whole: written beside its place and renamed."""
    folder = os.path.dirname(path) or "."
    with tempfile.NamedTemporaryFile("w", dir=folder, suffix=".part", delete=False, encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2)
    os.replace(f.name, path)


def failure_log(path: str, error: BaseException, operation: str) -> str | None:
    """Writes what failed, without secrets, and returns the path; null if the disk refuses."""
    lines = [operation, sys.version, *traceback.format_exception(error)]
    clean = re.sub(SECRET, "<redacted>", "\n".join(lines))
    try:
        with open(path, "w", encoding="utf-8") as f:
            f.write(clean)
    except OSError:
        return None
    return path
