"""``python -m millrace.cli scan FOLDER`` and ``glossary FILE OUT``: thin verbs over the session API."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.lookup import union_all
from millrace.session import session
from millrace.sources import documents, language, packs


def scan(files: DataFrame) -> DataFrame:
    """All units of a pack's files (path, content): language files, legacy ones, and other JSON documents."""
    is_language = F.col("path").rlike(language.SOURCE_FILE)
    json_units, _ = language.json_units(files)
    other, _ = documents.units(files.where(~is_language))
    columns = ["unit_id", "source_text", "file_path", "format", "locator", "risk", "policy"]
    return union_all([u.select(*columns) for u in (json_units, language.legacy_units(files), other)])


def summary(units: DataFrame) -> dict:
    row = units.agg(
        F.count("*").alias("units"), F.count_if(F.col("risk") == "high").alias("high_risk"), F.array_sort(F.collect_set("file_path")).alias("files")
    ).first()
    return row.asDict()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("scan", help="count the units of a pack").add_argument("input")
    g = verbs.add_parser("glossary", help="read a glossary file into a table")
    g.add_argument("input")
    g.add_argument("output")
    args = parser.parse_args(argv)
    spark = spark or session()
    if args.verb == "scan":
        print(json.dumps(summary(scan(packs.members(packs.folder(spark, args.input)))), ensure_ascii=False))
    else:
        language.glossary(spark, args.input).write.mode("overwrite").parquet(args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
