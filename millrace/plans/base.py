"""Registration of queries, and the tables they stand on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text units: seq, source_text, file_path, format, policy and decisions from labels."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    u = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("seq"),
        F.col("text").alias("source_text"),
        F.concat_ws("/", "source", "lang").alias("file_path"),
        F.col("lang").alias("format"),
        F.when(F.col("lang") == "de", "IMMUTABLE_ID").otherwise("TRANSLATABLE_DISPLAY").alias("policy"),
        F.when(F.col("quality") == 0, F.col("text")).when(F.col("quality") == 1, F.concat(F.lit("译 "), F.col("text"))).alias("final_target"),
        F.when((F.col("toxic") == 1) & (F.col("doc_id") % 3 == 0), "failed").when(F.col("doc_id") % 11 == 0, "blocked").alias("writeback"),
        (F.col("doc_id") % 13 == 0).alias("rejected"),
        (F.col("doc_id") % 7 == 0).alias("keep"),
    )
    return u


UNITS = """units AS (
  SELECT doc_id AS seq, text AS source_text, source || '/' || lang AS file_path, lang AS format,
         CASE WHEN lang = 'de' THEN 'IMMUTABLE_ID' ELSE 'TRANSLATABLE_DISPLAY' END AS policy,
         CASE WHEN quality = 0 THEN text WHEN quality = 1 THEN '译 ' || text END AS final_target,
         CASE WHEN toxic = 1 AND doc_id % 3 = 0 THEN 'failed' WHEN doc_id % 11 = 0 THEN 'blocked' END AS writeback,
         doc_id % 13 = 0 AS rejected, doc_id % 7 = 0 AS keep
  FROM documents LEFT JOIN labels USING (doc_id))"""


def _body(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join([str(k), *(quoted(x) for x in r)]) + ")" for k, r in enumerate(rows))


def literals(spark: SparkSession, rows: list[tuple], more: DataFrame | None = None) -> DataFrame:
    """id and the texts a, b of literal rows, as the same VALUES that the SQL has, and the rows of ``more`` behind them."""
    names = ["id", "a", "b"][: len(rows[0]) + 1]
    escaped = _body(rows).replace("\\", "\\\\")
    out = spark.sql(f"SELECT * FROM VALUES {escaped} AS t({', '.join(names)})")
    return out.select(F.col("id").cast("long"), *names[1:]).unionByName(more.select(*names)) if more is not None else out


def values(rows: list[tuple], more: str = "") -> str:
    """The same in SQL; ``more``: a SELECT of the same columns."""
    names = ["id", "a", "b"][: len(rows[0]) + 1]
    return f"(SELECT * FROM (VALUES {_body(rows)}) {'UNION ALL ' + more if more else ''}) AS t({', '.join(names)})"
