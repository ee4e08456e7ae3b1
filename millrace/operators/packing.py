"""Bounded packing of ordered segments into batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(
    df: DataFrame, key: str, order: str, size: str, most: int = 12, chars: int = 3000, line: str | None = None, gap: int = 4, whole: str | None = None
) -> DataFrame:
    """key, order, batch: a new batch starts where one more segment would pass ``most`` segments or ``chars`` characters.

    ``line``: a column of line numbers; a new batch also starts where more than ``gap`` lines lie between two segments.
    ``whole``: a column that names what is never split (a book's page, a payload); its segments, which follow one another,
    go into one batch even above the budget. A null name is a segment by itself, a null size counts 0, and so does a null
    line as no gap.

    The budget resets at each cut, so no window expresses it. Rows are laid out by key and order and streamed: a
    task holds a counter for one key at a time, never a whole group. A segment above ``chars`` is a batch of its own.
    Rows of one key and order follow each other by name, line and size, so that the result does not depend on how they lie.
    """
    fields = [f for f in df.select(key, order).schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", batch int"
    rows = df.select(
        F.col(key), F.col(order), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size"),
        (F.col(line).cast("long") if line else F.lit(None).cast("long")).alias("__line"), (F.col(whole).cast("string") if whole else F.lit(None).cast("string")).alias("__whole"),
    )
    if whole:
        sums = rows.where("__whole IS NOT NULL").groupBy(key, "__whole").agg(F.count("*").alias("__n"), F.sum("__size").alias("__sum"))
        rows = rows.join(sums, [key, "__whole"], "left")
    else:
        rows = rows.withColumn("__n", F.lit(None).cast("long")).withColumn("__sum", F.lit(None).cast("long"))
    rows = rows.select(key, order, "__size", "__line", "__whole", F.coalesce("__n", F.lit(1)).alias("__n"), F.coalesce("__sum", "__size").alias("__sum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch, n, total, at, held = object(), 0, 0, 0, None, None
        for b in batches:
            out = []
            for k, _, s, here, name, count, need in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != last:
                    last, batch, n, total, at, held = k, 0, 0, 0, None, None
                goes_on = name is not None and name == held
                far = at is not None and here is not None and here - at > gap
                if n and not goes_on and (n + count > most or total + need > chars or far):
                    batch, n, total = batch + 1, 0, 0
                n, total, held = n + 1, total + s, name
                at = at if here is None else here
                out.append(batch)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], names=[key, order, "batch"])

    return rows.repartition(key).sortWithinPartitions(key, order, "__whole", "__line", "__size").mapInArrow(run, schema)
