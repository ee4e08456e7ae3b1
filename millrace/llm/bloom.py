"""Bloom filters to keep rows that can't join out of a shuffle. An exact join always follows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let_go

#: Bits of a filter for each key (two are set: one row in 60 that can't join gets through), and the bounds of its size:
#: 8 KB to 16 MB. For more keys than the largest holds there is no filter, and every row is shuffled.
BITS_A_KEY, LEAST, MOST = 16, 1 << 16, 1 << 27


def build(keys: DataFrame, key: str) -> np.ndarray | None:
    """The filter of a column of 64-bit hashes, sized by their number. MOST / 8 bytes reach the driver at most."""
    n = keys.count()
    if n * BITS_A_KEY > MOST:
        return None
    bits = max(LEAST, 1 << (n * BITS_A_KEY - 1).bit_length() if n else 0)
    both = F.array(F.col(key), F.shiftright(F.col(key), 32).bitwiseXOR(F.col(key)))
    at = keys.select(F.explode(both).alias("h")).select(F.pmod("h", F.lit(bits)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy().astype(np.int64)] = got["bits"].to_numpy()
    return out


def hits(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    out = np.ones(len(keys), bool)
    for h in (keys, (keys >> np.int64(32)) ^ keys):
        at = h % np.int64(64 * len(words))
        out &= (words[at >> np.int64(6)] >> (at & np.int64(63)) & np.int64(1)) == 1
    return out


def kept(batches: Iterator[pa.RecordBatch], column: str, words: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The rows whose hash may be in the filter; all where there is none."""
    for b in batches:
        yield b if words is None else b.filter(pa.array(hits(words, b.column(column).to_numpy())))


def may_hold(keys: DataFrame, key: str, column: Column) -> Column:
    """A column: whether a 64-bit hash may be among the keys. Always true where there are too many keys for a filter."""
    made = build(keys, key)
    if made is None:
        return F.lit(True)
    filter_ = keys.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for b in batches:
            yield pa.array(hits(filter_.value, b.to_numpy(zero_copy_only=False).astype(np.int64)))

    return F.arrow_udf(run, "boolean")(column)


def without(docs: DataFrame, gone: DataFrame, key: str, column: Column) -> DataFrame:
    """The rows whose hash is not among the keys of ``gone``: an exact anti join of the few that may be, and all others
    as they lie."""
    held = docs.select(F.struct(*docs.columns).alias("row"), column.alias("h"))
    held = held.withColumn("may", may_hold(gone, key, F.col("h")))
    some = held.where("may").join(gone.select(F.col(key).alias("gone")).distinct(), F.col("h") == F.col("gone"), "left_anti")
    return some.select("row.*").unionByName(held.where("NOT may").select("row.*"))
