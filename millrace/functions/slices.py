"""Arrow batches of bounded bytes, and slices of them whose texts become Python objects together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow batch are worked on in slices of about so many bytes, so that what a slice makes stays small.
SLICE_BYTES = 2_000_000


#: Bytes of one Arrow batch between the JVM and Python (a batch ends with the row that passes them).
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch's bytes in the session, unless it names a number of bytes itself: with rows alone bounded, 10,000 texts
    of one batch stand several times in an executor's memory, in the JVM's buffers and in Python's."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key).isdigit():  # a session's own number of bytes wins
        spark.conf.set(key, str(BATCH_BYTES))


def cuts(*texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Where to cut arrays of texts of one length: (start, length) of slices of ``most`` bytes at most, or of one row."""
    sizes = sum(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8 for x in texts)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, stop - at
        at = stop


def row_function(returns: str, kind: pa.DataType, work: Callable, most: int = SLICE_BYTES) -> Callable[..., Column]:
    """A column function over one text or several. ``work`` turns a row's texts into a value of the Arrow type ``kind``; what it
    makes of one slice becomes Arrow data before the next slice is read."""
    small_batches(SparkSession.active())

    def made(*columns: pa.Array) -> pa.Array:
        out = [pa.array([work(*row) for row in zip(*(c.slice(at, n).to_pylist() for c in columns), strict=True)], kind) for at, n in cuts(*columns, most=most)]
        return pa.concat_arrays(out) if out else pa.array([], kind)

    def over_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield made(b)

    def over_many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for b in batches:
            yield made(*b)

    over_one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    over_many.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return lambda *texts: F.arrow_udf(over_one if len(texts) == 1 else over_many, returns)(*texts)
