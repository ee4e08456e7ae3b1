"""What several operators share: exact token rules, held-out folds and batched Arrow functions."""

from __future__ import annotations

import ctypes
import gc
import string
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.slices import cuts, small_batches
from millrace.session import checkpoint_dir

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, a-z and all of 0x80 and above.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_PATTERN = r"[^\x20\x09-\x0D]+"


#: What this Python worker keeps from task to task, by a name: two things at most, of one operator.
_held: dict[object, object] = {}
_lock = threading.Lock()


def held(name: object, make: Callable[[], object]) -> object:
    """A large thing that tasks of one operator share in a Python worker, made where it is missing."""
    with _lock:
        if name not in _held:
            if len(_held) > 1:
                del _held[next(iter(_held))]
            _held[name] = make()
        return _held[name]


def let_go() -> None:
    """Gives what another operator's tasks have left in this Python worker back to the system. Workers serve all stages of a
    session, so it would stand beside whatever the later ones need."""
    with _lock:
        if _held:
            _free()


def _free() -> None:
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def space_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; bytes methods touch ASCII only."""
    return text.encode("utf-8", "replace").lower().split()


def alnum_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split()


def parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches, and the texts of each. Only one slice's texts are Python strings at a time."""
    let_go()
    for b in batches:
        for at, n in cuts(b.column(column)):
            piece = b.slice(at, n)
            yield piece, piece.column(column).to_pylist()


def text_function(returns: str, work: Callable[[list[str | None]], pa.Array], holds: bool = False):
    """A column function over texts. ``work`` turns a list of texts into an Arrow array of as many values; ``holds`` says that it
    keeps something by ``held``."""
    small_batches(SparkSession.active())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not holds:
            let_go()
        for batch in batches:
            out = [work(batch.slice(at, n).to_pylist()) for at, n in cuts(batch)]
            yield pa.concat_arrays(out) if out else work([])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


class Scratch:
    """Tables of one run, written as Parquet into the folder that all executors share: their lineage ends there, and a lost
    executor costs no more than the tasks it ran. A table goes once ``drop`` names it, the others when the session ends."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
        self.made = 0
        self._fs().deleteOnExit(self._path(self.base))

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.base).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None:
                self._fs().delete(self._path(t._scratch), True)
