"""Content packs as tables of files: folders and archives, members of archives in archives included."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVES = (".zip", ".jar", ".mrpack")
FILES = "archives array<string>, path string, content binary, depth int"
#: Archives in archives are opened so deep; deeper ones stay files.
DEPTH = 3


def os_metadata(path: Column) -> Column:
    """Bookkeeping entries of operating systems, which are no content."""
    return path.rlike(r"(^|/)__MACOSX(/|$)|(^|/)\._[^/]*$|(^|/)\.DS_Store$")


def folder(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), content of every file under a folder. Only files that later filters keep are read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    # Spark may write a scheme with one slash or three; what follows the folder's own path is below it
    own = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
    below = F.substring(own, len(re.sub("^([a-z0-9]+):/+", r"\1:/", whole)) + 2, 1 << 20)
    return files.select(below.alias("path"), "content").where(~os_metadata(F.col("path")))


def members(files: DataFrame) -> DataFrame:
    """archives, path, content and depth of all files: archives (path, content) are opened where they lie, one at a time,
    and their members streamed; a file that is no archive stands for itself."""

    def opened(chain: list[str], path: str, content: bytes, depth: int) -> Iterator[tuple]:
        if path.lower().endswith(ARCHIVES) and depth < DEPTH and zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield from opened([*chain, path], info.filename, z.read(info), depth + 1)
        else:
            yield chain, path, content, depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for chain, name, data, depth in opened([], path, content, 0):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chain], pa.list_(pa.string())), pa.array([name]), pa.array([data], pa.binary()), pa.array([depth], pa.int32())],
                        names=["archives", "path", "content", "depth"],
                    )

    out = files.select("path", "content").mapInArrow(run, FILES)
    return out.where(~os_metadata(F.col("path")))


def nested_policy(depth: Column, policy: Column) -> Column:
    """Rows of archives inside archives can't be written back."""
    return F.when(depth >= 2, "UNKNOWN_REVIEW").otherwise(policy)
