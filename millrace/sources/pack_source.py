"""The data source ``pack``: a folder, or an archive with archives in it, as one row a file.

    spark.dataSource.register(PackSource)
    spark.read.format("pack").option("path", "/packs").load().where("path LIKE 'assets/%'")

An archive's directory is read where partitions are planned; its members are opened by tasks, and only those that filters on
path and depth leave (``spark.sql.python.filterPushdown.enabled``). It opens paths of the file system that driver and
executors mount. Where only Spark's own readers reach a store, ``packs.members(packs.folder(...))`` gives the same rows.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from millrace.sources.packs import ARCHIVES, DEPTH, FILES

BOOKKEEPING = re.compile(r"(^|/)__MACOSX(/|$)|(^|/)\._[^/]*$|(^|/)\.DS_Store$")
#: Bytes (unpacked) that one task is given at least, by default; a larger member is a task of its own.
TASK_BYTES = 8 << 20


class Share(InputPartition):
    """What one task reads: files of a folder, or members of one archive."""

    def __init__(self, file: str, under: str, members: list[str]):
        self.file, self.under, self.members = file, under, members


def is_archive(name: str) -> bool:
    return name.lower().endswith(ARCHIVES)


class PackSource(DataSource):
    """Options: ``path``; ``taskBytes`` (1: a task for each member); ``depth``, how many archives deep is looked."""

    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> PackReader:
        return PackReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)), int(self.options.get("depth", DEPTH)))


class PackReader(DataSourceReader):
    def __init__(self, root: str, task_bytes: int, depth: int):
        self.root, self.task_bytes, self.depth = re.sub("^file:/*", "/", root), max(1, task_bytes), depth
        self.paths: list[tuple[str, tuple]] = []
        self.depths: list[frozenset[int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of path and equalities of depth; gives all others back to Spark."""
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "holds"}
        for f in filters:
            kind, on = kinds.get(type(f)), getattr(f, "attribute", None)
            if kind and on == ("path",):
                self.paths.append((kind, tuple(f.value) if kind == "in" else (f.value,)))
            elif kind in ("is", "in") and on == ("depth",):
                self.depths.append(frozenset(f.value if kind == "in" else [f.value]))
            else:
                yield f

    def wanted(self, path: str, depth: int) -> bool:
        tests: dict[str, Callable[[str], bool]] = {"is": path.__eq__, "in": path.__eq__, "starts": path.startswith, "ends": path.endswith, "holds": path.__contains__}
        return not BOOKKEEPING.search(path) and all(depth in d for d in self.depths) and all(any(map(tests[kind], values)) for kind, values in self.paths)

    def leads(self, name: str, depth: int) -> bool:
        """Whether a file may give rows: it is wanted, or an archive that is opened."""
        return not BOOKKEEPING.search(name) and (self.wanted(name, depth) if not is_archive(name) or depth >= self.depth else True)

    def partitions(self) -> list[Share]:
        if os.path.isfile(self.root):
            if not is_archive(self.root):
                raise ValueError(f"neither a folder nor an archive: {self.root}")
            return self.shares(self.root, "")
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        out, plain, size = [], [], 0
        for at, folders, names in os.walk(self.root):
            folders.sort()
            for name in sorted(names):
                own = os.path.join(at, name)
                below = os.path.relpath(own, self.root).replace(os.sep, "/")
                if not self.leads(below, 0):
                    continue
                if is_archive(name) and self.depth > 0 and zipfile.is_zipfile(own):
                    out += self.shares(own, below)
                    continue
                if not self.wanted(below, 0):
                    continue
                plain.append(below)
                size += os.path.getsize(own)
                if size >= self.task_bytes:
                    out, plain, size = [*out, Share("", "", plain)], [], 0
        return [*out, Share("", "", plain)] if plain else out or [Share("", "", [])]

    def shares(self, file: str, under: str) -> list[Share]:
        """The members of one archive that may give rows, as they lie in it, in shares of task_bytes."""
        out, own, size = [], [], 0
        with zipfile.ZipFile(file) as z:
            for info in z.infolist():
                if info.is_dir() or not self.leads(info.filename, 1):
                    continue
                own.append(info.filename)
                size += info.file_size
                if size >= self.task_bytes:
                    out, own, size = [*out, Share(file, under, own)], [], 0
        return [*out, Share(file, under, own)] if own or not out else out

    def opened(self, chain: list[str], path: str, content: bytes, depth: int) -> Iterator[tuple[list[str], str, bytes, int]]:
        if is_archive(path) and depth < self.depth and zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if not info.is_dir() and self.leads(info.filename, depth + 1):
                        yield from self.opened([*chain, path], info.filename, z.read(info), depth + 1)
        elif self.wanted(path, depth):
            yield chain, path, content, depth

    def files(self, share: Share) -> Iterator[tuple[list[str], str, bytes, int]]:
        if not share.file:
            for below in share.members:
                with open(os.path.join(self.root, below), "rb") as f:
                    yield [], below, f.read(), 0
            return
        with zipfile.ZipFile(share.file) as z:
            for name in share.members:
                yield [share.under or os.path.basename(share.file)], name, z.read(name), 1

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        kinds = (pa.list_(pa.string()), pa.string(), pa.binary(), pa.int32())
        for start in self.files(share):
            for row in self.opened(*start):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["archives", "path", "content", "depth"])
