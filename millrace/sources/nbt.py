"""Binary tag documents and region files as leaf rows."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import paths as P

# Tag ids and their numbers' layouts.
END, BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, BYTES, STRING, LIST, COMPOUND, INTS, LONGS = range(13)
NUMBERS = {BYTE: ">b", SHORT: ">h", INT: ">i", LONG: ">q", FLOAT: ">f", DOUBLE: ">d"}
ITEMS = {BYTES: 1, INTS: 4, LONGS: 8}
LEAVES = "path string, chunk int, keys array<string>, type_id int, value string, error string"


def modified_utf8(raw: bytes) -> str:
    """Text of modified UTF-8: two bytes for NUL, and surrogate pairs of three bytes each."""
    text = raw.replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass")
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Reader:
    """Leaves of one document: strings and numbers, and arrays by their length."""

    def __init__(self, data: bytes):
        self.data, self.at = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data), 0

    def number(self, layout: str):
        (x,) = struct.unpack_from(layout, self.data, self.at)
        self.at += struct.calcsize(layout)
        return x

    def text(self) -> str:
        self.start = self.at
        n = self.number(">H")
        raw = self.data[self.at : self.at + n]
        if len(raw) < n:
            raise ValueError("the document ends within a text")
        self.at += n
        return modified_utf8(raw)

    def leaves(self) -> Iterator[tuple[list[str], int, str]]:
        if self.number(">B") != COMPOUND:
            raise ValueError("the root is no compound")
        self.text()
        yield from self.walk(COMPOUND, [])

    def walk(self, kind: int, keys: list[str]) -> Iterator[tuple[list[str], int, str]]:
        if kind in NUMBERS:
            yield keys, kind, str(self.number(NUMBERS[kind]))
        elif kind == STRING:
            yield keys, kind, self.text()
        elif kind in ITEMS:
            n = self.number(">i")
            self.at += n * ITEMS[kind]
            yield keys, kind, str(n)
        elif kind == LIST:
            item, n = self.number(">B"), self.number(">i")
            for k in range(n):
                yield from self.walk(item, [*keys, str(k)])
        elif kind == COMPOUND:
            while (child := self.number(">B")) != END:
                yield from self.walk(child, [*keys, self.text()])
        else:
            raise ValueError(f"tag {kind} is unknown")


def region_chunks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(index, document) of a region file's filled slots. Slots that are half empty or point outside are errors."""
    if len(data) < 8192:
        raise ValueError("the region is shorter than its header")
    unpack = {1: gzip.decompress, 2: zlib.decompress, 3: bytes}
    for k in range(1024):
        place = int.from_bytes(data[4 * k : 4 * k + 3], "big") * 4096
        sectors = data[4 * k + 3]
        if not place and not sectors:
            continue
        if not place or not sectors or place + 5 > len(data):
            raise ValueError(f"chunk {k} has no valid place")
        n, how = struct.unpack_from(">IB", data, place)
        if n < 1 or 4 + n > sectors * 4096 or place + 4 + n > len(data) or how not in unpack:
            raise ValueError(f"chunk {k} has no valid payload")
        yield k, unpack[how](data[place + 5 : place + 4 + n])


def leaves(files: DataFrame) -> DataFrame:
    """path, chunk, keys, type_id, value of every leaf of .dat, .nbt and .mca files (path, content).

    A file that can't be read gives one row with its error; so does an empty one (``empty``). The caller decides what
    fails: see ``broken_regions``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    if not content:
                        raise ValueError("empty")
                    parts = region_chunks(content) if path.lower().endswith(".mca") else [(None, content)]
                    for chunk, data in parts:
                        rows += [(path, chunk, k, t, v, None) for k, t, v in Reader(data).leaves()]
                except (ValueError, struct.error, OSError, EOFError, zlib.error, IndexError, RecursionError) as e:
                    rows = [(path, None, None, None, None, str(e) or type(e).__name__)]
                kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.string())
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "chunk", "keys", "type_id", "value", "error"]
                )

    own = files.where("lower(path) RLIKE '[.](dat|nbt|mca)$'").select("path", "content")
    return own.mapInArrow(run, LEAVES)


def broken_regions(files: DataFrame, found: DataFrame) -> DataFrame:
    """Region files with a whole header that could not be read: their loss must stop a run."""
    whole = files.where("lower(path) LIKE '%.mca' AND octet_length(content) >= 8192").select("path")
    return found.where("error IS NOT NULL").join(whole, "path", "left_semi").select("path", "error")


def as_modified_utf8(text: str) -> bytes:
    """The encoding that ``modified_utf8`` reads: NUL in two bytes, a surrogate for each half beyond the basic plane."""
    units = text.encode("utf-16-be", "surrogatepass")
    halves = (chr(int.from_bytes(units[k : k + 2], "big")) for k in range(0, len(units), 2))
    return "".join(halves).encode("utf-8", "surrogatepass").replace(b"\x00", b"\xc0\x80")


def with_texts(data: bytes, texts: dict[tuple[str, ...], str]) -> tuple[bytes, int]:
    """A document with texts put at key paths, and how many changed. All other bytes are copied; a path that holds no text is
    a KeyError. A gzip document stays one."""
    reader, spans, met = Reader(data), [], set()
    for keys, kind, value in reader.leaves():
        new = texts.get(tuple(keys)) if kind == STRING else None
        if new is not None:
            met.add(tuple(keys))
            if new != value:
                raw = as_modified_utf8(new)
                spans.append((reader.start, reader.at, struct.pack(">H", len(raw)) + raw))
    if missing := set(texts) - met:
        raise KeyError("/".join(min(missing)))
    out, end = [], 0
    for a, b, raw in spans:
        out += [reader.data[end:a], raw]
        end = b
    body = b"".join([*out, reader.data[end:]])
    packed = gzip.compress(body, mtime=0) if data[:2] == b"\x1f\x8b" else body
    return (packed if spans else data), len(spans)


def with_chunks(data: bytes, documents: dict[int, bytes]) -> bytes:
    """A region file with new documents (zlib) in some slots. Other slots' sectors and all time stamps are copied."""
    head, body, at = bytearray(8192), [], 2
    head[4096:] = data[4096:8192]
    for k in range(1024):
        place, sectors = int.from_bytes(data[4 * k : 4 * k + 3], "big") * 4096, data[4 * k + 3]
        if k in documents:
            packed = zlib.compress(documents[k])
            raw = struct.pack(">IB", len(packed) + 1, 2) + packed
        elif place:
            raw = data[place : place + sectors * 4096]
        else:
            continue
        size = -(-len(raw) // 4096)
        if size > 255:
            raise ValueError(f"chunk {k} is too large for its slot")
        body.append(raw.ljust(size * 4096, b"\0"))
        head[4 * k : 4 * k + 4] = at.to_bytes(3, "big") + bytes([size])
        at += size
    return bytes(head) + b"".join(body)


def rewritten(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content, changed and error of the files (path, content) that edits (path, chunk, keys, value) name.

    A file's edits meet in one row, as its content does. A file of which any edit fails keeps its bytes and has an error.
    Of several edits of one place the last by value is taken.
    """
    own = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk", "keys", "value"))).alias("edits"))

    def new_content(path: str, content: bytes, rows: list[dict]) -> tuple[bytes, int]:
        chunks: dict[int | None, dict] = {}
        for r in rows:
            chunks.setdefault(r["chunk"], {})[tuple(r["keys"])] = r["value"]
        if not path.lower().endswith(".mca"):
            return with_texts(content, chunks[None])
        made, changed, documents = {}, 0, dict(region_chunks(content))
        for k, texts in chunks.items():
            body, n = with_texts(documents[k], texts)
            if n:
                made[k], changed = body, changed + n
        return (with_chunks(content, made) if made else content), changed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                try:
                    content, changed, error = *new_content(r["path"], r["content"], r["edits"]), None
                except (ValueError, KeyError, struct.error, OSError, EOFError, zlib.error, IndexError) as e:
                    content, changed, error = r["content"], 0, str(e) or type(e).__name__
                row = [pa.array([r["path"]]), pa.array([content], pa.binary()), pa.array([changed], pa.int32()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(row, names=["path", "content", "changed", "error"])

    return files.select("path", "content").join(own, "path").mapInArrow(run, "path string, content binary, changed int, error string")


def tag_units(found: DataFrame) -> DataFrame:
    """path, chunk, keys, value, policy and reason of every text leaf, by what its reader sees in it and then by its keys.

    Feedback of commands and authors are matched values, player-shaped and internal names of entities stay, other names wait
    for a scan of all references; a text that its path does not clear is for review. Empty texts are no units.
    """
    texts = found.where((F.col("type_id") == STRING) & (F.trim("value") != ""))
    # places in lists, which the leaves have as numbers
    keys = F.transform("keys", lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    low, value = F.transform("keys", F.lower), F.col("value")
    name = F.element_at(low, -1) == "customname"
    hint = (
        F.when(F.array_contains(low, "lastoutput"), "command_feedback")
        .when(F.array_contains(low, "author"), "author_name")
        .when(P.player_name(keys, value).isNotNull(), "player_name")
        .when(name & P.internal_id(value), "entity_name_preserved")
        .when(name, "unknown_identity")
    )
    structure = F.lower("path").rlike(r"(^|/)structures?/.*\.nbt$")
    decided = P.tag_policy(keys, hint)
    cleared = (decided["policy"] != "TRANSLATABLE_DISPLAY") | P.safe_tag_path(keys, value, structure)
    return texts.select(
        "path", "chunk", "keys", "value",
        F.when(cleared, decided["policy"]).otherwise("UNKNOWN_REVIEW").alias("policy"),
        F.when(cleared, decided["reason"]).otherwise("no safe path").alias("reason"),
    )
