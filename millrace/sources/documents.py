"""Any JSON document as a table of its text leaves, and the units among them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.lines import command_starts
from millrace.functions.text import risk, stable_id, translatable
from millrace.operators import policy as P


def escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def walk(value: object, pointer: str = "") -> Iterator[tuple[str, str]]:
    """(pointer, text) of every string below a value, depth first in the document's order."""
    stack = [(pointer, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, str):
            yield at, v
        elif isinstance(v, dict):
            stack += reversed([(f"{at}/{escaped(str(k))}", x) for k, x in v.items()])
        elif isinstance(v, list):
            stack += reversed([(f"{at}/{k}", x) for k, x in enumerate(v)])


def lookup(value: object, pointer: str) -> object:
    """The value at a pointer; a KeyError where there is none."""
    for part in pointer.split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, list) and key.isdigit() and int(key) < len(value):
            value = value[int(key)]
        elif isinstance(value, dict) and key in value:
            value = value[key]
        else:
            raise KeyError(pointer)
    return value


def text_leaves(files: DataFrame) -> DataFrame:
    """path, seq, pointer and value of the strings of all .json files; a file that can't be parsed gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    found = list(walk(json.loads((content or b"").decode("utf-8-sig"))))
                except (ValueError, RecursionError):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(found), pa.string()),
                        pa.array(range(len(found)), pa.int64()),
                        pa.array([p.encode("utf-8", "replace").decode() for p, _ in found], pa.string()),
                        pa.array([v.encode("utf-8", "replace").decode() for _, v in found], pa.string()),
                    ],
                    names=["path", "seq", "pointer", "value"],
                )

    own = files.where(F.lower("path").endswith(".json")).select("path", "content")
    return own.mapInArrow(run, "path string, seq long, pointer string, value string")


def units(files: DataFrame, form: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(units, filtered): text leaves that their pointer's policy lets through and that are language, and all others with
    the reason."""
    how = P.pointer_policy(F.col("pointer"), F.lit("generic-json") if form is None else form)
    rows = text_leaves(files).withColumn("how", how).withColumn("plain", translatable(F.col("value")))
    shown = (F.col("how.policy") == P.DISPLAY) & F.col("plain")
    kept = rows.where(shown).select(
        stable_id(F.col("path"), F.col("pointer"), F.col("value")).alias("unit_id"),
        F.col("value").alias("source_text"),
        F.col("path").alias("file_path"),
        F.lit("generic-json").alias("format"),
        F.col("pointer").alias("locator"),
        F.col("seq"),
        risk(F.col("value"), F.col("pointer")).alias("risk"),
        F.col("how.policy").alias("policy"),
    )
    reason = F.when(F.col("how.policy") != P.DISPLAY, F.col("how.reason")).otherwise("not language")
    return kept, rows.where(~shown).select("path", F.col("pointer").alias("locator"), reason.alias("reason"))


def put(value: object, pointer: str, text: str) -> None:
    """Sets the text at a pointer; a KeyError where there is none."""
    above, _, last = pointer.rpartition("/")
    holder = lookup(value, above)
    key = last.replace("~1", "/").replace("~0", "~")
    if isinstance(holder, list) and key.isdigit() and int(key) < len(holder):
        holder[int(key)] = text
    elif isinstance(holder, dict) and key in holder:
        holder[key] = text
    else:
        raise KeyError(pointer)


def rewritten(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content, changed and error of the .json files that edits (path, pointer, value) name.

    A file whose texts are as they should be keeps its bytes, and so does one of which any edit fails.
    """
    own = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pointer", "value"))).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                content, changed, error = r["content"], 0, None
                try:
                    value = json.loads(content.decode("utf-8-sig"))
                    new = [e for e in r["edits"] if lookup(value, e["pointer"]) != e["value"]]
                    for e in new:
                        put(value, e["pointer"], e["value"])
                    if new:
                        content, changed = json.dumps(value, ensure_ascii=False, indent=2).encode("utf-8", "replace"), len(new)
                except (ValueError, KeyError) as e:
                    error = str(e)
                row = [pa.array([r["path"]]), pa.array([content], pa.binary()), pa.array([changed], pa.int32()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(row, names=["path", "content", "changed", "error"])

    return files.select("path", "content").join(own, "path").mapInArrow(run, "path string, content binary, changed int, error string")


def component_leaves(value: object, pointer: str = "", shown: bool = True) -> Iterator[tuple[str, str, str]]:
    """(pointer, kind, text) of a text component: kind ``text`` for what is shown (text, fallback, and the components below
    extra, with and a hover's contents), ``command`` for what a click runs. Depth first."""
    if isinstance(value, str):
        if shown:
            yield pointer, "text", value
    elif isinstance(value, list):
        for k, x in enumerate(value):
            yield from component_leaves(x, f"{pointer}/{k}", shown)
    elif isinstance(value, dict):
        for key, x in value.items():
            at = f"{pointer}/{escaped(str(key))}"
            if key in ("text", "fallback"):
                yield from component_leaves(x, at, isinstance(x, str))
            elif key in ("extra", "with"):
                yield from component_leaves(x, at)
            elif key in ("hoverEvent", "hover_event") and isinstance(x, dict):
                yield from component_leaves(x.get("contents"), f"{at}/contents")
            elif key in ("clickEvent", "click_event") and isinstance(x, dict) and x.get("action") == "run_command":
                for own in ("value", "command"):
                    if isinstance(x.get(own), str):
                        yield f"{at}/{own}", "command", x[own]


def components(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """key, pointer, kind and text of the leaves of JSON components. A payload that does not parse gives none; a bare JSON
    string is one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, found = [], []
            for k, raw in enumerate(b.column("payload").to_pylist()):
                try:
                    own = list(component_leaves(json.loads(raw or "")))
                except (ValueError, RecursionError):
                    continue
                of += [k] * len(own)
                found += own
            columns = [pa.array([x[i].encode("utf-8", "replace").decode() for x in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(of, pa.int64())), *columns], names=["key", "pointer", "kind", "text"])

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(F.col(key).alias("key"), F.col(payload).alias("payload")).mapInArrow(run, f"key {kind}, pointer string, kind string, text string")
    return found.withColumnRenamed("key", key)


def command_payload(command: Column) -> Column:
    """struct<kind, payload> of what a command shows: ``plain`` for say, ``json`` for tellraw, title and bossbar names, else
    null. A clear only matches and shows nothing."""
    c = F.regexp_replace(F.trim(command), "^/+", "")
    target = r"(?:@[a-z](?:\[[^\]]*\])?|\S+)"
    title = rf"(?is)^title\s+{target}\s+(?:title|subtitle|actionbar)\s+(.*)$"
    forms = ((r"(?is)^say\s+(.*)$", "plain"), (rf"(?is)^tellraw\s+{target}\s+(.*)$", "json"), (title, "json"), (r"(?is)^bossbar\s+(?:add\s+\S+|set\s+\S+\s+name)\s+(.*)$", "json"))
    out = None
    for pattern, kind in forms:
        pair = F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_extract(c, pattern, 1)).alias("payload"))
        out = F.when(c.rlike(pattern), pair) if out is None else out.when(c.rlike(pattern), pair)
    return out


def command_texts(lines: DataFrame, key: str, line: str) -> DataFrame:
    """key, depth (of the nested command), kind, pointer and text of all that commands show, commands behind ``run`` too."""
    nested = lines.select(F.col(key), F.posexplode(command_starts(F.col(line))).alias("depth", "command"))
    # a command that runs another shows what that one shows
    last = nested.where(~F.lower(F.regexp_replace(F.trim("command"), "^/+", "")).startswith("execute "))
    shown = last.withColumn("p", command_payload(F.col("command"))).where("p IS NOT NULL").select(key, "depth", "p.*")
    plain = shown.where("kind = 'plain'").select(key, "depth", "kind", F.lit("").alias("pointer"), F.col("payload").alias("text"))
    row = shown.where("kind = 'json'").select(F.struct(key, "depth").alias("row"), "payload")
    leaves = components(row, "row", "payload").select(f"row.{key}", "row.depth", "kind", "pointer", "text")
    return plain.unionByName(leaves)
