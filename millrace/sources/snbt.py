"""Tag structures and lenient JSON inside commands: where each text stands, under which keys, and what it is.

One grammar reads both: objects and lists of values, keys with or without quotes, texts in either quote or bare.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import paths as P
from millrace.sources.documents import component_leaves

TOKEN = re.compile(r"""\s*(?:([{}\[\]:,;])|("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|([^\s{}\[\]:,;"']+))""", re.S)
START = re.compile(r"\{|(?<!\S)\[")
SPANS = "key {key}, keys array<string>, start int, end int, quoted boolean, value string, parsed boolean"


def decoded(literal: str) -> str:
    """The text of a literal: a quoted one without its quotes and with its escaped quotes and backslashes undone."""
    if literal[:1] not in ("'", '"'):
        return literal
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), literal[1:-1], flags=re.S)


def spans(text: str) -> tuple[list[tuple[list[str], int, int, bool]], bool]:
    """(keys, start, end, quoted) of every value that is no object or list, over all structures in a text, and whether all of
    them were read whole. Places in lists are ``[n]``."""
    found: list[tuple[list[str], int, int, bool]] = []
    at, whole = 0, True
    # the brackets of a selector or an item hold no list but name=value, and stand right behind a word
    while (m := START.search(text, at)) is not None:
        start = m.start()
        end, own = _structure(text, start)
        if end is None:
            if text[start] == "{":
                whole = False
            at = start + 1
        else:
            found += own
            at = end
    return found, whole


def _structure(text: str, at: int) -> tuple[int | None, list]:
    """The end of the structure that starts here and its values; None if it is none."""
    found: list = []
    stack: list[list] = []  # kind, key or place, whether a value may follow, whether the key has had its own
    while True:
        m = TOKEN.match(text, at)
        if m is None:
            return None, []
        mark, quoted, bare = m.groups()
        at = m.end()
        if mark in ("{", "["):
            if stack and not stack[-1][2]:
                return None, []
            if stack:
                stack[-1][2:] = [False, True]
            stack.append([mark, None if mark == "{" else 0, mark == "[", False])
        elif mark in ("}", "]"):
            if not stack or (stack[-1][0] == "{") != (mark == "}") or (mark == "}" and stack[-1][1] is not None and not stack[-1][3]):
                return None, []
            stack.pop()
            if not stack:
                return at, found
        elif mark == ":":
            if not stack or stack[-1][0] != "{" or stack[-1][1] is None or stack[-1][2] or stack[-1][3]:
                return None, []
            stack[-1][2] = True
        elif mark == ",":
            if not stack or not stack[-1][3]:
                return None, []
            stack[-1][1:] = [None, False, False] if stack[-1][0] == "{" else [stack[-1][1] + 1, True, False]
        elif mark == ";":  # the type of a number list: [I;1,2]
            if not stack or stack[-1][0] != "[" or stack[-1][1] != 0 or not found or found[-1][3]:
                return None, []
            found.pop()
            stack[-1][2:] = [True, False]
        elif not stack:
            return None, []
        elif stack[-1][0] == "{" and not stack[-1][2]:
            if stack[-1][1] is not None:
                return None, []
            stack[-1][1] = decoded(quoted or bare)
        elif stack[-1][2]:
            keys = [s[1] if s[0] == "{" else f"[{s[1]}]" for s in stack]
            literal = quoted or bare
            found.append((keys, at - len(literal), at, quoted is not None))
            stack[-1][2:] = [False, True]
        else:
            return None, []


def structures(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, keys, start, end, quoted, value and parsed of the values in each text's structures. A text of which a structure can't
    be read gives its other values with ``parsed`` false, and a row without keys if it gives none."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, out = [], []
            for k, raw in enumerate(b.column("text").to_pylist()):
                found, whole = spans(raw) if raw else ([], True)
                own = [(p, a, e, q, decoded(raw[a:e]), whole) for p, a, e, q in found] or ([] if whole else [(None, None, None, None, None, False)])
                of += [k] * len(own)
                out += own
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.list_(pa.string()), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["key", "keys", "start", "end", "quoted", "value", "parsed"],
            )

    found = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, SPANS.format(key=kind))
    return found.withColumnRenamed("key", key)


def decisions(found: DataFrame, consumes: Column) -> DataFrame:
    """The values with ``decision``: ``display`` for texts under display keys, ``mechanism_locked``, ``unknown_mechanism_field`` or
    ``unparsed_mechanism``. ``consumes``: whether the command compares, where display keys hold matched values. Numbers, and
    bare words, are no texts and get none."""
    policy = P.command_policy(F.col("keys"))["policy"]
    text = F.col("quoted") & (F.trim("value") != "")
    decided = (
        F.when(~F.col("parsed"), "unparsed_mechanism")
        .when(~text, None)
        .when(consumes & (policy == "TRANSLATABLE_DISPLAY"), "mechanism_locked")
        .when(policy == "TRANSLATABLE_DISPLAY", "display")
        .when(policy == "UNKNOWN_REVIEW", "unknown_mechanism_field")
        .otherwise("mechanism_locked")
    )
    return found.withColumn("decision", decided)


def opened(value: str) -> list[tuple[str, str]]:
    """(pointer, text) of a display value: the shown leaves of a component that is written as a text, else the text itself."""
    if value.lstrip()[:1] in ("{", "[", '"'):
        try:
            return [(p, t) for p, kind, t in component_leaves(json.loads(value)) if kind == "text"]
        except (ValueError, RecursionError):
            pass
    return [("", value)]


def display_texts(decided: DataFrame, key: str) -> DataFrame:
    """key, keys, start, end, pointer and text of the display values, components opened one level."""
    shown = decided.where("decision = 'display'").select(key, "keys", "start", "end", "value")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([[{"pointer": p, "text": t} for p, t in opened(v)] for v in b.to_pylist()], pa.list_(pa.struct([("pointer", pa.string()), ("text", pa.string())])))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    parts = F.arrow_udf(run, "array<struct<pointer:string,text:string>>")
    return shown.select(key, "keys", "start", "end", F.explode(parts(F.col("value"))).alias("x")).select(key, "keys", "start", "end", "x.pointer", "x.text")
