"""What of a JSON document may not change: its skeleton, and the checks that stand on it."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.lines import command_tokens
from millrace.functions.slices import row_function
from millrace.functions.text import count
from millrace.operators.paths import PAYLOAD_CONTAINERS, PAYLOAD_LEAVES
from millrace.operators.rewrite import same_mechanism

LEAVES, CONTAINERS = frozenset(PAYLOAD_LEAVES), frozenset(PAYLOAD_CONTAINERS)


def shown(keys: list[str]) -> bool:
    """``paths.display_path`` of one chain of keys."""
    own = [k.rsplit(":", 1)[-1].lower() for k in keys]
    above = zip(own[:-1], keys[1:], strict=True)
    return bool(own) and own[-1] in LEAVES and all(n.lower() == "contents" if k in ("hoverevent", "hover_event") else k in CONTAINERS for k, n in above)


def bones(value: object) -> list[tuple[str, str]]:
    """(pointer, JSON of the value) of every leaf and empty container, sorted; texts that are shown are ``*``. A text that holds
    an object or a list is opened, and its keys follow those above it."""
    out, stack = [], [("", [], value)]
    while stack:
        at, keys, v = stack.pop()
        if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
            try:
                v = json.loads(v)
                at += "!"
            except (ValueError, RecursionError):
                pass
        if isinstance(v, dict) and v:
            stack += [(f"{at}/{k}", [*keys, str(k)], x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            stack += [(f"{at}/[{k}]", keys, x) for k, x in enumerate(v)]
        else:
            out.append((at, "*" if isinstance(v, str) and shown(keys) else json.dumps(v)))
    return sorted(out)


def json_skeleton(text: Column) -> Column:
    """A text that two documents share if they differ in shown texts at most; null for what does not parse. Shown are the texts
    at paths that ``paths.display_path`` proves."""

    def one(raw: str | None) -> str | None:
        try:
            return json.dumps(bones(json.loads(raw or "")))
        except (ValueError, RecursionError):
            return None

    return row_function("string", pa.string(), one)(text)


def payload_issue(source: Column, target: Column) -> Column:
    """Why a changed payload breaks its mechanism, or null: it no longer parses, or its skeleton moved."""
    a, b = json_skeleton(source), json_skeleton(target)
    return F.when(b.isNull() & a.isNotNull(), "unparseable").when(~a.eqNullSafe(b), "skeleton")


DIVIDER = r"(?m)^[ \t]*={4,}[ \t]*$"


def layout_issue(source: Column, target: Column) -> Column:
    """Rows of ``====`` must survive as many times, and the number of line breaks."""
    return F.when(count(source, DIVIDER) != count(target, DIVIDER), "divider").when(count(source, "\n") != count(target, "\n"), "line_count")


def command_issue(source: Column, target: Column, payload: str = r"(?s)[\[{].*[\]}]") -> Column:
    """Proof of an embedded command that shows something: the same words around its payload, the same skeleton in it, and the
    same placeholders, codes and addresses in all. Null if it holds."""
    shell = lambda c: command_tokens(F.regexp_replace(c, payload, " "))
    inside = lambda c: F.regexp_extract(c, payload, 0)
    return (
        F.when(shell(source) != shell(target), "shell")
        .when(payload_issue(inside(source), inside(target)).isNotNull(), payload_issue(inside(source), inside(target)))
        .when(~same_mechanism(source, target), "tokens")
    )
